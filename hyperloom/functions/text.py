"""String functions as Column expressions; everything stays inside the JVM.

All of them give null for null unless they say otherwise, and none of them looks at a prefix of the text only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at both ends, of any Unicode kind (trim removes blanks only).
_ENDS = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, _ENDS, "")


def non_blank(c: Column) -> Column:
    """Null for blank text, else the text as it is."""
    return F.when(strip(c) != "", c)


def tokens(c: Column) -> Column:
    """Distinct runs of a-z in the lower-case text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))


def keywords(c: Column, longer_than: int = 2) -> Column:
    """Tokens of more than ``longer_than`` letters."""
    return F.filter(tokens(c), lambda t: F.length(t) > longer_than)


def word_count(c: Column) -> Column:
    """Number of runs of anything but white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")), F.lit(0))


def strip_reasoning(c: Column) -> Column:
    """Without the first <reasoning> block and outer white space; an unclosed tag stays. '' for null."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), "(?is)^(.*?)<reasoning>.*?</reasoning>", "$1"))


def reasoning(c: Column) -> Column:
    """Content of the first <reasoning> block; '' where there is none or it is not closed."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?is)<reasoning>\s*(.*?)\s*</reasoning>", 1)


def strip_code_fence(c: Column) -> Column:
    """Without a code fence around the text."""
    inner = F.regexp_replace(strip(c), r"(?i)^```(?:json)?\s*", "")
    return F.regexp_replace(inner, r"\s*```$", "")


def first_question(c: Column, after: int = 50) -> Column:
    """The text up to its last question mark within ``after`` characters of the first, stripped; as it is without one."""
    at = F.instr(c, "?")
    head = strip(F.substring(c, F.lit(1), at + F.lit(after - 1)))
    cut = F.length(head) - F.instr(F.reverse(head), "?") + 1
    return F.when(at == 0, c).otherwise(strip(F.substring(head, F.lit(1), cut)))


#: Marks of a chat model's output, and rewrites of its markup in their order.
END_MARK, HEADER_MARK, BEGIN_MARK = "<|eot_id|>", "<|end_header_id|>", "<|begin_of_text|>"
REWRITES = (
    (r"\\\(|\\\)", ""),
    (r"\\text\{([^}]+)\}", "$1"),
    (r"\\[a-zA-Z]+\{([^}]+)\}", "$1"),
    (r"\\[a-zA-Z]+", ""),
    (r"\{|\}", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"(?U)#+\s*", ""),
    (r"\\(?![a-zA-Z0-9/])", ""),
)


def clean_generation(c: Column) -> Column:
    """What a model wrote, without header and end marks, commands and braces, emphasis, code and heading signs.

    The text ends at the first end mark and begins after the last header mark.
    """
    x = F.substring_index(F.substring_index(F.substring_index(c, END_MARK, 1), HEADER_MARK, -1), BEGIN_MARK, -1)
    x = strip(x)
    for pattern, to in REWRITES:
        x = F.regexp_replace(x, pattern, to)
    return strip(x)


def preview(c: Column, chars: int = 100) -> Column:
    """The first ``chars`` characters on one line, with an ellipsis where more follows. This is a display function."""
    return F.concat(F.translate(F.left(c, F.lit(chars)), "\n", " "), F.when(F.length(c) > chars, "…").otherwise(""))


def first_text_block(blocks: Column) -> Column:
    """The first block of a list of texts that is not blank, without outer white space."""
    return F.get(F.filter(F.transform(blocks, strip), lambda b: b != ""), F.lit(0))


def prefers_completion_budget(model: Column) -> Column:
    """Whether a model's name belongs to a family whose budget counts completion tokens."""
    # Families, by the beginning of the name.
    return F.lower(strip(model)).rlike("^(?:gpt-5|o1|o3|o4)")


def numbered_trace(path: Column, header: Column | None = None) -> Column:
    """One numbered line for each step of a solution path: output, formula, inputs, domain."""
    line = lambda e, i: F.format_string("  %d. %s = %s  [uses: %s]  (%s)", i + 1, e["output"], e["label"], F.array_join(e["inputs"], ", "), e["domain"])
    lines = F.array_join(F.transform(path, line), "\n")
    return F.concat_ws("\n", header, lines) if header is not None else lines


def chat_messages(system: Column, user: Column, assistant: Column) -> Column:
    """Messages of a supervised chat example; blank ones are left out."""
    roles = F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", user), ("assistant", assistant))))
    return F.filter(roles, lambda m: F.coalesce(strip(m["content"]), F.lit("")) != "")


def chat_text(system: Column, user: Column, assistant: Column) -> Column:
    """The same example as one text, for models without a chat template."""
    return F.concat(system, F.lit("\n\nUser: "), user, F.lit("\n\nAssistant: "), assistant)


def formula_names(formula: Column) -> Column:
    """Distinct identifiers of a formula that are neither functions, constants nor keywords."""
    # Functions, constants and words of the formula language.
    known = (
        "math", "abs", "sqrt", "sin", "cos", "tan", "exp", "log", "log10", "pi", "e", "and", "or", "not", "if", "else", "for",
        "while", "def", "import", "from", "as", "in", "is", "None", "True", "False",
    )
    return F.array_except(F.array_distinct(F.regexp_extract_all(formula, F.lit(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b"), F.lit(0))), F.array(*map(F.lit, known)))
