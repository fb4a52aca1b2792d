"""Problem 5: broken prompt and response pairs.

A pair is a first text (what was asked) and a second (what came of it); a defective second text is reported with the
first defect that applies, in the order of ``DEFECTS``.

Method: the languages of both texts are compared by the posteriors of a character n-gram naive Bayes, fitted on a
bounded sample of pages with a language label; a text that breaks off is found by the likelihood that a text ends
after its last words, from n-gram counts over the ends and the insides of all texts, in which the names of quantities
and all numbers are masked; a text that ends inside a name breaks off. A refusal is found by a word n-gram naive Bayes of
its last sentences, fitted on a bounded sample of texts that fixed wordings label; a copy by the likelihood of the share of
its word pairs that the first text has, under a mixture fitted to the shares of all pairs. Only the empty texts are told
by a rule.

Ends and insides are counted exactly: the ends of all different texts are grouped, the runs of words inside texts are
kept where some text ends on them, and both are joined by their hashes. A text counts once, however often it is
repeated, and the ends of texts with another defect do not count.

Defined results: a null first text is an empty one, a null second text is empty; repeated rows are reported each; empty
tables give no rows, and without pages labelled as English no text is foreign; without a text in the sample that the
fixed wordings meet there are no refusals, and without a text of a share of ``COPIES_FROM`` none below it is a copy; extra
columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hyperloom.dist import SharedTable, read_table, shared_table, sized_join, spread, uniform_hash

DEFECTS = ("empty", "refusal", "copy", "language", "truncated")

#: Labelled pages per language that the language model is fitted on, and the letters of a gram.
LANGUAGE_ROWS, GRAM = 250, 3
#: Pairs that the refusal model is fitted on; weight of the common rate against counts; most of one gram; least odds.
REFUSAL_ROWS, REFUSAL_PRIOR, REFUSAL_MOST, REFUSAL_ODDS = 50_000, 4.0, 4.0, 12.0
#: Words of context for the end of a text.
CONTEXT = (4, 3, 2)
#: Least likelihood of an end, weight of the shorter context against counts, and the share of the times that words go on
#: which counts against an end right after the next word: texts cut in a word share their last letters, too.
END_LIKELY, BACKOFF, GOES_ON = 0.5, 10.0, 0.03
#: Bins of the histogram of copied shares; the share from which the fit takes a text for a copy at first, and those between
#: which it takes it for one that quotes; least and most steepness of the copies' fall; least likelihood and least share of a copy.
SHARES, COPIES_FROM, QUOTES, STEEP, COPY_LIKELY, COPY_LEAST = 200, 0.9, (0.4, 0.7), (5.0, 60.0), 0.1, 0.65
#: Runs of words whose hashes are gathered before equal ones are counted together.
GATHERED = 2_000_000
#: Least log odds against English from which a text counts as foreign; fewest words judged, unless in another script.
FOREIGN_ODDS, FOREIGN_WORDS = 4.0, 6

#: Runs of letters and digits; signs of scripts without blanks stand apart from those of others.
WORDS = re.compile(r"[^\W_\u2e80-\U0003ffff]+|(?:(?![\W_])[\u2e80-\U0003ffff])+")
PLAIN_WORDS = re.compile("[a-z0-9]+")
TAGS = re.compile(r"(?i)</?\s*[a-z][a-z0-9 _-]{0,30}/?>")
FENCE = re.compile(r"(?i)```[a-z]*")
QUESTION = re.compile(r'"question"\s*:\s*"((?:[^"\\]|\\.)*)', re.S)
QUOTES_IN, CLOSED = frozenset('"“«„'), frozenset(".!?")
QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]')
SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"'”»)\]}]*\s+|\n+|(?<=[。！？])")
INVISIBLE = re.compile("[​-‏⁠-⁤﻿­᠎]")

#: Words that stand for nothing when they are all there is.
NOTHING = frozenset("null none nil nan na n a empty blank undefined tbd tba todo nothing missing reasoning question answer think thinking output response difficulty json chain of thought".split())

#: Wordings of a refusal that label the sample for the model; no text is judged by them.
REFUSAL = re.compile(
    r"\b(?:"
    r"i(?: a|')m (?:sorry|afraid|unable|not (?:able|permitted|allowed|comfortable|in a position|going to)|in no position|going to pass|prevented|barred)"
    r"|i (?:cannot|can ?not|can't|won't|will not|would not|wouldn't|could not|must not|mustn't|may not|shall not|should not|do not|don't) (?!see\b)(?:in good conscience|be able|help|assist|answer|respond|reply|continue|comply|discuss|provide|produce|write|give|work|reason|lay|comment|engage|fulfil|do|go|take|offer|share|support|feel|think|proceed|create|generate|say)"
    r"|i (?:must|have to|need to|am obliged to|am forced to|choose to|wish to|prefer to|politely|respectfully|will)? ?(?:decline|refuse|abstain|refrain|pass|say no|turn this down)\b"
    r"|i(?: would|'d) (?:rather|prefer) not|i stay out|i have been (?:told|instructed|asked) (?:never|not)|i am (?:not|no longer) (?:able|permitted|allowed|in)"
    r"|(?:there is )?no way i (?:could|can)|not possible for me|(?:not|no) something (?:for me|i)|something i am not|as an? (?:\w+ ){0,2}(?:assistant|model|system|ai)\b"
    r"|(?:my|the|our) (?:\w+ )?(?:guidelines?|polic(?:y|ies)|rules|instructions|terms) (?:keeps?|forbids?|prevents?|prohibits?|stops?|does? not|do not|leaves?|rules? out)"
    r"|my answer (?:has to be|is|must be) no|no (?:reply|answer|response) (?:can|will|may|is)|(?:assistant|model|system) (?:declines|refuses|abstains|cannot|will not)"
    r"|request (?:refused|denied|declined|rejected|blocked)|(?:request|prompt|question|content|answer|reply|topic|task|this) (?:was|is|has been|were|falls|lies|goes) (?:\w+ )?(?:blocked|withheld|refused|denied|declined|rejected|outside|beyond|off limits|not allowed|removed|censored)"
    r"|withheld by|content not allowed|(?:against|violates?|violate) (?:the|our|my) (?:\w+ )?(?:terms|policy|policies|rules|guidelines)|off limits|we do not (?:discuss|answer|help|provide)|not (?:a thing|to be|something) (?:to be )?answered"
    r"|(?:sorry(?! state)|apologies|apologise|apologize|regrettably|unfortunately)\b.{0,40}\b(?:i|we|me|no|not|refuse|unable|cannot|can't)\b"
    r"|ask (?:a human|someone|somebody|another|an expert)|please (?:look elsewhere|ask something else|consult)"
    r")"
)


def words_in(text: str) -> list[str]:
    """Words of a text in lower case; ASCII texts need only the short pattern."""
    low = text.lower()
    return PLAIN_WORDS.findall(low) if low.isascii() else WORDS.findall(low)


def unwrap(text: str) -> str:
    """The text without tags, fences, invisible characters and a JSON wrapper around its question."""
    text = INVISIBLE.sub("", text)
    if '"question"' in text and (m := QUESTION.search(text)):
        text = m.group(1)
        text = text.rstrip("\\") if len(text) - len(text.rstrip("\\")) % 2 else text
        try:
            text = json.loads(f'"{text}"', strict=False)
        except ValueError:
            text = text.replace("\\n", "\n").replace('\\"', '"')
    return FENCE.sub("\n", TAGS.sub("\n", text)).strip()


def name_words(name: str | None) -> tuple[str, ...]:
    """The words of a quantity's name, by underscores, blanks and changes to upper case."""
    return tuple(WORDS.findall(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name).lower())) if name else ()


class Names:
    """Names of quantities as word tuples by their first word: a vocabulary and what a pair adds to it."""

    def __init__(self, vocabulary: list[str]) -> None:
        self.by_first: dict[str, list[tuple[str, ...]]] = {}
        self.words_of: dict[str, tuple[str, ...]] = {}
        self.known: set[tuple[str, ...]] = set()
        self.parts = {w for v in vocabulary for w in name_words(v)}
        self.starts: set[tuple[str, ...]] = set()
        for v in vocabulary:
            self.known |= self._add(name_words(v))

    def _add(self, n: tuple[str, ...]) -> set[tuple[str, ...]]:
        if not n or n in self.known:
            return set()
        same = self.by_first.setdefault(n[0], [])
        if n not in same:
            same.append(n)
            same.sort(key=len, reverse=True)
        self.starts |= {n[:k] for k in range(1, len(n))}
        return {n}

    def own(self, names: list[str | None]) -> list[tuple[str, ...]]:
        """Adds the names of one pair that the vocabulary lacks; to be given back to ``forget``."""
        new = []
        for name in names:
            if name:
                n = self.words_of.get(name)
                if n is None:
                    if len(self.words_of) > 100_000:
                        self.words_of.clear()
                    n = self.words_of[name] = name_words(name)
                if len(n) > 1 and n not in self.known and n not in self.by_first.get(n[0], ()):
                    self.by_first.setdefault(n[0], []).insert(0, n)
                    new.append(n)
        return new

    def forget(self, new: list[tuple[str, ...]]) -> None:
        for n in new:
            self.by_first[n[0]].remove(n)

    def mask(self, words: list[str]) -> list[str]:
        """Words with names as V and whatever has a digit as #; runs of # are one. A cut name at the end is P."""
        out, i, n, by_first = [], 0, len(words), self.by_first
        while i < n:
            w = words[i]
            if w in by_first:
                for name in by_first[w]:
                    k = len(name)
                    if words[i + k - 1 : i + k] == [name[-1]] and tuple(words[i : i + k]) == name:
                        out.append("V")
                        i += k
                        break
                else:
                    if n - i < 6 and tuple(words[i:]) in self.starts:
                        out.append("P")
                        return out
                    out.append(w)
                    i += 1
            else:
                if w.isalpha():
                    out.append(w)
                elif not out or out[-1] != "#":
                    out.append("#")
                i += 1
        return out


def is_empty(text: str) -> bool:
    return all(w in NOTHING for w in words_in(text))


def last_sentences(text: str, names: Names) -> Iterator[tuple[str, list[str]]]:
    """The sentences of a text from its end, each with its masked words; what stands in quotation marks is not counted."""
    low = text.lower().replace("’", "'")
    for s in reversed(SENTENCE.split(QUOTED.sub(" ", low) if not QUOTES_IN.isdisjoint(low) else low)):
        masked = names.mask(words_in(s))
        if masked:
            yield s, masked


def labelled(text: str, names: Names) -> list[str] | None:
    """The sentence that the fixed wordings take for a refusal: it declines and stands in the tail without names."""
    for s, masked in last_sentences(text, names):
        m = REFUSAL.search(s)
        if m and (m.start() < 30 or "V" not in masked):
            return masked
        if "V" in masked:
            return None
    return None


def grams(masked: list[str]) -> set[str]:
    """Words of a sentence and pairs of them, its beginning and end included."""
    ends = ["^", *masked, "$"]
    return {*masked, *map(" ".join, zip(ends, ends[1:]))}


class Refusals:
    """Naive Bayes over the grams of a sentence, refusing or not; counts are smoothed towards a gram's common rate."""

    def __init__(self, counts: dict[str, tuple[int, int]]) -> None:
        yes, no = counts.get("", (0, 0))
        self.odds: dict[str, float] = {}
        k = REFUSAL_PRIOR
        for g, (p, n) in counts.items():
            if g and yes:
                q = k * (p + n) / (yes + no)
                self.odds[g] = max(-REFUSAL_MOST, min(REFUSAL_MOST, math.log((p + q) / (yes + k)) - math.log((n + q) / (no + k))))

    def is_refusal(self, text: str, names: Names) -> bool:
        """Whether one of the last sentences declines, up to the first, from the end, that has a name and does not.

        One or two words without a closing sign may be the beginning of a sentence that breaks off, and tell nothing.
        """
        if not self.odds:
            return False
        odds = self.odds.get
        for s, masked in last_sentences(text, names):
            if (len(masked) > 2 or s.rstrip()[-1:] in CLOSED) and sum(odds(g, 0.0) for g in grams(masked)) >= REFUSAL_ODDS:
                return True
            if "V" in masked:
                return False
        return False


def _count_grams(batches: Iterator[pa.RecordBatch], vocabulary: list[str]) -> Iterator[pa.RecordBatch]:
    """(gram, refusing sentences, others) of labelled texts; columns names, second. The gram '' counts the sentences."""
    names, yes, no = Names(vocabulary), Counter(), Counter()
    for batch in batches:
        for named, text in zip(*(c.to_pylist() for c in batch.columns)):
            text = unwrap(text)
            new = names.own(named or [])
            declined = labelled(text, names)
            if declined:
                yes.update(grams(declined) | {""})
            else:
                for _, masked in last_sentences(text, names):
                    no.update(grams(masked) | {""})
            names.forget(new)
    keys = list(yes.keys() | no.keys())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([yes[k] for k in keys], pa.int64()), pa.array([no[k] for k in keys], pa.int64())], names=["gram", "yes", "no"])


def refusal_counts(pairs: DataFrame, vocabulary: list[str], rows: int = REFUSAL_ROWS) -> dict[str, tuple[int, int]]:
    """Counts for ``Refusals`` from about ``rows`` pairs, those of the smallest hashes; equal texts among them count once."""
    some = pairs.where("second is not null").select("kind", "id", "names", "second")
    total = max(1, some.count())
    some = some.where(uniform_hash("kind", "id", seed=5) <= F.lit(0x7FFFFFFFFFFFFFFF * min(rows, total) // total))
    spread_out = some.withColumn("h", F.xxhash64("second")).repartition(pairs.sparkSession.sparkContext.defaultParallelism, "h")
    few = spread_out.groupBy("h").agg(F.min(F.struct("second", "names")).alias("r"))
    counted = few.select("r.names", "r.second").mapInArrow(lambda it: _count_grams(it, vocabulary), "gram string, yes long, no long")
    sums = counted.groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    return {r["gram"]: (r["yes"], r["no"]) for r in sums.collect()}  # the grams of a bounded sample


def pairs_of(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def copied_share(first: list[str], second: list[str]) -> float:
    """Share of the second text's different word pairs that the first has."""
    own = pairs_of(second)
    return len(own & pairs_of(first)) / len(own) if own else 0.0


def copy_threshold(shares: list[int]) -> float:
    """The share from which a text may well be a copy (a likelihood of ``COPY_LIKELY``), by a mixture fitted to the histogram of all shares.

    Sound texts and texts that quote follow a beta distribution each, copies a power of the share. Without a text from
    ``COPIES_FROM`` on, that is the threshold.
    """
    h = np.asarray(shares, dtype=float)
    x = (np.arange(len(h)) + 0.5) / len(h)
    part = np.stack([x < QUOTES[0], (x >= QUOTES[0]) & (x < QUOTES[1]), x >= COPIES_FROM]).astype(float)
    if (h * part[2]).sum() <= 0:
        return COPIES_FROM

    def density(w: np.ndarray, falls: bool) -> np.ndarray:
        n = w.sum()
        if n < 1e-6:
            return np.full(len(x), -1e9)
        if falls:
            a, b = min(STEEP[1], max(STEEP[0], -n / (w * np.log(x)).sum())), 1.0
        else:
            m = (w * x).sum() / n
            v = min(max((w * (x - m) ** 2).sum() / n, 2e-4), 0.99 * m * (1 - m))
            a, b = (m * (1 - m) / v - 1) * m, (m * (1 - m) / v - 1) * (1 - m)
        return (a - 1) * np.log(x) + (b - 1) * np.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + math.log(n)

    for _ in range(100):
        logs = np.stack([density(h * part[k], k == 2) for k in range(3)])
        part = np.exp(logs - logs.max(axis=0))
        part /= part.sum(axis=0)
    below = np.flatnonzero(part[2] < COPY_LIKELY)
    return max(COPY_LEAST, float((below[-1] + 1) / len(h)) if len(below) else 0.0)


class Languages:
    """Character n-gram naive Bayes; the score of a word is its grams' log probabilities in every language."""

    def __init__(self, tables: dict[str, dict[str, int]]) -> None:
        self.names = sorted(tables)
        self.english = self.names.index("en") if "en" in tables else -1
        grams = sorted({g for t in tables.values() for g in t})
        self.at = {g: i for i, g in enumerate(grams)}
        counts = np.array([[tables[n].get(g, 0) for n in self.names] for g in grams], dtype=np.float64).reshape(len(grams), len(self.names))
        total = counts.sum(axis=0) + 0.5 * (len(grams) + 1)
        self.logs = np.log((counts + 0.5) / total)
        self.unseen = np.log(0.5 / total)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1 << 16, len(self.names)))

    def _row(self, w: str) -> int:
        k = len(self.rows)
        if k == len(self.table):
            self.rows.clear()
            k = 0
        at = [self.at.get(g, -1) for g in grams_of(w)]
        seen = [i for i in at if i >= 0]
        self.table[k] = self.logs[seen].sum(axis=0) + (len(at) - len(seen)) * self.unseen
        self.rows[w] = k
        return k

    def odds(self, words: list[str]) -> np.ndarray:
        """Log odds of every language against English, tempered for the dependence of grams on one another."""
        if self.english < 0 or not words:
            return np.zeros(max(1, len(self.names)))
        if len(self.rows) + len(words) > len(self.table):
            self.rows.clear()
        rows = self.rows
        score = self.table[[rows[w] if w in rows else self._row(w) for w in words]].sum(axis=0) / GRAM
        return score - score[self.english]

    def is_foreign(self, words: list[str], least: float = FOREIGN_ODDS) -> bool:
        enough = len(words) >= FOREIGN_WORDS or any(w > "\u02ff" for w in words)
        return enough and float(self.odds(words).max()) >= least

    def differ(self, first: str, second: list[str], names: Names) -> bool:
        """Whether the second text is foreign while the first is English; against a foreign first text twice the odds.

        The first text is looked at only where the second is foreign.
        """
        if not self.is_foreign(second):
            return False
        return not self.is_foreign(plain(names.mask(words_in(first)), names)) or self.is_foreign(second, 2 * FOREIGN_ODDS)


def grams_of(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))]


def plain(masked: list[str], names: Names) -> list[str]:
    """Words for the language model: no names of quantities or words of such, numbers or single letters."""
    return [w for w in masked if (len(w) > 1 or w > "\u2e7f") and w not in names.parts]


def ending(masked: list[str]) -> list[str]:
    """The words up to the last name, where only a unit or 'in plain number' follows it at the end."""
    for k in range(len(masked) - 1, max(-1, len(masked) - 9), -1):
        if masked[k] == "V":
            return [*masked[: k + 1], "U"] if masked[k + 1 : k + 2] == ["in"] and len(masked) > k + 2 else masked
    return masked


_K = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """Masked word -> its hash, remembered."""

    def __missing__(self, w: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def _windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words, odd so that it is never 0."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        h = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            h = (h ^ hashes[k : k + n]) * np.uint64(_K)
            h ^= h >> np.uint64(31)
    return (h | np.uint64(1)).view(np.int64)


def runs_of(texts: list[list[str]], known: WordHashes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(hashes of the ends of the texts, runs inside texts).

    Ends are the last words for each context, shortest first, then for each context those without the last; 0 where a text
    is shorter. A run inside a text is one that words follow; for each length those of all texts in one array, with their
    text.
    """
    n = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.array([known[w] for t in texts for w in t], dtype=np.uint64)
    ends_at = np.cumsum(n)
    of = np.repeat(np.arange(len(texts)), n)
    ends, before, inside = [], [], []
    for size in range(1, CONTEXT[0] + 1):
        h = _windows(flat, size)
        for back, out, wanted in ((0, ends, size in CONTEXT), (1, before, size + 1 in CONTEXT)):
            if wanted:
                enough = n >= size + back
                e = np.zeros(len(texts), dtype=np.int64)
                e[enough] = h[ends_at[enough] - size - back]
                out.append(e)
        same = (of[: len(h)] == of[size - 1 :]) if len(h) else np.zeros(0, dtype=bool)
        same[ends_at[n >= size] - size] = False
        inside.append((h[same], of[: len(h)][same]))
    return ends + before, inside


KINDS = ("dataset", "eval_sft")
#: Uses of a row: a text that stands once; one of several rows of a text; the row of these by which their text is counted.
BOTH, ALONE, COUNTED = 0, 1, 2
ENDS, BEFORE = [f"end{n}" for n in reversed(CONTEXT)], [f"before{n}" for n in reversed(CONTEXT)]
FEATURES = "kind int, id long, use int, empty boolean, refusal boolean, share double, foreign boolean, cut boolean, " + ", ".join(f"{e} long" for e in ENDS + BEFORE) + ", run long, n long"
_FEATURES = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("use", pa.int32()), *((c, pa.bool_()) for c in ("empty", "refusal")), ("share", pa.float64()), *((c, pa.bool_()) for c in ("foreign", "cut")), *((e, pa.int64()) for e in ENDS + BEFORE), ("run", pa.int64()), ("n", pa.int64())])


class Gathered:
    """Hashes of runs of each kind; equal ones are counted together now and then."""

    def __init__(self) -> None:
        self.runs: list[list[np.ndarray]] = [[] for _ in KINDS]
        self.size = 0

    def add(self, kind: int, hashes: np.ndarray) -> None:
        self.runs[kind].append(hashes)
        self.size += len(hashes)

    def flush(self) -> Iterator[pa.RecordBatch]:
        for kind, own in enumerate(self.runs):
            if own:
                run, n = np.unique(np.concatenate(own), return_counts=True)
                k = len(run)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, dtype=np.int32)), *(pa.nulls(k, f.type) for f in list(_FEATURES)[1:-2]), pa.array(run), pa.array(n)], schema=_FEATURES)
        self.__init__()


def _features(batches: Iterator[pa.RecordBatch], vocabulary: list[str], tables: dict, refusals: dict) -> Iterator[pa.RecordBatch]:
    """What one pair tells about its defect, with the hashes of its end; and the runs inside texts with their counts.

    Columns of the batches: kind, id, names, first, second, use. Runs are those of texts that are counted.
    """
    names, languages, declines, known, gathered = Names(vocabulary), Languages(tables), Refusals(refusals), WordHashes(), Gathered()
    for batch in batches:
        for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
            kinds, uses = part.column(0).to_pylist(), part.column(5).to_pylist()
            flags: list[tuple] = []
            tails: list[list[str]] = []
            for named, first, second in zip(*(part.column(k).to_pylist() for k in (2, 3, 4))):
                text = unwrap(second or "")
                if is_empty(text):
                    flags.append((True, False, None, False, False))
                    tails.append([])
                    continue
                new = names.own(named or [])
                words = words_in(text)
                masked = names.mask(words)
                tails.append(ending(masked))
                if declines.is_refusal(text, names):
                    flags.append((False, True, None, False, False))
                else:
                    share = copied_share(words_in(first or ""), words)
                    unquoted = names.mask(words_in(QUOTED.sub(" ", text))) if '"' in text else masked
                    flags.append((False, False, share, languages.differ(first or "", plain(unquoted, names), names), masked[-1:] == ["P"]))
                names.forget(new)
            ends, inside = runs_of(tails, known)
            kind, use = np.array(kinds), np.array(uses)
            for hashes, of in inside:
                for k in range(len(KINDS)):
                    gathered.add(k, hashes[(kind[of] == k) & (use[of] != ALONE)])
            columns = zip(*flags) if flags else [()] * 5
            arrays = [pa.array(c, f.type) for c, f in zip(columns, list(_FEATURES)[3:8])]
            nothing = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(5), *arrays, *(pa.array(e) for e in ends), nothing, nothing], schema=_FEATURES)
            if gathered.size > GATHERED:
                yield from gathered.flush()
    yield from gathered.flush()


def end_evidence(open_rows: DataFrame, runs: DataFrame) -> SharedTable:
    """(kind, h, e, i): for each run of words on which a text ends, the texts that end on it and how often it goes on.

    A run that stands only at ends may be cut in its last word; at least the share ``GOES_ON`` of the times that the words
    before the last stand counts as going on.

    ``open_rows`` (kind, use and the ends) are texts without another defect, ``runs`` (kind, run, n) the runs inside texts.
    """
    both = F.explode(F.array(*(F.struct(F.col(e).alias("h"), F.col(b).alias("before")) for e, b in zip(ENDS, BEFORE)))).alias("x")
    ends = open_rows.where(F.col("use") != ALONE).select("kind", both).select("kind", "x.*").where("h <> 0")
    ends = shared_table(ends.groupBy("kind", "h", "before").agg(F.count(F.lit(1)).alias("e")), "ends")
    wanted = shared_table(ends.df.select("kind", "h").union(ends.df.select("kind", "before")).distinct(), "wanted")
    met = sized_join(runs.withColumnRenamed("run", "h"), wanted, ["kind", "h"], "left_semi")
    inside = shared_table(met.groupBy("kind", "h").agg(F.sum("n").alias("i")), "inside")
    out = sized_join(ends.df, inside, ["kind", "h"], "left")
    out = sized_join(out, _as(inside, "kind", F.col("h").alias("before"), F.col("i").alias("on")), ["kind", "before"], "left")
    goes_on = F.greatest(F.coalesce("i", F.lit(0)).cast("double"), GOES_ON * F.coalesce("on", F.lit(0)))
    return shared_table(out.select("kind", "h", "e", goes_on.alias("i")), "evidence")


def unlikely_ends(open_rows: DataFrame, evidence: SharedTable) -> SharedTable:
    """(kind, ends): the ends after which a text is not likely to end.

    P(a text ends here | its last words); long contexts rest on short ones where counts are few. A text's own end is not
    counted as evidence for itself.
    """
    rows, p = open_rows.select("kind", *ENDS).distinct(), F.lit(0.0)
    for name in ENDS:
        own = _as(evidence, "kind", F.col("h").alias(name), F.col("e").alias("_e"), F.col("i").alias("_i"))
        rows = sized_join(rows, own, ["kind", name], "left")
        e, i = F.greatest(F.coalesce("_e", F.lit(0)) - 1, F.lit(0)), F.coalesce("_i", F.lit(0.0))
        before = F.col("_p") if "_p" in rows.columns else p
        rows = rows.withColumn("_p", F.when(F.col(name) == 0, before).otherwise((e + BACKOFF * before) / (e + i + BACKOFF))).drop("_e", "_i")
    return shared_table(rows.where(F.col("_p") < END_LIKELY).select("kind", *ENDS, F.lit(True).alias("unlikely")), "unlikely")


class _View(SharedTable):
    """A written table under other columns."""

    def __init__(self, table: SharedTable, *columns) -> None:
        super().__init__(table.spark, table.path, table.schema)
        self.columns = columns

    @property
    def df(self) -> DataFrame:
        return super().df.select(*self.columns)


def _as(table: SharedTable, *columns) -> SharedTable:
    return _View(table, *columns)


def language_tables(pages: DataFrame, vocabulary: list[str], rows: int = LANGUAGE_ROWS) -> dict[str, dict[str, int]]:
    """Gram counts per language of ``pages`` (text, lang): at most ``rows`` labelled pages each, those of smallest hash.

    A label is its two letters before any dash, in any case.
    """
    label = F.regexp_extract(F.lower("lang"), "^([a-z]{2})(?:-.*)?$", 1)
    own = pages.select(label.alias("l"), "text", F.xxhash64("text").alias("h")).where("l <> '' and text <> ''")
    few = own.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("k") <= rows)
    names, tables = Names(vocabulary), {}
    for r in few.select("l", "text").collect():
        own_table = tables.setdefault(r["l"], Counter())
        for w in plain(names.mask(words_in(r["text"])), names):
            own_table.update(grams_of(w))
    return tables


def once_counted(rows: DataFrame) -> DataFrame:
    """``rows`` with their use, and for each text that several rows of a kind repeat one more row, by which it is counted."""
    text = F.xxhash64("second").alias("text")
    repeated = shared_table(rows.where("second is not null").groupBy("kind", text).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "text", F.lit(True).alias("again")), "repeated")
    keyed = rows.withColumn("text", text)
    columns = ["kind", "id", "names", "first", "second"]
    uses = sized_join(keyed, repeated, ["kind", "text"], "left").select(*columns, F.when(F.col("again"), ALONE).otherwise(BOTH).alias("use"))
    least = F.min(F.struct("id", "first", "names", "second")).alias("r")  # the same row on every run
    counted = sized_join(keyed, repeated, ["kind", "text"], "left_semi").groupBy("kind", "text").agg(least)
    return uses.union(counted.select("kind", *(f"r.{c}" for c in columns[1:]), F.lit(COUNTED).alias("use")))


def broken_pairs(pairs: DataFrame, pages: DataFrame, formulas: DataFrame) -> DataFrame:
    """(source_table, row_id, defect) of the defective rows of ``pairs`` (kind, id, names, first, second).

    ``pages`` (text, lang) are what the language model is fitted on, ``formulas`` (output, inputs) give the vocabulary of
    quantities; kind is the index of the pair's table in ``KINDS``.
    """
    spark = pairs.sparkSession
    named = formulas.select(F.explode(F.array_union(F.array("output"), F.coalesce("inputs", F.array().cast("array<string>")))).alias("v"))
    vocabulary = sorted(r["v"] for r in named.where("v is not null").distinct().collect())  # a fixed table
    own = spread(pairs.select("kind", "id", "names", "first", "second"), "id")
    held = spark.sparkContext.broadcast((vocabulary, {k: dict(v) for k, v in language_tables(pages, vocabulary).items()}, refusal_counts(own, vocabulary)))
    features = shared_table(once_counted(own).mapInArrow(lambda it: _features(it, *held.value), FEATURES), "features")
    rows = features.df.where("run is null").drop("run", "n")
    at = F.least(F.floor(F.col("share") * SHARES), F.lit(SHARES - 1)).alias("at")
    shares = [[0] * SHARES for _ in KINDS]
    for r in rows.where((F.col("use") != ALONE) & F.col("share").isNotNull()).groupBy("kind", at).count().collect():  # at most the bins of each kind
        shares[r["kind"]][r["at"]] = r["count"]
    copied = F.col("share") >= F.element_at(F.array(*(F.lit(copy_threshold(h)) for h in shares)), F.col("kind") + 1)
    defect = F.when(F.col("empty"), "empty").when(F.col("refusal"), "refusal").when(copied, "copy").when(F.col("foreign"), "language").when(F.col("cut"), "truncated")
    rows = rows.select("kind", "id", "use", defect.alias("defect"), *ENDS, *BEFORE)
    open_rows = rows.where("defect is null")
    unlikely = unlikely_ends(open_rows, end_evidence(open_rows, features.df.where("run is not null").select("kind", "run", "n")))
    told = sized_join(rows.where(F.col("use") != COUNTED), unlikely, ["kind", *ENDS], "left")
    told = told.withColumn("defect", F.coalesce("defect", F.when(F.col("unlikely"), "truncated"))).where("defect is not null")
    return told.select(F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("source_table"), F.col("id").alias("row_id"), "defect")


def _names(trace_target: str = "trace.target"):
    return F.array_union(F.array("target", trace_target), F.coalesce("trace.leafs", F.array().cast("array<string>")))


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Defective pairs of dataset (question, chain_of_thought) and eval_sft (trace_str, question)."""
    data = read_table(spark, sf_dir, "dataset").where("chain_of_thought is not null")
    data = data.select(F.lit(0).alias("kind"), F.col("record_id").alias("id"), _names().alias("names"), F.col("question").alias("first"), F.col("chain_of_thought").alias("second"))
    tuned = read_table(spark, sf_dir, "eval_sft")
    tuned = tuned.select(F.lit(1).alias("kind"), F.col("eval_id").alias("id"), _names().alias("names"), F.col("trace_str").alias("first"), F.col("question").alias("second"))
    return broken_pairs(data.union(tuned), read_table(spark, sf_dir, "documents").select("text", "lang"), read_table(spark, sf_dir, "hyperedges").select("output", "inputs"))


QUERIES, SQL = {"p5_found": p5_found}, {}
