"""Problem 8: keyword-stuffed and link-list pages.

Method: pages are cut into units (sentences, list lines). The units of clear list shape and of clear sentence shape are
exploded into phrase shingles of one and two words, and for every phrase the distinct hosts that have it in lists and the
pages that have it in lists and in sentences are counted exactly, in a grouped aggregation. A phrase that at least
``HOSTS`` hosts replicate in lists, and that lists have more than sentences, is list evidence; one of sentences is sentence
evidence. Every run of at most ``RUN`` words of a unit is then judged by the phrases it is stitched from, the longer
phrase before its words, joined with the density of links, tags and separators; a page is flagged if at least three
quarters of its blank-separated words stand in list runs. A list shape alone is no evidence: without replicated phrases
only links and tags are.

All phrases are counted; there is no floor. The phrases that are evidence are broadcast if they measure at most
``EVIDENCE_BYTES``, else each page meets its own by a join; both ways give the same rows.

Shingles of three words and more are not used, because random lists of a vocabulary seldom repeat them (see the README).

Defined results: null, empty and blank texts have no words and are not flagged; words are counted over the whole text,
whatever its length; without a host the source stands in, and pages without either share one host; repeated rows are
judged each; an empty table gives no rows; extra columns are ignored. A sign of ``MARKS`` standing alone is read as what
it marks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.dist import SharedTable, read_table, shared_table, spread

#: Least share of words in list runs, words of a run, hosts that must replicate a phrase in lists.
SHARE, RUN, HOSTS = 0.75, 14, 3
#: Least and most log ratio of a phrase's page shares in lists and in sentences that counts as evidence.
ODDS, MOST = 1.0, 4.0
#: What the shape of a list with replicated phrases and a list before it add to the log ratios of a run of words.
LISTED, STAY = 6.0, 10.0
#: Least share of a list's words that stand in replicated phrases for its shape to count.
STITCHED = 0.1
#: The evidence is broadcast up to this size in memory: 16 bytes a phrase.
EVIDENCE_BYTES = 24 << 20
#: Pages that are cut at a time.
PAGES = 2000

#: Runs of letters; signs of scripts without blanks stand apart from those of others.
LETTERS = re.compile(r"[^\W\d_⺀-\U0003ffff]+(?:[-'’][^\W\d_⺀-\U0003ffff]+)*|(?:(?![\W\d_])[⺀-\U0003ffff])+")
#: Tags of markup, and numbers with the letters of a serial.
MARKUP = re.compile(r"(?i)</?[a-z][a-z0-9]*\b>?|[a-z]*[-/]?[0-9]+(?:[.,][0-9]+)*[-/]?[a-z]*")
#: What MARKUP cannot do without; signs that a link and an end in ASCII have; digits in ASCII.
MARKED, LINK_SIGNS, PLAIN_ENDS, DIGIT = re.compile("[<0-9]"), frozenset("/.="), frozenset(".!?"), re.compile("[0-9]")
LINK = re.compile(r"(?i)://|\bhref=|^\W*(?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}/\S|^\W*www\.\S|\]\(\S+\.[a-z]{2,}")
TAG = re.compile(r"^#[^\W\d_]\w*")
END = re.compile(r"(?:[.!?](?<!\bno\.)(?<!\d\.)|[。！？])[\"'”»)`*]*$|[。！？]", re.I)
SEPARATED = re.compile(r"[,;、，；]$|^(?:[^\w\s#(]{1,4}|[–—])$")
CODE = re.compile(r"[={}_\[\]\\]|\w\(|\.{4,}")
#: Ends of a sentence in scripts without blanks, and signs that may close or open one.
WIDE_ENDS, CLOSING, OPENING = "。！？", "\"'”»)`*", "\"'“«([*->•#"

#: Private signs that stand for a new line, two blanks and a line of keywords in the header while a text is cut.
MARKS = LINE, WIDE, HEADER = "\U0010fffd", "\U0010fffc", "\U0010fffb"
NEW_LINE = r"\s*[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]\s*"
META = r'(?i)(<meta\b[^>]*\bname="?[a-z_-]*(?:keywords|description|tags))'

#: Facts of a blank-separated word, in the columns of the fact table.
LINKS, TAGS, DIGITS, CODES, SEPARATORS, ENDS, PLAIN, CELLS, WIDE_END, STARTS, NAMED = range(11)


def host_of(url: str | None, source: str | None) -> str:
    """Host of an address, without a scheme or www; the source where there is none."""
    if url:
        m = re.match(r"(?i)\s*(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/?#\s:]+)", url)
        if m:
            return m.group(1).lower()
    return (source or "").lower()


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def words_of(text: str) -> list[str]:
    low = text.lower()
    return LETTERS.findall(MARKUP.sub(" ", low) if MARKED.search(low) else low)


#: Numbers without marks; last signs of an end in ASCII; the facts of a number and of a link, the latter by its end.
NUMBER, MAY_END = r"^[0-9]+(?:\.[0-9]+)?$", frozenset(".!?" + CLOSING)
A_NUMBER = ((False, False, True, False, False, False, 0, False, False, True, False), 0)
A_LINK = tuple(((True, False, False, False, False, end, 0, False, False, False, False), 0) for end in (False, True))


class WordFacts(dict):
    """Blank-separated word -> (its facts, the hash of its words or 0), remembered."""

    def __init__(self, names: frozenset[str] = frozenset()) -> None:
        self.names = names

    def __missing__(self, w: str) -> tuple[tuple, int]:
        first = w.lstrip(OPENING)[:1]
        starts = first.isupper() or first.isdigit()
        if w.isalpha() and w.isascii():  # a plain word has none of the marks
            own, marks, wide = [w.lower()], (False,) * 6, False
        else:
            short = w.isascii()
            ends = (not short or not PLAIN_ENDS.isdisjoint(w)) and bool(END.search(w))
            last = "" if short else w.rstrip(CLOSING)[-1:]
            wide = last != "" and last in WIDE_ENDS
            if not LINK_SIGNS.isdisjoint(w) and LINK.search(w):  # a unit with links has no shape, so the other marks do not matter
                own, marks = [], (True, bool(TAG.match(w)), False, False, False, ends)
            else:
                tag = bool(TAG.match(w))
                own = [] if tag else words_of(w)
                digits = bool(DIGIT.search(w)) if short else any(c.isdigit() for c in w)
                marks = (False, tag, digits, bool(CODE.search(w)), bool(SEPARATED.search(w)), ends)
        key = signed(xxhash.xxh3_64_intdigest(" ".join(own)) | 1) if own else 0
        self[w] = out = ((*marks, len(own), w == "|", wide, starts, bool(own) and self.names.issuperset(own)), key)
        return out

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > 1_000_000:
            self.clear()
        new = [w for w in words if w not in self and w.isascii() and not w.isalpha()]
        if new:  # most of the words that stand once are links and numbers; ASCII ones are told by one call each
            text = pa.array(new, pa.string())
            links, numbers = (np.asarray(pc.match_substring_regex(text, p)) for p in (LINK.pattern, NUMBER))
            for i in np.flatnonzero(numbers):
                self[new[i]] = A_NUMBER
            for i in np.flatnonzero(links & ~numbers):
                w = new[i]
                ends = w[-1] in MAY_END and bool(END.search(w))
                self[w] = A_LINK[ends] if w[0] != "#" else ((True, bool(TAG.match(w)), *A_LINK[ends][0][2:]), 0)
        rows = [self[w] for w in words]
        return np.array([r[0] for r in rows], dtype=np.int32).reshape(len(rows), 11), np.array([r[1] for r in rows], dtype=np.int64)


class Cut:
    """Pages cut into words and units.

    Of each word: ``facts``, ``key`` (hash, 0 without letters), ``page``, ``unit``; of each unit: ``start``, ``size``,
    ``sums`` of the facts, ``header``, ``owner`` (its page) and ``shape`` (1 list, -1 sentence, 0 neither).
    """

    def __init__(self, texts: pa.Array, known: WordFacts) -> None:
        for m in MARKS:
            if pc.any(pc.match_substring(texts, m)).as_py():
                texts = pc.replace_substring(texts, m, "?")
        if pc.any(pc.match_substring(texts, "<meta", ignore_case=True)).as_py():
            texts = pc.replace_substring_regex(texts, META, HEADER + r" \1")
        texts = pc.replace_substring_regex(pc.utf8_trim_whitespace(texts), NEW_LINE, f" {LINE} ")
        split = pc.utf8_split_whitespace(pc.replace_substring(texts, "  ", f" {WIDE} "))
        codes = split.flatten().dictionary_encode()
        distinct = codes.dictionary.to_pylist()
        facts, keys = known.table(distinct)
        mark = np.array([MARKS.index(w) + 1 if w in MARKS else 0 if w else 4 for w in distinct], dtype=np.int8)
        code = np.asarray(codes.indices)
        page = np.repeat(np.arange(len(texts)), np.diff(np.asarray(split.offsets)))
        self.pages = len(texts)
        marks = mark[code] if len(code) else np.zeros(0, dtype=np.int8)
        real = marks == 0
        line = np.cumsum((marks == 1) | np.r_[False, page[1:] != page[:-1]]) if len(code) else np.zeros(0, dtype=np.int64)
        lines = int(line[-1]) + 1 if len(line) else 0
        gaps, header = np.bincount(line[marks == 2], minlength=lines), np.bincount(line[marks == 3], minlength=lines) > 0
        code, self.page, line = code[real], page[real], line[real]
        self.facts, self.key = facts[code] if len(code) else np.zeros((0, 11), dtype=np.int32), keys[code] if len(code) else np.zeros(0, dtype=np.int64)
        n = len(code)
        new_line = np.r_[True, line[1:] != line[:-1]][:n]
        ended = np.r_[False, self.facts[:-1, ENDS] > 0][:n] & ~header[line]
        self.start = np.flatnonzero(new_line | ended)
        self.unit = np.cumsum(new_line | ended) - 1
        self.size = np.diff(np.r_[self.start, n])
        self.sums = np.add.reduceat(self.facts, self.start, axis=0, dtype=np.int64) if n else np.zeros((0, 11), dtype=np.int64)
        self.owner = self.page[self.start]
        own = line[self.start]
        self.header = header[own]
        whole = np.bincount(own, minlength=lines)[own] == 1
        self.shape = self._shapes(np.where(whole & ~self.header, gaps[own], 0))

    def _shapes(self, gaps: np.ndarray) -> np.ndarray:
        """1 or -1 for units of clear shape; two blanks in a line part items, too."""
        s, n = self.sums, self.size
        if not len(n):
            return np.zeros(0, dtype=np.int8)
        items = 1 + s[:, SEPARATORS] + gaps
        rows = (items >= 6) & (n - s[:, SEPARATORS] <= 4 * items) & (s[:, DIGITS] <= 0.3 * items)
        table = (s[:, CELLS] >= 4) & (s[:, DIGITS] <= 0.8 * s[:, CELLS]) & (s[:, PLAIN] > s[:, DIGITS])
        free = s[:, LINKS] == 0
        lists = free & (s[:, CODES] == 0) & (rows | table)
        plain = (n <= 45) & (items * 3 <= n) & (s[:, PLAIN] >= 6) & (self.facts[self.start, STARTS] > 0)
        sentences = free & ~lists & (s[:, ENDS] > 0) & ((self.facts[self.start + n - 1, WIDE_END] > 0) | plain)
        return np.where(lists | self.header, 1, np.where(sentences, -1, 0)).astype(np.int8)

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, last word, hash, whether it may be evidence) of all shingles: single words, then pairs of a unit."""
        at = np.flatnonzero(self.key)
        key, named = self.key[at], self.facts[at, NAMED] > 0
        two = np.flatnonzero(self.unit[at][1:] == self.unit[at][:-1]) if len(at) else at
        with np.errstate(over="ignore"):
            pair = (key[two] * np.int64(-7046029254386353131) + key[two + 1]) & ~np.int64(1)
        return np.r_[at, at[two]], np.r_[at, at[two + 1]], np.r_[key, pair], np.r_[~named, ~(named[two] & named[two + 1])]


_COUNTS = pa.schema([("phrase", pa.int64()), ("host", pa.int64()), ("lists", pa.int64()), ("sentences", pa.int64())])


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of integer columns and how often each occurs."""
    if not len(columns[0]):
        return list(columns), np.zeros(0, dtype=np.int64)
    order = np.lexsort(columns[::-1])
    sorted_ = [c[order] for c in columns]
    new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_])]
    at = np.flatnonzero(new)
    return [c[at] for c in sorted_], np.diff(np.r_[at, len(new)])


def _count_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(phrase, host, pages with it in lists, pages with it in sentences) of some pages; columns text, url, source.

    Hosts are told apart for lists only. Phrase 0 counts the pages with lists and with sentences.
    """
    known = WordFacts()
    for batch in batches:
        for part in (batch.slice(at, PAGES) for at in range(0, batch.num_rows, PAGES)):
            cut = Cut(part.column(0), known)
            hosts = np.array([signed(xxhash.xxh3_64_intdigest(host_of(u, s))) for u, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist())], dtype=np.int64)
            first, _, phrase, _ = cut.phrases()
            shape, page = cut.shape[cut.unit[first]], cut.page[first]
            for s in (1, -1):
                (key, on), _ = _distinct(phrase[shape == s], page[shape == s])
                some = np.unique(on)
                key, on = np.r_[key, np.zeros(len(some), dtype=np.int64)], np.r_[on, some]
                (key, host), n = _distinct(key, hosts[on]) if s == 1 else _distinct(key, np.zeros(len(key), dtype=np.int64))
                zero = np.zeros(len(n), dtype=np.int64)
                if len(n):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(host) if s == 1 else pa.nulls(len(n), pa.int64()), pa.array(n if s == 1 else zero), pa.array(zero if s == 1 else n)], schema=_COUNTS)


def phrase_evidence(pages: DataFrame) -> SharedTable:
    """(phrase, odds) of every phrase that is evidence, above 0 for lists, below for sentences, from ``pages`` (text, url, source)."""
    counts = pages.select("text", "url", "source").mapInArrow(_count_phrases, "phrase long, host long, lists long, sentences long")
    by_host = counts.groupBy("phrase", "host").agg(F.sum("lists").alias("lists"), F.sum("sentences").alias("sentences"))
    sums = shared_table(by_host.groupBy("phrase").agg(F.sum("lists").alias("lists"), F.sum("sentences").alias("sentences"), F.count("host").alias("hosts")), "phrases")
    whole = sums.df.where("phrase = 0").select(F.greatest(F.lit(1), F.max("lists")), F.greatest(F.lit(1), F.max("sentences"))).collect()[0]
    odds = F.log((F.col("lists") + 0.5) / (whole[0] or 1)) - F.log((F.col("sentences") + 0.5) / (whole[1] or 1))
    found = sums.df.where("phrase <> 0").withColumn("odds", F.greatest(F.lit(-MOST), F.least(F.lit(MOST), odds)))
    out = shared_table(found.where(F.expr(f"odds >= {ODDS} and hosts >= {HOSTS} or odds <= -{ODDS}")).select("phrase", "odds"), "evidence")
    sums.drop()
    return out


class Evidence:
    """Log ratios by phrase, looked up for many phrases at once."""

    def __init__(self, phrase: np.ndarray, odds: np.ndarray) -> None:
        order = np.argsort(phrase)
        self.phrase, self.odds = phrase[order], odds[order]

    def of(self, phrase: np.ndarray) -> np.ndarray:
        if not len(self.phrase):
            return np.zeros(len(phrase))
        at = np.minimum(np.searchsorted(self.phrase, phrase), len(self.phrase) - 1)
        return np.where(self.phrase[at] == phrase, self.odds[at], 0.0)


def word_odds(cut: Cut, evidence: Evidence) -> np.ndarray:
    """The evidence of each word: that of the best replicated pair it stands in, else its own."""
    first, last, phrase, free = cut.phrases()
    odds = np.where(free, evidence.of(phrase), 0.0)
    singles = int(np.count_nonzero(cut.key))
    out, pair = np.zeros(len(cut.key)), np.zeros(len(cut.key))
    out[first[:singles]] = odds[:singles]
    np.maximum.at(pair, first[singles:], odds[singles:])
    np.maximum.at(pair, last[singles:], odds[singles:])
    return np.where(pair > 0, pair, out)


def _in_list(n: int, links: int, tags: int, marked: int, minus: int, plain: int, odds: float, before: bool, alone: bool) -> bool:
    """Whether a run of n words is part of a list; ``marked`` counts ends and code, ``before`` tells of the run before."""
    if tags and tags >= minus and (tags > 1 or n == 1):
        return True
    if links:
        return minus < 2 * links and minus * 3 <= n
    if odds > ODDS or before and minus and odds + STAY > ODDS:
        return True
    # A short line without an end and evidence goes with the text before it.
    return before and odds >= 0 and 2 * plain > n and alone and n <= 6 and not marked


def listed_words(cut: Cut, evidence: Evidence) -> tuple[np.ndarray, np.ndarray]:
    """(blank-separated words, those in list runs) of each page."""
    words = np.bincount(cut.page, minlength=cut.pages)
    if not len(cut.size):
        return words, np.zeros(cut.pages, dtype=np.int64)
    odds = word_odds(cut, evidence)
    # Runs of about the same number of words, so that no short rest is judged alone.
    runs = np.where(cut.header, 1, -(-cut.size // RUN))
    of = np.repeat(np.arange(len(runs)), runs)
    k = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
    start = cut.start[of] + cut.size[of] * k // runs[of]
    n = np.diff(np.r_[start, len(odds)])
    total = lambda x: np.add.reduceat(x, start)
    facts = np.add.reduceat(cut.facts, start, axis=0, dtype=np.int64)
    stitched = np.add.reduceat((odds > 0).astype(np.int64), cut.start) >= np.maximum(1, STITCHED * cut.size)
    bonus = np.where((cut.shape[of] == 1) & stitched[of], LISTED, 0.0)
    columns = (n, facts[:, LINKS], facts[:, TAGS], facts[:, ENDS] + facts[:, CODES], total((odds < 0).astype(np.int64)), facts[:, PLAIN], total(odds) + bonus)
    owner, listed, state, last = cut.owner[of], np.zeros(len(of), dtype=np.int64), False, -1
    for i, (page, header, alone, *row) in enumerate(zip(owner.tolist(), cut.header[of].tolist(), (runs[of] == 1).tolist(), *(c.tolist() for c in columns))):
        state = header or _in_list(*row, state and page == last, alone)
        last = page
        if state:
            listed[i] = row[0]
    return words, np.bincount(owner, weights=listed, minlength=cut.pages).astype(np.int64)


def _judge_pages(batches: Iterator[pa.RecordBatch], names: frozenset[str], evidence: Evidence) -> Iterator[pa.RecordBatch]:
    known = WordFacts(names)
    for batch in batches:
        for part in (batch.slice(at, PAGES) for at in range(0, batch.num_rows, PAGES)):
            words, listed = listed_words(Cut(part.column(1), known), evidence)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(listed)], names=["doc_id", "words", "listed"])


def _page_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, phrase) of all different phrases of each page; columns page, text."""
    known = WordFacts()
    for batch in batches:
        for part in (batch.slice(at, PAGES) for at in range(0, batch.num_rows, PAGES)):
            cut = Cut(part.column(1), known)
            first, _, phrase, _ = cut.phrases()
            (on, key), _ = _distinct(cut.page[first], phrase)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(on)), pa.array(key)], names=["page", "phrase"])


def _judge_own(batches: Iterator[pa.RecordBatch], names: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """The same with each page's own evidence; columns doc_id, text, phrases, odds."""
    known = WordFacts(names)
    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.slice(i, 1)
            own = Evidence(np.array(part.column(2)[0].as_py() or [], dtype=np.int64), np.array(part.column(3)[0].as_py() or [], dtype=np.float64))
            words, listed = listed_words(Cut(part.column(1), known), own)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(listed)], names=["doc_id", "words", "listed"])


JUDGED = "doc_id long, words long, listed long"


def list_words(pages: DataFrame, formulas: DataFrame | None = None, limit: int = EVIDENCE_BYTES) -> DataFrame:
    """(doc_id, words, listed) of every page of ``pages`` (doc_id, text, url, source) that has words.

    Words of the quantities of ``formulas`` (output, inputs: a fixed table) are no evidence by themselves.
    """
    spark = pages.sparkSession
    own = spread(pages.select("doc_id", "text", "url", "source").where("text is not null and text <> ''"), "doc_id")
    names: frozenset[str] = frozenset()
    if formulas is not None:
        named = formulas.select(F.explode(F.array_union(F.array("output"), F.coalesce("inputs", F.array().cast("array<string>")))).alias("v"))
        names = frozenset(w for r in named.where("v is not null").distinct().collect() for w in re.findall("[a-z]+", r["v"].lower()))
    evidence = phrase_evidence(own)
    if 16 * evidence.rows() <= limit:
        rows = evidence.df.toArrow()
        held = spark.sparkContext.broadcast((names, np.asarray(rows["phrase"]), np.asarray(rows["odds"])))
        judged = own.select("doc_id", "text").mapInArrow(lambda it: _judge_pages(it, held.value[0], Evidence(*held.value[1:])), JUDGED)
    else:
        page = F.xxhash64("text").alias("page")  # equal texts are met by the same evidence
        texts = own.select("text").distinct().select(page, "text")
        met = texts.mapInArrow(_page_phrases, "page long, phrase long").join(evidence.df.hint("shuffle_merge"), "phrase")
        lists = met.groupBy("page").agg(F.collect_list(F.struct("phrase", "odds")).alias("e"))  # the phrases of one text
        both = own.select("doc_id", "text", page).join(lists, "page", "left").select("doc_id", "text", F.col("e.phrase").alias("p"), F.col("e.odds").alias("o"))
        judged = both.mapInArrow(lambda it: _judge_own(it, names), JUDGED)
    return judged.where("words > 0")


def p8_counts(spark, sf_dir: str) -> DataFrame:
    """Words and words in lists of every page."""
    formulas = read_table(spark, sf_dir, "hyperedges").select("output", "inputs")
    return list_words(read_table(spark, sf_dir, "documents").select("doc_id", "text", "url", "source"), formulas)


def p8_found(spark, sf_dir: str) -> DataFrame:
    """Pages made of search words, addresses or goods labels."""
    return p8_counts(spark, sf_dir).where(F.col("listed") >= SHARE * F.col("words")).select("doc_id")


QUERIES, SQL = {"p8_found": p8_found, "p8_counts": p8_counts}, {}
