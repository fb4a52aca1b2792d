"""Problem 2: near-duplicate records with small edits.

Method: grouped prefix join. Records of equal target and word set collapse into one class; a class orders its words
rarest first and only the words of its prefix can be the first shared word of a similar pair. Classes with identical
prefix and size form one group that enters the join once; group pairs pass the size and position filters and then
expand to members, whose 128-bit word bitmaps bound the symmetric difference; what is left is verified on whole word
sets. Words too common to tell records apart are never joined alone: a class joins on such a word together with its
next ones, as many as the estimated frequency of the combination needs (see ``_prefix_keys``). No pair is lost.

Texts are split and hashed once, in the JVM, into one table of sorted word hashes, which all steps read.

Word frequencies are counted over all records in a sketch of fixed size. They only set the order and the depth of the
keys, so a collision in the sketch costs time, never a pair.

Defined results: records whose target has no name key, null questions and questions without words are in no pair.
Repeated rows are pairs of similarity 1. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.dist import SharedTable, name_key, read_table, shared_table, sized_join, spread
from hyperloom.llm.splits import components

#: Counters of the frequency sketch and of its pieces.
SKETCH, PIECE = 1 << 20, 1 << 12
#: A key may stand in about this many records; commoner words are joined in combination.
COMMON = 1000
#: Most words in one combination.
DEPTH = 4
#: Sets up to this many words share too few for combinations: their pairs join on single words.
SMALL = 8


def word_sets(records: DataFrame) -> SharedTable:
    """(id, by, words, h1, h2): the hash of each record's target, its different word hashes, and the identity of both.

    ``records`` has id, target and text; only those with a name key and a word have a row. Equal words have equal hashes
    under all targets, so the table packs well.
    """
    texts = spread(records.select("id", "target", "text"), "id").select("id", F.xxhash64(name_key("target"), F.lit(1)).alias("by"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"), name_key("target").alias("k"))
    texts = texts.where("k is not null and size(w) > 0").select("id", "by", F.array_sort(F.array_distinct(F.transform("w", lambda w: F.xxhash64(w)))).alias("words"))
    return shared_table(texts.select("id", "by", "words", F.xxhash64("by", "words").alias("h1"), F.xxhash64("words", F.lit(7), "by").alias("h2")), "words")


def _mix(x: np.ndarray, by: np.ndarray | int) -> np.ndarray:
    """A 64-bit finalizer: spreads x ^ by over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (by if isinstance(by, np.ndarray) else np.uint64(by))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _flat(by: pa.Array, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(targets, all word hashes spread by their record's target, where each record's begin and end)."""
    own, n = np.asarray(by).view(np.uint64), np.asarray(lists.value_lengths(), dtype=np.int64)
    return own, _mix(np.asarray(lists.flatten()).view(np.uint64), np.repeat(own, n)), np.r_[0, np.cumsum(n)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's share of the frequency sketch in pieces; columns by, words. A target counts its records."""
    sketch = np.zeros(SKETCH, dtype=np.int64)
    for batch in batches:
        for values in _flat(batch.column(0), batch.column(1))[:2]:
            sketch += np.bincount((values & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    pieces = [(p, c) for p, c in enumerate(sketch.reshape(-1, PIECE)) if c.any()]
    if pieces:
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pieces], pa.int32()), pa.array([c.tobytes() for _, c in pieces], pa.binary())], names=["piece", "counts"])


def _add_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if p in sums:
                sums[p] = sums[p] + np.frombuffer(c, dtype=np.int64)
            else:
                sums[p] = np.frombuffer(c, dtype=np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], names=["piece", "counts"])


def _longer_misses(n: int, t: float) -> int:
    """Words of a set of n that may be missing in any similar set that is not larger."""
    return n - math.ceil(t * n - 1e-9)


def _shorter_misses(n: int, t: float) -> int:
    """Words of a set of n that may be missing in any similar set that is not smaller."""
    return n - math.ceil(2 * t / (1 + t) * n - 1e-9)


def _prefix_keys(words: np.ndarray, df: np.ndarray, total: float, misses: int, common: float) -> tuple[list[int], list[int]]:
    """Keys of a set and the words that each passes over; words rarest first, df their counts among total records.

    Two similar sets share all but ``misses`` words, so their first shared word stands at most at place ``misses`` and
    their k-th at most at ``misses`` + k - 1. A word that is rare enough is a key by itself; otherwise it is combined
    with each later word that may be the next shared one, until the frequency to be expected of the combination (the
    product of the shares) is small enough. That depends on target and words only, so both sets choose the same keys.
    """
    first = words[: misses + 1]
    rare = int(np.searchsorted(df[: len(first)], common, side="right"))
    keys, passed = first[:rare].tolist(), list(range(rare))
    if rare == len(first):
        return keys, passed
    w, f, n = words[: misses + DEPTH].tolist(), df[: misses + DEPTH].tolist(), len(words)
    stack = [(w[i], f[i], i, 1) for i in range(rare, len(first))]
    while stack:
        key, expect, last, depth = stack.pop()
        if expect <= common or depth == DEPTH:
            keys.append(key)
            passed.append(last - depth + 1)
            continue
        for j in range(last + 1, min(misses + depth + 1, n)):
            stack.append(((key * 0x9E3779B97F4A7C15 + w[j]) & 0xFFFFFFFFFFFFFFFF, expect * f[j] / total, j, depth + 1))
    return keys, passed


_INDEX = pa.schema([("id", pa.int64()), ("gid", pa.int64()), ("n", pa.int32()), ("b1", pa.int64()), ("b2", pa.int64()), ("keys", pa.list_(pa.int64())), ("passed", pa.list_(pa.int32()))])


def _index(batches: Iterator[pa.RecordBatch], sketch: np.ndarray, t: float, common: float) -> Iterator[pa.RecordBatch]:
    """One row per class: group of its prefix, size, bitmap, keys and the words that each key passes over; columns id, by, words."""
    for batch in batches:
        for part in (batch.slice(at, 2000) for at in range(0, batch.num_rows, 2000)):
            by, flat, ends = _flat(part.column(1), part.column(2))
            of = np.repeat(np.arange(part.num_rows), np.diff(ends))
            df = sketch[(flat & np.uint64(SKETCH - 1)).astype(np.int64)]
            order = np.lexsort((flat, df, of))  # each record's words, rarest first
            flat, df = flat[order], df[order].astype(np.float64)
            bits = np.bincount(of * 128 + (flat & np.uint64(127)).astype(np.int64), minlength=128 * part.num_rows).reshape(-1, 128) & 1
            bitmap = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)
            totals = np.maximum(1, sketch[(by & np.uint64(SKETCH - 1)).astype(np.int64)]).astype(float).tolist()
            gids, all_keys, all_passed = [], [], []
            for r in range(part.num_rows):
                words, own = flat[ends[r] : ends[r + 1]], df[ends[r] : ends[r + 1]]
                n = len(words)
                misses = _longer_misses(n, t)
                keys, passed = [], []
                if n > SMALL:
                    keys, passed = _prefix_keys(words, own, totals[r], misses, common)
                if n * t <= SMALL:  # pairs with a small set join on single words, told apart by the mark
                    few = _mix(words[: misses + 1], 77).tolist()
                    keys, passed = keys + few, passed + list(range(len(few)))
                gids.append(xxhash.xxh3_64_intdigest(words[: misses + DEPTH].tobytes() + n.to_bytes(4, "little") + int(by[r]).to_bytes(8, "little")))
                all_keys.append(keys)
                all_passed.append(passed)
            cuts = pa.array(np.cumsum([0] + [len(k) for k in all_keys]).astype(np.int32))
            keys = np.array([k for own in all_keys for k in own], dtype=np.uint64).view(np.int64)
            passed = np.array([k for own in all_passed for k in own], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(gids, dtype=np.uint64).view(np.int64)), pa.array(np.diff(ends).astype(np.int32)), pa.array(bitmap[:, 0]), pa.array(bitmap[:, 1]), pa.ListArray.from_arrays(cuts, pa.array(keys)), pa.ListArray.from_arrays(cuts, pa.array(passed))], schema=_INDEX)


def _without(records: DataFrame, dropped: SharedTable) -> DataFrame:
    return sized_join(records, dropped, "id", "left_anti")


def similar_classes(records: DataFrame, threshold: float = 0.8, common: int = COMMON) -> tuple[SharedTable, SharedTable]:
    """Pairs of classes (a > b by id, similarity) and the copies (id, rep) that a class has besides its representative.

    ``records`` has id (bigint, unique), target and text. A class is all records of equal target key and word set, its
    representative the one of the smallest id.
    """
    t = float(threshold)
    sets = word_sets(records)
    pieces = sets.df.select("by", "words").mapInArrow(_sketch, "piece int, counts binary").repartition("piece").mapInArrow(_add_pieces, "piece int, counts binary")
    sketch = np.zeros(SKETCH, dtype=np.int64)
    for r in pieces.collect():  # at most SKETCH counters in all
        sketch[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["counts"], dtype=np.int64)

    same = sets.df.select("id", "h1", "h2")
    many = shared_table(same.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "many")
    copies = shared_table(sized_join(same, many, ["h1", "h2"]).where("id <> rep").select("id", "rep"), "copies")
    many.drop()
    own = _without(sets.df.select("id", "by", "words"), copies)

    held = records.sparkSession.sparkContext.broadcast(sketch.astype(np.int32 if sketch.max(initial=0) < 2**31 else np.int64))
    index = shared_table(own.mapInArrow(lambda b: _index(b, held.value, t, common), "id long, gid long, n int, b1 long, b2 long, keys array<long>, passed array<int>"), "index")

    # Groups of equal prefix and size: one leader joins for all; slack is how far a member's bitmap is from the leader's.
    flat = index.df.select("id", "gid", "n", "b1", "b2")
    shared = flat.groupBy("gid").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "b1", "b2")).alias("lead")).where("c > 1").select("gid", "lead")
    lead = shared_table(shared.select("gid", F.col("lead.id").alias("lead"), F.col("lead.b1").alias("l1"), F.col("lead.b2").alias("l2")), "lead")
    apart = lambda p, q, r, s: F.bit_count(F.col(p).bitwiseXOR(F.col(q))) + F.bit_count(F.col(r).bitwiseXOR(F.col(s)))
    members = shared_table(sized_join(flat, lead, "gid").select("lead", "id", "n", "b1", "b2", apart("b1", "l1", "b2", "l2").alias("far")), "members")
    slack = shared_table(members.df.groupBy("lead").agg(F.max("far").alias("slack")).withColumnRenamed("lead", "id"), "slack")
    led = shared_table(members.df.where("id <> lead").select("id"), "led")
    rows = sized_join(_without(index.df, led), slack, "id", "left")
    rows = rows.select(F.explode(F.arrays_zip("keys", "passed")).alias("k"), "id", F.col("n").cast("int"), F.coalesce("slack", F.lit(0)).cast("int").alias("slack"), "b1", "b2")
    rows = rows.select(F.col("k.keys").alias("key"), "id", "n", F.col("k.passed").alias("passed"), "slack", "b1", "b2")

    a, b = rows.alias("a"), rows.alias("b")
    least = f"ceil({t / (1 + t)!r}D * (a.n + b.n) - 1e-9D)"  # words that a similar pair shares at least
    order = "(a.n > b.n or (a.n = b.n and a.id > b.id))"
    room = "bit_count(a.b1 ^ b.b1) + bit_count(a.b2 ^ b.b2)"
    near = f"a.n - a.passed >= {least} and b.n - b.passed >= {least} and {room} - a.slack - b.slack <= a.n + b.n - 2 * {least}"
    met = a.join(b, F.expr(f"a.key = b.key and {order} and {near}")).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct()
    met = shared_table(met, "met")
    for table in (index, slack, led, lead):
        table.drop()

    # Group pairs expand to members; members of one group meet one another.
    across = met.df
    for side in ("x", "y"):
        across = sized_join(across, _View(members, F.col("lead").alias(side), F.col("id").alias("_m")), side, "left").withColumn(side, F.coalesce("_m", side)).drop("_m")
    m, o = members.df.alias("a"), members.df.alias("b")
    within = m.join(o, F.expr(f"a.lead = b.lead and a.id > b.id and {room} <= a.n + b.n - 2 * {least}")).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    pairs = shared_table(across.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).union(within.select("x", "y")), "pairs")
    met.drop()
    members.drop()

    needed = shared_table(pairs.df.select(F.col("a").alias("id")).union(pairs.df.select("b")).distinct(), "needed")
    words = shared_table(sized_join(sets.df.select("id", "words"), needed, "id", "left_semi"), "words")
    both = sized_join(pairs.df, _View(words, F.col("id").alias("a"), F.col("words").alias("wa")), "a")
    both = sized_join(both, _View(words, F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    common_words = F.size(F.array_intersect("wa", "wb"))
    sim = both.select("a", "b", common_words.alias("i"), (F.size("wa") + F.size("wb")).alias("s"))
    sim = sim.where(F.col("i") >= F.lit(t) * (F.col("s") - F.col("i")) - 1e-9).select("a", "b", (F.col("i") / (F.col("s") - F.col("i"))).alias("similarity"))
    out = shared_table(sim, "similar")
    for table in (pairs, needed, words, sets):
        table.drop()
    return out, copies


class _View(SharedTable):
    """A written table under other columns."""

    def __init__(self, table: SharedTable, *columns) -> None:
        super().__init__(table.spark, table.path, table.schema)
        self.columns = columns

    @property
    def df(self) -> DataFrame:
        return super().df.select(*self.columns)


def near_duplicate_pairs(records: DataFrame, threshold: float = 0.8, common: int = COMMON) -> DataFrame:
    """(a, b, similarity) of every pair of records, a < b, copies spelled out."""
    similar, copies = similar_classes(records, threshold, common)
    sim = similar.df
    reps = copies.df.select(F.col("rep"), F.col("id"))
    members = shared_table(reps.union(reps.select("rep", F.col("rep").alias("id")).distinct()), "of")
    for side in ("a", "b"):
        sim = sized_join(sim, _View(members, F.col("rep").alias(side), F.col("id").alias("_m")), side, "left").withColumn(side, F.coalesce("_m", side)).drop("_m")
    equal = members.df.alias("x").join(members.df.alias("y"), F.expr("x.rep = y.rep and x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(1.0).alias("similarity"))
    return sim.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").union(equal)


def near_duplicate_groups(records: DataFrame, threshold: float = 0.8, common: int = COMMON) -> DataFrame:
    """(id, group_id, links) of each record: the smallest id of its connected group and the number of records it is similar to.

    A record alone has itself as group and no links. Copies are linked with one another and with all copies of what they
    are similar to; nothing is spelled out for that, links are sums of the classes' sizes.
    """
    similar, copies = similar_classes(records, threshold, common)
    sim = similar.df
    text = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    of = components(sim.select(text("b").alias("a"), text("a").alias("b")))
    groups = _View(of, F.col("name").cast("long").alias("rep"), F.col("group").cast("long").alias("g"))
    sizes = shared_table(copies.df.groupBy("rep").agg((F.count(F.lit(1)) + 1).alias("c")), "sizes")
    ways = sim.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(sim.select("b", "a"))
    ways = sized_join(ways, _View(sizes, F.col("rep").alias("other"), "c"), "other", "left")
    links = shared_table(ways.groupBy("rep").agg(F.sum(F.coalesce("c", F.lit(1))).alias("links")), "links")
    rows = sized_join(records.select("id"), copies, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    for table in (groups, links, sizes):
        rows = sized_join(rows, table, "rep", "left")
    return rows.select("id", F.coalesce("g", "rep").alias("group_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("c", F.lit(1)) - 1).alias("links"))


def _questions(spark, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "dataset").select(F.col("record_id").alias("id"), "target", F.col("question").alias("text"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Pairs of records of one target whose questions share at least 0.7 of their words."""
    return near_duplicate_pairs(_questions(spark, sf_dir), 0.7).select(F.col("a").alias("record_id_a"), F.col("b").alias("record_id_b"))


def p2_groups(spark, sf_dir: str) -> DataFrame:
    """Each record's group of near-duplicates and number of links."""
    return near_duplicate_groups(_questions(spark, sf_dir), 0.7).withColumnRenamed("id", "record_id")


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}

#: Brute force within each target.
_PAIRS = """q AS (
  SELECT record_id, regexp_replace(lower(target), '[^a-z0-9]', '', 'g') AS k,
         list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS w
  FROM dataset WHERE question IS NOT NULL AND target IS NOT NULL),
p AS (
  SELECT a.record_id AS record_id_a, b.record_id AS record_id_b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS s
  FROM q a JOIN q b ON a.k = b.k AND a.record_id < b.record_id AND a.k <> ''),
f AS (SELECT record_id_a, record_id_b FROM p WHERE s > 0 AND i >= 0.7 * (s - i) - 1e-9)"""
SQL = {
    "p2_found": f"WITH {_PAIRS} SELECT record_id_a, record_id_b FROM f",
    "p2_groups": f"""
WITH RECURSIVE {_PAIRS},
e AS MATERIALIZED (SELECT record_id_a AS a, record_id_b AS b FROM f UNION ALL SELECT record_id_b, record_id_a FROM f),
r AS (SELECT DISTINCT a AS n, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n WHERE r.m < e.b),
g AS (SELECT n, min(m) AS m FROM r GROUP BY n), l AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT record_id, coalesce(g.m, record_id) AS group_id, coalesce(links, 0) AS links FROM dataset LEFT JOIN g ON g.n = record_id LEFT JOIN l ON l.a = record_id""",
}
