"""Problem 1: splits that keep related records together.

Method: records name quantities, names that occur in one record are linked, and a distributed union-find turns the
links into groups: every partition first builds a local forest, forests are then merged hierarchically. Groups go
largest first to the split furthest below its target.

Defined results: a record whose name keys are all null or empty belongs to no group in ``grouped`` (no row) and is a
group of its own in ``assign``; empty tables give empty results; repeated rows count as often as they occur; extra
columns are ignored. Ties between splits go to the split named first in string order, ties between groups to the
smaller hash of the group's name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.dist import SharedTable, hash_rank, name_key, read_table, shared_table, sized_join, uniform_hash

#: Forest links that one task may merge; beyond it the contraction runs distributed to its end.
FOREST_LINKS = 2_000_000
#: Forests that one task merges at each level of the hierarchy.
FAN_IN = 8


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition; gives a link to the smallest name for each other name of a tree."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                low, high = (a, b) if a < b else (b, a)
                parent[high] = low
    pairs = [(x, find(x)) for x in list(parent)]
    pairs = [(x, y) for x, y in pairs if x != y]
    for at in range(0, len(pairs), 50_000):
        part = pairs[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"a": [x for x, _ in part], "b": [y for _, y in part]})


def components(links: DataFrame, limit: int = FOREST_LINKS) -> SharedTable:
    """(name, group) of every linked name of ``links`` (a, b: strings); group is the smallest name it reaches."""
    spark = links.sparkSession
    forest = links.select("a", "b").mapInArrow(_local_forest, "a string, b string")
    first = shared_table(forest, "forest")
    if first.rows() > limit:
        return _contract(spark, first)
    top = merged(first, _files(first), FAN_IN)
    return shared_table(top.df.select(F.col("a").alias("name"), F.col("b").alias("group")), "components")


def _files(table: SharedTable) -> int:
    return max(1, len(table.df.inputFiles()))


def merged(level: SharedTable, parts: int, fan_in: int) -> SharedTable:
    """One forest of the forests in ``level``: each round merges them ``fan_in`` at a time, side by side, and is written.

    A round's tasks take the links round-robin, so that every one gets its share of each forest; only the last round,
    over at most ``fan_in`` forests, is one task.
    """
    while True:
        parts = max(1, -(-parts // fan_in))
        above = shared_table(level.df.repartition(parts).mapInArrow(_local_forest, "a string, b string"), "forest")
        level.drop()
        level = above
        if parts == 1:
            return level


def _contract(spark, forest: SharedTable) -> SharedTable:
    """Components of a forest too large for one task: roots hook to their smallest neighbour, paths are then halved."""
    names = forest.df.select(F.col("a").alias("name")).union(forest.df.select("b")).distinct()
    label = shared_table(names.select("name", F.col("name").alias("group")), "labels")
    edges = forest
    while edges.rows():
        pairs = edges.df.select(F.greatest("a", "b").alias("r"), F.least("a", "b").alias("to"))
        hooks = shared_table(pairs.groupBy("r").agg(F.min("to").alias("to")), "hooks")
        while True:
            up = hooks.df.select(F.col("r").alias("to"), F.col("to").alias("top"))
            nearer = sized_join(hooks.df, shared_table(up, "up"), "to", "left")
            moved = shared_table(nearer.select("r", F.coalesce("top", "to").alias("to"), F.col("top").isNotNull().alias("m")), "hooks")
            hooks, more = shared_table(moved.df.select("r", "to"), "hooks"), moved.df.where("m").limit(1).count()
            if not more:
                break
        root = shared_table(hooks.df.select(F.col("r").alias("group"), "to"), "root")
        label = shared_table(sized_join(label.df, root, "group", "left").select("name", F.coalesce("to", "group").alias("group")), "labels")
        ends = edges.df
        for c in ("a", "b"):
            at = shared_table(hooks.df.select(F.col("r").alias(c), F.col("to").alias("_t")), "ends")
            ends = sized_join(ends, at, c, "left").withColumn(c, F.coalesce("_t", c)).drop("_t")
        edges = shared_table(ends.where("a <> b").distinct(), "edges")
    return shared_table(label.df.where("name <> `group`"), "components")


def grouped(records: DataFrame, record: str, names: list[str], nameless: bool = False) -> DataFrame:
    """(record, group_name) of each record that has a name key in at least one of the columns ``names``.

    With ``nameless`` the others come, too, each as a group of its own, called # and its record.
    """
    keys = [f"_k{i}" for i in range(len(names))]
    keyed = records.select(F.col(record), *(name_key(n).alias(k) for n, k in zip(names, keys)))
    keyed = keyed.withColumn("_k", F.coalesce(*keys, *([F.concat(F.lit("#"), F.col(record).cast("string"))] if nameless else [])))
    keyed = keyed.where(F.col("_k").isNotNull())
    links = [keyed.where(F.col(k) != F.col("_k")).select(F.least("_k", k).alias("a"), F.greatest("_k", k).alias("b")) for k in keys[1:]]
    pairs = links[0]
    for more in links[1:]:
        pairs = pairs.union(more)
    of = components(pairs.distinct())
    found = sized_join(keyed.select(record, F.col("_k").alias("name")), of, "name", "left")
    return found.select(record, F.coalesce("group", "name").alias("group_name"))


def _give(room: dict[str, float], size: int, count: int) -> dict[str, int]:
    """How many of ``count`` groups of one size each split gets, each going to the split furthest below target.

    The same as dealing them singly: all but the last few follow from the level to which the splits' rooms are filled.
    """
    got = {s: 0 for s in room}
    if count > 4 * len(room):
        low, high = min(room.values()) - float(size) * (count + 1), max(room.values())
        for _ in range(100):  # the lowest level reached with fewer than count groups
            mid = (low + high) / 2
            if sum(max(0, int((r - mid) // size)) for r in room.values()) > count - len(room):
                low = mid
            else:
                high = mid
        for s, r in room.items():
            got[s] = max(0, int((r - high) // size))
    heap = [(-(r - got[s] * size), s) for s, r in room.items()]
    heapq.heapify(heap)
    for _ in range(count - sum(got.values())):
        below, s = heap[0]
        got[s] += 1
        heapq.heapreplace(heap, (below + size, s))
    for s in room:
        room[s] -= got[s] * size
    return got


def greedy_plan(sizes: list[tuple[int, int]], shares: dict[str, float]) -> list[tuple[int, str, int, int]]:
    """(size, split, from, to): which places of the groups of each size go to which split. sizes: (size, groups)."""
    total, whole = sum(n * c for n, c in sizes), sum(shares.values()) or 1
    room = {s: total * share / whole for s, share in sorted(shares.items())}
    plan = []
    for n, c in sorted(sizes, reverse=True):
        at = 0
        for s, k in _give(room, n, c).items():
            if k:
                plan.append((n, s, at, at + k))
                at += k
    return plan


def assign(records: DataFrame, record: str, names: list[str], shares: DataFrame) -> DataFrame:
    """(plan_id, record, split_name) of every record for every plan of ``shares`` (plan_id, split_name, share_pct).

    The driver holds the counts of groups by size (at most the square root of twice the records) and the shares.
    """
    spark = records.sparkSession
    of = shared_table(grouped(records, record, names, nameless=True), "groups")
    sizes = shared_table(of.df.groupBy("group_name").agg(F.count(F.lit(1)).alias("size")), "sizes")
    classes = [(r["size"], r["count"]) for r in sizes.df.groupBy("size").count().collect()]
    plans: dict[str, dict[str, float]] = {}
    for r in shares.where("plan_id is not null and split_name is not null").groupBy("plan_id", "split_name").agg(F.sum("share_pct").alias("s")).collect():
        plans.setdefault(r["plan_id"], {})[r["split_name"]] = float(r["s"] or 0)
    rows = [(p, *x) for p, own in sorted(plans.items()) for x in greedy_plan(classes, own)]
    plan = shared_table(spark.createDataFrame(rows, "plan_id string, size long, split_name string, low long, high long"), "plan")
    ranked = hash_rank(sizes.df, ["size"], uniform_hash("group_name"), ["group_name"], sizes.rows(), "place")
    placed = sized_join(ranked, plan, "size").where("place >= low and place < high").select("plan_id", "group_name", "split_name")
    return sized_join(of.df, shared_table(placed, "placed"), "group_name").select("plan_id", record, "split_name")


def _dataset(spark, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "dataset").select("record_id", "target", F.col("trace.target").alias("trace_target"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Records and the smallest name key of their group."""
    return grouped(_dataset(spark, sf_dir), "record_id", ["target", "trace_target"])


def p1_split(spark, sf_dir: str) -> DataFrame:
    """Every record's split under every plan."""
    return assign(_dataset(spark, sf_dir), "record_id", ["target", "trace_target"], read_table(spark, sf_dir, "split_shares"))


QUERIES = {"p1_found": p1_found, "p1_split": p1_split}

#: Components by a recursive walk over the distinct links.
SQL = {
    "p1_found": """
WITH RECURSIVE k AS (
  SELECT record_id, nullif(regexp_replace(lower(target), '[^a-z0-9]', '', 'g'), '') AS a,
         nullif(regexp_replace(lower(trace.target), '[^a-z0-9]', '', 'g'), '') AS b FROM dataset),
e AS (SELECT DISTINCT a, b FROM k WHERE a <> b),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS n, a AS m FROM s UNION SELECT s.b, r.m FROM r JOIN s ON s.a = r.n)
SELECT record_id, coalesce(g.m, coalesce(k.a, k.b)) AS group_name
FROM k LEFT JOIN (SELECT n, min(m) AS m FROM r GROUP BY n) g ON g.n = coalesce(k.a, k.b)
WHERE coalesce(k.a, k.b) IS NOT NULL""",
}
