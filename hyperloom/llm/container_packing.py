"""Problem 7: filling fixed-capacity containers with items.

Method: exact-complement hashing on the histogram of item lengths (at most ``capacity`` entries, whatever the data's
size). The longest length still available opens a container; its gap is looked up among the available single lengths,
then among pair sums, then among triple sums. A gap that no combination fills takes the longest fitting length (best
fit) and is looked up again. The filling found is repeated as often as the counts allow, so every one uses up a length
and the plan has a few rows per length. Items are then ranked
inside their length in parallel, and a rank finds its container by binary search in the plan.

Items longer than the capacity are divided into full containers and one rest, other items never.

Defined results: items of null, zero or negative size take no room and give no row; equal items are separate; an empty
table gives no rows; extra columns are ignored. Ties between equal lengths go by the hash of the id, then the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hyperloom.dist import RANK_ROWS, hash_rank, shared_table, uniform_hash
from hyperloom.llm.corpus_encoding import documents, token_counts

#: Tokens a container holds.
CAPACITY = 2048


class Lengths:
    """Counts of the lengths 1..capacity still available, with bit sets of them and of their complements.

    Bit x of ``there`` tells that length x is left, bit capacity - x of ``mirror`` the same; so the lengths whose
    partner for a sum is left, too, are the bits of one shift and one and.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.left = capacity, [0] * (capacity + 1)
        self.there = self.mirror = 0
        for size, n in counts.items():
            if n > 0:
                self.left[size] = n
                self.there |= 1 << size
                self.mirror |= 1 << (capacity - size)

    def take(self, size: int, n: int = 1) -> None:
        self.left[size] -= n
        if not self.left[size]:
            self.there ^= 1 << size
            self.mirror ^= 1 << (self.capacity - size)

    def pairs(self, total: int) -> int:
        """Bits of the lengths that some length left adds up to the total with."""
        return self.there & self.mirror >> (self.capacity - total)

    def longest(self, most: int) -> int:
        """The longest length left up to ``most``; 0 if none is."""
        return max(0, (self.there & (2 << most) - 1).bit_length() - 1)

    def complement(self, gap: int) -> list[int]:
        """Up to three lengths left that sum to the gap, the fewest first and of these the longest; [] if there are none."""
        left = self.left
        if left[gap]:
            return [gap]
        for a in _down(self.pairs(gap)):
            if a != gap - a or left[a] > 1:
                return [a, gap - a]
        for a in _down(self.there & (1 << max(gap - 1, 0)) - 1):
            for b in _down(self.pairs(gap - a) & (2 << a) - 1):
                c = gap - a - b
                if left[b] > (b == a) and left[c] > (c == a) + (c == b):
                    return [a, b, c]
        return []


def _down(bits: int) -> Iterator[int]:
    """Set bits from the highest to the lowest, without bit 0."""
    while bits > 1:
        top = bits.bit_length() - 1
        yield top
        bits ^= 1 << top


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(items per container by length, number of such containers) for the counts of lengths 1..capacity.

    A container is filled from the longest length left; the same filling is repeated as often as the counts allow, so
    that every entry uses up one of its lengths but for a remainder.
    """
    lengths = Lengths(counts, capacity)
    plan: list[tuple[dict[int, int], int]] = []
    while size := lengths.longest(capacity):
        use, gap, fill = {}, capacity, [size]
        while fill:
            for x in fill:
                use[x] = use.get(x, 0) + 1
                lengths.take(x)
                gap -= x
            fill = lengths.complement(gap) if gap else []
            if not fill and gap and (x := lengths.longest(gap)):
                fill = [x]
        more = min(lengths.left[x] // k for x, k in use.items())
        if more:
            for x, k in use.items():
                lengths.take(x, more * k)
        plan.append((use, 1 + more))
    return plan


def _slots(plan: list[tuple[dict[int, int], int]], first: int, capacity: int) -> dict[str, np.ndarray]:
    """The plan by length: ranks from ``low`` on go to containers from ``base`` on, ``per`` to each."""
    used = np.zeros(capacity + 1, dtype=np.int64)
    rows: list[tuple[int, int, int, int]] = []
    at = first
    for items, times in plan:
        for x, k in items.items():
            rows.append((x, int(used[x]), at, k))
            used[x] += k * times
        at += times
    rows.sort()
    size, low, base, per = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))
    return {"size": size, "low": low, "base": base, "per": per, "starts": np.searchsorted(size, np.arange(capacity + 2))}


def _place(batches: Iterator[pa.RecordBatch], slots: dict[str, np.ndarray], capacity: int) -> Iterator[pa.RecordBatch]:
    stride = np.int64(1) << 40  # ranks of one length stay below
    keys = slots["size"] * stride + slots["low"]
    for batch in batches:
        size = np.asarray(batch.column("size"), dtype=np.int64)
        rank = np.asarray(batch.column("rank"), dtype=np.int64)
        at = np.searchsorted(keys, size * stride + rank, side="right") - 1
        box = slots["base"][at] + (rank - slots["low"][at]) // slots["per"][at]
        yield pa.RecordBatch.from_arrays([pa.array(box), batch.column("id"), batch.column("part"), pa.array(size)], names=["container", "id", "part", "size"])


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, id, part, size) of every piece of ``items`` (id bigint, n bigint).

    Part counts the pieces of an item from 0; only items longer than the capacity have more than one. The driver holds
    the histogram of rests (at most ``capacity`` entries) and the plan made from it.
    """
    spark = items.sparkSession
    sizes = shared_table(items.select("id", F.col("n").cast("long").alias("n")).where("n > 0"), "sizes")
    whole, rest = F.floor(F.col("n") / capacity).cast("long"), F.col("n") % capacity
    rests = sizes.df.select("id", whole.cast("int").alias("part"), rest.alias("size")).where("size > 0")
    counts = {r["size"]: r["count"] for r in rests.groupBy("size").count().collect()}
    plan = packing_plan(counts, capacity)
    boxes = sum(times for _, times in plan)
    held = spark.sparkContext.broadcast(_slots(plan, 0, capacity))
    ranked = hash_rank(rests, ["size"], uniform_hash("id"), ["id"], sizes.rows(), "rank")
    placed = ranked.select("id", "part", "size", "rank").mapInArrow(lambda it: _place(it, held.value, capacity), "container long, id long, part int, size long")
    # Full pieces: one container each, numbered after the others by item in a running order of hashed buckets.
    long = sizes.df.where(F.col("n") >= capacity).select("id", whole.alias("full"))
    own = _running(long, "full", boxes, sizes.rows())
    full = own.select(F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)).alias("part"), "id", "first").select((F.col("first") + F.col("part")).alias("container"), "id", "part", F.lit(capacity).cast("long").alias("size"))
    return placed.unionByName(full)


def _running(rows: DataFrame, amount: str, start: int, most: int) -> DataFrame:
    """Adds ``first``: start plus the amounts of all rows before, rows ordered by (hashed bucket, hash, id).

    ``most`` bounds the rows; buckets hold ``RANK_ROWS`` of them on average.
    """
    bits = max(4, (most // RANK_ROWS).bit_length())
    hashed = rows.withColumn("_o", uniform_hash("id")).withColumn("_b", F.shiftright("_o", 63 - bits).cast("int"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over one row a bucket
    starts = hashed.groupBy("_b").agg(F.sum(amount).alias("_n")).withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_b").orderBy("_o", "id").rowsBetween(Window.unboundedPreceding, -1)
    out = hashed.join(F.broadcast(starts), "_b").withColumn("first", F.lit(start) + F.col("_s") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return out.drop("_o", "_b", "_s")


def p7_containers(spark, sf_dir: str) -> DataFrame:
    """Containers of 2,048 tokens with their documents and token counts."""
    out = pack(token_counts(documents(spark, sf_dir)))
    return out.select(F.col("container").alias("container_id"), F.col("id").alias("doc_id"), "part", F.col("size").alias("n_tokens"))


QUERIES, SQL = {"p7_containers": p7_containers}, {}
