"""Problem 4: choosing a varied subset.

Method: records become hashed feature vectors (one-hot of the key of each subdomain, target and leaf, scaled so that
each of the three fields weighs the same). Equal combinations of the three fields share one vector, so mini-batch
k-means runs over combinations: every batch is a hashed sample of them, its sums per centre are aggregated on the
executors, and only k centres reach the driver. Clusters get square-root quotas; slots that a cluster cannot use for
something new are dealt out again. Inside a cluster the quota is levelled over its combinations, so the rare ones come in whole and the
crowded ones are cut to one level; inside a combination each different question counts once, and repeats are taken
only when all different questions are in.

Defined results: null fields are a value of their own; null and empty questions are one question; repeated rows are
repeats; a subset larger than the table is the table; an empty table gives no rows. Everything is ordered by hashes of
the content and record_id, so a rerun or a lost executor gives the same subset.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hyperloom.dist import hash_rank, name_key, read_table, shared_table, sized_join, uniform_hash

#: Width of the hashed feature vectors.
WIDTH = 256
#: Clusters, batches and combinations a batch draws on average.
CLUSTERS, BATCHES, BATCH_ROWS = 64, 8, 20_000


def _vectors(slots: pa.Array, weights: pa.Array) -> np.ndarray:
    """Dense matrix of the rows' hashed slots."""
    out = np.zeros((len(slots), WIDTH), dtype=np.float32)
    flat, rows = np.asarray(slots.flatten()), np.repeat(np.arange(len(slots)), np.diff(np.asarray(slots.offsets)))
    np.add.at(out, (rows, flat), np.asarray(weights.flatten(), dtype=np.float32))
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)


def _batch_sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums and counts of the partition's vectors per nearest centre."""
    sums, counts = np.zeros_like(centres), np.zeros(len(centres), dtype=np.int64)
    for batch in batches:
        for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
            x = _vectors(part.column(0), part.column(1))
            near = _nearest(x, centres)
            np.add.at(sums, near, x)
            counts += np.bincount(near, minlength=len(centres))
    seen = np.flatnonzero(counts)
    if len(seen):
        yield pa.RecordBatch.from_pydict({"c": pa.array(seen, pa.int32()), "n": pa.array(counts[seen], pa.int64()), "s": pa.array([v.tolist() for v in sums[seen]], pa.list_(pa.float32()))})


def _assign(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
            near = _nearest(_vectors(part.column("slots"), part.column("weights")), centres)
            yield pa.RecordBatch.from_arrays([part.column("combo"), pa.array(near, pa.int32())], names=["combo", "cluster"])


def minibatch_kmeans(combos: DataFrame, rows: int, k: int = CLUSTERS, batches: int = BATCHES, batch_rows: int = BATCH_ROWS) -> np.ndarray:
    """Centres over ``combos`` (combo bigint hash, slots, weights). Starts from the k combinations of smallest hash."""
    start = combos.orderBy("combo").limit(k).select("slots", "weights").toArrow()
    if not start.num_rows:
        return np.zeros((1, WIDTH), dtype=np.float32)
    centres = _vectors(start["slots"].combine_chunks(), start["weights"].combine_chunks())
    seen = np.zeros(len(centres))
    share = min(1.0, batch_rows / max(1, rows))
    for b in range(batches):
        batch = combos.where(uniform_hash("combo", seed=b + 1) < F.lit(int(share * 0x7FFFFFFFFFFFFFFF))) if share < 1 else combos
        part = batch.select("slots", "weights").mapInArrow(lambda it, c=centres: _batch_sums(it, c), "c int, n long, s array<float>")
        sums, counts = np.zeros_like(centres), np.zeros(len(centres))
        merged = part.repartition(8, "c").mapInArrow(_merge_sums, "c int, n long, s array<float>")
        for r in merged.collect():  # at most k rows
            sums[r["c"]], counts[r["c"]] = np.array(r["s"], dtype=np.float32), r["n"]
        got = counts > 0
        seen[got] += counts[got]
        rate = (counts[got] / seen[got])[:, None]  # every centre's own learning rate
        centres[got] += (rate * (sums[got] / counts[got][:, None] - centres[got])).astype(np.float32)
    return centres


def _merge_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for c, n, s in zip(*(x.to_pylist() for x in batch.columns)):
            own = total.setdefault(c, [0, np.zeros(WIDTH, dtype=np.float64)])
            own[0] += n
            own[1] += np.array(s)
    if total:
        yield pa.RecordBatch.from_pydict({"c": pa.array(list(total), pa.int32()), "n": pa.array([v[0] for v in total.values()], pa.int64()), "s": pa.array([v[1].tolist() for v in total.values()], pa.list_(pa.float32()))})


def root_quotas(sizes: dict[int, int], tiers: list[dict[int, int]], size: int) -> dict[int, int]:
    """Quotas that sum to size (or all rows), in proportion to the square roots of the clusters' sizes.

    Slots are dealt up to the first tier's caps (combinations), then to the next (different texts, then all rows), so
    that no cluster repeats itself while another still has something new. What a cluster cannot use is dealt again.
    """
    got, left = {c: 0 for c in sizes}, min(size, sum(sizes.values()))
    for cap in tiers:
        while left > 0:
            live = {c: math.sqrt(n) for c, n in sizes.items() if got[c] < cap[c]}
            if not live:
                break
            whole = sum(live.values())
            offer = {c: left * r / whole for c, r in live.items()}
            give = {c: min(cap[c] - got[c], int(x)) for c, x in offer.items()}
            if not any(give.values()):  # fewer slots than clusters: largest remainders, smaller cluster number first
                give = {c: 1 for c in sorted(live, key=lambda c: (-offer[c], c))[:left]}
            for c, g in give.items():
                got[c] += g
                left -= g
    return got


def varied_subset(records: DataFrame, size: int, clusters: int = CLUSTERS) -> DataFrame:
    """(record, cluster) of ``size`` records out of ``records`` (record, subdomains, target, leafs, question)."""
    spark = records.sparkSession
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), name_key), lambda x: x.isNotNull())))
    rows = records.select("record", clean(F.col("subdomains")).alias("s"), F.array_compact(F.array(name_key("target"))).alias("t"), clean(F.col("leafs")).alias("l"), F.xxhash64(F.regexp_replace(F.lower(F.coalesce("question", F.lit(""))), r"\s+", " ")).alias("q"))
    rows = rows.withColumn("combo", uniform_hash("s", "t", "l"))
    # Repeats collapse before anything is shuffled by combination: (combo, question) with its count and its representative,
    # the record of the smallest hash. The source is read once for all that.
    own = rows.withColumn("o", uniform_hash("record"))
    texts = shared_table(own.groupBy("combo", "q").agg(F.count(F.lit(1)).alias("n"), F.min_by("record", "o").alias("record"), F.first("s").alias("s"), F.first("t").alias("t"), F.first("l").alias("l")), "texts")
    by_combo = texts.df.groupBy("combo").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.first("s").alias("s"), F.first("t").alias("t"), F.first("l").alias("l"))
    slot = lambda c, seed: F.transform(c, lambda x: F.pmod(F.xxhash64(x, F.lit(seed)), F.lit(WIDTH)).cast("int"))
    weight = lambda c: F.transform(c, lambda x: (1 / F.sqrt(F.size(c))).cast("float"))
    combos = shared_table(by_combo.select("combo", "n", "texts", F.concat(slot("s", 1), slot("t", 2), slot("l", 3)).alias("slots"), F.concat(weight(F.col("s")), weight(F.col("t")), weight(F.col("l"))).alias("weights")), "combos")
    centres = minibatch_kmeans(combos.df, combos.rows(), clusters)
    near = shared_table(combos.df.select("combo", "slots", "weights").mapInArrow(lambda it: _assign(it, centres), "combo long, cluster int"), "near")
    at = shared_table(sized_join(combos.df.select("combo", "n", "texts"), near, "combo"), "at")

    found = at.df.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"), F.count(F.lit(1)).alias("combos")).collect()  # at most k rows
    sizes = {r["cluster"]: r["n"] for r in found}
    quota = root_quotas(sizes, [{r["cluster"]: r[c] for r in found} for c in ("combos", "texts", "n")], size)
    # Levels: the combinations of one cluster take turns, first over different questions, then over repeats. The level
    # is found on the histogram of sizes, which has at most the square root of twice the rows.
    turns = _levels(at.df.select("cluster", F.col("texts").alias("m")), quota)
    first = {c: min(quota[c], t["filled"]) for c, t in turns.items()}
    repeat = _levels(at.df.select("cluster", (F.col("n") - F.col("texts")).alias("m")), {c: quota[c] - first[c] for c in quota})
    levels = spark.createDataFrame([(c, turns[c]["level"], turns[c]["extra"], repeat[c]["level"], repeat[c]["extra"]) for c in quota], "cluster int, level long, extra long, again long, more long")
    plan = at.df.join(F.broadcast(levels), "cluster")
    plan = _extras(plan, F.col("texts"), "level", "extra", "take", at.rows())
    plan = _extras(plan, F.col("n") - F.col("texts"), "again", "more", "repeats", at.rows())
    plan = shared_table(plan.select("combo", "cluster", "take", "repeats").where("take > 0"), "plan")

    reps = texts.df.select("combo", "record")
    ranked = hash_rank(reps, ["combo"], uniform_hash("record"), ["record"], texts.rows(), "place")
    chosen = sized_join(ranked, plan, "combo").where("place < take").select("record", "cluster")
    wanting = shared_table(plan.df.where("repeats > 0"), "wanting")
    if not wanting.rows():
        return chosen
    rep = shared_table(reps.select("record"), "reps")
    others = sized_join(sized_join(rows.select("record", "combo"), wanting, "combo"), rep, "record", "left_anti")
    again = hash_rank(others, ["combo"], uniform_hash("record"), ["record"], sum(sizes.values()), "place").where("place < repeats")
    return chosen.union(again.select("record", "cluster"))


def _levels(members: DataFrame, quota: dict[int, int]) -> dict[int, dict[str, int]]:
    """Of each cluster, the level to which its members (cluster, m) are filled by the quota and the slots left over."""
    hist: dict[int, list[tuple[int, int]]] = {c: [] for c in quota}
    for r in members.where("m > 0").groupBy("cluster", "m").count().collect():
        hist[r["cluster"]].append((r["m"], r["count"]))
    out = {}
    for c, own in hist.items():
        left, level, live, filled = quota[c], 0, sum(k for _, k in own), 0
        for m, k in sorted(own):
            step = min(m - level, left // live)
            level, left, filled = level + step, left - step * live, filled + step * live
            if step < 1 and level < m or left < live and level < m:
                break
            live -= k
        extra = min(left, live)
        out[c] = {"level": level, "extra": extra, "filled": filled + extra}
    return out


def _extras(plan: DataFrame, has, level: str, extra: str, name: str, rows: int) -> DataFrame:
    """min(level, has) slots each, and one more for the first ``extra`` members above the level in hash order."""
    above = plan.withColumn("_above", (has > F.col(level)).cast("int"))
    ranked = hash_rank(above, ["cluster", "_above"], uniform_hash("combo", seed=7), ["combo"], rows, "_place")
    more = F.when((F.col("_above") == 1) & (F.col("_place") < F.col(extra)), 1).otherwise(0)
    return ranked.withColumn(name, F.least(F.col(level), has) + more).drop("_above", "_place")


def p4_subset(spark, sf_dir: str) -> DataFrame:
    """A twentieth of the dataset's records, spread over their combinations, with the cluster of each."""
    data = read_table(spark, sf_dir, "dataset").select(F.col("record_id").alias("record"), "trace.subdomains", "target", "trace.leafs", "question")
    return varied_subset(data, data.count() // 20).withColumnRenamed("record", "record_id")


QUERIES, SQL = {"p4_subset": p4_subset}, {}
