"""Problem 3: a sample that matches target proportions of categories.

Method: category moments (records per cell) are aggregated distributedly; the weights of the cells are calibrated by
Newton iterations on the dual of exponential tilting, cells held by their floor or emptied by their supply are fixed
and the rest is solved again; records are then drawn with the resulting probabilities by the pivotal method, run in
parallel over hashed buckets whose one undecided record each meets in a second round. The draw has exactly the
calibrated number of each cell.

A record is in a plan's cell if its difficulty is equal and the first entry of its chapters has the name key of the
cell's chapter. Needed is the greater of the floor and the share of the sample size rounded up; a cell with fewer
records than needed is reported with the gap, and then takes all that it has.

Defined results: null or empty chapters, null difficulties and cells of no plan give no row; an empty table gives an
empty sample and reports every cell with a need; repeated rows are records of their own; a plan whose floors exceed
its sample size keeps the floors; cells of equal key in a plan are merged with their shares added, and the first
chapter spelling in string order is reported.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.dist import name_key, read_table, shared_table, uniform_hash

#: Records of a cell that one bucket of the pivotal draw holds on average.
BUCKET_ROWS = 20_000


def newton_tilt(base: np.ndarray, want: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Tilting parameters l with base * exp(l) = want, from the concave dual sum(want * l) - sum(base * exp(l)).

    base > 0, want >= 0; a cell of no want gets minus infinity. Steps are damped so that the dual never falls.
    """
    lam = np.zeros(len(base))
    live = want > 0
    b, w, x = base[live], want[live], np.zeros(int(live.sum()))
    for _ in range(rounds):
        moment = b * np.exp(x)
        gradient = w - moment
        if np.all(np.abs(gradient) <= 1e-9 * np.maximum(1, w)):
            break
        x = x + np.clip(gradient / moment, -1, 1)  # the Hessian of the dual is minus the diagonal of the moments
    lam[live], lam[~live] = x, -np.inf
    return lam


def calibrate(counts: list[int], share: list[float], floor: list[int], size: int) -> tuple[list[int], list[float]]:
    """(records to draw, inclusion probability) of each cell.

    Targets are size * share; cells below their floor are fixed at it, cells without enough records at what they have,
    and the remaining size is spread over the others in proportion, by Newton steps on the dual at every turn.
    """
    n, s = np.array(counts, dtype=float), np.array(share, dtype=float)
    low = np.minimum(np.array(floor, dtype=float), n)
    fixed, drawn = np.full(len(n), False), np.zeros(len(n))
    while not fixed.all():
        free = ~fixed
        rest, weight = max(0.0, size - drawn[fixed].sum()), s[free].sum()
        want = rest * s[free] / weight if weight > 0 else np.zeros(int(free.sum()))
        base = np.maximum(n[free], 1e-12) * max(1e-12, size / max(1.0, n.sum()))
        moment = base * np.exp(newton_tilt(base, want))
        over, under = moment > n[free] + 1e-9, moment < low[free] - 1e-9
        at = np.flatnonzero(free)
        # Fix the side that errs more; the other may come right once the rest is spread again.
        if (moment - n[free])[over].sum() >= (low[free] - moment)[under].sum() and over.any():
            drawn[at[over]], fixed[at[over]] = n[free][over], True
        elif under.any():
            drawn[at[under]], fixed[at[under]] = low[free][under], True
        else:
            drawn[at], fixed[at] = moment, True
    whole = np.floor(drawn + 1e-9)
    left = int(round(drawn.sum())) - int(whole.sum())
    for i in sorted(range(len(n)), key=lambda i: (-(drawn[i] - whole[i]), i)):  # largest remainders first
        if left > 0 and whole[i] < n[i] and drawn[i] > whole[i]:
            whole[i] += 1
            left -= 1
    return [int(x) for x in whole], [float(x / c) if c else 0.0 for x, c in zip(whole, n)]


def pivotal(ids: list[int], probabilities: list[float], seed: int) -> tuple[list[int], tuple[int, float] | None]:
    """Sequential pivotal method: the chosen ids and the one that stays undecided with its probability."""
    draw = np.random.Generator(np.random.PCG64(seed)).random(2 * len(ids) + 2)
    chosen, used, hold = [], 0, None
    for i, p in zip(ids, probabilities):
        if p >= 1 - 1e-12:
            chosen.append(i)
        elif p > 1e-12:
            if hold is None:
                hold = (i, p)
                continue
            j, q = hold
            total = p + q
            u, used = draw[used], used + 1
            if total < 1 - 1e-12:  # one of the two is out, the other carries both chances
                hold = (j, total) if u < q / total else (i, total)
            else:  # one of the two is in, the other carries what is over one
                win_j = (1 - p) / (2 - total) if total < 2 - 1e-12 else 0.5
                chosen.append(j if u < win_j else i)
                rest = total - 1
                hold = ((i if u < win_j else j), rest) if rest > 1e-12 else None
    return chosen, hold


def _draw_buckets(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One bucket of a cell, its records with one probability each; decided ids come with p = 1."""
    plan, cell, bucket = (k.as_py() for k in keys)
    t = table.sort_by([("_o", "ascending"), ("record", "ascending")])
    seed = xxhash.xxh3_64_intdigest(f"{plan}|{cell}|{bucket}")
    chosen, hold = pivotal(t["record"].to_pylist(), t["p"].to_pylist(), seed)
    rows = [(i, 1.0) for i in chosen] + ([hold] if hold else [])
    return pa.table({"plan_id": pa.array([plan] * len(rows), pa.string()), "cell": pa.array([cell] * len(rows), pa.int32()), "_o": pa.array([bucket] * len(rows), pa.int64()), "record": pa.array([i for i, _ in rows], pa.int64()), "p": pa.array([p for _, p in rows], pa.float64())})


class Plan:
    """The calibrated cells of all plans: (plan, cell, chapter, key, difficulty, records, needed, drawn, probability)."""

    def __init__(self, cells: list[dict]) -> None:
        self.cells = cells

    def gaps(self, spark) -> DataFrame:
        rows = [(c["plan_id"], c["chapter"], c["difficulty"], c["records"], c["needed"], c["needed"] - c["records"]) for c in self.cells if c["records"] < c["needed"]]
        return spark.createDataFrame(rows, "plan_id string, chapter string, requested_difficulty int, records long, needed long, missing long")


def plan_sample(records: DataFrame, mix: DataFrame) -> Plan:
    """Calibrates every plan of ``mix`` on ``records`` (key, difficulty). The driver holds the plans' cells only."""
    cells = mix.select("plan_id", "chapter", name_key("chapter").alias("key"), F.col("requested_difficulty").alias("difficulty"), "share_pct", "min_rows", "sample_size")
    cells = cells.where("plan_id is not null and key is not null and difficulty is not null")
    wanted = cells.select("key", "difficulty").distinct()
    moments = records.select("key", "difficulty").join(F.broadcast(wanted), ["key", "difficulty"], "left_semi").groupBy("key", "difficulty").agg(F.count(F.lit(1)).alias("records"))
    have = {(r["key"], r["difficulty"]): r["records"] for r in moments.collect()}
    plans: dict[str, dict] = {}
    for r in sorted(cells.collect(), key=lambda r: (r["plan_id"], r["key"], r["difficulty"], r["chapter"])):
        own = plans.setdefault(r["plan_id"], {})
        c = own.setdefault((r["key"], r["difficulty"]), {"plan_id": r["plan_id"], "chapter": r["chapter"], "key": r["key"], "difficulty": r["difficulty"], "share": 0, "floor": 0, "size": 0})
        c["share"] += r["share_pct"] or 0
        c["floor"] = max(c["floor"], r["min_rows"] or 0)
        c["size"] = max(c["size"], r["sample_size"] or 0)
    out = []
    for own in plans.values():
        rows = list(own.values())
        size = max(c["size"] for c in rows)
        counts = [have.get((c["key"], c["difficulty"]), 0) for c in rows]
        drawn, p = calibrate(counts, [c["share"] / 100 for c in rows], [c["floor"] for c in rows], size)
        for i, c in enumerate(rows):
            needed = max(c["floor"], -(-c["share"] * size // 100))
            out.append(c | {"cell": i, "records": counts[i], "needed": int(needed), "drawn": drawn[i], "p": p[i]})
    return Plan(out)


def draw(records: DataFrame, plan: Plan) -> DataFrame:
    """(plan_id, record, key, difficulty) of the sampled ``records`` (record, key, difficulty)."""
    spark = records.sparkSession
    rows = [(c["plan_id"], c["cell"], c["key"], c["difficulty"], c["p"], max(1, math.ceil(c["records"] / BUCKET_ROWS))) for c in plan.cells if c["p"] > 0]
    cells = spark.createDataFrame(rows, "plan_id string, cell int, key string, difficulty int, p double, buckets int")
    own = records.select("record", "key", "difficulty").join(F.broadcast(cells), ["key", "difficulty"])
    own = own.withColumn("_o", uniform_hash("plan_id", "record"))
    sure = own.where("p >= 1").select("plan_id", "cell", "record")
    split = own.where("p < 1").withColumn("bucket", F.pmod(F.col("_o"), F.col("buckets")))
    schema = "plan_id string, cell int, _o long, record long, p double"
    first = shared_table(split.groupBy("plan_id", "cell", "bucket").applyInArrow(_draw_buckets, schema), "drawn")
    # One undecided record a bucket, so a cell's second round is as small as its number of buckets.
    open_rows = first.df.where("p < 1").withColumn("bucket", F.lit(-1).cast("long"))
    second = open_rows.groupBy("plan_id", "cell", "bucket").applyInArrow(_draw_buckets, schema)
    # Probabilities of a cell sum to a whole number, so what is left undecided is in or out but for rounding.
    decided = first.df.where("p = 1").union(second.where("p > 0.5")).select("plan_id", "cell", "record")
    chosen = sure.union(decided)
    return chosen.join(F.broadcast(cells.select("plan_id", "cell", "key", "difficulty")), ["plan_id", "cell"]).select("plan_id", "record", "key", "difficulty")


def _dataset(spark, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "dataset").select(F.col("record_id").alias("record"), name_key(F.get("trace.chapters", F.lit(0))).alias("key"), F.col("requested_difficulty").alias("difficulty"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Cells of target_mix that have fewer records than needed.

    By the problem's definition these follow from the counts of the cells alone; the calibration that runs with them decides
    what ``p3_sample`` draws.
    """
    plan = plan_sample(_dataset(spark, sf_dir), read_table(spark, sf_dir, "target_mix"))
    return plan.gaps(spark).select("plan_id", "chapter", "requested_difficulty")


def p3_gaps(spark, sf_dir: str) -> DataFrame:
    """The same cells with the records they have, need and miss."""
    return plan_sample(_dataset(spark, sf_dir), read_table(spark, sf_dir, "target_mix")).gaps(spark)


def p3_sample(spark, sf_dir: str) -> DataFrame:
    """The sampled records of every plan."""
    records = _dataset(spark, sf_dir)
    return draw(records, plan_sample(records, read_table(spark, sf_dir, "target_mix"))).withColumnRenamed("record", "record_id").withColumnRenamed("key", "chapter_key").withColumnRenamed("difficulty", "requested_difficulty")


QUERIES = {"p3_found": p3_found, "p3_gaps": p3_gaps, "p3_sample": p3_sample}

_CELLS = """
WITH h AS (SELECT regexp_replace(lower(trace.chapters[1]), '[^a-z0-9]', '', 'g') AS k, requested_difficulty AS d, count(*) AS n FROM dataset GROUP BY 1, 2),
c AS (SELECT plan_id, chapter, requested_difficulty, greatest(min_rows, CAST(ceil(share_pct * sample_size / 100) AS BIGINT)) AS needed,
             coalesce((SELECT sum(n) FROM h WHERE h.k = regexp_replace(lower(chapter), '[^a-z0-9]', '', 'g') AND h.d = requested_difficulty), 0)::BIGINT AS records
      FROM target_mix)
"""
SQL = {
    "p3_found": _CELLS + "SELECT plan_id, chapter, requested_difficulty FROM c WHERE records < needed",
    "p3_gaps": _CELLS + "SELECT plan_id, chapter, requested_difficulty, records, needed, needed - records AS missing FROM c WHERE records < needed",
}
