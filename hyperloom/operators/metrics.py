"""Grouped statistics of judged questions. All are single-pass aggregations; none collects a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.functions import rewards, text


def valid(c: str) -> Column:
    """A judge's score counts from 1 on; -1 is a failed judgement."""
    return F.coalesce(F.col(c) >= 1, F.lit(False))


def sem(c: str) -> Column:
    """Standard error of the mean; 0 for a single value."""
    return F.coalesce(F.stddev_samp(c) / F.sqrt(F.count(c)), F.lit(0.0))


def mean_sem(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sem(value).alias("sem"))


def confusion(rows: DataFrame, requested: str, judged: str, size: int = 10) -> DataFrame:
    """Dense counts (requested, judged) over 1..size; scores below 1 are left out, larger ones count as ``size``."""
    held = rows.where(valid(requested) & valid(judged)).select(F.least(F.col(requested), F.lit(size)).alias("requested"), F.least(F.col(judged), F.lit(size)).alias("judged"))
    counts = held.groupBy("requested", "judged").agg(F.count(F.lit(1)).alias("n"))
    grid = rows.sparkSession.range(1, size + 1).select(F.col("id").cast("int").alias("requested"), F.explode(F.sequence(F.lit(1), F.lit(size))).alias("judged"))
    return grid.join(F.broadcast(counts), ["requested", "judged"], "left").select("requested", "judged", F.coalesce("n", F.lit(0)).alias("n"))


def bucket(c: str) -> Column:
    """1..3 for up to 3, up to 6 and above."""
    return F.when(F.col(c) <= 3, 1).when(F.col(c) <= 6, 2).otherwise(3)


def alignment(rows: DataFrame, requested: str, judged: str) -> DataFrame:
    """(n, mae, pearson) over valid judgements; pearson is null for a single row or without variance."""
    ok = rows.where(valid(judged) & F.col(requested).isNotNull()).select(F.col(requested).cast("double").alias("x"), F.col(judged).cast("double").alias("y"))
    agg = ok.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("x"))).alias("mae"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.covar_pop("x", "y").alias("c"))
    return agg.select("n", "mae", F.when((F.col("n") > 1) & (F.col("sx") > 0) & (F.col("sy") > 0), F.try_divide("c", F.col("sx") * F.col("sy"))).alias("pearson"))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n) of equal-width bins over min..max, the last one closed; one distinct value fills the first bin."""
    v = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    lo, hi = v.agg(F.min("v")).scalar(), v.agg(F.max("v")).scalar()
    placed = v.select("v", lo.alias("lo"), hi.alias("hi"))
    at = F.least(F.lit(bins), F.coalesce(F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins) + 1, F.lit(1)))
    return placed.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def expected_words(trace: Column) -> Column:
    """Keywords of the target, the leafs and all quantities of the path."""
    path = F.array_join(F.transform(trace["path"], lambda e: F.concat_ws(" ", e["output"], F.array_join(e["inputs"], " "))), " ")
    return text.keywords(F.concat_ws(" ", trace["target"], F.array_join(trace["leafs"], " "), path))


def with_distractors(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``distractors``: sorted vocabulary words of the question that its trace does not account for.

    The vocabulary is that of the graph's variables, a fixed table; it becomes one array by a scalar subquery.
    """
    words = names.select(F.explode(text.keywords(F.col("variable"))).alias("w")).agg(F.collect_set("w")).scalar()
    found = F.array_intersect(text.tokens(F.col("question")), F.col("_v"))
    out = rows.withColumn("_v", words).withColumn("distractors", F.array_sort(F.array_except(found, expected_words(F.col("trace")))))
    return out.drop("_v")


def summary(rows: DataFrame, names: DataFrame) -> DataFrame:
    """One row: counts, faithfulness, feasibility, alignment, distractors and lengths of judged questions."""
    f = F.col("claude_faithfulness")
    enriched = with_distractors(rows, names).withColumn("words", text.word_count(F.col("question"))).withColumn("k", F.size("distractors"))
    feas = F.when(valid("claude_feasibility"), F.col("claude_feasibility"))
    req, got = F.col("requested_difficulty").cast("double"), F.when(valid("claude_difficulty") & F.col("requested_difficulty").isNotNull(), F.col("claude_difficulty").cast("double"))
    x = F.when(got.isNotNull(), req)
    agg = enriched.agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(valid("claude_difficulty")).alias("n_valid"),
        F.avg(f["variable_coverage"]).alias("mean_coverage"), F.avg(f["target_present"].cast("int")).alias("target_rate"), F.avg(f["faithful"].cast("int")).alias("faithful_rate"),
        F.avg(feas).alias("mean_feasibility"), F.median(feas).alias("median_feasibility"),
        F.avg(F.abs(got - x)).alias("mae"), F.covar_pop(x, got).alias("_c"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(got).alias("_sy"),
        F.avg("k").alias("mean_distractors"), F.max("k").alias("max_distractors"), F.avg("words").alias("mean_words"),
    )
    r = F.when((F.col("n_valid") > 1) & (F.col("_sx") > 0) & (F.col("_sy") > 0), F.try_divide("_c", F.col("_sx") * F.col("_sy")))
    return agg.withColumn("pearson", r).drop("_c", "_sx", "_sy")


def combined_frame(log: DataFrame) -> DataFrame:
    """Per step of the runs whose first step is of combined mode: the frame that training curves are drawn from.

    ``log`` has run_id, step, reward_kind, mean_reward, mean_reward_scaled, reward_raw, loss and, where they were logged,
    mean_faithfulness_raw, mean_feasibility_raw and the two weights; means that were not logged are 0, weights one half.
    """
    own = log.where("run_id is not null and step is not null")
    mode = own.groupBy("run_id").agg(F.min_by("reward_kind", "step").alias("_mode")).where("_mode = 'combined'").select("run_id")
    logged = lambda name, value: F.coalesce(F.col(name).cast("double"), F.lit(value)) if name in log.columns else F.lit(value)
    mean = F.try_divide(F.aggregate("reward_raw", F.lit(0.0), lambda a, x: a + x), F.size("reward_raw"))
    return own.join(mode, "run_id").where("reward_raw is not null").select(
        "run_id", "step", mean.alias("combined_mean"), F.coalesce("mean_reward_scaled", "mean_reward").alias("scaled"),
        logged("mean_faithfulness_raw", 0.0).alias("faithfulness_mean"), logged("mean_feasibility_raw", 0.0).alias("feasibility_mean"),
        logged("combined_faith_weight", 0.5).alias("faithfulness_weight"), logged("combined_feas_weight", 0.5).alias("feasibility_weight"), "loss",
    )


def adaptive_frame(rows: DataFrame) -> DataFrame:
    """Per step the frame of the adaptive reward; ``rows`` has step, f, e, d and for each its running mean and weight."""
    own = {c: F.coalesce(c, F.lit(0.0)) for c in "fed"}
    raw = rewards.combined([own[c] for c in "fed"], [F.col(f"w{c}") for c in "fed"])
    names = {"f": "faithfulness", "e": "feasibility", "d": "difficulty"}
    return rows.select(
        "step", *(own[c].alias(f"{n}_mean") for c, n in names.items()), *(F.col(f"w{c}").alias(f"weight_{n}") for c, n in names.items()),
        *(F.col(f"ema_{c}").alias(f"ema_{n}") for c, n in names.items()), raw.alias("combined_mean"), rewards.scaled(raw).alias("scaled"),
    )
