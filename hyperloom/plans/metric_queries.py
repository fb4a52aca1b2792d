"""Aggregations over judged questions, traces and training logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyperloom.dist import read_table
from hyperloom.functions import text
from hyperloom.operators import metrics
from hyperloom.plans.record_queries import ADAPTIVE_SQL, adaptive
from hyperloom.plans.registry import query


def _data(spark, d):
    return read_table(spark, d, "dataset")


def _eval(spark, d):
    return read_table(spark, d, "eval_sft")


def _log(spark, d):
    """The training log without repeated lines."""
    return read_table(spark, d, "rl_steps").select("run_id", "step", "reward_kind", "mean_reward_raw", "mean_reward_scaled", "mean_kl_sample", "reward_std_raw", "reward_raw", "rewards", "loss").distinct()


_LOG = "(SELECT DISTINCT run_id, step, reward_kind, mean_reward_raw, mean_reward_scaled, mean_kl_sample, reward_std_raw, reward_raw, rewards, loss FROM rl_steps)"
_KEYS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda t: length(t) > 2))"
_EXPECTED = _KEYS.format("concat_ws(' ', trace.target, array_to_string(trace.leafs, ' '), array_to_string(list_transform(trace.path, lambda p: p.output || ' ' || array_to_string(p.inputs, ' ')), ' '))")
_DISTRACTORS = f"""(SELECT d.*, len(list_filter(list_intersect(list_distinct(regexp_extract_all(lower(question), '[a-z]+')), x.words), lambda w: NOT list_contains(coalesce({_EXPECTED}, []), w))) AS k,
  len(list_filter(string_split_regex(question, '[\\s\\p{{Z}}]+'), lambda w: w <> '')) AS words
  FROM dataset d CROSS JOIN (SELECT list(DISTINCT w) AS words FROM (SELECT unnest({_KEYS.format('variable')}) AS w FROM hypernyms)) x)"""


@query("metrics_summary", f"""
SELECT count(*) AS n_records, count(*) FILTER (claude_difficulty >= 1) AS n_valid, avg(claude_faithfulness.variable_coverage) AS mean_coverage, avg(CAST(claude_faithfulness.target_present AS INT)) AS target_rate, avg(CAST(claude_faithfulness.faithful AS INT)) AS faithful_rate,
  avg(claude_feasibility) FILTER (claude_feasibility >= 1) AS mean_feasibility, CAST(median(claude_feasibility) FILTER (claude_feasibility >= 1) AS DOUBLE) AS median_feasibility,
  avg(abs(claude_difficulty - requested_difficulty)) FILTER (claude_difficulty >= 1) AS mae, corr(requested_difficulty, claude_difficulty) FILTER (claude_difficulty >= 1) AS pearson,
  avg(k) FILTER (question IS NOT NULL AND trace IS NOT NULL) AS mean_distractors, max(k) FILTER (question IS NOT NULL AND trace IS NOT NULL) AS max_distractors, avg(coalesce(words, 0)) AS mean_words FROM {_DISTRACTORS} WHERE trace IS NOT NULL""")
def metrics_summary(spark, d):
    return metrics.summary(_data(spark, d).where("trace is not null"), read_table(spark, d, "hypernyms")).withColumn("max_distractors", F.col("max_distractors").cast("long"))


def _confusion_sql(size: int, req: str, got: str) -> str:
    return f"""SELECT CAST(r.i AS INT) AS requested, CAST(j.i AS INT) AS judged, count(d.a) AS n FROM (SELECT unnest(range(1, {size + 1})) AS i) r CROSS JOIN (SELECT unnest(range(1, {size + 1})) AS i) j
LEFT JOIN (SELECT {req} AS a, {got} AS b FROM dataset WHERE requested_difficulty >= 1 AND claude_difficulty >= 1) d ON d.a = r.i AND d.b = j.i GROUP BY 1, 2"""


_B3 = "CASE WHEN {0} <= 3 THEN 1 WHEN {0} <= 6 THEN 2 ELSE 3 END"


@query("confusion_10x10", _confusion_sql(10, "least(requested_difficulty, 10)", "least(claude_difficulty, 10)"))
def confusion_10x10(spark, d):
    return metrics.confusion(_data(spark, d), "requested_difficulty", "claude_difficulty")


@query("confusion_3x3", _confusion_sql(3, _B3.format("requested_difficulty"), _B3.format("claude_difficulty")))
def confusion_3x3(spark, d):
    rows = _data(spark, d).where("requested_difficulty >= 1 and claude_difficulty >= 1")
    return metrics.confusion(rows.select(metrics.bucket("requested_difficulty").alias("r"), metrics.bucket("claude_difficulty").alias("j")), "r", "j", 3)


@query("confusion_rownorm", f"SELECT requested, judged, coalesce(n / nullif(sum(n) OVER (PARTITION BY requested), 0), 0.0) AS share FROM ({_confusion_sql(10, 'least(requested_difficulty, 10)', 'least(claude_difficulty, 10)')})")
def confusion_rownorm(spark, d):
    from pyspark.sql.window import Window

    c = metrics.confusion(_data(spark, d), "requested_difficulty", "claude_difficulty")
    return c.select("requested", "judged", F.coalesce(F.try_divide("n", F.sum("n").over(Window.partitionBy("requested"))), F.lit(0.0)).alias("share"))


_RATES = "avg(claude_faithfulness.variable_coverage) AS coverage, avg(CAST(claude_faithfulness.target_present AS INT)) AS target_rate, avg(CAST(claude_faithfulness.faithful AS INT)) AS faithful_rate"


def _rates():
    f = F.col("claude_faithfulness")
    return F.avg(f["variable_coverage"]).alias("coverage"), F.avg(f["target_present"].cast("int")).alias("target_rate"), F.avg(f["faithful"].cast("int")).alias("faithful_rate")


@query("faithfulness_rates", f"SELECT coalesce(model, 'tuned') AS model, {_RATES} FROM eval_sft GROUP BY 1")
def faithfulness_rates(spark, d):
    return _eval(spark, d).groupBy(F.coalesce("model", F.lit("tuned")).alias("model")).agg(*_rates())


@query("faithfulness_by_difficulty", f"SELECT requested_difficulty, {_RATES} FROM dataset GROUP BY 1")
def faithfulness_by_difficulty(spark, d):
    return _data(spark, d).groupBy("requested_difficulty").agg(*_rates())


@query("distractor_stats", f"SELECT requested_difficulty, avg(k) AS mean, CAST(median(k) AS DOUBLE) AS median, max(k) AS most FROM {_DISTRACTORS} WHERE question IS NOT NULL AND trace IS NOT NULL GROUP BY 1")
def distractor_stats(spark, d):
    rows = metrics.with_distractors(_data(spark, d).where("question is not null and trace is not null"), read_table(spark, d, "hypernyms")).withColumn("k", F.size("distractors"))
    return rows.groupBy("requested_difficulty").agg(F.avg("k").alias("mean"), F.median("k").alias("median"), F.max("k").cast("long").alias("most"))


@query("difficulty_alignment", "SELECT count(*) AS n, avg(abs(claude_difficulty - requested_difficulty)) AS mae, corr(requested_difficulty, claude_difficulty) AS pearson FROM dataset WHERE claude_difficulty >= 1 AND requested_difficulty IS NOT NULL")
def difficulty_alignment(spark, d):
    return metrics.alignment(_data(spark, d), "requested_difficulty", "claude_difficulty")


@query("mean_sem_by_group", "SELECT requested_difficulty, count(claude_difficulty) AS n, avg(claude_difficulty) AS mean, coalesce(stddev_samp(claude_difficulty) / sqrt(count(claude_difficulty)), 0.0) AS sem FROM dataset WHERE claude_difficulty >= 1 GROUP BY 1")
def mean_sem_by_group(spark, d):
    return metrics.mean_sem(_data(spark, d).where("claude_difficulty >= 1"), "requested_difficulty", "claude_difficulty")


@query("feasibility_summary", "SELECT requested_difficulty, count(*) AS n, avg(claude_feasibility) AS mean, CAST(median(claude_feasibility) AS DOUBLE) AS median, avg(CAST(claude_feasibility <= 3 AS INT)) AS low, avg(CAST(claude_feasibility >= 7 AS INT)) AS high FROM eval_sft WHERE claude_feasibility >= 1 GROUP BY 1")
def feasibility_summary(spark, d):
    x = F.col("claude_feasibility")
    return _eval(spark, d).where("claude_feasibility >= 1").groupBy("requested_difficulty").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.avg((x <= 3).cast("int")).alias("low"), F.avg((x >= 7).cast("int")).alias("high"))


@query("chapter_coverage", "SELECT chapter, count(*) AS n FROM (SELECT unnest(trace.chapters) AS chapter FROM dataset) GROUP BY 1")
def chapter_coverage(spark, d):
    return _data(spark, d).select(F.explode("trace.chapters").alias("chapter")).groupBy("chapter").agg(F.count(F.lit(1)).alias("n"))


@query("question_length", r"""
WITH q AS (SELECT requested_difficulty, len(list_filter(string_split_regex(question, '[\s\p{Z}]+'), lambda w: w <> '')) AS words FROM dataset WHERE question IS NOT NULL)
SELECT requested_difficulty, count(words) AS n, avg(words) AS mean, coalesce(stddev_samp(words) / sqrt(count(words)), 0.0) AS sem FROM q GROUP BY 1""")
def question_length(spark, d):
    rows = _data(spark, d).where("question is not null").withColumn("words", text.word_count(F.col("question")))
    return metrics.mean_sem(rows, "requested_difficulty", "words")


_LENGTHS = "(SELECT len(trace.path) AS length, claude_feasibility AS score FROM eval_sft WHERE trace.path IS NOT NULL)"


def _lengths(spark, d):
    return _eval(spark, d).where("trace.path is not null").select(F.size("trace.path").cast("long").alias("length"), F.col("claude_feasibility").alias("score"))


@query("score_stats_by_length", f"SELECT length, avg(score) AS mean, min(score) AS least, max(score) AS most, count(score) AS n FROM {_LENGTHS} WHERE score IS NOT NULL GROUP BY 1")
def score_stats_by_length(spark, d):
    return _lengths(spark, d).where("score is not null").groupBy("length").agg(F.avg("score").alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"), F.count("score").alias("n"))


@query("score_stats_overall", f"SELECT avg(score) AS mean, min(score) AS least, max(score) AS most, count(score) AS n FROM {_LENGTHS}")
def score_stats_overall(spark, d):
    return _lengths(spark, d).agg(F.avg("score").alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"), F.count("score").alias("n"))


@query("boxplot_by_length", f"SELECT length, CAST(min(score) AS DOUBLE) AS lo, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS q2, quantile_cont(score, 0.75) AS q3, CAST(max(score) AS DOUBLE) AS hi FROM {_LENGTHS} WHERE score IS NOT NULL GROUP BY 1")
def boxplot_by_length(spark, d):
    box = _lengths(spark, d).where("score is not null").groupBy("length").agg(F.percentile("score", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("p"))
    return box.select("length", *(F.col("p")[i].alias(n) for i, n in enumerate(("lo", "q1", "q2", "q3", "hi"))))


@query("episode_summary", f"SELECT run_id, coalesce(avg(mean_reward_raw), 0.0) AS mean, coalesce(min(mean_reward_raw), 0.0) AS least, coalesce(max(mean_reward_raw), 0.0) AS most FROM {_LOG} GROUP BY 1")
def episode_summary(spark, d):
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return _log(spark, d).groupBy("run_id").agg(z(F.avg("mean_reward_raw")).alias("mean"), z(F.min("mean_reward_raw")).alias("least"), z(F.max("mean_reward_raw")).alias("most"))


@query("trace_length_stats", "SELECT count(*) AS n, count(*) FILTER (trace IS NULL) AS failed, min(len(trace.path)) AS least, max(len(trace.path)) AS most, avg(len(trace.path)) AS mean, CAST(median(len(trace.path)) AS DOUBLE) AS median, stddev_pop(len(trace.path)) AS std FROM dataset")
def trace_length_stats(spark, d):
    n = F.when(F.col("trace.path").isNotNull(), F.size("trace.path").cast("long"))
    return _data(spark, d).select("trace", n.alias("n")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("trace").isNull()).alias("failed"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.stddev_pop("n").alias("std"))


@query("trace_length_hist", "SELECT len(trace.path) AS length, count(*) AS n FROM dataset WHERE trace.path IS NOT NULL GROUP BY 1")
def trace_length_hist(spark, d):
    return _data(spark, d).where("trace.path is not null").groupBy(F.size("trace.path").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))


@query("histogram_unit_bins", "SELECT CAST(least(10, claude_feasibility) AS INT) AS bin, count(*) AS n FROM eval_sft WHERE claude_feasibility BETWEEN 1 AND 10 GROUP BY 1")
def histogram_unit_bins(spark, d):
    rows = _eval(spark, d).where(F.col("claude_feasibility").between(1, 10))
    return rows.groupBy(F.least(F.width_bucket(F.col("claude_feasibility").cast("double"), F.lit(0.5), F.lit(10.5), F.lit(10)), F.lit(10)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("histogram_equi", """
WITH v AS (SELECT CAST(length(question) AS DOUBLE) AS v FROM dataset WHERE question IS NOT NULL), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v)
SELECT CAST(least(20, coalesce(floor((v - lo) / nullif(hi - lo, 0) * 20) + 1, 1)) AS INT) AS bin, count(*) AS n FROM v CROSS JOIN e GROUP BY 1""")
def histogram_equi(spark, d):
    return metrics.histogram(_data(spark, d).select(F.length("question").alias("v")), "v", 20)


@query("rl_step_stats", f"""
SELECT run_id, step, avg(x) AS mean_raw, avg(greatest(-1.0, least(1.0, x - 1))) AS mean_scaled, coalesce(stddev_pop(x), 0.0) AS std
FROM (SELECT run_id, step, unnest(reward_raw) AS x FROM (SELECT DISTINCT run_id, step, reward_raw FROM rl_steps)) GROUP BY 1, 2""")
def rl_step_stats(spark, d):
    rows = read_table(spark, d, "rl_steps").select("run_id", "step", "reward_raw").distinct().select("run_id", "step", F.explode("reward_raw").alias("x"))
    return rows.groupBy("run_id", "step").agg(F.avg("x").alias("mean_raw"), F.avg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("x") - 1))).alias("mean_scaled"), F.coalesce(F.stddev_pop("x"), F.lit(0.0)).alias("std"))


@query("rl_flatten", """
SELECT run_id, step, unnest(coalesce(reward_raw, list_transform(rewards, lambda r: r + 1))) AS raw FROM (SELECT DISTINCT run_id, step, reward_raw, rewards FROM rl_steps)""")
def rl_flatten(spark, d):
    rows = read_table(spark, d, "rl_steps").select("run_id", "step", "reward_raw", "rewards").distinct()
    return rows.select("run_id", "step", F.explode(F.coalesce("reward_raw", F.transform("rewards", lambda r: r + 1))).alias("raw"))


@query("rl_combined_frame", """
WITH l AS (SELECT DISTINCT run_id, step, reward_kind, mean_reward, mean_reward_scaled, reward_raw, loss FROM rl_steps WHERE run_id IS NOT NULL AND step IS NOT NULL),
m AS (SELECT run_id, arg_min(reward_kind, step) AS kind FROM l GROUP BY run_id)
SELECT run_id, step, list_avg(reward_raw) AS combined_mean, coalesce(mean_reward_scaled, mean_reward) AS scaled, 0.0::DOUBLE AS faithfulness_mean, 0.0::DOUBLE AS feasibility_mean, 0.5::DOUBLE AS faithfulness_weight, 0.5::DOUBLE AS feasibility_weight, loss
FROM l JOIN m USING (run_id) WHERE m.kind = 'combined' AND reward_raw IS NOT NULL""")
def rl_combined_frame(spark, d):
    """Per step of the runs that began in combined mode: combined mean, scaled reward, component means and weights, loss."""
    log = read_table(spark, d, "rl_steps").select("run_id", "step", "reward_kind", "mean_reward", "mean_reward_scaled", "reward_raw", "loss").distinct()
    return metrics.combined_frame(log)


@query("rl_adaptive_frame", f"""
WITH RECURSIVE {ADAPTIVE_SQL}, n AS (SELECT *, wf + we + wd AS z, coalesce(f, 0) AS a, coalesce(e, 0) AS b, coalesce(d, 0) AS c FROM w)
SELECT step, a AS faithfulness_mean, b AS feasibility_mean, c AS difficulty_mean, wf / z AS weight_faithfulness, we / z AS weight_feasibility, wd / z AS weight_difficulty, ef AS ema_faithfulness, ee AS ema_feasibility, ed AS ema_difficulty,
  (wf * a + we * b + wd * c) / z AS combined_mean, greatest(-1.0, least(1.0, (wf * a + we * b + wd * c) / z - 1)) AS scaled FROM n""")
def rl_adaptive_frame(spark, d):
    """Per step: means of the three signals, their running means and weights, and the adaptive reward raw and scaled."""
    return metrics.adaptive_frame(adaptive(spark, d))


@query("score_vs_score", "SELECT eval_id, claude_feasibility AS a, claude_faithfulness.variable_coverage AS b FROM eval_sft WHERE claude_feasibility >= 1 AND claude_faithfulness.variable_coverage IS NOT NULL")
def score_vs_score(spark, d):
    return _eval(spark, d).select("eval_id", F.col("claude_feasibility").alias("a"), F.col("claude_faithfulness.variable_coverage").alias("b")).where("a >= 1 and b is not null")
