"""Sources, sinks and streams, exercised as round trips through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hyperloom.dist import read_table, shared_dir
from hyperloom.plans.registry import query
from hyperloom.sources import files
from hyperloom.streaming import logs


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _short(spark, d):
    return read_table(spark, d, "eval_sft").select("eval_id", "target", "requested_difficulty", "claude_feasibility")


_SHORT = "SELECT eval_id, target, requested_difficulty, claude_feasibility FROM eval_sft"
_SCHEMA = "eval_id long, target string, requested_difficulty int, claude_feasibility int"


@query("scan_json_array", _SHORT)
def scan_json_array(spark, d):
    """Records written as JSON arrays of about a thousand, one a file, and read back."""
    path = _place(spark, "arrays")
    rows = _short(spark, d)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("eval_id"), F.lit(1 + rows.count() // 1000)))  # an array is held whole, so it is kept short
    rows.groupBy("part").agg(F.to_json(F.collect_list(F.struct("eval_id", "target", "requested_difficulty", "claude_feasibility"))).alias("value")).write.partitionBy("part").text(path)
    return files.read_records(spark, path, _SCHEMA)


@query("scan_jsonl_tolerant", _SHORT)
def scan_jsonl_tolerant(spark, d):
    """Lines with blank and cut ones between them; the sound ones come back."""
    path = _place(spark, "lines")
    line = F.to_json(F.struct("eval_id", "target", "requested_difficulty", "claude_feasibility"))
    _short(spark, d).select(F.explode(F.array(line, F.lit(""), F.left(line, F.length(line) - 3))).alias("value")).write.text(path)
    return files.read_lines(spark, path, _SCHEMA)[0]


@query("require_keys", "SELECT eval_id FROM eval_sft WHERE claude_feasibility >= 1")
def require_keys(spark, d):
    """Lines that hold the key 'score', be it null."""
    path = _place(spark, "keys")
    rows = _short(spark, d).select("eval_id", F.when(F.col("claude_feasibility") >= 1, F.lit(', "score": null')).otherwise("").alias("s"))
    rows.select(F.concat(F.lit('{"eval_id": '), "eval_id", "s", F.lit("}")).alias("value")).write.text(path)
    return files.read_lines(spark, path, "eval_id long, score double", ["score"])[0].select("eval_id")


_STEPS = "SELECT run_id, step, mean_reward_raw, loss FROM rl_steps"
_STEP_SCHEMA = "run_id string, step int, mean_reward_raw double, loss double"


@query("scan_rl_log", _STEPS)
def scan_rl_log(spark, d):
    path = _place(spark, "log")
    read_table(spark, d, "rl_steps").select("run_id", "step", "mean_reward_raw", "loss").write.json(path)
    return files.read_log(spark, path, _STEP_SCHEMA)


@query("sink_json_atomic", _SHORT)
def sink_json_atomic(spark, d):
    path = _place(spark, "atomic")
    files.write_atomic(_short(spark, d).limit(10), path)
    files.write_atomic(_short(spark, d), path)
    return files.read_log(spark, path, _SCHEMA)


@query("sink_resume", _SHORT)
def sink_resume(spark, d):
    """Half of the rows, then all of them by key: nothing stands twice."""
    path = _place(spark, "resume")
    rows = _short(spark, d)
    files.append(rows.where("claude_feasibility >= 7"), path, "parquet", ["eval_id"])
    files.append(rows, path, "parquet", ["eval_id"])
    return spark.read.parquet(path)


@query("sink_jsonl_append", f"{_STEPS} UNION ALL {_STEPS}")
def sink_jsonl_append(spark, d):
    path = _place(spark, "append")
    rows = read_table(spark, d, "rl_steps").select("run_id", "step", "mean_reward_raw", "loss")
    files.append(rows, path)
    files.append(rows, path)
    return files.read_log(spark, path, _STEP_SCHEMA)


@query("sink_failed_path", "SELECT 'out/data_failed.json' AS failed, 'out/data.meta.json' AS meta")
def sink_failed_path(spark, d):
    return spark.createDataFrame([(files.beside("out/data.json", "_failed"), files.beside("out/data.json", ".meta"))], "failed string, meta string")


@query("sink_metrics", "SELECT requested_difficulty, count(*) AS n FROM dataset GROUP BY 1")
def sink_metrics(spark, d):
    path = _place(spark, "metrics")
    files.write_atomic(read_table(spark, d, "dataset").groupBy("requested_difficulty").agg(F.count(F.lit(1)).alias("n")), path)
    return files.read_log(spark, path, "requested_difficulty int, n long")


@query("sink_lengths", "SELECT record_id, len(trace.path) AS length FROM dataset WHERE trace.path IS NOT NULL")
def sink_lengths(spark, d):
    path = _place(spark, "lengths")
    files.write_atomic(read_table(spark, d, "dataset").where("trace.path is not null").select("record_id", F.size("trace.path").cast("long").alias("length")), path)
    return files.read_log(spark, path, "record_id long, length long")


@query("sink_episode_log", _STEPS)
def sink_episode_log(spark, d):
    path = _place(spark, "episodes")
    files.write_by(read_table(spark, d, "rl_steps").select("run_id", "step", "mean_reward_raw", "loss"), path, "run_id")
    return spark.read.schema("step int, mean_reward_raw double, loss double, run_id string").json(path).select("run_id", "step", "mean_reward_raw", "loss")


@query("resolve_latest_run", "SELECT 'run_20310102' AS name")
def resolve_latest_run(spark, d):
    path = _place(spark, "runs")
    for name in ("run_20310101", "run_20310102", "other_9"):
        spark.range(1).write.json(f"{path}/{name}")
    return spark.createDataFrame([(files.latest_run(spark, path).rpartition("/")[2],)], "name string")


@query("stream_rl_log", """
SELECT run_id, step, count(*) AS lines, avg(mean_reward_raw) AS mean FROM (SELECT DISTINCT run_id, step, mean_reward_raw FROM rl_steps WHERE step IS NOT NULL AND run_id IS NOT NULL) GROUP BY 1, 2""")
def stream_rl_log(spark, d):
    """The log as a stream of files: repeated lines dropped, one row a step."""
    return logs.run_to_table(logs.step_stats(logs.stream_log(spark, f"{d}/rl_steps.parquet")), _place(spark, "stream"))


@query("stream_windowed", """
SELECT time_bucket(INTERVAL '1 hour', logged_at) AS hour, run_id, count(*) AS lines, avg(mean_reward_raw) AS mean FROM rl_steps WHERE logged_at IS NOT NULL GROUP BY 1, 2""")
def stream_windowed(spark, d):
    """Lines and mean reward per run and hour of logging, with a watermark for late lines."""
    rows = logs.run_to_table(logs.windowed_stats(logs.stream_log(spark, f"{d}/rl_steps.parquet")), _place(spark, "stream"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "run_id", "lines", "mean")


@query("stream_ema", """
WITH RECURSIVE s AS (SELECT run_id, step, any_value(mean_reward_raw) AS v, row_number() OVER (PARTITION BY run_id ORDER BY step) AS k FROM rl_steps WHERE run_id IS NOT NULL AND step IS NOT NULL GROUP BY run_id, step),
r AS (SELECT run_id, step, v, k, CAST(1.0 AS DOUBLE) AS ema FROM s WHERE k = 1
      UNION ALL SELECT s.run_id, s.step, s.v, s.k, coalesce(0.9 * r.ema + 0.1 * r.v, r.ema) FROM r JOIN s ON s.run_id = r.run_id AND s.k = r.k + 1)
SELECT run_id, step, ema, false AS late FROM r""")
def stream_ema(spark, d):
    """Running means kept per run across micro-batches."""
    return logs.run_to_table(logs.stream_ema(logs.stream_log(spark, f"{d}/rl_steps.parquet")), _place(spark, "stream"), "append")


@query("scan_older_graph", "SELECT id, output, coalesce(domain, 'unknown') AS domain, len(inputs) AS inputs FROM hyperedges")
def scan_older_graph(spark, d):
    """The graph document in its older reading: formulas without a domain count as unknown."""
    path = _place(spark, "older")
    files.write_graph_document(read_table(spark, d, "hyperedges"), read_table(spark, d, "hypernyms"), path)
    return files.read_graph_document(spark, path).select("id", "output", F.coalesce("domain", F.lit("unknown")).alias("domain"), F.size("inputs").cast("long").alias("inputs"))


@query("scan_variable_graph", "SELECT output AS variable, coalesce(output_unit, '') AS si_unit, label AS formula, len(inputs) AS needs FROM hyperedges")
def scan_variable_graph(spark, d):
    """Formulas as a variable document, half of them as bare texts, read back."""
    path = _place(spark, "variables")
    e = read_table(spark, d, "hyperedges").withColumn("k", F.regexp_extract("id", "[0-9]+", 0).cast("int") % 2)
    whole = F.to_json(F.struct(F.col("label").alias("formula"), F.col("inputs").alias("dependencies")))
    quoted = F.concat(F.lit('"'), "label", F.lit('"'))
    entry = F.concat(F.lit('{"variable": "'), "output", F.lit('", "si_unit": "'), F.coalesce("output_unit", F.lit("")), F.lit('", "formulas": ['), F.when(F.col("k") == 0, whole).otherwise(quoted), F.lit("]}"))
    e.agg(F.concat(F.lit('{"variables": ['), F.array_join(F.collect_list(entry), ","), F.lit("]}")).alias("value")).coalesce(1).write.text(path)
    return files.read_variable_graph(spark, path).select("variable", "si_unit", "formula", F.size("dependencies").cast("long").alias("needs"))
