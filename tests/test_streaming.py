"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from hyperloom.operators.ordered import ema
from hyperloom.streaming import logs


def test_stream_equals_batch(spark, sf, tmp_path):
    path = f"{sf}/rl_steps.parquet"
    got = logs.run_to_table(logs.stream_ema(logs.stream_log(spark, path)), str(tmp_path), "append")
    once = spark.read.parquet(path).where("run_id is not null and step is not null").dropDuplicates(["run_id", "step"])
    want = ema(once, "run_id", "step", ["mean_reward_raw"])
    both = got.join(want, ["run_id", "step"])
    assert got.count() == want.count() == both.count()
    assert both.where(F.abs(F.col("ema") - F.col("ema_mean_reward_raw")) > 1e-9).count() == 0


def test_late_lines_are_dropped(spark, sf, tmp_path):
    stats = logs.windowed_stats(logs.stream_log(spark, f"{sf}/rl_steps.parquet"))
    got = logs.run_to_table(stats, str(tmp_path), "append")
    assert got.count() > 0 and got.groupBy("window", "run_id").count().where("count > 1").count() == 0


def test_files_in_any_order(spark, tmp_path):
    log = f"{tmp_path}/log"
    for k in range(20):  # 7 is prime to 20: later files have earlier steps
        rows = [("r", 20 * i + 7 * k % 20, float(i + k)) for i in range(5)]
        spark.createDataFrame(rows, "run_id string, step int, mean_reward_raw double").coalesce(1).write.mode("append").parquet(log)
    got = {r["step"]: r["ema"] for r in logs.run_to_table(logs.stream_ema(logs.stream_log(spark, log)), f"{tmp_path}/out", "append").collect()}
    want = {r["step"]: r["ema_mean_reward_raw"] for r in ema(spark.read.parquet(log), "run_id", "step", ["mean_reward_raw"]).collect()}
    assert got.keys() == want.keys() == set(range(100))
    assert all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_lines_of_past_steps_are_told(spark, tmp_path):
    """A file that arrives after a run of the stream brings steps that are past."""
    log, out = f"{tmp_path}/log", f"{tmp_path}/out"
    put = lambda *steps: spark.createDataFrame([("r", s, float(s)) for s in steps], "run_id string, step int, mean_reward_raw double").coalesce(1).write.mode("append").parquet(log)
    put(1, 2, 5)
    logs.run_to_table(logs.stream_ema(logs.stream_log(spark, log)), out, "append")
    put(3, 6)
    got = {r["step"]: (r["ema"], r["late"]) for r in logs.run_to_table(logs.stream_ema(logs.stream_log(spark, log)), out, "append").collect()}
    assert got[3] == (None, True) and not got[6][1] and abs(got[6][0] - (0.9 * got[5][0] + 0.1 * 5)) < 1e-9 and sorted(got) == [1, 2, 3, 5, 6]


def test_repeated_lines_count_once(spark, tmp_path):
    from pyspark.sql import types as T

    rows = [("r", 1, 1.0, None), ("r", 1, 1.0, None), ("r", 1, 3.0, None), ("q", None, 1.0, None)]
    schema = T.StructType.fromDDL("run_id string, step int, mean_reward_raw double, logged_at timestamp")
    for _ in range(2):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    got = [tuple(r) for r in logs.run_to_table(logs.step_stats(logs.stream_log(spark, f"{tmp_path}/log")), f"{tmp_path}/out").collect()]
    assert got == [("r", 1, 2, 2.0)]
