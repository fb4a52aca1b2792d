"""Structured-streaming twins of the log operators; on a finished log they give what the batch operators give."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG = "run_id string, step int, reward_kind string, mean_reward_raw double, mean_reward_scaled double, loss double, logged_at timestamp, arrived_at timestamp"


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet log, a file or a growing folder, as a stream.

    All files that are there form one micro-batch, so that the order of a finished log's files does not matter.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    from hyperloom.dist import _fs

    fs, at = _fs(spark, path)
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def step_stats(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """(run_id, step, lines, mean) of each step; lines repeated within ``late`` of logging count once.

    Lines without a time of logging are kept; what is later than ``late`` behind the newest line of an earlier micro-batch
    is dropped, so the memory for repetitions is bounded.
    """
    timed = stream.where("run_id is not null and step is not null").select("run_id", "step", "mean_reward_raw", F.coalesce(F.col("logged_at").cast("timestamp"), F.current_timestamp()).alias("at"))
    once = timed.withWatermark("at", late).dropDuplicatesWithinWatermark(["run_id", "step", "mean_reward_raw"])
    return once.groupBy("run_id", "step").agg(F.count(F.lit(1)).alias("lines"), F.avg("mean_reward_raw").alias("mean"))


def windowed_stats(stream: DataFrame, late: str = "2 days", width: str = "1 hour") -> DataFrame:
    """Lines and mean reward per run and hour of logging; lines later than ``late`` are dropped by the watermark."""
    timed = stream.withColumn("logged_at", F.col("logged_at").cast("timestamp")).withWatermark("logged_at", late)
    return timed.groupBy(F.window("logged_at", width), "run_id").agg(F.count(F.lit(1)).alias("lines"), F.avg("mean_reward_raw").alias("mean"))


def stream_ema(stream: DataFrame, decay: float = 0.9, start: float = 1.0) -> DataFrame:
    """(run_id, step, ema, late) before each line, in order of steps inside a micro-batch; the state is one number a run.

    Of files that arrive later, lines of a step that is past come out as late, without a mean, and do not count, as what was
    given out cannot be taken back.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, last = state.get if state.exists else (start, -1)
        rows = pd.concat([b for b in batches if len(b)]).drop_duplicates(["step"]).sort_values("step")
        out = []
        for step, x in zip(rows["step"], rows["mean_reward_raw"]):
            if step <= last:
                out.append((key[0], int(step), None, True))
                continue
            out.append((key[0], int(step), float(value), False))
            if not pd.isna(x):
                value = decay * value + (1 - decay) * x
            last = int(step)
        state.update((float(value), int(last)))
        yield pd.DataFrame(out, columns=["run_id", "step", "ema", "late"])

    rows = stream.where("run_id is not null and step is not null").select("run_id", "step", "mean_reward_raw")
    return rows.groupBy("run_id").applyInPandasWithState(fold, "run_id string, step int, ema double, late boolean", "ema double, last int", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there to its end and gives its result as a table."""
    spark = stream.sparkSession
    if mode == "complete":
        put = stream.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/rows"))
    else:
        put = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows")
    put.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
