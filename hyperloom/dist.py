"""Building blocks that keep plans distributed: shared tables, size-checked joins, exact ranks.

* ``shared_table`` cuts lineage with a Parquet table in the folder that ``spark.checkpoint.dir`` names.
* ``sized_join`` broadcasts only after measuring the side, and shuffles (with adaptive skew handling) otherwise.
* ``hash_rank`` numbers rows inside groups of any size without putting a group into one task.
"""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A side is broadcast up to this many bytes, as they are in memory.
BROADCAST_BYTES = 24 * 1024 * 1024
#: Rows that one window partition of hash_rank may hold on average.
RANK_ROWS = 100_000

_session_dirs: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """A source that comes in fewer pieces than there are cores, cut anew by ``by``; one of many files stays as it is.

    For maps that cost far more than moving their rows. ``df`` must be a scan without a shuffle.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *by) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a new local one where that is unset (tests)."""
    app = spark.sparkContext.applicationId
    if app not in _session_dirs:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="hyperloom-")
            spark.sparkContext.setCheckpointDir(base)
        _session_dirs[app] = f"{base.rstrip('/')}/hyperloom-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _session_dirs[app])
    return _session_dirs[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        _fs(spark, path)[0].delete(_fs(spark, path)[1], True)
    except Exception:  # the JVM may be gone when the interpreter ends
        pass


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class SharedTable:
    """A written table: ``df`` reads it, ``nbytes`` is its size on disk, ``rows()`` counts from the footers once."""

    def __init__(self, spark: SparkSession, path: str, schema) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self._rows: int | None = None

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    @property
    def nbytes(self) -> int:
        fs, at = _fs(self.spark, self.path)
        return int(fs.getContentSummary(at).getLength())

    def rows(self) -> int:
        if self._rows is None:
            self._rows = self.spark.read.schema(self.schema).parquet(self.path).count()
        return self._rows

    def fits(self, limit: int) -> bool:
        """Whether the table takes at most ``limit`` bytes in memory.

        A row is a header and eight bytes a column; texts and lists are taken for ten times their size on disk.
        """
        size = self.nbytes
        wide = any(f.dataType.typeName() in ("string", "binary", "array", "map", "struct") for f in self.schema.fields)
        return size <= limit and self.rows() * (24 + 8 * len(self.schema.fields)) + 10 * size * wide <= limit

    def drop(self) -> None:
        """Frees the folder; only for tables that no returned DataFrame reads any more."""
        _drop(self.spark, self.path)


def shared_table(df: DataFrame, name: str = "t") -> SharedTable:
    """Writes ``df`` once to the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return SharedTable(spark, path, df.schema)


def sized_join(left: DataFrame, right: SharedTable, on, how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Joins a written table: broadcast if it takes at most ``limit`` bytes, else a shuffle join that AQE splits on skew."""
    other = right.df
    return left.join(F.broadcast(other) if right.fits(limit) else other.hint("shuffle_merge"), on, how)


def uniform_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A non-negative 63-bit hash of the columns, the same on every run."""
    return F.xxhash64(*cols, F.lit(seed)).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def text_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A non-negative 63-bit hash by MD5 that other engines can compute, too; nulls are passed over."""
    text = F.concat_ws("|", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") * 8


def text_hash_sql(*cols: str, seed: int = 0) -> str:
    """The same hash in SQL."""
    text = ", ".join([*(f"CAST({c} AS VARCHAR)" for c in cols), f"'{seed}'"])
    return f"(CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 15) AS BIGINT) * 8)"


def hash_rank(df: DataFrame, groups: list[str], order: Column, tie: list[str], rows: int, name: str = "rank") -> DataFrame:
    """Adds ``name``: the 0-based place of each row in its group by (order, tie).

    ``order`` must be a ``uniform_hash`` or ``text_hash``. Its leading bits cut every group into buckets small enough for a window;
    bucket counts give each bucket's offset, so a group of any size is ranked in parallel. ``rows`` is df's row count.
    """
    bits = max(0, math.ceil(math.log2(max(1, rows) / RANK_ROWS)))
    ordered = df.withColumn("_o", order)
    if bits == 0:
        w = Window.partitionBy(*groups).orderBy("_o", *tie)
        return ordered.withColumn(name, F.row_number().over(w).cast("long") - 1).drop("_o")
    ordered = ordered.withColumn("_b", F.shiftright("_o", 63 - bits).cast("int"))
    counts = ordered.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = shared_table(counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "starts")
    cond = F.col("l._b") == F.col("r._b")
    for g in groups:
        cond = cond & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    right = F.broadcast(starts.df) if starts.fits(BROADCAST_BYTES) else starts.df
    joined = ordered.alias("l").join(right.alias("r"), cond).select("l.*", "r._start")
    w = Window.partitionBy(*groups, "_b").orderBy("_o", *tie)
    return joined.withColumn(name, F.row_number().over(w).cast("long") - 1 + F.col("_start")).drop("_o", "_b", "_start")


def name_key(col: Column | str) -> Column:
    """Lower case with everything but a-z and 0-9 removed; null where nothing is left."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), F.lit(""))
