"""Readers and writers of JSON documents, record arrays and line logs.

Readers take explicit schemas, so a scan never infers. Lines that cannot be read are kept apart with their text instead
of being lost. Writers go through Spark's committer: a folder is complete or absent.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.dist import _fs

GRAPH = "nodes array<string>, hyperedges array<struct<id:string,domain:string,subdomain:string,output:string,inputs:array<string>,label:string,output_unit:string>>, hypernyms map<string,string>, chapters array<string>"


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return bool(fs.exists(at))


def write_graph_document(edges: DataFrame, hypernyms: DataFrame, path: str) -> None:
    """One JSON document: nodes, hyperedges, hypernyms and chapters. The graph is one record by its format."""
    nodes = edges.select(F.col("output").alias("n")).union(edges.select(F.explode("inputs"))).agg(F.array_sort(F.collect_set("n")).alias("nodes"))
    rows = edges.agg(F.collect_list(F.struct("id", "domain", "subdomain", "output", "inputs", "label", "output_unit")).alias("hyperedges"))
    names = hypernyms.groupBy("variable").agg(F.min("hypernym").alias("h")).agg(F.map_from_entries(F.collect_list(F.struct("variable", "h"))).alias("hypernyms"), F.array_sort(F.collect_set("h")).alias("chapters"))
    whole = nodes.withColumn("hyperedges", rows.scalar()).withColumn("h", names.select(F.struct("hypernyms", "chapters")).scalar())
    whole.select("nodes", "hyperedges", "h.hypernyms", "h.chapters").coalesce(1).write.mode("overwrite").json(path)


def read_graph_document(spark: SparkSession, path: str) -> DataFrame:
    """The formulas of a graph document, one a row."""
    return spark.read.schema(GRAPH).json(path, multiLine=True).select(F.explode("hyperedges").alias("e")).select("e.*")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON array; none if the file is missing or holds anything but an array."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"array<struct<{_struct(spark, schema)}>>")).alias("r")).select("r.*")


def _struct(spark: SparkSession, schema: str) -> str:
    fields = spark.createDataFrame([], schema).schema.fields
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in fields)


def read_lines(spark: SparkSession, path: str, schema: str, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): JSON lines; blank ones are skipped, unreadable ones and those lacking a key are rejects.

    A key that is there with a null value counts as there.
    """
    if not exists(spark, path):
        empty = spark.createDataFrame([], schema)
        return empty, spark.createDataFrame([], "line string")
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("line"))
    parsed = lines.withColumn("r", F.from_json("line", f"struct<{_struct(spark, schema)},_bad:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    there = F.json_object_keys("line")
    good = F.col("r").isNotNull() & F.col("r._bad").isNull() & there.isNotNull()
    for k in keys or []:
        good = good & F.array_contains(there, k)
    good = F.coalesce(good, F.lit(False))
    return parsed.where(good).select("r.*").drop("_bad"), parsed.where(~good).select("line")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A strict line log: a broken line ends the job."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def latest_run(spark: SparkSession, folder: str, prefix: str = "run_") -> str | None:
    """The last of the folder's runs by name; None without any."""
    if not exists(spark, folder):
        return None
    fs, at = _fs(spark, folder)
    runs = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith(prefix)]
    return max((p.toString() for p in runs), default=None)


def write_atomic(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Replaces a folder by renames; a job that fails leaves the old rows, and readers see the old or the new ones.

    The rows go to a folder beside it first. Between the two renames the path is absent for a moment, as a folder cannot
    be renamed over another; the old rows then stand under ``<path>.old`` and are put back if the second rename fails.
    """
    spark = rows.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old"
    fs, at = _fs(spark, path)
    place = lambda p: _fs(spark, p)[1]
    try:
        rows.write.format(kind).save(fresh)
    except Exception:
        fs.delete(place(fresh), True)
        raise
    there = fs.exists(at)
    if there:
        fs.delete(place(old), True)
        if not fs.rename(at, place(old)):
            raise OSError(f"cannot move {path}")
    if not fs.rename(place(fresh), at):
        if there:
            fs.rename(place(old), at)
        raise OSError(f"cannot move the new rows to {path}")
    fs.delete(place(old), True)


def append(rows: DataFrame, path: str, kind: str = "json", key: list[str] | None = None) -> None:
    """Adds rows; with ``key`` only those whose key is not there yet (a resumed run then adds nothing twice)."""
    if key and exists(rows.sparkSession, path):
        there = rows.sparkSession.read.schema(rows.schema).format(kind).load(path).select(*key).distinct()
        rows = rows.join(there, key, "left_anti")
    rows.write.mode("append").format(kind).save(path)


def write_by(rows: DataFrame, path: str, column: str) -> None:
    """One folder per value of a column, as for episodes; rows of a value are spread, not gathered in one task."""
    rows.write.mode("overwrite").partitionBy(column).json(path)


def beside(path: str, ending: str) -> str:
    """The path of a companion: x.json and '_failed' give x_failed.json."""
    stem, dot, suffix = path.rpartition(".")
    return f"{stem}{ending}.{suffix}" if dot and "/" not in suffix else f"{path}{ending}"


#: A variable's formulas are either objects or bare texts; both read as text and are told apart by their first sign.
VARIABLES = "variables array<struct<variable:string,si_unit:string,formulas:array<string>>>"


def read_variable_graph(spark: SparkSession, path: str) -> DataFrame:
    """(variable, si_unit, formula, dependencies) of a variable document; a bare formula's names are its dependencies."""
    from hyperloom.functions.text import formula_names

    v = spark.read.schema(VARIABLES).json(path, multiLine=True).select(F.explode("variables").alias("v"))
    rows = v.select("v.variable", F.coalesce("v.si_unit", F.lit("")).alias("si_unit"), F.explode_outer("v.formulas").alias("f"))
    parsed = rows.withColumn("o", F.when(F.col("f").startswith("{"), F.from_json("f", "formula string, dependencies array<string>")))
    formula = F.coalesce("o.formula", F.when(~F.col("f").startswith("{"), F.col("f")))
    return parsed.select("variable", "si_unit", formula.alias("formula"), F.coalesce("o.dependencies", formula_names(formula)).alias("dependencies"))
