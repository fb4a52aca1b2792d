"""Operators over ordered rows. Windows are partitioned by run, step, target or the like; orders are total."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from hyperloom.dist import hash_rank, text_hash


def monotonicity(rows: DataFrame, by: str, requested: str, judged: str, tie: str) -> DataFrame:
    """Per group of at least two valid rows, the share of neighbours by (requested, judged) that do not fall."""
    ok = rows.where((F.col(judged) >= 1) & F.col(by).isNotNull() & F.col(requested).isNotNull())
    # Equal (requested, judged) pairs are neighbours that do not fall, so they are counted and not windowed.
    pairs = ok.groupBy(by, requested, judged).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(by).orderBy(requested, judged)
    steps = pairs.withColumn("_next", F.lead(judged).over(w))
    good = F.sum(F.col("_n") - 1 + F.coalesce((F.col("_next") >= F.col(judged)).cast("long"), F.lit(0)))
    return steps.groupBy(by).agg(good.alias("_g"), (F.sum("_n") - 1).alias("_s")).where("_s > 0").select(by, (F.col("_g") / F.col("_s")).alias("share"))


def placed(rows: DataFrame, by: list[str], order: str, span: int = 10_000) -> DataFrame:
    """Adds _n, the 0-based place of each row in its group by a unique integer column, from counts of spans of it."""
    cut = rows.withColumn("_span", F.floor(F.col(order) / span))
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*by, "_span").agg(F.count(F.lit(1)).alias("_k"))
    starts = counts.withColumn("_s", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    inside = Window.partitionBy(*by, "_span").orderBy(order)
    return cut.join(starts, [*by, "_span"]).withColumn("_n", F.col("_s") + F.row_number().over(inside) - 1).drop("_span", "_s")


def framed(rows: DataFrame, by: list[str], order: str, before: int, after: int, columns, size: int = 10_000, span: int = 10_000) -> DataFrame:
    """Adds window columns over ``before`` rows back and ``after`` ahead, cutting long groups into pieces.

    A piece is ``size`` rows of a group and, as copies that are dropped again, the neighbours that its frames reach;
    so a group of any length is spread over tasks. ``columns`` maps a window to the columns to add, by name.
    """
    piece = F.floor(F.col("_n") / size)
    home = placed(rows, by, order, span).withColumn("_home", piece)
    near = F.array_distinct(F.array(F.floor((F.col("_n") - after) / size), piece, F.floor((F.col("_n") + before) / size)))
    w = Window.partitionBy(*by, "_piece").orderBy("_n").rowsBetween(-before, after)
    out = home.withColumn("_piece", F.explode(near))
    for name, c in columns(w).items():
        out = out.withColumn(name, c)
    return out.where("_piece = _home").drop("_n", "_home", "_piece")


def rolling_same(rows: DataFrame, by: list[str], order: str, value: str, width: int, size: int = 10_000) -> DataFrame:
    """Adds ``rolling``: centred sums over ``width``, missing neighbours counting as 0, over ``width``."""
    return framed(rows, by, order, width // 2, (width - 1) // 2, lambda w: {"rolling": F.sum(value).over(w) / width}, max(size, width))


def rolling_valid(rows: DataFrame, by: list[str], order: str, value: str, width: int, size: int = 10_000) -> DataFrame:
    """Trailing means over full windows only."""
    both = framed(rows, by, order, width - 1, 0, lambda w: {"rolling": F.avg(value).over(w), "_full": F.count(value).over(w) == width}, max(size, width))
    return both.where("_full").drop("_full")


def group_advantage(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds ``advantage``: the value less its group's mean; 0 where the group's deviation is below 1e-8."""
    w = Window.partitionBy(*by)
    return rows.withColumn("advantage", F.when(F.stddev_pop(value).over(w) < 1e-8, 0.0).otherwise(F.col(value) - F.avg(value).over(w)))


def capped_sample(rows: DataFrame, by: str, kind: str, order: str, each: int, most: int) -> DataFrame:
    """At most ``each`` rows of every (by, kind) and ``most`` of every kind, by the group's name and a hash of ``order``.

    The first cut leaves at most ``each`` rows a group; running counts of groups then replace a window over a kind.
    """
    first = Window.partitionBy(by, kind).orderBy(text_hash(order, seed=1), order)
    few = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= each)
    sizes = few.groupBy(kind, by).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(kind).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_s", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    return few.join(starts, [kind, by]).where(F.col("_s") + F.col("_r") <= most).drop("_r", "_c", "_s")


def ema(rows: DataFrame, by: str, order: str, values: list[str], decay: float = 0.9, start: float = 1.0, span: int = 10_000) -> DataFrame:
    """Running means as they stand before each row: ema_t = decay * ema_(t-1) + (1 - decay) * value_(t-1), from ``start``.

    ``order`` is an integer column. A run is cut into spans of it that are folded apart: a span of n values takes what
    comes in to decay**n times that plus a constant, so the spans' starts follow from one row a span, and a run of any
    length is spread over tasks. A null value leaves the means as they are.
    """
    own = rows.select(by, order, *values).where(F.col(by).isNotNull() & F.col(order).isNotNull()).withColumn("_span", F.floor(F.col(order) / span))
    kind, whole = dict(rows.dtypes)[by], dict(rows.dtypes)[order]
    type_ = to_arrow_type(rows.schema[by].dataType)
    key = f"`{by}` {kind}, _span long"
    after = [F.col(order).cast("long").alias(order), *(F.col(v) for v in values)]

    def constants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(by, span, decay**n and constant of each value) of each span."""
        for k, group in _groups(batches):
            row = list(k)
            for v in range(len(values)):
                factor, constant = 1.0, 0.0
                for x in (r[3 + v] for r in group):
                    if x is not None:
                        factor, constant = factor * decay, decay * constant + (1 - decay) * x
                row += [factor, constant]
            yield pa.RecordBatch.from_arrays([pa.array(row[:1], type_), *(pa.array([x]) for x in row[1:])], names=[by, "_span", *(f"_{n}{v}" for v in range(len(values)) for n in "fc")])

    pairs = ", ".join(f"_f{v} double, _c{v} double" for v in range(len(values)))
    cut = own.select(by, "_span", *after).repartition(by, "_span").sortWithinPartitions(by, "_span", order)
    spans = cut.mapInArrow(constants, f"{key}, {pairs}")

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(by, span, mean that comes in of each value): a fold over one row a span."""
        run, state = None, []
        for batch in batches:
            out: list[list] = [[] for _ in range(2 + len(values))]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != run:
                    run, state = row[0], [start] * len(values)
                for c, x in zip(out, (row[0], row[1], *state)):
                    c.append(x)
                state = [row[2 + 2 * v] * state[v] + row[3 + 2 * v] for v in range(len(values))]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], type_), pa.array(out[1], pa.int64()), *(pa.array(c, pa.float64()) for c in out[2:])], names=[by, "_span", *(f"_s{v}" for v in range(len(values)))])

    ins = ", ".join(f"_s{v} double" for v in range(len(values)))
    first = spans.repartition(by).sortWithinPartitions(by, "_span").mapInArrow(starts, f"{key}, {ins}")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The means before each row of a span, from the span's start."""
        for k, group in _groups(batches):
            out: list[list] = [[] for _ in values]
            for v in range(len(values)):
                mean = group[0][3 + len(values) + v]
                for r in group:
                    out[v].append(mean)
                    if r[3 + v] is not None:
                        mean = decay * mean + (1 - decay) * r[3 + v]
            yield pa.RecordBatch.from_arrays([pa.array([k[0]] * len(group), type_), pa.array([r[2] for r in group], pa.int64()), *(pa.array(o, pa.float64()) for o in out)], names=names)

    names = [by, order, *(f"ema_{v}" for v in values)]
    joined = own.join(first, [by, "_span"]).select(by, "_span", *after, *(f"_s{v}" for v in range(len(values))))
    schema = ", ".join([f"`{by}` {kind}", f"`{order}` long", *(f"`ema_{v}` double" for v in values)])
    out = joined.repartition(by, "_span").sortWithinPartitions(by, "_span", order).mapInArrow(fold, schema)
    return out.withColumn(order, F.col(order).cast(whole))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first two columns, group by group."""
    key, group = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != key and group:
                yield key, group
                group = []
            key = row[:2]
            group.append(row)
    if group:
        yield key, group


def page(rows: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """One page of the rows in order; empty beyond the last."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def first_accepted(rows: DataFrame, order: list[str], accept: Column, n: int, tries: int = 5) -> DataFrame:
    """The first n rows that are accepted, looking at no more than n * ``tries`` rows in order."""
    return rows.orderBy(*order).limit(n * tries).where(accept).orderBy(*order).limit(n)


def biased_choice(rows: DataFrame, depths: DataFrame, deep: Column, pick: Column, least: int) -> DataFrame:
    """Adds ``target``: where ``deep`` is true one of the quantities of at least ``least`` depth, else any of ``depths`` (v, depth).

    The quantities are those of a formula table; they become two arrays by scalar subqueries. Without deep ones any is taken.
    """
    pool = lambda own: own.agg(F.array_sort(F.collect_list("v")).alias("p")).scalar()
    both = rows.withColumn("_deep", pool(depths.where(F.col("depth") >= least))).withColumn("_any", pool(depths))
    own = F.when(deep & (F.size("_deep") > 0), F.col("_deep")).otherwise(F.col("_any"))
    return both.withColumn("target", F.get(own, F.try_mod(pick, F.size(own)).cast("int"))).drop("_deep", "_any")


def epoch_batches(rows: DataFrame, key: str, epoch: int, size: int) -> DataFrame:
    """(key, batch): the epoch's shuffled batches; every epoch has its own order, the same on every run."""
    ranked = hash_rank(rows.select(key), [], text_hash(key, seed=epoch), [key], rows.count(), "place")
    return ranked.select(key, F.floor(F.col("place") / size).alias("batch"))
