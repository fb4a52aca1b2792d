"""Projections, filters and joins over question records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_of(*cols: Column) -> Column:
    """The first that is neither null nor empty; '' if none is."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols), F.lit(""))


def project_trace(trace: Column) -> Column:
    """The trace with its steps' fields in a fixed order; a step without a subdomain takes its domain."""
    step = lambda e: F.struct(e["id"], e["output"], e["inputs"], e["label"], e["domain"], F.coalesce(e["subdomain"], e["domain"]).alias("subdomain"))
    return F.struct(trace["target"].alias("target"), F.transform(trace["path"], step).alias("path"), trace["leafs"].alias("leafs"), trace["chapters"].alias("chapters"), trace["hypernym"].alias("hypernym"))


def quality_tests(feasibility: Column, coverage: Column, target_present: Column, least_feasibility: int, least_coverage: float) -> Column:
    """The failed tests joined by ', ', '' if all pass; a null value fails its test."""
    low_f = F.when(~F.coalesce(feasibility >= least_feasibility, F.lit(False)), F.format_string(f"feas=%d<{least_feasibility}", F.coalesce(feasibility, F.lit(-1))))
    low_c = F.when(~F.coalesce(coverage >= least_coverage, F.lit(False)), F.format_string(f"cov=%.2f<{least_coverage}", F.coalesce(coverage, F.lit(0.0))))
    no_target = F.when(~F.coalesce(target_present, F.lit(False)), F.lit("target_missing"))
    return F.concat_ws(", ", low_f, low_c, no_target)


def failure_kind(least_feasibility: int, least_coverage: float) -> Column:
    """Where an attempt failed, by what its row holds: no answer, the wrong difficulty, no question, given up, tests."""
    f = F.col("claude_faithfulness")
    failed = quality_tests(F.col("claude_feasibility"), f["variable_coverage"], f["target_present"], least_feasibility, least_coverage)
    asked = F.array_contains("parsed_difficulties", F.col("requested_difficulty"))
    return (
        F.when(F.coalesce("error", F.lit("")) != "", "gen_exception")
        .when((F.size("parsed_difficulties") > 0) & ~F.coalesce(asked, F.lit(False)), "wrong_difficulty")
        .when(F.trim(F.coalesce("question", F.lit(""))) == "", "parse_error")
        .when(F.coalesce("drop_reason", F.lit("")).contains("attempts"), "gave_up")
        .when(failed != "", "quality_filter")
        .otherwise("kept")
    )


def retries(failed: DataFrame, passed: DataFrame, most: int, tokens: int) -> DataFrame:
    """(target, requested_difficulty, last, passed, remaining, more_tokens) of what was tried.

    A difficulty remains while it has neither passed nor been given up and attempts are left; the next one may use
    ``tokens`` more for each attempt before it.
    """
    keys = ["target", "requested_difficulty"]
    known = "target is not null and requested_difficulty is not null"
    gave_up = F.coalesce("drop_reason", F.lit("")).contains("attempts")
    tried = failed.where(known).groupBy(*keys).agg(F.max("attempt").alias("last"), F.bool_or(gave_up).alias("_up"))
    done = passed.where(known).select(*keys).distinct().withColumn("_passed", F.lit(True))
    both = tried.join(done, keys, "full").select(*keys, F.coalesce("last", F.lit(0)).alias("last"), F.coalesce("_up", F.lit(False)).alias("_up"), F.coalesce("_passed", F.lit(False)).alias("passed"))
    both = both.withColumn("remaining", ~F.col("passed") & ~F.col("_up") & (F.col("last") < most))
    return both.withColumn("more_tokens", F.when(F.col("remaining"), tokens * F.col("last"))).drop("_up")


def with_input_units(edges: DataFrame) -> DataFrame:
    """Formulas with ``input_units``, a map from each input to the unit that the first formula giving it has."""
    own = edges.groupBy(F.col("output").alias("v")).agg(F.min_by("output_unit", "id").alias("u")).where("u is not null")
    used = edges.select("id", F.explode(F.array_distinct("inputs")).alias("v")).join(own, "v")
    maps = used.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("v", "u"))).alias("input_units"))  # a formula's inputs
    return edges.join(maps, "id", "left")


def first_input_unit(edges: DataFrame) -> DataFrame:
    """(variable, unit): of the first formula by id whose ``input_units`` name the variable."""
    units = edges.select("id", F.explode("input_units").alias("variable", "u"))
    return units.groupBy("variable").agg(F.min_by("u", "id").alias("unit"))


def scores_by_index(items: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """(key, score, reward) of every item (key, asked) from ``judged`` (key, score), whatever order they come back in.

    An item that was not asked has 0 and -1; one whose score is missing counts as 5. Scores are held within 0..10.
    """
    score = F.when(~F.col("asked"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(F.col("score").cast("double"), F.lit(5.0)))))
    rows = items.join(judged, key, "left").withColumn("score", score)
    return rows.select(key, "score", F.when(F.col("asked"), F.col("score") / 10 * 2 - 1).otherwise(-1.0).alias("reward"))


def browse(records: DataFrame, difficulties: list[int] | None = None, chapters: list[str] | None = None, containing: str | None = None, faithful: bool | None = None, with_reasoning: bool | None = None) -> DataFrame:
    """Records by facets; None leaves a facet open. The substring is looked for in target, question and reasoning."""
    out = records
    if difficulties is not None:
        out = out.where(F.col("requested_difficulty").isin(difficulties))
    if chapters is not None:
        out = out.where(F.coalesce(F.get("trace.chapters", F.lit(0)), F.lit("")).isin(chapters))
    if containing:
        part = F.lit(containing.lower())
        out = out.where(F.lower(F.concat_ws("\n", "target", "question", "chain_of_thought")).contains(part))
    if faithful is not None:
        out = out.where(F.coalesce("claude_faithfulness.faithful", F.lit(False)) == faithful)
    if with_reasoning is not None:
        out = out.where((F.trim(F.coalesce("chain_of_thought", F.lit(""))) != "") == with_reasoning)
    return out


def held_out(pool: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows of the pool whose key is not among the used ones; the whole pool if none is left."""
    fresh = pool.join(used.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return fresh.unionByName(pool.where(~fresh.limit(1).exists()))


def positional_pairs(left: DataFrame, right: DataFrame, left_order: str, right_order: str, columns: list[str]) -> DataFrame:
    """Row i of one side beside row i of the other, by running numbers, with a flag where ``columns`` differ.

    Numbers come from per-partition counts of a range sort, so neither side passes through one task.
    """
    l, r = numbered(left.select(left_order, *columns), left_order).alias("l"), numbered(right.select(right_order, *columns), right_order).alias("r")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return l.join(r, "n").select("n", F.col(f"l.{left_order}").alias("left_id"), F.col(f"r.{right_order}").alias("right_id"), (~same).alias("differs"))


def numbered(rows: DataFrame, order: str, side: int = 48) -> DataFrame:
    """Adds n: the 0-based place of each row by a unique integer column.

    Quantiles of the column cut the rows into about equal buckets, whatever its spread; each row's place is its bucket's
    offset and its place there. A bucket is found in two steps of ``side`` bounds each.
    """
    k = side * side
    at = F.array(*(F.lit(i / k) for i in range(1, k)))
    bounds = rows.agg(F.percentile_approx(order, at, 20_000)).scalar()
    b = rows.withColumn("_q", bounds)
    below = lambda c: F.size(F.filter(c, lambda q: q < F.col(order)))
    coarse = F.transform(F.sequence(F.lit(1), F.lit(side - 1)), lambda i: F.get(F.col("_q"), i * side - 1))
    b = b.withColumn("_c", below(coarse)).withColumn("_b", F.col("_c") * side + below(F.slice("_q", F.col("_c") * side + 1, F.lit(side - 1)))).drop("_q", "_c")
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over at most side * side rows
    starts = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_s", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = Window.partitionBy("_b").orderBy(order)
    return b.join(F.broadcast(starts), "_b").withColumn("n", F.col("_s") + F.row_number().over(inside) - 1).drop("_b", "_s")


def incompatible_steps(steps: DataFrame, allowed: DataFrame) -> DataFrame:
    """Traces with a step that uses what a step of a domain not allowed for it produces.

    ``steps`` has trace, output, inputs, domain; ``allowed`` has producer, consumer. A domain may always feed itself.
    """
    made = steps.select("trace", F.col("output").alias("v"), F.coalesce("domain", F.lit("unknown")).alias("producer"))
    used = steps.select("trace", F.explode("inputs").alias("v"), F.coalesce("domain", F.lit("unknown")).alias("consumer"))
    met = used.join(made, ["trace", "v"]).where("producer <> consumer")
    return met.join(allowed, ["producer", "consumer"], "left_anti").select("trace").distinct()
