"""Graph operators that relational plans express: nodes, chains, depth, cycles, reachability, drawings of traces.

``edges`` always has id, output, inputs array<string>, domain and further columns of the formula table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.dist import SharedTable, shared_table, sized_join


def links(edges: DataFrame) -> DataFrame:
    """(v, dep): every quantity with what one of its formulas needs."""
    return edges.select(F.col("output").alias("v"), F.explode("inputs").alias("dep")).where("v is not null and dep is not null").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("output").alias("node")).union(edges.select(F.explode("inputs")))
    return e.where("node is not null").distinct()


def hypernyms(edges: DataFrame, order: str) -> DataFrame:
    """(variable, hypernym): the domain in which a quantity is seen first, an output before the inputs of its formula."""
    seen = edges.select(F.col(order).alias("k"), F.lit(-1).alias("p"), F.col("output").alias("variable"), "domain")
    used = edges.select(F.col(order).alias("k"), F.posexplode("inputs").alias("p", "variable"), "domain").select("k", "p", "variable", "domain")
    return seen.union(used).where("variable is not null").groupBy("variable").agg(F.min_by("domain", F.struct("k", "p")).alias("hypernym"))


def depth(edges: DataFrame, most: int) -> DataFrame:
    """(v, depth): the longest simple dependency path, up to ``most`` steps; 0 for what no formula makes.

    A path is known by its end and the set of quantities on it, so paths that differ only in their order are one row.
    """
    d = edges.sparkSession
    own = shared_table(links(edges), "links")
    made = own.df.select("v").distinct()
    level = made.select("v", F.col("v").alias("end"), F.array("v").alias("on"))
    best = nodes(edges).select(F.col("node").alias("v"), F.lit(0).alias("depth"))
    for k in range(1, most + 1):
        step = level.join(F.broadcast(own.df.select(F.col("v").alias("end"), "dep")) if own.fits(1 << 23) else own.df.select(F.col("v").alias("end"), "dep"), "end")
        step = step.where(~F.array_contains("on", F.col("dep"))).select("v", F.col("dep").alias("end"), F.array_sort(F.array_append("on", F.col("dep"))).alias("on")).distinct()
        table = shared_table(step, "paths")
        if not table.rows():
            break
        best = best.union(table.df.select("v", F.lit(k)))
        level = table.df
    return best.groupBy("v").agg(F.max("depth").alias("depth"))


def _closure(own: SharedTable) -> SharedTable:
    """(v, dep) of everything that v needs in turn, from its links; paths double in length every round."""
    rows, found = own.rows(), own
    while True:
        further = found.df.select(F.col("v").alias("_s"), F.col("dep").alias("v"))
        step = shared_table(found.df.select(F.col("v").alias("v"), F.col("dep").alias("_to")), "steps")
        longer = sized_join(further, step, "v").select(F.col("_s").alias("v"), F.col("_to").alias("dep"))
        grown = shared_table(found.df.union(longer).distinct(), "closure")
        step.drop()
        if found is not own:
            found.drop()
        more, found = grown.rows(), grown
        if more == rows:
            return found
        rows = more


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(target, node): everything that the formulas of a target may need, the target included; ``start`` has target."""
    own = start.select("target").where("target is not null").distinct()
    all_ = _closure(shared_table(links(edges), "links"))
    needs = sized_join(own.withColumnRenamed("target", "v"), all_, "v").select(F.col("v").alias("target"), F.col("dep").alias("node"))
    return own.select("target", F.col("target").alias("node")).union(needs.where("target <> node"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node): quantities that their own formulas need in turn.

    Nodes that nothing needs, or that need nothing with a formula, cannot lie on a cycle; they are peeled off first.
    """
    table = shared_table(links(edges), "core")
    while True:
        made, used = table.df.select("v").distinct(), table.df.select(F.col("dep").alias("v")).distinct()
        core = made.join(used, "v", "left_semi")
        kept = table.df.join(core, "v", "left_semi").join(core.withColumnRenamed("v", "dep"), "dep", "left_semi").select("v", "dep")
        smaller = shared_table(kept, "core")
        done = smaller.rows() == table.rows()
        table.drop()
        table = smaller
        if done:
            break
    return _closure(table).df.where("v = dep").select(F.col("v").alias("node")).distinct()


def trace_graph(traces: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, node, kind) and edges (key, source, sink, relation) of drawn traces.

    Quantities meet formulas: an input leads to formula@step, which leads to its output. Only what an edge meets is a node:
    the target if it is the trace's, else a leaf if the trace gives it, else derived if a step makes it, else a leaf.
    """
    steps = traces.where("trace.path is not null").select(F.col(key), "trace.target", "trace.leafs", F.posexplode("trace.path").alias("i", "e")).where("e.id is not null")
    formula = F.concat(F.col("e.id"), F.lit("@"), F.col("i") + 1)
    made = steps.select(key, formula.alias("source"), F.col("e.output").alias("sink"), F.lit("produces").alias("relation"))
    used = steps.select(key, F.explode("e.inputs").alias("source"), formula.alias("sink"), F.lit("input").alias("relation"))
    edges = made.union(used).where("source is not null and sink is not null").distinct()
    ends = steps.select(key, "target", "leafs", F.explode(F.array_append(F.transform(F.coalesce("e.inputs", F.array().cast("array<string>")), lambda v: F.struct(v.alias("node"), F.lit(False).alias("made"))), F.struct(F.col("e.output").alias("node"), F.lit(True).alias("made")))).alias("x"))
    rank = F.when(F.col("x.node") == F.col("target"), 0).when(F.array_contains("leafs", F.col("x.node")), 1).when(F.col("x.made"), 2).otherwise(3)
    quantities = ends.where("x.node is not null").groupBy(key, F.col("x.node").alias("node")).agg(F.min(rank).alias("rank"))
    kinds = F.array(*map(F.lit, ("target", "leaf", "derived", "leaf")))
    formulas = steps.select(key, formula.alias("node"), F.lit("formula").alias("kind"))  # the step keeps them apart
    return quantities.select(key, "node", F.get(kinds, F.col("rank")).alias("kind")).union(formulas), edges


def merged(nodes: DataFrame, edges: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, kind) and edges (source, sink, relation) of several drawn traces as one graph.

    Formulas bear the number of their trace, T<key>:; quantities are merged, and the last trace decides their kind.
    """
    name = lambda c: F.concat(F.lit("T"), F.col(key).cast("string"), F.lit(":"), F.col(c))
    quantities = nodes.where("kind <> 'formula'").groupBy("node").agg(F.max_by("kind", key).alias("kind"))
    formulas = nodes.where("kind = 'formula'").select(name("node").alias("node"), "kind")
    made = F.col("relation") == "produces"
    lines = edges.select(F.when(made, name("source")).otherwise(F.col("source")).alias("source"), F.when(made, F.col("sink")).otherwise(name("sink")).alias("sink"), "relation")
    return quantities.union(formulas), lines.distinct()


def execution_order(path: Column) -> Column:
    """The formulas so that each follows what it needs, as early as possible; null if they need one another in a ring.

    Formulas that wait for nothing run first, in the order of the path, then those that this sets free. Of formulas with
    the same output the last counts. One pass over the (short) path, inside the JVM.
    """
    n = F.size(path)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    outputs = F.transform(path, lambda e: e["output"])
    last = F.filter(places, lambda j: ~F.array_contains(F.slice(outputs, j + 2, F.greatest(n, F.lit(1))), F.get(outputs, j)))
    waits = F.transform(path, lambda e: F.filter(last, lambda j: F.array_contains(e["inputs"], F.get(outputs, j))))
    first = F.filter(places, lambda i: F.size(F.get(waits, i)) == 0)
    start = F.struct(waits.alias("waits"), first.alias("ready"), F.array().cast("array<int>").alias("done"))

    def step(s: Column, _: Column) -> Column:
        at = F.get(s["ready"], F.lit(0))
        done = F.array_append(s["done"], at)
        freed = F.filter(places, lambda j: F.array_contains(F.get(s["waits"], j), at) & (F.size(F.array_except(F.get(s["waits"], j), done)) == 0))
        ready = F.concat(F.slice(s["ready"], 2, F.greatest(n, F.lit(1))), freed)
        return F.when(F.size(s["ready"]) > 0, F.struct(s["waits"].alias("waits"), ready.alias("ready"), done.alias("done"))).otherwise(s)

    done = F.aggregate(places, start, step, lambda s: s["done"])
    return F.when(F.size(done) == n, F.transform(done, lambda k: F.get(path, k)))


def completed(run: Column, leafs: Column, target: Column, fits: list[tuple[str, str]]) -> Column:
    """struct<path, leafs> of a trace in order of execution with all that must be given; null where it cannot run.

    A step may use what a step of another domain makes only if ``fits`` names the two (producer, consumer). What no step
    makes is given, but for the target.
    """
    domain = lambda e: F.coalesce(e["domain"], F.lit("unknown"))
    outputs = F.transform(run, lambda e: e["output"])
    maker = F.map_from_entries(F.array_distinct(F.transform(run, lambda e: F.struct(e["output"], F.element_at(F.transform(F.filter(run, lambda m: m["output"] == e["output"]), domain), -1)))))
    allowed = F.array(*(F.lit(f"{p}>{c}") for p, c in fits)) if fits else F.array().cast("array<string>")
    clash = lambda e: F.exists(e["inputs"], lambda v: F.coalesce((F.try_element_at(maker, v) != domain(e)) & ~F.array_contains(allowed, F.concat(F.try_element_at(maker, v), F.lit(">"), domain(e))), F.lit(False)))
    missing = F.filter(F.flatten(F.transform(run, lambda e: e["inputs"])), lambda v: v.isNotNull() & ~F.array_contains(outputs, v) & ~v.eqNullSafe(target))
    givens = F.array_sort(F.array_distinct(F.array_compact(F.concat(leafs, missing))))
    return F.when(run.isNotNull() & ~F.exists(run, clash), F.struct(run.alias("path"), givens.alias("leafs")))


def working_formula(edges: DataFrame, available: DataFrame, excluded: DataFrame) -> DataFrame:
    """(output, id): of every quantity its first formula by id that needs only ``available`` (variable) and none ``excluded``."""
    needs = edges.where("id is not null and output is not null").select("id", "output", F.explode_outer(F.array_distinct("inputs")).alias("variable"))
    there = shared_table(available.select("variable").distinct().withColumn("there", F.lit(True)), "there")
    shunned = shared_table(excluded.select("variable").distinct().withColumn("shunned", F.lit(True)), "shunned")
    met = sized_join(sized_join(needs, there, "variable", "left"), shunned, "variable", "left")
    ok = F.bool_and(F.col("variable").isNull() | (F.coalesce("there", F.lit(False)) & ~F.coalesce("shunned", F.lit(False))))
    return met.groupBy("output", "id").agg(ok.alias("ok")).where("ok").groupBy("output").agg(F.min("id").alias("id"))
