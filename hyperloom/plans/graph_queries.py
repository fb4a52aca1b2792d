"""Graph queries over the formula table and the recorded traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyperloom.dist import read_table, text_hash_sql
from hyperloom.functions import formula as fm
from hyperloom.operators import graph, traverse, treewalk
from hyperloom.plans.registry import query


def _edges(spark, d):
    return read_table(spark, d, "hyperedges")


def _targets(spark, d):
    return _edges(spark, d).select(F.col("output").alias("target")).where("target is not null").distinct()


#: Most quantities on a dependency path, as in the inventory.
MOST_DEPTH = 10
#: Levels of formulas in an enumerated trace, the reference's default.
TRACE_DEPTH = 5

_N = "CAST(regexp_extract(id, '[0-9]+') AS INT)"


@query("build_graph", f"""
WITH seen AS (SELECT {_N} AS k, -1 AS p, output AS variable, domain FROM hyperedges UNION ALL SELECT {_N}, pos - 1, inputs[pos], domain FROM (SELECT *, unnest(range(1, len(inputs) + 1)) AS pos FROM hyperedges))
SELECT variable, arg_min(domain, k * 1000 + p) AS hypernym FROM seen WHERE variable IS NOT NULL GROUP BY variable""")
def build_graph(spark, d):
    return graph.hypernyms(_edges(spark, d).withColumn("k", F.regexp_extract("id", "[0-9]+", 0).cast("int")), "k")


@query("scan_graph_json", "SELECT id, output, unnest(inputs) AS input, coalesce(subdomain, domain) AS subdomain FROM hyperedges")
def scan_graph_json(spark, d):
    """The graph written as one JSON document and read back into edges."""
    from hyperloom.dist import shared_dir
    from hyperloom.sources import files

    path = f"{shared_dir(spark)}/graph-document"
    files.write_graph_document(_edges(spark, d), read_table(spark, d, "hypernyms"), path)
    return files.read_graph_document(spark, path).select("id", "output", F.explode("inputs").alias("input"), F.coalesce("subdomain", "domain").alias("subdomain"))


@query("all_targets", "SELECT output AS node, true AS producible FROM hyperedges UNION SELECT v, v IN (SELECT output FROM hyperedges) FROM (SELECT unnest(inputs) AS v FROM hyperedges)")
def all_targets(spark, d):
    e = _edges(spark, d)
    made = e.select(F.col("output").alias("node"), F.lit(True).alias("m")).distinct()
    return graph.nodes(e).join(made, "node", "left").select("node", F.coalesce("m", F.lit(False)).alias("producible"))


@query("all_dependencies", "SELECT v, array_to_string(list_sort(list(DISTINCT dep)), ' ') AS needs FROM (SELECT output AS v, unnest(inputs) AS dep FROM hyperedges) GROUP BY v")
def all_dependencies(spark, d):
    return graph.links(_edges(spark, d)).groupBy("v").agg(F.array_join(F.array_sort(F.collect_set("dep")), " ").alias("needs"))


DEPTH_SQL = f"""
WITH RECURSIVE l AS (SELECT DISTINCT output AS v, unnest(inputs) AS dep FROM hyperedges),
p AS (SELECT DISTINCT v, v AS e, [v] AS o, 0 AS k FROM l UNION SELECT p.v, l.dep, list_sort(list_append(p.o, l.dep)), k + 1 FROM p JOIN l ON l.v = p.e WHERE NOT list_contains(p.o, l.dep) AND k < {MOST_DEPTH}),
n AS (SELECT output AS v FROM hyperedges UNION SELECT unnest(inputs) FROM hyperedges)
SELECT n.v, coalesce(max(p.k), 0) AS depth FROM n LEFT JOIN p USING (v) GROUP BY n.v"""


@query("max_dep_depth", DEPTH_SQL)
def max_dep_depth(spark, d):
    return graph.depth(_edges(spark, d), MOST_DEPTH)


@query("deep_variables", f"SELECT v, depth FROM ({DEPTH_SQL}) WHERE depth >= 3")
def deep_variables(spark, d):
    return graph.depth(_edges(spark, d), MOST_DEPTH).where("depth >= 3")


@query("detect_cycles", """
WITH RECURSIVE l AS (SELECT DISTINCT output AS v, unnest(inputs) AS dep FROM hyperedges),
r AS (SELECT v, dep FROM l UNION SELECT r.v, l.dep FROM r JOIN l ON l.v = r.dep)
SELECT DISTINCT v AS node FROM r WHERE v = dep""")
def detect_cycles(spark, d):
    return graph.on_cycles(_edges(spark, d))


@query("prune_tree", """
WITH RECURSIVE l AS (SELECT DISTINCT output AS v, unnest(inputs) AS dep FROM hyperedges),
r AS (SELECT output AS target, output AS node FROM hyperedges UNION SELECT r.target, l.dep FROM r JOIN l ON l.v = r.node)
SELECT target, node FROM r""")
def prune_tree(spark, d):
    return graph.reachable(_edges(spark, d), _targets(spark, d))


@query("trace_to_graph", """
WITH s AS (SELECT record_id, trace.path[i] AS e, i FROM (SELECT record_id, trace, unnest(range(1, len(trace.path) + 1)) AS i FROM dataset))
SELECT record_id, e.id || '@' || i AS source, e.output AS sink, 'produces' AS relation FROM s WHERE e.id IS NOT NULL AND e.output IS NOT NULL
UNION SELECT record_id, x, f, 'input' FROM (SELECT record_id, unnest(e.inputs) AS x, e.id || '@' || i AS f FROM s) WHERE x IS NOT NULL AND f IS NOT NULL""")
def trace_to_graph(spark, d):
    return graph.trace_graph(read_table(spark, d, "dataset"), "record_id")[1]


_NODES = """
WITH s AS (SELECT record_id, trace.target AS t, trace.leafs AS lf, trace.path[i] AS e, i FROM (SELECT record_id, trace, unnest(range(1, len(trace.path) + 1)) AS i FROM dataset)),
n AS (SELECT record_id, t, lf, e.output AS node, true AS made FROM s WHERE e.id IS NOT NULL UNION ALL SELECT record_id, t, lf, unnest(e.inputs), false FROM s WHERE e.id IS NOT NULL),
k AS (SELECT record_id, node, CASE WHEN bool_or(coalesce(node = t, false)) THEN 'target' WHEN bool_or(coalesce(list_contains(lf, node), false)) THEN 'leaf' WHEN bool_or(made) THEN 'derived' ELSE 'leaf' END AS kind FROM n WHERE node IS NOT NULL GROUP BY 1, 2)
"""


@query("trace_to_graph_nodes", f"{_NODES} SELECT record_id, node, kind FROM k UNION ALL SELECT DISTINCT record_id, e.id || '@' || i, 'formula' FROM s WHERE e.id IS NOT NULL")
def trace_to_graph_nodes(spark, d):
    """The nodes of every drawn trace with their kinds."""
    return graph.trace_graph(read_table(spark, d, "dataset"), "record_id")[0]


@query("merged_graph", f"{_NODES} SELECT node, arg_max(kind, record_id) AS kind FROM k GROUP BY node UNION ALL SELECT DISTINCT 'T' || record_id || ':' || e.id || '@' || i, 'formula' FROM s WHERE e.id IS NOT NULL")
def merged_graph(spark, d):
    """Nodes of all drawn traces: quantities are merged, a later trace decides their kind; formulas bear their trace's number."""
    return graph.merged(*graph.trace_graph(read_table(spark, d, "dataset"), "record_id"), "record_id")[0]


@query("merged_graph_edges", """
WITH s AS (SELECT record_id, trace.path[i] AS e, i FROM (SELECT record_id, trace, unnest(range(1, len(trace.path) + 1)) AS i FROM dataset)),
f AS (SELECT 'T' || record_id || ':' || e.id || '@' || i AS f, e FROM s WHERE e.id IS NOT NULL)
SELECT f AS source, e.output AS sink, 'produces' AS relation FROM f WHERE e.output IS NOT NULL UNION SELECT x, f, 'input' FROM (SELECT unnest(e.inputs) AS x, f FROM f) WHERE x IS NOT NULL""")
def merged_graph_edges(spark, d):
    """Edges of all drawn traces."""
    return graph.merged(*graph.trace_graph(read_table(spark, d, "dataset"), "record_id"), "record_id")[1]


@query("traces_by_length", "SELECT len(trace.path) AS steps, count(*) AS traces, count(DISTINCT trace.target) AS targets FROM dataset WHERE trace.path IS NOT NULL GROUP BY 1")
def traces_by_length(spark, d):
    return read_table(spark, d, "dataset").where("trace.path is not null").groupBy(F.size("trace.path").cast("long").alias("steps")).agg(F.count(F.lit(1)).alias("traces"), F.countDistinct("trace.target").alias("targets"))


@query("trace_sample")
def trace_sample(spark, d):
    """Eight random traces of every producible target."""
    return traverse.trace_sample(_targets(spark, d).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(7)))), _edges(spark, d))


#: All traces in SQL: a state is what is still to be settled (quantities, and formulas whose inputs are), what is made and given.
_TRACES = f"""
WITH RECURSIVE g AS (SELECT map_from_entries(list({{'k': output, 'v': fs}})) AS m FROM (SELECT output, list({{'id': id, 'inputs': inputs}} ORDER BY id) AS fs FROM hyperedges GROUP BY output)),
s AS (
  SELECT DISTINCT output AS target, [{{'v': output, 'f': CAST(NULL AS VARCHAR), 'd': 0, 'up': CAST([] AS VARCHAR[])}}] AS todo, CAST([] AS VARCHAR[]) AS path, CAST([] AS VARCHAR[]) AS made, CAST([] AS VARCHAR[]) AS leafs, CAST([] AS BIGINT[]) AS place FROM hyperedges
  UNION ALL
  SELECT target,
    CASE WHEN way.kind = 'use' THEN list_concat(list_concat(list_transform(way.inputs, lambda x: {{'v': x, 'f': CAST(NULL AS VARCHAR), 'd': top.d + 1, 'up': list_append(top.up, top.v)}}), [{{'v': top.v, 'f': way.id, 'd': top.d, 'up': top.up}}]), rest) ELSE rest END,
    CASE WHEN way.kind = 'done' THEN list_append(path, top.f) ELSE path END,
    CASE WHEN way.kind = 'done' THEN list_append(made, top.v) ELSE made END,
    CASE WHEN way.kind = 'give' THEN list_append(leafs, top.v) ELSE leafs END,
    list_append(place, k)
  FROM (SELECT *, unnest(range(1, len(ways) + 1)) AS k, ways[k] AS way FROM (SELECT *, CASE
      WHEN top.f IS NOT NULL THEN [{{'kind': 'done', 'id': '', 'inputs': CAST([] AS VARCHAR[])}}]
      WHEN list_contains(made, top.v) OR list_contains(leafs, top.v) THEN [{{'kind': 'there', 'id': '', 'inputs': CAST([] AS VARCHAR[])}}]
      WHEN list_contains(top.up, top.v) THEN []
      ELSE list_concat(
        CASE WHEN top.d < {TRACE_DEPTH} THEN list_transform(list_filter(coalesce(map_extract(m, top.v)[1], []), lambda f: NOT list_contains(f.inputs, target)), lambda f: {{'kind': 'use', 'id': f.id, 'inputs': f.inputs}}) ELSE [] END,
        CASE WHEN top.v <> target THEN [{{'kind': 'give', 'id': '', 'inputs': CAST([] AS VARCHAR[])}}] ELSE [] END) END AS ways
    FROM (SELECT *, todo[1] AS top, todo[2:] AS rest FROM s WHERE len(todo) > 0) CROSS JOIN g)))
"""


@query("trace_enum", f"{_TRACES} SELECT DISTINCT target, array_to_string(path, ' ') AS path, array_to_string(list_sort(leafs), ' ') AS leafs FROM s WHERE len(todo) = 0 AND len(path) > 0")
def trace_enum(spark, d):
    """All traces of every target: formulas in order of execution, and givens."""
    t = traverse.trace_enum(_targets(spark, d), _edges(spark, d), TRACE_DEPTH)
    return t.select("target", F.array_join("path.id", " ").alias("path"), F.array_join("leafs", " ").alias("leafs"))


@query("limit_traces", f"""{_TRACES},
t AS (SELECT target, array_to_string(path, ' ') AS path, array_to_string(list_sort(leafs), ' ') AS leafs, min(place) AS place FROM s WHERE len(todo) = 0 AND len(path) > 0 GROUP BY ALL)
SELECT target, trace_no, path, leafs FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY place) - 1 AS INT) AS trace_no FROM t) WHERE trace_no < 10""")
def limit_traces(spark, d):
    """The first ten traces of every target, in the order of their choices."""
    t = traverse.trace_enum(_targets(spark, d), _edges(spark, d), TRACE_DEPTH, most=10)
    return t.select("target", "trace_no", F.array_join("path.id", " ").alias("path"), F.array_join("leafs", " ").alias("leafs"))


@query("trace_fallback", "SELECT v AS target, 0 AS steps FROM (SELECT DISTINCT unnest(inputs) AS v FROM hyperedges) WHERE v NOT IN (SELECT output FROM hyperedges)")
def trace_fallback(spark, d):
    """Quantities without a formula stand for themselves: one empty trace."""
    e = _edges(spark, d)
    bare = graph.nodes(e).withColumnRenamed("node", "target").join(_targets(spark, d), "target", "left_anti")
    return traverse.trace_chains(bare, e).select("target", F.size("path").alias("steps"))


#: The order of execution by popping formulas that wait for nothing, in SQL, of the paths of a table t (record_id, path, ks); a
#: formula waits for the last one of each output.
_POPPED = """
w AS (SELECT record_id, list_transform(ks, lambda i: list_filter(ks, lambda j: list_contains(path[i].inputs, path[j].output) AND NOT list_contains(list_transform(path[j + 1:], lambda e: e.output), path[j].output))) AS waits, ks FROM t),
q AS (SELECT record_id, waits, list_filter(ks, lambda i: len(waits[i]) = 0) AS ready, CAST([] AS BIGINT[]) AS done FROM w
  UNION ALL SELECT record_id, waits, list_concat(ready[2:], list_filter(range(1, len(waits) + 1), lambda j: list_contains(waits[j], ready[1]) AND len(list_filter(waits[j], lambda x: NOT list_contains(list_append(done, ready[1]), x))) = 0)), list_append(done, ready[1]) FROM q WHERE len(ready) > 0),
o AS (SELECT record_id, CASE WHEN len(done) = len(waits) THEN done END AS done FROM q WHERE len(ready) = 0)
"""
_ORDER = f"""
WITH RECURSIVE t AS (SELECT record_id, trace.target AS target, coalesce(trace.leafs, []) AS leafs, trace.path AS path, range(1, len(trace.path) + 1) AS ks FROM dataset WHERE len(trace.path) > 0),
{_POPPED}"""


@query("topo_sort", f"{_ORDER} SELECT record_id, array_to_string(list_transform(done, lambda k: path[k].id), ' ') AS steps FROM o JOIN t USING (record_id)")
def topo_sort(spark, d):
    """The formulas of every recorded trace in order of execution; null where they need one another in a ring."""
    rows = read_table(spark, d, "dataset").where(F.size("trace.path") > 0)
    return rows.select("record_id", F.array_join(F.transform(graph.execution_order(F.col("trace.path")), lambda e: e["id"]), " ").alias("steps"))


#: Chains in SQL: each state follows one quantity; a way is a formula and the input to be followed next, or the end.
_CHAINS = f"""
WITH RECURSIVE g AS (SELECT map_from_entries(list({{'k': output, 'v': fs}})) AS m FROM (SELECT output, list({{'id': id, 'output': output, 'inputs': list_filter(coalesce(inputs, []), lambda x: x IS NOT NULL)}} ORDER BY {_N}, id) AS fs FROM hyperedges GROUP BY output)),
s AS (
  SELECT DISTINCT output AS target, output AS v, CAST([] AS STRUCT(id VARCHAR, output VARCHAR, inputs VARCHAR[])[]) AS path, CAST([] AS VARCHAR[]) AS seen, CAST([] AS VARCHAR[]) AS loops, 0 AS level, CAST([] AS BIGINT[]) AS place FROM hyperedges
  UNION ALL
  SELECT target, way.x, CASE WHEN way.f IS NULL THEN path ELSE list_append(path, way.f) END, CASE WHEN way.f IS NULL THEN seen ELSE met END, CASE WHEN way.f IS NULL THEN loops ELSE list_concat(loops, list_filter(way.f.inputs, lambda x: list_contains(met, x) AND x <> v)) END, level + 1, list_concat(place, way.at)
  FROM (SELECT *, unnest(CASE WHEN len(found) = 0 THEN [{{'f': NULL, 'x': NULL, 'at': [CAST(0 AS BIGINT)]}}] ELSE flatten(list_transform(range(1, len(found) + 1), lambda k: CASE WHEN list_contains(found[k].inputs, target) THEN [] ELSE list_concat(
          CASE WHEN len(list_filter(found[k].inputs, lambda x: list_contains(met, x) AND x <> v)) > 0 AND len(list_filter(found[k].inputs, lambda x: NOT list_contains(met, x))) = 0 THEN [{{'f': found[k], 'x': CAST(NULL AS VARCHAR), 'at': [k, 0]}}] ELSE [] END,
          list_transform(list_filter(range(1, len(found[k].inputs) + 1), lambda j: NOT list_contains(met, found[k].inputs[j])), lambda j: {{'f': found[k], 'x': found[k].inputs[j], 'at': [k, j]}})) END)) END) AS way
    FROM (SELECT *, list_append(seen, v) AS met, CASE WHEN level < 10 THEN coalesce(map_extract(m, v)[1], []) ELSE [] END AS found FROM s CROSS JOIN g WHERE v IS NOT NULL))),
c AS (SELECT target, path, list_concat(seen, flatten(list_transform(path, lambda f: f.inputs))) AS near, seen, loops, place, list_transform(path, lambda f: f.output) AS outs FROM s WHERE v IS NULL),
d AS (SELECT *, row_number() OVER (PARTITION BY target, list_sort(list_transform(path, lambda f: f.id)) ORDER BY place) AS again FROM c),
t AS (SELECT *, range(1, len(path) + 1) AS ks FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY place) AS nth, row_number() OVER () AS record_id FROM d WHERE again = 1) WHERE nth <= 100),
{_POPPED},
r AS (SELECT target, place, list_transform(done, lambda k: path[k].id) AS ids, list_sort(list_distinct(list_filter(near, lambda x: NOT list_contains(outs, x) AND NOT list_contains(loops, x) AND x <> target))) AS leafs FROM t JOIN o USING (record_id) WHERE done IS NOT NULL),
a AS (SELECT target, CAST(row_number() OVER (PARTITION BY target ORDER BY place) - 1 AS INT) AS trace_no, ids, leafs FROM r
  UNION ALL SELECT DISTINCT output, 0, CAST([] AS VARCHAR[]), [output] FROM hyperedges WHERE output NOT IN (SELECT target FROM r))
"""


@query("trace_enum_chain", f"{_CHAINS} SELECT target, trace_no, array_to_string(ids, ' ') AS path, array_to_string(leafs, ' ') AS leafs FROM a")
def trace_enum_chain(spark, d):
    """Completed chains of every target."""
    t = traverse.trace_chains(_targets(spark, d), _edges(spark, d))
    return t.select("target", "trace_no", F.array_join("path.id", " ").alias("path"), F.array_join("leafs", " ").alias("leafs"))


@query("traces_formatted", f"{_CHAINS} SELECT target, trace_no, CAST(len(ids) AS INT) AS steps, array_to_string(ids, ' > ') AS line, array_to_string(leafs, ', ') AS given FROM a")
def traces_formatted(spark, d):
    """Chains as text lines."""
    t = traverse.trace_chains(_targets(spark, d), _edges(spark, d))
    return t.select("target", "trace_no", F.size("path").alias("steps"), F.array_join("path.id", " > ").alias("line"), F.array_join("leafs", ", ").alias("given"))


#: A domain may feed another: (producer, consumer).
FITS = [("pump_hydraulics", "belt_drives")]


@query("trace_complete", f"""{_ORDER},
c AS (SELECT record_id, target, leafs, list_transform(done, lambda k: path[k]) AS run FROM o JOIN t USING (record_id)),
x AS (SELECT record_id, bool_or(coalesce(m.domain, 'unknown') <> coalesce(u.domain, 'unknown') AND NOT (coalesce(m.domain, 'unknown') = 'pump_hydraulics' AND coalesce(u.domain, 'unknown') = 'belt_drives') AND list_contains(u.inputs, m.output)) AS odd
      FROM (SELECT record_id, unnest(run) AS m, run FROM c) CROSS JOIN LATERAL (SELECT unnest(run) AS u) WHERE NOT list_contains(list_transform(list_slice(run, list_position(run, m) + 1, len(run)), lambda e: e.output), m.output) GROUP BY record_id)
SELECT record_id, CASE WHEN NOT odd THEN array_to_string(list_transform(run, lambda e: e.id), ' ') END AS steps,
  CASE WHEN NOT odd THEN array_to_string(list_sort(list_distinct(list_filter(list_concat(leafs, list_filter(flatten(list_transform(run, lambda e: e.inputs)), lambda v: NOT list_contains(list_transform(run, lambda e: e.output), v) AND v IS DISTINCT FROM target)), lambda v: v IS NOT NULL))), ' ') END AS givens
FROM c LEFT JOIN x USING (record_id)""")
def trace_complete(spark, d):
    """Every recorded trace in order of execution with all that must be given; null where it cannot run or domains do not fit."""
    rows = read_table(spark, d, "dataset").where(F.size("trace.path") > 0)
    rows = rows.select("record_id", "trace.target", F.coalesce("trace.leafs", F.array().cast("array<string>")).alias("leafs"), graph.execution_order(F.col("trace.path")).alias("run"))
    done = graph.completed(F.col("run"), F.col("leafs"), F.col("target"), FITS)
    return rows.select("record_id", done.alias("c")).select("record_id", F.array_join(F.transform("c.path", lambda e: e["id"]), " ").alias("steps"), F.array_join("c.leafs", " ").alias("givens"))


@query("tree_walk")
def tree_walk(spark, d):
    """Four walks of every target with levels, formulas and values."""
    return treewalk.tree_walks(_targets(spark, d).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(3)))), _edges(spark, d))


@query("walk_length")
def walk_length(spark, d):
    return treewalk.tree_walks(_targets(spark, d).withColumn("seed", F.lit(0)), _edges(spark, d)).groupBy("target").agg(F.max("length").alias("length"), F.count_if("leaf").alias("leafs"))


#: A formula in SQL: names become their values, then the innermost and tightest operation is done, one in each round.
_X = r"(-?[0-9.]+(?:e[+-]?[0-9]+)?)"
_VALUES = rf"""
WITH RECURSIVE g AS (SELECT variable, (100 + {text_hash_sql('variable', seed=42)} // 8 % 9901) / 100.0 AS value FROM hypernyms),
n AS (SELECT id, label, unnest(list_distinct(regexp_extract_all(label, '[a-zA-Z_][a-zA-Z0-9_]*'))) AS v FROM hyperedges),
l AS (SELECT id, any_value(label) AS label, list_sort(list({{'n': -length(v), 'v': v, 'x': CAST(value AS VARCHAR)}}) FILTER (value IS NOT NULL)) AS names FROM n LEFT JOIN g ON g.variable = n.v GROUP BY id),
e AS (SELECT id, list_reduce(list_prepend(label, list_transform(names, lambda y: y.v || '=' || y.x)), lambda t, y: regexp_replace(t, '\b' || split_part(y, '=', 1) || '\b', split_part(y, '=', 2), 'g')) AS t FROM l
  UNION ALL
  SELECT id, CASE
      WHEN regexp_matches(p, '^{_X}$') THEN CASE f WHEN 'sqrt' THEN replace(t, 'sqrt(' || p || ')', CAST(sqrt(CAST(p AS DOUBLE)) AS VARCHAR)) WHEN 'log10' THEN replace(t, 'log10(' || p || ')', CAST(log10(CAST(p AS DOUBLE)) AS VARCHAR)) ELSE replace(t, '(' || p || ')', p) END
      ELSE replace(t, o, CAST(CASE s WHEN '^' THEN pow(a, b) WHEN '*' THEN a * b WHEN '/' THEN a / nullif(b, 0) WHEN '+' THEN a + b ELSE a - b END AS VARCHAR)) END
  FROM (SELECT *, TRY_CAST(regexp_extract(o, '^{_X}', 1) AS DOUBLE) AS a, TRY_CAST(regexp_extract(o, '{_X}$', 1) AS DOUBLE) AS b, CASE WHEN contains(o, '^') THEN '^' ELSE regexp_extract(o, ' ([*/+-]) ', 1) END AS s
        FROM (SELECT *, coalesce(nullif(regexp_extract(p, '{_X}\^{_X}'), ''), nullif(regexp_extract(p, '{_X} [*/] {_X}'), ''), regexp_extract(p, '{_X} [+-] {_X}')) AS o
              FROM (SELECT id, t, coalesce(nullif(regexp_extract(t, '\(([^()]*)\)', 1), ''), t) AS p, regexp_extract(t, '([a-z0-9]*)\([^()]*\)', 1) AS f FROM e WHERE NOT regexp_matches(t, '^{_X}$') AND regexp_matches(t, '^[-0-9.e+*/^ ()sqrtlog]*$'))) WHERE o <> '' OR regexp_matches(p, '^{_X}$'))),
v AS (SELECT id, max(CAST(t AS DOUBLE)) AS value FROM e WHERE regexp_matches(t, '^{_X}$') GROUP BY id)
"""


@query("safe_eval", f"{_VALUES} SELECT h.id, v.value, len(h.inputs) AS inputs FROM hyperedges h LEFT JOIN v USING (id)")
def safe_eval(spark, d):
    """Every formula evaluated on a given value for each quantity; null where it is undefined."""
    return _evaluated(spark, d).select("id", "value", F.size("inputs").cast("long").alias("inputs"))


def _evaluated(spark, d):
    """Formulas with their values on those that ``uniform_value`` gives."""
    from hyperloom.plans.record_queries import uniform_value

    e = _edges(spark, d)
    forms = {f for own in treewalk.variables_of(e).values() for f, _ in own}  # a fixed table
    needed = e.select("id", F.explode(F.array_distinct("inputs")).alias("variable")).where("variable is not null")
    given = needed.join(uniform_value(spark, d).dropDuplicates(["variable"]), "variable").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("variable", "value"))).alias("given"))
    value = F.when(F.lit(False), F.lit(None).cast("double"))
    for f in sorted(forms):  # one flat CASE
        value = value.when(F.col("label") == f, fm.column(f, lambda n: F.try_element_at("given", F.lit(n))))
    rows = e.join(given, "id", "left").withColumn("value", value)
    return rows.withColumn("value", F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value")))


_GIVEN_FROM = 30.0


@query("find_working_formula", f"""
WITH g AS (SELECT variable, (100 + {text_hash_sql('variable', seed=42)} // 8 % 9901) / 100.0 AS value FROM hypernyms),
u AS (SELECT id, output, unnest(CASE WHEN len(inputs) > 0 THEN inputs ELSE [NULL] END) AS v FROM hyperedges),
k AS (SELECT id, output, bool_and(v IS NULL OR coalesce(value >= {_GIVEN_FROM}, false)) AND NOT bool_or(coalesce(v LIKE '%\\_rate' ESCAPE '\\', false)) AS works FROM u LEFT JOIN g ON g.variable = u.v GROUP BY 1, 2)
SELECT output, min(id) AS id FROM k WHERE works GROUP BY output""")
def find_working_formula(spark, d):
    """Of every quantity the first formula by id that needs only what is there and no rate.

    There are the quantities to which ``uniform_value`` gives at least ``_GIVEN_FROM``.
    """
    from hyperloom.plans.record_queries import uniform_value

    e = _edges(spark, d)
    have = uniform_value(spark, d).where(F.col("value") >= _GIVEN_FROM).select("variable")
    shun = graph.nodes(e).where(F.col("node").endswith("_rate")).select(F.col("node").alias("variable"))
    return graph.working_formula(e, have, shun)


@query("eval_backward")
def eval_backward(spark, d):
    """Values of the targets of random walks."""
    return treewalk.tree_walks(_targets(spark, d).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(3)))), _edges(spark, d)).where("node = target").select("target", "seed", "value")


@query("cycle_break")
def cycle_break(spark, d):
    """Derived quantities of walks through quantities that lie on a cycle."""
    on = graph.on_cycles(_edges(spark, d)).select(F.col("node").alias("target"))
    return treewalk.tree_walks(on.withColumn("seed", F.lit(1)), _edges(spark, d), 6).select("target", "node", "level", "leaf", "value")


@query("creates_cycle", """
SELECT a.id, bool_or(b.id IS NOT NULL OR list_contains(a.inputs, a.output)) AS turns_back FROM hyperedges a LEFT JOIN hyperedges b ON list_contains(a.inputs, b.output) AND list_contains(b.inputs, a.output) GROUP BY a.id""")
def creates_cycle(spark, d):
    """Whether a formula needs its own quantity, itself or through one other formula."""
    e = _edges(spark, d)
    own = e.select("id", "output", F.explode("inputs").alias("x"))
    back = e.select(F.col("output").alias("x"), F.explode("inputs").alias("y"))
    two = own.join(back, "x").where("y = output").select("id")
    hits = own.where("x = output").select("id").union(two).distinct().withColumn("t", F.lit(True))
    return e.select("id").join(hits, "id", "left").select("id", F.coalesce("t", F.lit(False)).alias("turns_back"))


@query("try_formulas", f"{_VALUES} SELECT h.output, min(h.id) AS id, arg_min(v.value, h.id) AS value FROM hyperedges h JOIN v USING (id) WHERE v.value IS NOT NULL GROUP BY h.output")
def try_formulas(spark, d):
    """Of every quantity the first formula by id that has a value on the given ones, and the value."""
    return _evaluated(spark, d).where("value is not null").groupBy("output").agg(F.min("id").alias("id"), F.min_by("value", "id").alias("value"))
