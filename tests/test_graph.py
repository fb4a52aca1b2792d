"""Walks: properties of every trace, a brute-force enumeration, rings, ties and empty graphs."""

import itertools
import random

from pyspark.sql import functions as F

from hyperloom.functions import formula as fm
from hyperloom.operators import graph as relational
from hyperloom.operators import traverse as tr
from hyperloom.operators import treewalk as tw
from hyperloom.plans import graph_queries, record_queries

ROWS = [("f1", "a", ["b", "c"], "x", None), ("f2", "b", ["d"], "x", "x:1"), ("f10", "b", ["e"], "y", None), ("f3", "d", ["b"], "x", None), ("f4", "e", ["a"], "y", None), ("f5", "c", [], "x", None), ("f6", "s", ["s", "d"], "x", None)]
G = tr.Graph(ROWS)


def check(t: tr.Trace, target: str):
    made = set()
    for f in t.order:
        assert all(i in made or i in t.leafs for i in f.inputs)
        made.add(f.output)
    assert target in made and target not in t.leafs and not made & t.leafs


def test_enumeration_is_sound_and_different():
    for target in ("a", "b", "d", "e"):
        found = list(tr.enumerate_traces(G, target, 4))
        assert len({(tuple(f.id for f in t.order), t.leafs) for t in found}) == len(found)
        for t in found:
            check(t, target)
    # Ids sort as text, so f10 comes before f2.
    assert [f.id for f in next(tr.enumerate_traces(G, "b", 3)).order][-1] == "f10"
    assert len(list(tr.enumerate_traces(G, "a", 3, most=2))) == 2
    assert list(tr.enumerate_traces(G, "nothing", 3)) == []


def test_enumeration_against_all_choices():
    """Without cycles the traces are all ways to give or derive what is needed."""
    g = tr.Graph([("f1", "t", ["p", "q"], "x", None), ("f2", "p", ["r"], "x", None), ("f3", "p", ["s"], "x", None), ("f4", "q", ["r"], "x", None)])
    want = {(frozenset({"f1", *p, *q}),) for p, q in itertools.product([(), ("f2",), ("f3",)], [(), ("f4",)])}
    assert {(frozenset(f.id for f in t.order),) for t in tr.enumerate_traces(g, "t", 3)} == want


def test_samples():
    for seed in range(40):
        t = tr.sample(G, "a", 5, seed)
        check(t, "a")
        assert tr.sample(G, "a", 5, seed) == t
    held = tr.sample(G, "a", 5, 1, single=True)
    assert {(f.domain, f.subdomain) for f in held.order} == {("x", "x")}
    assert tr.sample(G, "nothing") is None and tr.sample(tr.Graph([]), "a") is None


def test_order_and_completion():
    f = {r[0]: tr.Formula(r[0], r[1], tuple(r[2]), r[3], r[4]) for r in ROWS}
    assert [x.id for x in tr.execution_order((f["f1"], f["f2"]))] == ["f2", "f1"]
    assert tr.execution_order((f["f2"], f["f3"])) is None and tr.execution_order(()) == ()
    done = tr.complete(tr.Chain((f["f1"], f["f2"]), frozenset({"d"}), frozenset(), 2), "a")
    assert done.leafs == {"c", "d"}
    assert tr.complete(tr.Chain((f["f4"], f["f1"]), frozenset(), frozenset(), 2), "z", lambda p, c: False) is None
    assert tr.complete_chains(G, "zz") == []
    lone = tr.Graph([("f1", "t", ["p", "t"], "x", None)])
    assert tr.complete_chains(lone, "t") == [tr.Chain((), frozenset({"t"}), frozenset(), 0)]


def test_walks_and_rings():
    v = {"t": [("p * q", ("p", "q"))], "p": [("q + r", ("q", "r"))], "q": [("p - r", ("p", "r"))]}
    for seed in range(20):
        w = tw.tree_walk(v, "t", 4, random.Random(seed))
        assert tw.pruned(w) <= w.nodes() and w.length() >= 1
        values = tw.evaluate_walk(v, w, random.Random(seed))
        assert set(values) == w.nodes()
    w = tw.tree_walk(v, "t", 4, random.Random(0))
    assert any({"p", "q"} == set(r) for r in tw.rings(w)) and tw.turns_back(w, "p", {"q"})
    assert tw.tree_walk({}, "t", 3, random.Random(0)).leafs == {"t"}
    assert tw.working([("a", ("x",)), ("b", ("y",))], {"y"}) == ("b", ("y",))


def test_relational_operators(spark):
    e = spark.createDataFrame([(i, o, ins, d, s) for i, o, ins, d, s in ROWS], "id string, output string, inputs array<string>, domain string, subdomain string")
    assert {r["node"] for r in relational.on_cycles(e).collect()} == {"a", "b", "d", "e", "s"}
    deep = {r["v"]: r["depth"] for r in relational.depth(e, 6).collect()}
    assert deep["c"] == 0 and deep["a"] == 2 and deep["s"] == 5
    reach = relational.reachable(e, spark.createDataFrame([("s",)], "target string"))
    assert {r["node"] for r in reach.collect()} == {"s", "d", "b", "e", "a", "c"}
    empty = e.limit(0)
    assert relational.on_cycles(empty).count() == 0 and relational.depth(empty, 3).count() == 0
    assert tr.trace_sample(e.select(F.col("output").alias("target")).withColumn("seed", F.lit(1)), e).count() == 6  # s needs itself


def test_depth_is_not_cut_before_ten_steps(spark, tmp_path):
    chain = [(f"f{i}", f"v{i}", [f"v{i + 1}"]) for i in range(12)]
    spark.createDataFrame(chain, "id string, output string, inputs array<string>").write.parquet(f"{tmp_path}/hyperedges.parquet")
    want = {f"v{i}": min(12 - i, 10) for i in range(13)}
    assert {r["v"]: r["depth"] for r in graph_queries.max_dep_depth(spark, str(tmp_path)).collect()} == want
    assert {r["v"]: r["depth"] for r in graph_queries.deep_variables(spark, str(tmp_path)).collect()} == {v: k for v, k in want.items() if k >= 3}


def test_traces_are_enumerated_to_five_levels(spark, tmp_path):
    chain = [(f"f{i}", f"v{i}", [f"v{i + 1}"], "x", None) for i in range(7)]
    spark.createDataFrame(chain, "id string, output string, inputs array<string>, domain string, subdomain string").write.parquet(f"{tmp_path}/hyperedges.parquet")
    for q in (graph_queries.trace_enum, graph_queries.limit_traces):
        paths = [r["path"] for r in q(spark, str(tmp_path)).where("target = 'v0'").collect()]
        got = {tuple(p.split()) if isinstance(p, str) else tuple(e["id"] for e in p) for p in paths}
        assert got == {tuple(f"f{i}" for i in reversed(range(n))) for n in range(1, 6)}


def test_all_formulas_are_evaluated(spark, sf, tmp_path):
    given = {r["variable"]: r["value"] for r in record_queries.uniform_value(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/hyperedges.parquet").collect()
    want = {r["id"]: fm.evaluate(r["label"], given) for r in rows}
    got = {r["id"]: r["value"] for r in graph_queries.safe_eval(spark, sf).collect()}
    assert got.keys() == want.keys() and sum(v is not None for v in want.values()) > 300
    assert all((got[i] is None) == (v is None) and (v is None or abs(got[i] - v) <= 1e-9 * max(1, abs(v))) for i, v in want.items())
    first = {v: min(r["id"] for r in rows if r["output"] == v and want[r["id"]] is not None) for v in {r["output"] for r in rows if want[r["id"]] is not None}}
    tried = {r["output"]: (r["id"], r["value"]) for r in graph_queries.try_formulas(spark, sf).collect()}
    assert {v: i for v, (i, _) in tried.items()} == first and all(x == got[i] for i, x in tried.values())


def test_undefined_formulas_are_passed_over(spark, tmp_path):
    e = [("f1", "t", ["a"], "a / 0"), ("f2", "t", ["a"], "log(-a)"), ("f3", "t", ["a", "gone"], "a + missing"), ("f4", "t", ["a", "b", "c"], "a + b + c"), ("f5", "u", ["a"], "(0 - a) ^ 0.5")]
    spark.createDataFrame(e, "id string, output string, inputs array<string>, label string").write.parquet(f"{tmp_path}/hyperedges.parquet")
    spark.createDataFrame([(v,) for v in "abctu"], "variable string").write.parquet(f"{tmp_path}/hypernyms.parquet")
    given = {r["variable"]: r["value"] for r in record_queries.uniform_value(spark, str(tmp_path)).collect()}
    assert {r["id"]: r["value"] for r in graph_queries.safe_eval(spark, str(tmp_path)).collect()} == {"f1": None, "f2": None, "f3": None, "f4": given["a"] + given["b"] + given["c"], "f5": None}
    assert [tuple(r)[:2] for r in graph_queries.try_formulas(spark, str(tmp_path)).collect()] == [("t", "f4")]


def test_working_formula(spark):
    e = spark.createDataFrame([("f1", "t", ["a_rate"]), ("f2", "t", ["a", "b"]), ("f3", "u", ["gone"]), ("f4", "t", ["a"]), ("f5", "w", []), ("f6", None, ["a"]), ("f7", "u", None)], "id string, output string, inputs array<string>")
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "variable string")
    of = lambda have, shun: {r["output"]: r["id"] for r in relational.working_formula(e, have, shun).collect()}
    assert of(names("a", "b", "a_rate"), names("a_rate")) == {"t": "f2", "w": "f5", "u": "f7"}
    assert of(names("a"), names("b")) == {"t": "f4", "w": "f5", "u": "f7"}
    for have, shun in (({"a", "b", "a_rate"}, {"a_rate"}), ({"a"}, {"b"})):  # the same as walking through the formulas
        assert tw.working([("f1", ("a_rate",)), ("f2", ("a", "b")), ("f4", ("a",))], have, shun)[0] == of(names(*have), names(*shun))["t"]


def test_columns_put_formulas_in_order(spark):
    """The order inside the JVM is that of the walk, with rings, several formulas of an output and formulas of themselves."""
    rng, paths = random.Random(4), []
    for _ in range(150):
        n = rng.randrange(0, 7)
        paths.append([(f"f{k}", rng.choice("abcdef"), [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 3))], rng.choice(["x", "y", None])) for k in range(n)])
    paths.append([("f1", "a", ["a"], "x")])
    rows = spark.createDataFrame([(i, p, ["g"], "a") for i, p in enumerate(paths)], "i int, path array<struct<id:string,output:string,inputs:array<string>,domain:string>>, leafs array<string>, target string")
    run = rows.withColumn("run", relational.execution_order(F.col("path")))
    out = run.select("i", F.transform("run", lambda e: e["id"]).alias("ids"), relational.completed(F.col("run"), F.col("leafs"), F.col("target"), [("x", "y")]).alias("c")).collect()
    met = 0
    for r in out:
        own = tuple(tr.Formula(i, o, tuple(ins), d, d) for i, o, ins, d in paths[r["i"]])
        want = tr.execution_order(own)
        assert r["ids"] == (None if want is None else [f.id for f in want])
        done = tr.complete(tr.Chain(own, frozenset({"g"}), frozenset(), 0), "a", lambda p, c: (p, c) == ("x", "y")) if own else None
        if own:
            assert (r["c"] is None) == (done is None)
            if done is not None:
                met += 1
                assert [e["id"] for e in r["c"]["path"]] == [f.id for f in done.order] and set(r["c"]["leafs"]) == done.leafs
    assert met > 20


def test_domains_are_held():
    g = tr.Graph([("f1", "t", ["p"], "x", "x:1", "p"), ("f2", "t", ["q"], "y", None, "q"), ("f3", "p", ["r"], "y", None, "r"), ("f4", "q", ["r"], "y", "y:2", "r")])
    for seed in range(10):
        assert [f.id for f in tr.sample(g, "t", 5, seed, True, "x").order] == ["f1"]
        assert tr.sample(g, "t", 5, seed, True, "z") is None
    assert {tuple(f.id for f in t.order) for t in tr.enumerate_traces(g, "t", 5, True, domain="y", subdomain="y")} == {("f2",)}
    assert {tuple(f.id for f in t.order) for t in tr.enumerate_traces(g, "t", 5, True, domain="y")} == {("f2",), ("f4", "f2")}
    assert g.hypernyms == {"t": "x", "p": "x", "q": "y", "r": "y"}


def test_drawn_traces(spark):
    """Only what an edge meets is a node; the last trace decides a merged node's kind."""
    step = "struct<id:string,output:string,inputs:array<string>>"
    t = [(1, ("t", ["l", "away"], [("f1", "m", ["l"]), ("f2", "t", ["m", "n"])])), (2, ("m", ["t"], [("f9", "m", ["t", None])])), (3, None), (4, ("t", None, None))]
    rows = spark.createDataFrame(t, f"k long, trace struct<target:string,leafs:array<string>,path:array<{step}>>")
    nodes, edges = relational.trace_graph(rows, "k")
    assert {tuple(r) for r in nodes.collect()} == {(1, "t", "target"), (1, "l", "leaf"), (1, "m", "derived"), (1, "n", "leaf"), (1, "f1@1", "formula"), (1, "f2@2", "formula"), (2, "m", "target"), (2, "t", "leaf"), (2, "f9@1", "formula")}
    all_nodes, lines = relational.merged(nodes, edges, "k")
    assert {tuple(r) for r in all_nodes.collect()} == {("t", "leaf"), ("m", "target"), ("l", "leaf"), ("n", "leaf"), ("T1:f1@1", "formula"), ("T1:f2@2", "formula"), ("T2:f9@1", "formula")}
    assert ("t", "T2:f9@1", "input") in {tuple(r) for r in lines.collect()} and lines.count() == 7
