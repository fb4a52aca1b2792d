"""Backward walks through a formula graph, one target (and seed) a row.

A walk depends on the order of choices and on CPython's random numbers, which no relational plan reproduces, so walks run
in Arrow batches on the executors; the graph travels with them. Work is spread over targets and seeds.

Walk states are immutable values that are passed along, so nothing has to be undone when a branch fails.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A graph above this number of formulas is not sent along with every task.
MOST_FORMULAS = 200_000


class Formula(NamedTuple):
    id: str
    output: str
    inputs: tuple[str, ...]
    domain: str | None
    subdomain: str | None
    label: str | None = None


class Trace(NamedTuple):
    """What a walk has settled: formulas in order of execution, givens, and the domain it is held to."""

    order: tuple[Formula, ...] = ()
    leafs: frozenset[str] = frozenset()
    held: tuple[str | None, str | None] | None = None

    def settled(self, v: str) -> bool:
        return v in self.leafs or any(f.output == v for f in self.order)


class Graph:
    def __init__(self, rows: list[tuple]) -> None:
        self.formulas = [Formula(i, o, tuple(x for x in (ins or ()) if x is not None), d, s or d, *more) for i, o, ins, d, s, *more in rows if i is not None and o is not None]
        self.making: dict[str, list[Formula]] = {}
        for f in self.formulas:
            self.making.setdefault(f.output, []).append(f)
        self.hypernyms: dict[str, str | None] = {}
        for f in self.formulas:
            for x in (f.output, *f.inputs):
                self.hypernyms.setdefault(x, f.domain)  # the domain in which a quantity is seen first
        self.nodes = set(self.hypernyms)

    def usable(self, v: str, target: str, trace: Trace) -> list[Formula]:
        """Formulas for v that do not need the target and keep to the domain held."""
        found = [f for f in self.making.get(v, ()) if target not in f.inputs]
        if trace.held is not None:
            d, s = trace.held
            found = [f for f in found if f.domain == d and (s is None or f.subdomain == s)]
        return found


def collect_graph(edges: DataFrame) -> list[tuple]:
    """Rows of a formula table for ``Graph``, in the order of the numbers in their ids; its size is checked first."""
    if edges.count() > MOST_FORMULAS:
        raise ValueError(f"more than {MOST_FORMULAS} formulas; use the relational operators of hyperloom.operators.graph")
    label = F.col("label") if "label" in edges.columns else F.lit(None).cast("string")
    rows = edges.select("id", "output", "inputs", "domain", "subdomain", label.alias("label")).collect()
    number = lambda r: int("".join(c for c in r["id"] if c.isdigit()) or 0)
    return [tuple(r) for r in sorted(rows, key=lambda r: (number(r), r["id"]))]


def _hold(trace: Trace, f: Formula, single: bool) -> Trace:
    return trace._replace(held=(f.domain, f.subdomain)) if single and trace.held is None else trace


def _start(single: bool, domain: str | None, subdomain: str | None) -> Trace:
    """A walk held to one domain keeps to that of its first formula, or to the one (and subdomain) named."""
    return Trace(held=(domain, subdomain)) if single and domain is not None else Trace()


def sample(graph: Graph, target: str, depth: int = 5, seed: int | None = None, single: bool = False, domain: str | None = None, subdomain: str | None = None) -> Trace | None:
    """One trace by a random walk that prefers formulas with more inputs that can be derived; None without a formula."""
    rng = random.Random(seed)

    def settle(v: str, level: int, above: tuple[str, ...], trace: Trace) -> Trace | None:
        if trace.settled(v):
            return trace
        if v in above:
            return None
        choices = graph.usable(v, target, trace)
        if choices and level < depth:
            rng.shuffle(choices)
            keys = [(-sum(x in graph.making for x in f.inputs), rng.random()) for f in choices]
            for _, f in sorted(zip(keys, choices), key=lambda kf: kf[0]):
                state: Trace | None = _hold(trace, f, single)
                for x in f.inputs:
                    state = settle(x, level + 1, (*above, v), state)
                    if state is None:
                        break
                if state is not None:
                    return state._replace(order=(*state.order, f))
        return trace._replace(leafs=trace.leafs | {v})

    found = settle(target, 0, (), _start(single, domain, subdomain))
    return found._replace(leafs=found.leafs - {target}) if found and any(f.output == target for f in found.order) else None


def enumerate_traces(graph: Graph, target: str, depth: int = 5, single: bool = False, most: int | None = None, domain: str | None = None, subdomain: str | None = None) -> Iterator[Trace]:
    """All different traces in order of formula ids as text; every quantity but the target may also be given."""

    def settle(v: str, level: int, above: frozenset[str], trace: Trace) -> Iterator[Trace]:
        if trace.settled(v):
            yield trace
            return
        if v in above:
            return
        choices = graph.usable(v, target, trace) if level < depth else []
        for f in sorted(choices, key=lambda f: f.id):
            yield from using(f, level, above | {v}, trace)
        if v != target:
            yield trace._replace(leafs=trace.leafs | {v})

    def using(f: Formula, level: int, above: frozenset[str], trace: Trace) -> Iterator[Trace]:
        def rest(k: int, state: Trace) -> Iterator[Trace]:
            if k == len(f.inputs):
                yield state._replace(order=(*state.order, f))
            else:
                for s in settle(f.inputs[k], level + 1, above, state):
                    yield from rest(k + 1, s)

        return rest(0, _hold(trace, f, single))

    def different() -> Iterator[Trace]:
        seen = set()
        for t in settle(target, 0, frozenset(), _start(single, domain, subdomain)):
            key = (tuple(f.id for f in t.order), t.leafs)
            if key not in seen:
                seen.add(key)
                yield t

    return islice(different(), most)


class Chain(NamedTuple):
    """A trace that follows one input at a time, with the quantities at which it would turn back on itself."""

    order: tuple[Formula, ...]
    leafs: frozenset[str]
    loops: frozenset[str]
    depth: int


def chains(graph: Graph, target: str, depth: int = 10, most: int = 100) -> list[Chain]:
    """Chains from the target to a given, first of each set of formulas; before they are completed."""

    def follow(v: str, path: tuple[Formula, ...], seen: frozenset[str], loops: frozenset[str], level: int) -> Iterator[Chain]:
        found = graph.making.get(v, []) if level < depth else []
        if not found:
            yield Chain(path, (seen | {v}) - {f.output for f in path} - loops - {target}, loops, level)
            return
        for f in found:
            if target in f.inputs:
                continue
            longer, met = (*path, f), seen | {v}
            turned = [x for x in f.inputs if x in met and x != v]
            back = loops | set(turned)
            if turned and all(x in met for x in f.inputs if x not in back):
                yield Chain(longer, (met | set(f.inputs)) - {g.output for g in longer} - back - {target}, back, level + 1)
            for x in f.inputs:
                if x not in met:
                    yield from follow(x, longer, met, back, level + 1)

    def first() -> Iterator[Chain]:
        seen = set()
        for c in follow(target, (), frozenset(), frozenset(), 0):
            key = tuple(sorted(f.id for f in c.order))
            if key not in seen:
                seen.add(key)
                yield c

    return list(islice(first(), most))


def execution_order(path: tuple[Formula, ...]) -> tuple[Formula, ...] | None:
    """The formulas so that each follows what it needs, as early as possible; None if they need one another in a ring.

    Of formulas with the same output the last counts.
    """
    maker = {f.output: k for k, f in enumerate(path)}
    waits = [{maker[x] for x in f.inputs if x in maker} for f in path]
    done, ready = [], [k for k, w in enumerate(waits) if not w]
    left = set(range(len(path)))
    while ready:
        k = ready.pop(0)
        done.append(k)
        left.discard(k)
        for j in sorted(left):
            if k in waits[j]:
                waits[j].discard(k)
                if not waits[j]:
                    ready.append(j)
    return tuple(path[k] for k in done) if not left else None


def complete(chain: Chain, target: str, fits: Callable[[str, str], bool] = lambda producer, consumer: True) -> Chain | None:
    """The chain in execution order with missing inputs as givens; None if it cannot be executed or domains do not fit."""
    if not chain.order:
        return chain
    order = execution_order(chain.order)
    if order is None:
        return None
    domain = {f.output: f.domain or "unknown" for f in order}
    if any(x in domain and domain[x] != (f.domain or "unknown") and not fits(domain[x], f.domain or "unknown") for f in order for x in f.inputs):
        return None
    made, leafs, have = {f.output for f in order}, set(chain.leafs), chain.leafs | chain.loops | {target}
    for f in order:
        for x in f.inputs:
            if x not in have:
                if x in made:
                    return None
                leafs.add(x)
                have = have | {x}
        have = have | {f.output}
    return chain._replace(order=order, leafs=frozenset(leafs))


def complete_chains(graph: Graph, target: str, depth: int = 10, most: int = 100, fits=lambda p, c: True) -> list[Chain]:
    """Valid chains of a known quantity; one empty chain with the target given if there is none. [] for an unknown one."""
    if target not in graph.nodes:
        return []
    found = [c for c in (complete(c, target, fits) for c in chains(graph, target, depth, most)) if c is not None]
    return found or [Chain((), frozenset({target}), frozenset(), 0)]


STEP = "struct<id:string,output:string,inputs:array<string>,label:string,domain:string,subdomain:string>"
TRACES = f"target string, seed long, trace_no int, path array<{STEP}>, leafs array<string>, chapters array<string>, subdomains array<string>, hypernym string"

_STEP = pa.struct([("id", pa.string()), ("output", pa.string()), ("inputs", pa.list_(pa.string())), ("label", pa.string()), ("domain", pa.string()), ("subdomain", pa.string())])
_TRACE_SCHEMA = pa.schema([("target", pa.string()), ("seed", pa.int64()), ("trace_no", pa.int32()), ("path", pa.list_(_STEP)), ("leafs", pa.list_(pa.string())), ("chapters", pa.list_(pa.string())), ("subdomains", pa.list_(pa.string())), ("hypernym", pa.string())])
#: Traces of one Arrow batch.
BATCH = 2_000


def _row(graph: Graph, target: str, seed: int | None, k: int, t: Trace) -> dict:
    text = lambda xs: sorted({x for x in xs if x is not None})
    path = [{"id": f.id, "output": f.output, "inputs": list(f.inputs), "label": f.label, "domain": f.domain, "subdomain": f.subdomain} for f in t.order]
    return {"target": target, "seed": seed, "trace_no": k, "path": path, "leafs": sorted(t.leafs), "chapters": text(f.domain for f in t.order), "subdomains": text(f.subdomain for f in t.order), "hypernym": graph.hypernyms.get(target, "unknown")}


def _walks(targets: DataFrame, edges: DataFrame, walk: Callable[[Graph, str, int | None], Iterable[Trace]]) -> DataFrame:
    spark, rows = targets.sparkSession, collect_graph(edges)
    held = spark.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, found = Graph(held.value), []
        for batch in batches:
            for target, seed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, t in enumerate(walk(graph, target, seed)):
                    found.append(_row(graph, target, seed, k, t))
                    if len(found) >= BATCH:  # traces of a target stream out, they are never gathered
                        yield pa.RecordBatch.from_pylist(found, schema=_TRACE_SCHEMA)
                        found = []
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=_TRACE_SCHEMA)

    return targets.select("target", F.col("seed").cast("long")).repartition(F.col("target"), F.col("seed")).mapInArrow(run, TRACES)


def trace_sample(targets: DataFrame, edges: DataFrame, depth: int = 5, single: bool = False, domain: str | None = None, subdomain: str | None = None) -> DataFrame:
    """One random trace of each (target, seed) that has one; ``single`` keeps it to one domain, that named or the first."""
    return _walks(targets, edges, lambda g, t, s: [x for x in [sample(g, t, depth, s, single, domain, subdomain)] if x])


def trace_enum(targets: DataFrame, edges: DataFrame, depth: int, single: bool = False, most: int | None = None, domain: str | None = None, subdomain: str | None = None) -> DataFrame:
    """All traces of each target; bound the depth or the number, traces grow fast."""
    return _walks(targets.withColumn("seed", F.lit(None).cast("long")), edges, lambda g, t, s: enumerate_traces(g, t, depth, single, most, domain, subdomain))


def trace_chains(targets: DataFrame, edges: DataFrame, depth: int = 10, most: int = 100) -> DataFrame:
    """Completed chains of each target, as traces."""
    return _walks(targets.withColumn("seed", F.lit(None).cast("long")), edges, lambda g, t, s: [Trace(c.order, c.leafs) for c in complete_chains(g, t, depth, most)])
