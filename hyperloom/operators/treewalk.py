"""Breadth-first walks that choose one formula per quantity, and their evaluation with random givens.

Formulas are grouped by the quantity they give; walks are independent, one (target, seed) a row, and run in Arrow batches.
"""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.functions import formula as fm

Variables = dict[str, list[tuple[str, tuple[str, ...]]]]


@dataclass
class Walk:
    target: str
    level: dict[str, int] = field(default_factory=dict)
    leafs: set[str] = field(default_factory=set)
    base: set[str] = field(default_factory=set)
    links: list[tuple[str, str]] = field(default_factory=list)  # (needed, by)
    chosen: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)

    def nodes(self) -> set[str]:
        return {self.target, *self.level, *self.leafs, *self.base}

    def length(self) -> int:
        """1 and the deepest level with a quantity that is derived; 1 if none is."""
        return 1 + max((k for v, k in self.level.items() if v not in self.leafs), default=0)


def working(options: list[tuple[str, tuple[str, ...]]], have: set[str], shun: set[str] = frozenset()) -> tuple[str, tuple[str, ...]] | None:
    """The first formula that needs only what is there and nothing that is shunned."""
    return next(((f, d) for f, d in options if set(d) <= have and not set(d) & shun), None)


def turns_back(walk: Walk, v: str, needs: set[str]) -> bool:
    """Whether a formula would need the target, its own quantity or one that needs that quantity directly."""
    return walk.target in needs or v in needs or any(needed == v and by in needs for needed, by in walk.links)


def tree_walk(variables: Variables, target: str, most: int, rng: random.Random) -> Walk:
    """From the target to givens: one random formula a quantity, at most ``most`` levels.

    A quantity is given if no formula gives it, at the last level, and where its formula's needs would lie beyond it;
    one that is met again keeps its level, and only the link is added.
    """
    w = Walk(target, {target: 0})
    queue = deque([target])
    while queue:
        v = queue.popleft()
        options = [(f, d) for f, d in variables.get(v, ()) if f and d]
        if w.level[v] >= most or not options:
            w.leafs.add(v)
            if v not in variables:
                w.base.add(v)
            continue
        w.chosen[v] = f, needs = rng.choice(options)
        below = w.level[v] + 1
        for x in sorted(set(needs)):
            if x not in variables:
                w.base.add(x)
                w.leafs.add(x)
            elif below >= most:
                continue
            elif not any(g and d for g, d in variables[x]):
                w.leafs.add(x)
            elif x not in w.level:
                w.level[x] = below
                queue.append(x)
            if (x, v) not in w.links:
                w.links.append((x, v))
        if below >= most:
            w.leafs.add(v)
    return w


def pruned(walk: Walk) -> set[str]:
    """Quantities that the chosen formulas need for the target, in turn."""
    keep, queue = {walk.target}, [walk.target]
    there = walk.nodes()
    while queue:
        v = queue.pop()
        needs = walk.chosen[v][1] if v in walk.chosen else [x for x, by in walk.links if by == v]
        for x in needs:
            if x in there and x not in keep:
                keep.add(x)
                queue.append(x)
    return keep


def rings(walk: Walk) -> list[list[str]]:
    """Cycles among derived quantities, each from the quantity at which a depth-first search meets itself."""
    found, done = [], set()
    for start in sorted(set(walk.chosen) - walk.leafs):
        path: list[str] = []

        def visit(v: str) -> None:
            if v in path:
                found.append(path[path.index(v) :])
                return
            if v in done or v in walk.leafs or v not in walk.chosen:
                return
            path.append(v)
            for x in walk.chosen[v][1]:
                visit(x)
            path.pop()
            done.add(v)

        visit(start)
    return found


def evaluate_walk(variables: Variables, walk: Walk, rng: random.Random, low: float = 1.0, high: float = 100.0) -> dict[str, float]:
    """Values of the walk's quantities, to two places: random givens, then formulas from the deepest level up.

    A quantity on a ring becomes a given; one whose formula cannot be evaluated takes another, at last a random value.
    """
    given = lambda a, b: round(rng.uniform(a, b), 2)
    leafs = set(walk.leafs)
    values: dict[str, float] = {}
    for ring in rings(walk):
        first = next((v for v in ring if v != walk.target), None)
        if len(ring) > 1 and first is not None and first not in values:
            values[first] = given(1.0, 10.0)
            leafs.add(first)
    for v in sorted(leafs & walk.nodes()):
        values.setdefault(v, given(low, high))
    waiting = [v for v in sorted(walk.level, key=lambda v: (-walk.level[v], v)) if v not in values]
    for _ in range(2 * (1 + max(walk.level.values()))):
        for v in list(waiting):
            f, needs = walk.chosen[v]
            if all(x in values for x in needs) and (out := fm.evaluate(f, values)) is not None:
                values[v] = round(out, 2)
                waiting.remove(v)
    for v in waiting:
        others = (fm.evaluate(f, values) for f, d in variables.get(v, ()) if set(d) <= values.keys())
        out = next((x for x in others if x is not None), None)
        values[v] = round(out, 2) if out is not None else given(low, high)
    return values


def variables_of(edges: DataFrame) -> Variables:
    """Formulas by quantity from a formula table (output, label, inputs); the table's size is checked first."""
    from hyperloom.operators.traverse import MOST_FORMULAS

    if edges.count() > MOST_FORMULAS:
        raise ValueError(f"more than {MOST_FORMULAS} formulas")
    out: Variables = {}
    for r in sorted(edges.where("output is not null").select("id", "output", "label", "inputs").collect(), key=lambda r: r["id"]):
        out.setdefault(r["output"], []).append((r["label"] or "", tuple(x for x in (r["inputs"] or ()) if x is not None)))
    return out


_SCHEMA = pa.schema([("target", pa.string()), ("seed", pa.int64()), ("node", pa.string()), ("level", pa.int32()), ("leaf", pa.bool_()), ("needed", pa.bool_()), ("formula", pa.string()), ("value", pa.float64()), ("length", pa.int32())])


def tree_walks(targets: DataFrame, edges: DataFrame, most: int = 4) -> DataFrame:
    """One row per quantity of the walk of each (target, seed), with level, formula and value."""
    held = targets.sparkSession.sparkContext.broadcast(variables_of(edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variables = held.value
        for batch in batches:
            for target, seed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rng = random.Random(seed)
                w = tree_walk(variables, target, most, rng)
                values, keep, length = evaluate_walk(variables, w, rng), pruned(w), w.length()
                rows = [{"target": target, "seed": seed, "node": v, "level": w.level.get(v), "leaf": v in w.leafs, "needed": v in keep, "formula": w.chosen.get(v, (None,))[0], "value": values.get(v), "length": length} for v in sorted(w.nodes())]
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    schema = "target string, seed long, node string, level int, leaf boolean, needed boolean, formula string, value double, length int"
    return targets.select("target", F.col("seed").cast("long")).repartition(F.col("target"), F.col("seed")).mapInArrow(run, schema)
