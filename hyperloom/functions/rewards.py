"""Reward algebra of the training logs as Column expressions; nulls of scores count as failed judgements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def faithfulness_raw(coverage: Column, target: Column, faithful: Column) -> Column:
    """Coverage and two half points: 0..2."""
    return _zero(coverage) + 0.5 * _zero(target.cast("int")) + 0.5 * _zero(faithful.cast("int"))


def feasibility_raw(score: Column) -> Column:
    """A judge's 1..10 spread over 0..2; 0 outside."""
    return F.when(score.between(1, 10), (score - 1) * F.lit(2.0) / 9).otherwise(0.0)


def difficulty_raw(requested: Column, judged: Column) -> Column:
    """2 for the requested difficulty, falling by 2/9 a step; 0 if either lies outside 1..10."""
    near = F.greatest(F.lit(0.0), 2.0 * (1 - F.abs(requested - judged) / F.lit(9.0)))
    return F.when(requested.between(1, 10) & judged.between(1, 10), near).otherwise(0.0)


def scaled(raw: Column) -> Column:
    """Raw minus 1, held within -1..1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw - 1))


def combined(raws: list[Column], weights: list[Column]) -> Column:
    """Weighted mean, with a weight sum of at least 1e-8."""
    total = F.greatest(F.lit(1e-8), sum(weights[1:], weights[0]))
    parts = [r * w / total for r, w in zip(raws, weights)]
    return sum(parts[1:], parts[0])


def inverse_weights(means: list[Column], epsilon: float = 1e-3) -> list[Column]:
    """Weights in inverse proportion to running means, summing to 1."""
    inverse = [1 / (m + epsilon) for m in means]
    total = sum(inverse[1:], inverse[0])
    return [i / total for i in inverse]


def judge_reward(score: Column) -> Column:
    """A score of 0..10 as -1..1; a missing one counts as 5."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(score.cast("double"), F.lit(5.0))))
    return held / 10 * 2 - 1


def faithfulness_reward(score: Column) -> Column:
    """A score of 1..10 as -1..1."""
    return (F.greatest(F.lit(1.0), F.least(F.lit(10.0), score.cast("double"))) - 1) / 9 * 2 - 1


def length_reward(length: Column, most: Column) -> Column:
    """A length as -1..1 of the greatest; -1 where that is not above 0."""
    return F.when(most > 0, length / most).otherwise(0.0) * 2 - 1


def token_budget(difficulty: Column, base: int, step: int, reasoning: Column, extra: int = 512) -> Column:
    """Tokens allowed for a question: more above difficulty 3, and extra for a written chain of thought."""
    return F.lit(base) + step * F.greatest(F.lit(0), difficulty - 3) + F.when(reasoning, extra).otherwise(0)


def alternating_phase(step: Column, period: int | Column) -> Column:
    """0 and 1 in turns of ``period`` steps, steps counting from 1."""
    turn = F.floor((F.greatest(F.lit(1), step) - 1) / (F.lit(period) if isinstance(period, int) else period))
    return F.pmod(turn, F.lit(2)).cast("int")


def active_reward(kind: Column, step: Column, period: Column) -> Column:
    """The signal in use at a step: the kind itself, or faithfulness and feasibility in turns for an alternating one."""
    phase = alternating_phase(step, F.greatest(F.lit(1), F.coalesce(period, F.lit(1))))
    return F.when(kind == "alternating", F.when(phase == 0, "faithfulness").otherwise("feasibility")).otherwise(kind)


def switched(active: Column, faithfulness: Column, feasibility: Column, faithfulness_weight: float, feasibility_weight: float) -> Column:
    """The raw reward under the active signal; any but the two single ones combines them."""
    both = combined([faithfulness, feasibility], [F.lit(faithfulness_weight), F.lit(feasibility_weight)])
    return F.when(active == "faithfulness", faithfulness).when(active == "feasibility", feasibility).otherwise(both)


def memory_budget(total_bytes: Column, share: float, copies: Column) -> Column:
    """Whole GiB of a device that each of ``copies`` resident models may use, at least 1."""
    held = total_bytes * (F.lit(share) / F.greatest(F.lit(1), copies))
    return F.greatest(F.lit(1).cast("long"), F.floor(held / (1 << 30)))


def loss_mask(prefix: Column, completion: Column, longest: int, ignored: int = -100) -> Column:
    """struct<input_ids, labels, attention_mask> of one example, cut at ``longest``; labels skip the prefix."""
    ids = F.slice(F.concat(prefix, completion), 1, longest)
    labels = F.slice(F.concat(F.transform(prefix, lambda _: F.lit(ignored)), completion), 1, longest)
    return F.struct(ids.alias("input_ids"), labels.alias("labels"), F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"))


def right_pad(ids: Column, length: Column, filler: int) -> Column:
    """The list filled up to ``length``."""
    return F.concat(ids, F.array_repeat(F.lit(filler), (length - F.size(ids)).cast("int")))


def tail_sum(values: Column, prompt_length: Column) -> Column:
    """Sum of the values from place prompt_length - 1 (at least 0) on."""
    start = F.greatest(F.lit(0), prompt_length - 1)
    own = F.filter(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda x: x["i"] >= start)
    return F.aggregate(own, F.lit(0.0), lambda a, x: a + x["v"])
