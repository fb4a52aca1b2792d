"""Parsers for what judges and generators write; Column expressions, and one Arrow UDF for JSON truthiness."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperloom.functions.text import strip, strip_code_fence

_READ = T.StructType([T.StructField("leaf_hits", T.MapType(T.StringType(), T.BooleanType())), T.StructField("target_present", T.BooleanType())])


def parse_score(c: Column, low: int = 1, high: int = 10) -> Column:
    """The first word that is an integer of low..high once ( ) . : / around it are dropped; -1 if none is.

    Commas part words. Digits of other scripts and digit separators are not numbers.
    """
    words = F.split(F.translate(F.coalesce(c, F.lit("")), ",", " "), r"(?U)\s+")
    numbers = F.transform(words, lambda w: F.regexp_replace(w, r"^[().:/]+|[().:/]+$", "").try_cast("int"))
    return F.coalesce(F.get(F.filter(numbers, lambda n: n.between(low, high)), F.lit(0)), F.lit(-1))


@F.pandas_udf(_READ)
def _read_verdict(text: pd.Series, leafs: pd.Series) -> pd.DataFrame:
    """First JSON object of each text; values are taken for true as Python does ('false' is a text, so true)."""
    decode = json.JSONDecoder().raw_decode
    hits, present = [], []
    for t, names in zip(text, leafs):
        names = [] if names is None else [n for n in names if n is not None]
        try:
            found = decode(t, t.index("{"))[0]
            own = found.get("leaf_hits") or {}
            row = ({n: bool(own.get(n, False)) for n in names}, bool(found.get("target_present", False)))
        except (ValueError, AttributeError, TypeError):
            row = ({n: False for n in names}, False)
        hits.append(row[0])
        present.append(row[1])
    return pd.DataFrame({"leaf_hits": pd.Series(hits, dtype=object), "target_present": present})


def parse_verdict(text: Column, leafs: Column) -> Column:
    """struct<leaf_hits, target_present> from a judge's answer; unreadable answers give all false."""
    return _read_verdict(strip_code_fence(F.coalesce(text, F.lit(""))), leafs)


def verdict(hits: Column, target_present: Column, leafs: Column) -> Column:
    """The full verdict: coverage is hits over leafs (at least 1), faithful needs the target and full coverage."""
    n = F.size(F.filter(F.map_values(hits), lambda h: h))
    coverage = n / F.greatest(F.size(F.coalesce(leafs, F.array().cast("array<string>"))), F.lit(1))
    return F.struct(hits.alias("leaf_hits"), target_present.alias("target_present"), coverage.alias("variable_coverage"), (target_present & (coverage >= 1)).alias("faithful"))


def _once(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def question_items(text: Column) -> Column:
    """array<struct<difficulty int, question string>> from a generator's answer.

    The JSON array between the first [ and the last ] is read; where it is broken, whole objects are salvaged by pattern.
    """
    items = "array<struct<difficulty:int,question:string>>"

    def read(body: Column) -> Column:
        start, end = F.instr(body, "["), F.length(body) - F.instr(F.reverse(body), "]") + 1
        whole = F.when((start > 0) & (end > start), F.from_json(F.substring(body, start, end - start + 1), items))
        return _once(whole, lambda w: F.when(F.exists(w, lambda x: x["question"].isNotNull()), w).otherwise(salvaged(body)))

    def salvaged(body: Column) -> Column:
        objects = F.regexp_extract_all(body, F.lit(r'\{[^{}]*"question"\s*:\s*"(?:[^"\\]|\\.)*"[^{}]*\}'), F.lit(0))
        return F.filter(F.transform(objects, lambda o: F.from_json(o, "difficulty int, question string")), lambda x: x.isNotNull())

    return _once(strip_code_fence(F.regexp_replace(F.coalesce(text, F.lit("")), "(?is)^(.*?)<reasoning>.*?</reasoning>", "$1")), read)


def valid_items(items: Column) -> Column:
    """Items with a difficulty of 1..10 and a question that is not blank, trimmed."""
    trimmed = F.transform(items, lambda x: F.struct(x["difficulty"].alias("difficulty"), strip(x["question"]).alias("question")))
    return F.filter(trimmed, lambda x: x["difficulty"].between(1, 10) & (F.coalesce(x["question"], F.lit("")) != ""))


def pick_difficulty(items: Column, difficulty: Column) -> Column:
    """The question of the last item of that difficulty; null without one."""
    own = F.filter(items, lambda x: x["difficulty"] == difficulty)
    return F.get(own, F.size(own) - 1)["question"]
