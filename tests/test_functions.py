"""Golden cases of the scalar functions."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hyperloom.functions import formula, parse, rewards, text
from hyperloom.plans import record_queries

SCORES = {"8": 8, "Score: 7.": 7, "7/10": -1, "7.5": -1, "(9)": 9, "11 4": 4, "": -1, None: -1, "-3 2": 2, "8\n": 8, "+5": 5, "a,6,b": 6, "0 10": 10}


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("v")).collect()[0]["v"]


def test_parse_score(spark):
    df = spark.createDataFrame([(k, v) for k, v in SCORES.items()], "t string, want int")
    assert not df.where(parse.parse_score(F.col("t")) != F.col("want")).count()


def test_reasoning_blocks(spark):
    two = "x <REASONING>a</reasoning> y <reasoning>b</reasoning>"
    assert one(spark, text.strip_reasoning(F.col("t")), t=two) == "x  y <reasoning>b</reasoning>"
    assert one(spark, text.strip_reasoning(F.col("t")), t="<reasoning>open") == "<reasoning>open"
    assert one(spark, text.strip_reasoning(F.col("t")), t=None) == ""
    assert one(spark, text.reasoning(F.col("t")), t=two) == "a"


def test_words_and_questions(spark):
    assert one(spark, text.word_count(F.col("t")), t=" a b\n\tc ") == 3
    assert one(spark, text.word_count(F.col("t")), t=None) == 0
    assert one(spark, text.first_question(F.col("t")), t="What? And? " + "x" * 90 + "?") == "What? And?"
    assert one(spark, text.first_question(F.col("t")), t="none") == "none"
    assert one(spark, text.preview(F.col("t"), 3), t="a\nbcd") == "a b…"


def test_verdict_truthiness(spark):
    df = spark.createDataFrame([('{"leaf_hits": {"a": "yes", "b": 0, "z": true}, "target_present": "false"} prose', ["a", "b"]), ("no json", ["a"]), ('```json\n{"leaf_hits": {}}\n```', None)], "t string, leafs array<string>")
    got = [r["v"] for r in df.select(parse.parse_verdict(F.col("t"), F.col("leafs")).alias("v")).collect()]
    assert (dict(got[0]["leaf_hits"]), got[0]["target_present"]) == ({"a": True, "b": False}, True)
    assert (dict(got[1]["leaf_hits"]), got[1]["target_present"]) == ({"a": False}, False)
    assert not got[2]["leaf_hits"]


def test_empty_leafs_are_never_faithful(spark):
    v = spark.range(1).select(parse.verdict(F.create_map().cast("map<string,boolean>"), F.lit(True), F.array().cast("array<string>")).alias("v")).collect()[0]["v"]
    assert v["variable_coverage"] == 0 and v["faithful"] is False


def test_question_items(spark):
    whole = '```json\n[{"difficulty": 3, "question": " q "}, {"difficulty": 3, "question": "last"}, {"difficulty": 11, "question": "x"}]\n```'
    items = one(spark, parse.valid_items(parse.question_items(F.col("t"))), t=whole)
    assert [(i["difficulty"], i["question"]) for i in items] == [(3, "q"), (3, "last")]
    cut = '[{"difficulty": 3, "question": "kept"}, {"difficulty": 4, "quest'
    assert [i["question"] for i in one(spark, parse.question_items(F.col("t")), t=cut)] == ["kept"]
    assert one(spark, parse.pick_difficulty(parse.question_items(F.col("t")), F.lit(3)), t=whole) == "last"
    assert one(spark, parse.question_items(F.col("t")), t=None) == []


def test_rewards(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).collect()[0]["v"]
    assert value(rewards.feasibility_raw(F.lit(10))) == 2.0 and value(rewards.feasibility_raw(F.lit(-1))) == 0.0
    assert value(rewards.difficulty_raw(F.lit(5), F.lit(5))) == 2.0 and value(rewards.difficulty_raw(F.lit(0), F.lit(5))) == 0.0
    assert value(rewards.judge_reward(F.lit(None).cast("double"))) == 0.0
    assert value(rewards.alternating_phase(F.lit(0), 5)) == 0 and value(rewards.alternating_phase(F.lit(6), 5)) == 1
    m = value(rewards.loss_mask(F.array(*map(F.lit, (1, 2))), F.array(*map(F.lit, (3, 4, 5))), 4))
    assert (m["input_ids"], m["labels"], m["attention_mask"]) == ([1, 2, 3, 4], [-100, -100, 3, 4], [1] * 4)
    assert value(rewards.tail_sum(F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.lit(2))) == 5.0


def test_formula_is_closed(spark):
    assert formula.evaluate("a * b^2 / sqrt(c)", {"a": 2, "b": 3, "c": 4}) == 9
    assert formula.evaluate("a / 0", {"a": 1}) is None and formula.evaluate("sqrt(-1)", {}) is None and formula.evaluate("10**1000.0", {}) is None
    for bad in ("__import__('os')", "a.b", "(lambda: 1)()", "[1]", "a if b else c", "", None, "1 +"):
        assert formula.parse(bad) is None
    assert formula.names("x * math.pi + sin(y) - x / e") == ["x", "y"]
    df = spark.createDataFrame([(2.0, 0.0)], "a double, b double")
    r = df.select(formula.column("a^3 + abs(-a)", F.col).alias("p"), formula.column("a / b", F.col).alias("q"), formula.column("import os", F.col).alias("r")).collect()[0]
    assert (r["p"], r["q"], r["r"]) == (10.0, None, None)


@given(st.floats(0.1, 50), st.floats(0.1, 50))
def test_formula_equals_python(a, b):
    assert math.isclose(formula.evaluate("(a + b) * a / b - log(a)", {"a": a, "b": b}), (a + b) * a / b - math.log(a))


@pytest.mark.parametrize("text_, want", [("```json\n[1]\n```", "[1]"), ("[1]", "[1]"), ("``` x", "x")])
def test_fences(spark, text_, want):
    assert one(spark, text.strip_code_fence(F.col("t")), t=text_) == want


def test_examples_are_encoded_whole(spark, tmp_path):
    from hyperloom.functions import tokens

    own = tokens.encoding(f"{tokens.FOLDER}/byte_bpe_50k.tiktoken")
    texts = [(1, "ab " * 200, "xyz?" * 150), (2, "p q" * 2000, "é" * 100), (3, "p " * 3000, "q"), (4, "", "ä€ <|endoftext|>" * 30), (5, "x", None)]
    spark.createDataFrame(texts, "record_id long, trace_str string, question string").write.parquet(f"{tmp_path}/dataset.parquet")
    want = {}
    for i, p, q in texts[:4]:
        prefix, rest = own.encode_ordinary(p), own.encode_ordinary(q)
        trained = rest[: max(0, 2048 - len(prefix))]
        want[i] = (min(len(prefix) + len(rest), 2048), len(trained), sum(trained))
    assert {r["record_id"]: (r["n"], r["trained"], r["kept"]) for r in record_queries.encode_mask(spark, str(tmp_path)).collect()} == want
    rows = tokens.encoded(spark.createDataFrame(texts, "i long, p string, q string"), "i", ["p", "q"]).collect()
    assert {r["i"]: r["q"] for r in rows}[5] is None and {r["i"]: r["p"] for r in rows}[4] == []


def test_generations_are_cleaned(spark):
    said = "<|begin_of_text|>sys<|end_header_id|>\n\n## A \\(x\\) **bold** *it* `code` \\text{m/s} \\frac{a}{b} \\alpha {z} \\\\ end \\%<|eot_id|>tail"
    want = "A x bold it code m/s a\u007fb  z  end %".replace("\u007f", "")
    assert one(spark, text.clean_generation(F.col("t")), t=said) == want
    assert one(spark, text.first_question(F.col("t")), t="  So? " + "y" * 60) == "So?"
    assert one(spark, text.clean_generation(F.col("t")), t="") == "" and one(spark, text.clean_generation(F.col("t")), t=None) is None


def test_active_rewards(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).collect()[0]["v"]
    turn = lambda step: value(rewards.active_reward(F.lit("alternating"), F.lit(step), F.lit(20)))
    assert [turn(s) for s in (0, 1, 20, 21, 40, 41)] == ["faithfulness"] * 3 + ["feasibility"] * 2 + ["faithfulness"]
    assert value(rewards.active_reward(F.lit("combined"), F.lit(50), F.lit(None).cast("int"))) == "combined"
    assert value(rewards.switched(F.lit("combined"), F.lit(2.0), F.lit(1.0), 0.5, 0.5)) == 1.5
    assert value(rewards.memory_budget(F.lit(80 << 30), 0.85, F.lit(2))) == 34 and value(rewards.memory_budget(F.lit(1), 0.85, F.lit(0))) == 1
