"""Ranks, joins and files on small and awkward inputs."""

import json

from pyspark.sql import functions as F

from hyperloom import dist
from hyperloom.operators import ordered, records, scoring
from hyperloom.sources import files


def test_hash_rank_equals_a_window(spark, monkeypatch):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.lit(None).cast("string")).otherwise("g").alias("g"))
    plain = dist.hash_rank(df, ["g"], dist.uniform_hash("id"), ["id"], 10)
    monkeypatch.setattr(dist, "RANK_ROWS", 100)
    cut = dist.hash_rank(df, ["g"], dist.uniform_hash("id"), ["id"], 5000)
    assert sorted(map(tuple, plain.select("id", "rank").collect())) == sorted(map(tuple, cut.select("id", "rank").collect()))
    top = cut.groupBy("g").agg(F.max("rank").alias("m"), F.countDistinct("rank").alias("n")).collect()
    assert all(r["m"] + 1 == r["n"] for r in top) and sum(r["n"] for r in top) == 5000


def test_sized_join_both_ways(spark):
    right = dist.shared_table(spark.range(50).select("id", (F.col("id") * 2).alias("x")))
    for limit in (0, 1 << 30):
        assert dist.sized_join(spark.range(100), right, "id", "left", limit).where("x is not null").count() == 50


def test_small_sources_are_spread(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    got = dist.spread(spark.read.parquet(f"{tmp_path}/t"), "id")
    assert got.rdd.getNumPartitions() == 4 and got.count() == 1000
    many = spark.range(1000).repartition(9)
    many.write.parquet(f"{tmp_path}/u")
    own = spark.read.option("maxPartitionBytes", "1").parquet(f"{tmp_path}/u")
    n = own.rdd.getNumPartitions()
    assert dist.spread(own, "id").rdd.getNumPartitions() == max(n, 4)


def test_sizes_are_those_in_memory(spark):
    """A column of one value packs to nothing on disk, but not in memory."""
    t = dist.shared_table(spark.range(200_000).select(F.lit(1).cast("long").alias("x"), F.lit(2).cast("long").alias("y")).coalesce(1))
    assert t.nbytes < 100_000 and t.fits(8_000_000) and not t.fits(7_000_000) and t.rows() == 200_000
    assert not dist.shared_table(spark.range(100).select(F.repeat(F.lit("x"), 50).alias("t"))).fits(1)


def test_name_key(spark):
    df = spark.createDataFrame([("A_b c1", "abc1"), ("  ", None), (None, None), ("Ü", None)], "t string, want string")
    assert df.where(dist.name_key("t").eqNullSafe(F.col("want"))).count() == 4


def test_positional_and_held_out(spark):
    a = spark.createDataFrame([(5, "x"), (9, "y"), (70, "z")], "i long, t string")
    b = spark.createDataFrame([(1, "x"), (2, None)], "j long, t string")
    got = sorted(map(tuple, records.positional_pairs(a, b, "i", "j", ["t"]).collect()))
    assert got == [(0, 5, 1, False), (1, 9, 2, True)]
    assert records.held_out(a, b, "t").count() == 2
    assert records.held_out(a, a, "t").count() == 3  # nothing is left, so all come back


def test_line_logs(spark, tmp_path):
    lines = ['{"a": 1, "score": null}', "", '{"a": 2}', '{"a": 3, "sc', "not json", '{"a": 4, "score": 0.5}', "[1]"]
    (tmp_path / "log").write_text("\n".join(lines))
    good, bad = files.read_lines(spark, str(tmp_path / "log"), "a int, score double", ["score"])
    assert sorted(r["a"] for r in good.collect()) == [1, 4] and bad.count() == 4
    assert files.read_lines(spark, str(tmp_path / "none"), "a int")[0].count() == 0
    assert files.read_records(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "r.json").write_text(json.dumps([{"a": 1}, {"a": None, "b": 2}]))
    assert [r["a"] for r in files.read_records(spark, str(tmp_path / "r.json"), "a int").collect()] == [1, None]
    assert files.latest_run(spark, str(tmp_path)) is None


def test_ema_order_and_gaps(spark):
    df = spark.createDataFrame([("r", 2, 0.5), ("r", 1, 2.0), ("r", 3, None), ("r", 4, 1.0), ("q", 1, 5.0), (None, 1, 1.0)], "run string, step int, v double")
    for span in (1, 2, 3, 10_000):
        got = {(r["run"], r["step"]): round(r["ema_v"], 6) for r in ordered.ema(df, "run", "step", ["v"], span=span).collect()}
        assert got == {("r", 1): 1.0, ("r", 2): 1.1, ("r", 3): 1.04, ("r", 4): 1.04, ("q", 1): 1.0}


def test_group_advantage_without_variance(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 3.0)], "g string, x double")
    assert sorted(r["advantage"] for r in ordered.group_advantage(df, ["g"], "x").collect()) == [-1.0, 0.0, 0.0, 1.0]


def test_epochs_cover_all_rows(spark):
    df = spark.range(100)
    one, two = (ordered.epoch_batches(df, "id", e, 30).collect() for e in (1, 2))
    assert sorted(r["id"] for r in one) == list(range(100)) and {r["batch"] for r in one} == {0, 1, 2, 3} and one != two


def test_scorer_retries_and_gives_up(spark):
    calls = []

    def failing(texts, budget):
        calls.append(budget)
        if len(calls) < 3:
            raise OSError
        return ["ok"] * len(texts)

    assert scoring.ask(failing, ["a"], 100, wait=0) == ["ok"] and calls == [100, 400, 1600]
    assert scoring.ask(lambda t, b: 1 / 0, ["a", "b"], 1, wait=0) == [None, None]
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    assert [r["id"] for r in scoring.answers(df, "id", "t").collect()] == [1]


def test_framed_windows_equal_plain_ones(spark):
    from pyspark.sql.window import Window

    df = spark.range(300).select((F.col("id") % 3 == 0).cast("int").alias("g"), (F.col("id") * 7).alias("o"), (F.col("id") % 11).cast("double").alias("v"))
    w = Window.partitionBy("g").orderBy("o")
    plain = df.withColumn("rolling", F.sum("v").over(w.rowsBetween(-2, 2)) / 5)
    for size in (5, 17, 10_000):
        cut = ordered.framed(df, ["g"], "o", 2, 2, lambda x: {"rolling": F.sum("v").over(x) / 5}, size, 40)
        assert sorted(map(tuple, cut.select("g", "o", "rolling").collect())) == sorted(map(tuple, plain.select("g", "o", "rolling").collect()))
        tail = ordered.rolling_valid(df, ["g"], "o", "v", 4, size)
        want = df.withColumn("m", F.avg("v").over(w.rowsBetween(-3, 0))).withColumn("n", F.count("v").over(w.rowsBetween(-3, 0))).where("n = 4")
        assert sorted(map(tuple, tail.select("o", "rolling").collect())) == sorted(map(tuple, want.select("o", "m").collect()))


def test_places_by_quantiles(spark):
    """One outlying id must not put all rows into one bucket."""
    df = spark.range(20_000).select((F.col("id") * 3).alias("i")).union(spark.createDataFrame([(10**15,), (-(10**15),)], "i long"))
    got = records.numbered(df, "i")
    want = sorted(r["i"] for r in df.collect())
    assert [r["i"] for r in got.orderBy("n").collect()] == want and [r["n"] for r in got.orderBy("n").select("n").collect()] == list(range(20_002))
    assert records.numbered(df.limit(0), "i").count() == 0


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    files.write_atomic(spark.range(5), path)
    bad = spark.range(5).select(F.raise_error(F.lit("broken")).alias("id"))
    try:
        files.write_atomic(bad, path)
        raise AssertionError("the write must fail")
    except Exception as e:
        assert "broken" in str(e)
    assert sorted(r["id"] for r in files.read_log(spark, path, "id long").collect()) == list(range(5))
    files.write_atomic(spark.range(2), path)
    assert files.read_log(spark, path, "id long").count() == 2
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["out"]


def test_text_hash_is_the_same_in_sql(spark):
    import duckdb

    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "")], "i long, t string").select("i", "t", dist.text_hash("i", "t", seed=4).alias("h")).collect()
    c = duckdb.connect()
    for r in rows:
        assert c.execute(f"SELECT {dist.text_hash_sql('i', 't', seed=4)} FROM (SELECT ?::BIGINT AS i, ?::VARCHAR AS t)", [r["i"], r["t"]]).fetchone()[0] == r["h"] >= 0


def test_failures_and_retries(spark):
    cols = "target string, requested_difficulty int, attempt int, drop_reason string, error string, question string, parsed_difficulties array<int>, claude_feasibility int, claude_faithfulness struct<variable_coverage:double,target_present:boolean>"
    rows = [("t", 1, 1, None, "boom", None, None, None, None), ("t", 1, 2, None, None, "q", [2], None, None), ("t", 2, 1, None, "", " ", None, None, None), ("u", 1, 3, "max attempts", None, "q", None, 9, (1.0, True)), ("u", 2, 2, "x", None, "q", [2], 3, None), ("v", 1, 1, None, None, "q", [1], 9, (1.0, True)), (None, None, None, None, None, None, None, None, None)]
    failed = spark.createDataFrame(rows, cols)
    assert [r["k"] for r in failed.select(records.failure_kind(7, 1.0).alias("k")).collect()] == ["gen_exception", "wrong_difficulty", "parse_error", "gave_up", "quality_filter", "kept", "parse_error"]
    got = {(r["target"], r["requested_difficulty"]): (r["last"], r["passed"], r["remaining"], r["more_tokens"]) for r in records.retries(failed, spark.createDataFrame([("u", 2), ("w", 5), (None, 1)], "target string, requested_difficulty int"), 3, 600).collect()}
    assert got == {("t", 1): (2, False, True, 1200), ("t", 2): (1, False, True, 600), ("u", 1): (3, False, False, None), ("u", 2): (2, True, False, None), ("v", 1): (1, False, True, 600), ("w", 5): (0, True, False, None)}


def test_scores_come_back_by_item(spark):
    items = spark.createDataFrame([(1, True), (2, False), (3, True)], "i int, asked boolean")
    judged = spark.createDataFrame([(3, 11), (2, 7)], "i int, score int")
    assert {r["i"]: (r["score"], r["reward"]) for r in records.scores_by_index(items, judged, "i").collect()} == {1: (5.0, 0.0), 2: (0.0, -1.0), 3: (10.0, 1.0)}


def test_accepted_attempts_and_biased_choice(spark):
    df = spark.range(100).select("id", (F.col("id") % 10 == 9).alias("ok"))
    assert [r["id"] for r in ordered.first_accepted(df, ["id"], F.col("ok"), 4).collect()] == [9, 19]  # twenty tries only
    depths = spark.createDataFrame([("a", 0), ("b", 3), ("c", 4)], "v string, depth int")
    got = ordered.biased_choice(spark.range(6), depths, F.col("id") < 4, F.col("id"), 3)
    assert [r["target"] for r in got.orderBy("id").collect()] == ["b", "c", "b", "c", "b", "c"]
    assert {r["target"] for r in ordered.biased_choice(spark.range(6), depths, F.lit(True), F.col("id"), 9).collect()} == {"a", "b", "c"}


def test_batches_fall_back_to_single_calls():
    one = lambda texts, budget: [f"{t}!" for t in texts]
    assert scoring.ask_batch(one, one, ["a", "b"], 9) == ["a!", "b!"]
    assert scoring.ask_batch(lambda t, b: ["x"], one, ["a", "b"], 9) == ["a!", "b!"]  # answers that cannot be told apart
    assert scoring.ask_batch(lambda t, b: 1 / 0, lambda t, b: one(t, b) if t != ["b"] else 1 / 0, ["a", "b"], 9, wait=0) == ["a!", None]


def test_judges_side_by_side(spark):
    rows = spark.createDataFrame([(1, "t", ["p", "q"], "x", "What?"), (2, None, [], None, None)], "i int, trace_str string, leafs array<string>, target string, question string")

    def verdict(texts, budget):
        assert budget == 256
        return ['{"leaf_hits": {"p": true, "q": 1}, "target_present": "yes"}' for _ in texts]

    def fails(texts, budget):
        raise OSError

    got = {r["i"]: r for r in scoring.judge_questions(rows, "i", {"difficulty": lambda t, b: ["7"] * len(t), "feasibility": fails, "faithfulness": verdict}, tries=1).collect()}
    assert {i: (r["difficulty"], r["feasibility"], r["verdict"]["faithful"]) for i, r in got.items()} == {1: (7, -1, True), 2: (7, -1, False)}
    prompt = rows.select(scoring.judge_prompt("feasibility", F.col("trace_str"), F.col("leafs"), F.col("target"), F.col("question")).alias("p")).collect()
    assert prompt[0]["p"].endswith("\nt\nGiven: p, q\nTarget: x\nQuestion: What?") and "(none)" in prompt[1]["p"]
    assert scoring.judge_questions(rows.limit(0), "i").count() == 0
