"""The training-data operators against brute force, on awkward small inputs and on the smallest tables."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hyperloom.dist import read_table
from hyperloom.llm import broken_pairs, catalog, container_packing, corpus_encoding, near_duplicates, splits, stuffed_pages, target_sample, varied_subset
from tests.oracle import connect, rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    assert rows_of(df) == rows_of_sql(connect(sf), catalog.oracle_sql()[name], df.columns)


# --- 1: splits ------------------------------------------------------------------------------------------------------

LINKS = "id long, a string, b string, group_name string, _k string"


def records(spark):
    rows = [(1, "A b", "x", "z", None), (2, "ab", None, None, "q"), (3, None, "X", None, None), (4, None, None, None, None), (5, "", " ", None, None), (6, "lone", "lone", None, None), (6, "lone", "lone", None, None)]
    return spark.createDataFrame(rows, LINKS)


def brute_groups(pairs):
    groups = []
    for p in pairs:
        hit = [g for g in groups if g & p]
        groups = [g for g in groups if not g & p] + [set(p).union(*hit)]
    return {x: min(g) for g in groups for x in g}


def test_groups(spark):
    got = sorted(map(tuple, splits.grouped(records(spark), "id", ["a", "b"]).collect()))
    assert got == [(1, "ab"), (2, "ab"), (3, "ab"), (6, "lone"), (6, "lone")]
    assert splits.grouped(records(spark).limit(0), "id", ["a", "b"]).count() == 0


@pytest.mark.parametrize("limit", [0, 10**6])
def test_components_both_ways(spark, limit):
    rng = random.Random(5)
    pairs = [tuple(sorted(f"n{rng.randrange(120):03d}" for _ in "ab")) for _ in range(90)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    pairs = [p for p in pairs if p[0] != p[1]]
    got = {r["name"]: r["group"] for r in splits.components(spark.createDataFrame(pairs, "a string, b string").distinct(), limit).df.collect()}
    want = {k: v for k, v in brute_groups([set(p) for p in pairs]).items() if k != v}
    assert got == want


def test_forests_are_merged_level_by_level(spark):
    """Forty forests become five in five tasks, then one."""
    rng = random.Random(8)
    pairs = [tuple(sorted((f"n{rng.randrange(400):03d}", f"n{rng.randrange(400):03d}"))) for _ in range(300)]
    links = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a string, b string").repartition(40)
    forest = splits.shared_table(links.mapInArrow(splits._local_forest, "a string, b string"), "forest")
    assert splits._files(forest) >= 40
    tasks, write = [], splits.shared_table

    def watched(df, name):
        tasks.append(df.rdd.getNumPartitions())
        return write(df, name)

    splits.shared_table = watched
    try:
        top = splits.merged(forest, 40, 8)
    finally:
        splits.shared_table = write
    assert tasks == [5, 1]
    assert {r["a"]: r["b"] for r in top.df.collect()} == {k: v for k, v in brute_groups([set(p) for p in pairs]).items() if k != v}


def test_nameless_records_are_groups_of_their_own(spark):
    got = sorted(map(tuple, splits.grouped(records(spark), "id", ["a", "b"], nameless=True).collect()))
    assert got == [(1, "ab"), (2, "ab"), (3, "ab"), (4, "#4"), (5, "#5"), (6, "lone"), (6, "lone")]


def test_giving_is_the_greedy(spark):
    rng = random.Random(1)
    for _ in range(300):
        room = {s: rng.uniform(-20, 200) for s in "abc"[: rng.randrange(1, 4)]}
        size, count = rng.randrange(1, 9), rng.randrange(0, 60)
        own = dict(room)
        for _ in range(count):
            s = min(own, key=lambda s: (-own[s], s))
            own[s] -= size
        got = splits._give(room, size, count)
        assert sum(got.values()) == count
        assert sorted(room.values()) == pytest.approx(sorted(own.values()), abs=1e-6)


def test_splits_keep_groups(spark, sf):
    out = splits.p1_split(spark, sf)
    found = splits.p1_found(spark, sf)
    assert out.join(found, "record_id").groupBy("plan_id", "group_name").agg(F.countDistinct("split_name").alias("n")).where("n > 1").count() == 0
    n = read_table(spark, sf, "dataset").count()
    assert out.count() == 3 * n and out.dropDuplicates(["plan_id", "record_id"]).count() == 3 * n
    shares = spark.createDataFrame([("p", "x", 50), ("p", "y", 50), (None, "z", 1)], "plan_id string, split_name string, share_pct int")
    assert splits.assign(records(spark).limit(0), "id", ["a", "b"], shares).count() == 0


# --- 2: near duplicates ---------------------------------------------------------------------------------------------


def brute_pairs(rows, t):
    sets = [(i, re.sub("[^a-z0-9]", "", (k or "").lower()), set(re.findall("[a-z0-9]+", (x or "").lower()))) for i, k, x in rows]
    return {(min(i, j), max(i, j)) for (i, k, a), (j, m, b) in itertools.combinations(sets, 2) if k and k == m and a and b and len(a & b) >= t * len(a | b) - 1e-9}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        k = rng.randrange(len(out))
        out[k] = f"w{rng.randrange(400)}" if rng.random() < 0.7 else out[k]
        if rng.random() < 0.4:
            out.insert(rng.randrange(len(out)), f"w{rng.randrange(400)}")
        if rng.random() < 0.4 and len(out) > 1:
            out.pop(rng.randrange(len(out)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("common", [2, 8, 1000])
def test_pairs_equal_brute_force(spark, common):
    """Small limits force combinations of words, whose keys must lose no pair."""
    rng, rows = random.Random(common), []
    for g in range(60):
        base = [f"w{min(rng.randrange(400), rng.randrange(400), rng.randrange(400))}" for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 11, 12, 13, 20, 40]))]
        for _ in range(rng.randrange(1, 6)):
            rows.append((len(rows) * 3 + 1, rng.choice(["T a", "t_A", "u"]), " ".join(edited(rng, base, rng.randrange(0, 6)))))
    rows += [(10_000, None, "w1 w2"), (10_001, "T a", None), (10_002, "T a", "!!"), (10_003, "", "w1"), (10_004, "T a", ""), (10_005, "t a", "Kelvin K"), (10_006, "ta", "kelvin k")]
    rows.append((10_007, "u", " ".join(f"x{i}" for i in range(30_000))))
    rows.append((10_008, "U", " ".join(f"x{i}" for i in range(29_000))))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, target string, text string, key string")
    for t in (0.7, 0.8):
        got = near_duplicates.near_duplicate_pairs(df, t, common)
        pairs = [(r["a"], r["b"]) for r in got.collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == brute_pairs(rows, t)


def test_groups_of_near_duplicates(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, "t", text), (2, "t", text), (3, "t", text + " more"), (4, "t", "else"), (5, "s", text), (6, None, text), (7, "T", "same here"), (8, "t", "here same"), (9, "t", "same, here")]
    got = {r["id"]: (r["group_id"], r["links"]) for r in near_duplicates.near_duplicate_groups(spark.createDataFrame(rows, "id long, target string, text string"), 0.8).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 2), 8: (7, 2), 9: (7, 2)}
    assert near_duplicates.near_duplicate_pairs(spark.createDataFrame([], "id long, target string, text string")).count() == 0


# --- 3: samples -----------------------------------------------------------------------------------------------------


def test_newton_meets_the_targets():
    base, want = np.array([3.0, 100.0, 0.5, 7.0]), np.array([30.0, 1.0, 0.0, 7.0])
    assert np.allclose(base * np.exp(target_sample.newton_tilt(base, want)), want)


def test_calibration():
    drawn, p = target_sample.calibrate([1000, 1000, 5, 0], [0.5, 0.3, 0.1, 0.1], [0, 0, 2, 4], 100)
    assert sum(drawn) == 100 and drawn[2] == 5 and drawn[3] == 0
    assert target_sample.calibrate([100, 100], [0.99, 0.01], [0, 30], 100)[0] == [70, 30]
    assert target_sample.calibrate([3, 3], [0.5, 0.5], [0, 0], 100)[0] == [3, 3]
    assert target_sample.calibrate([], [], [], 10) == ([], [])


def test_pivotal_is_exact_and_unbiased():
    p, hits = [0.2, 0.5, 0.7, 0.6, 1.0, 0.0], np.zeros(6)
    for seed in range(4000):
        chosen, hold = target_sample.pivotal(list(range(6)), p, seed)
        chosen += [hold[0]] if hold and hold[1] > 0.5 else []
        assert len(chosen) == 3
        hits[chosen] += 1
    assert np.abs(hits / 4000 - p).max() < 0.04


def sample_tables(spark):
    data = [(i, "K one", 5) for i in range(400)] + [(1000 + i, "k_two", 5) for i in range(7)] + [(2000, None, 5), (2001, "k one", None), (2002, "", 5), (3000, "other", 5), (0, "K one", 5)]
    rows = spark.createDataFrame(data, "record long, chapter string, difficulty int").select("record", target_sample.name_key("chapter").alias("key"), "difficulty", F.lit("x").alias("p"), F.lit(1).alias("cell"))
    mix = spark.createDataFrame([("a", "k-one", 5, 60, 2, 50), ("a", "k two", 5, 40, 2, 50), ("b", "none", 5, 100, 3, 10), (None, "k one", 5, 1, 1, 1), ("b", None, 5, 0, 1, 1)], "plan_id string, chapter string, requested_difficulty int, share_pct int, min_rows long, sample_size long")
    return rows, mix


def test_sample_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(target_sample, "BUCKET_ROWS", 30)  # several buckets a cell
    rows, mix = sample_tables(spark)
    plan = target_sample.plan_sample(rows, mix)
    assert sorted(map(tuple, plan.gaps(spark).collect())) == [("a", "k two", 5, 7, 20, 13), ("b", "none", 5, 0, 10, 10)]
    got = target_sample.draw(rows, plan)
    counts = {(r["plan_id"], r["key"]): r["count"] for r in got.groupBy("plan_id", "key").count().collect()}
    assert counts == {("a", "kone"): 43, ("a", "ktwo"): 7}
    assert sorted(got.collect()) == sorted(target_sample.draw(rows, plan).collect())  # the same on every run
    none = target_sample.plan_sample(rows.limit(0), mix)
    assert none.gaps(spark).count() == 3 and target_sample.draw(rows.limit(0), none).count() == 0


# --- 4: varied subsets ----------------------------------------------------------------------------------------------


def test_quotas():
    for size in (0, 1, 2, 7, 50, 105, 500):
        caps = {1: 5, 2: 2, 3: 1}, {1: 100, 2: 4, 3: 1}
        got = varied_subset.root_quotas({1: 100, 2: 4, 3: 1}, list(caps), size)
        assert sum(got.values()) == min(size, 105) and all(got[c] <= caps[1][c] for c in got)


def test_subset_spans_the_data(spark):
    rows = [(i, ["s:a"], "t1", ["l1", "L 1"], "same question") for i in range(300)]
    rows += [(1000 + i, ["s:a"], "t1", ["l1"], f"question {i}") for i in range(40)]
    rows += [(2000 + i, [f"s:{i}"], f"t{i}", [f"l{i}"], "q") for i in range(30)]
    rows += [(3000, None, None, None, None), (3001, [None], "", [], ""), (3002, ["s:a"], "t1", ["l1"], "y" * 200_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "record long, subdomains array<string>, target string, leafs array<string>, question string, cluster int, combo string")
    for size in (10, 40, 80, 5000):
        got = varied_subset.varied_subset(df, size, clusters=8)
        ids = {r["record"] for r in got.collect()}
        assert got.count() == len(ids) == min(size, len(rows))
        if size == 40:
            assert len({i for i in ids if 2000 <= i < 2030}) == 30  # every rare combination
        if size >= 40:
            assert len([i for i in ids if i < 300]) <= max(1, size - 73)  # repeats only when nothing new is left
    assert varied_subset.varied_subset(df.limit(0), 5).count() == 0
    assert sorted(varied_subset.varied_subset(df, 40, 8).collect()) == sorted(varied_subset.varied_subset(df, 40, 8).collect())


# --- 5: defective pairs ---------------------------------------------------------------------------------------------

ENGLISH = ["Nothing in the record explains why it fell so far that morning.", "The crew has noted what the gauge said and went home at last.", "It helps to sketch the thing before writing down any formula."]
GERMAN = ["Die Werkstatt hat den Prüfstand neu gebaut und alle Werte notiert.", "Wer hier arbeitet kennt die Anlage und ihre Mängel schon lange.", "Erst nach einer Stunde stand der Zeiger still und niemand fragte."]


def pair_tables(spark):
    good = "From pump_flow and pipe_loss the total lift follows.\nPump_flow is {0} m.\nPipe loss is {1} m.\nLevel {2}: plain words; the last sentence asks for the total_lift"
    rows = [(0, i, ["total_lift"], f"At the yard pump flow is {i} m and pipe loss is {i * 2} m on day {i}. Find the total lift.", good.format(i, i * 2, i % 9)) for i in range(60)]
    bad = [
        (100, "<reasoning>\n- \n</reasoning>", "empty"), (101, "N/A", "empty"), (102, "​", "empty"), (103, None, "empty"),
        (104, "Sorry, I cannot help with that.", "refusal"), (105, "From pump_flow the total lift follows.\nI must decline to go on.", "refusal"),
        (106, "AT THE YARD pump flow is 7 m and pipe loss is 14 m, on day 7! find the total lift", "copy"),
        (107, " ".join(GERMAN), "language"), (108, "From pump_flow and pipe_loss the total lift follows.\nPump_flow is 4", "truncated"),
        (109, good.format(1, 2, 3)[:-9], "truncated"), (110, "x" * 300_000, "truncated"),
    ]
    first = "At the yard pump flow is 7 m and pipe loss is 14 m on day 7. Find the total lift."
    rows += [(0, i, None, first, t) for i, t, _ in bad]
    pages = spark.createDataFrame([(" ".join(ENGLISH), "en"), (ENGLISH[0], "EN"), (" ".join(GERMAN), "de-x"), (GERMAN[1], "de"), (None, "fr"), ("", "it"), ("text", None)] * 3, "text string, lang string")
    formulas = spark.createDataFrame([("total_lift", ["pump_flow", "pipe_loss"]), ("other", None)], "output string, inputs array<string>")
    return spark.createDataFrame([(*r, "clash") for r in rows], "kind int, id long, names array<string>, first string, second string, defect string"), pages, formulas, {i: d for i, _, d in bad}


def test_defects(spark):
    pairs, pages, formulas, want = pair_tables(spark)
    got = broken_pairs.broken_pairs(pairs, pages, formulas)
    assert {r["row_id"]: r["defect"] for r in got.collect()} == want
    assert got.where("source_table <> 'dataset'").count() == 0
    assert broken_pairs.broken_pairs(pairs.limit(0), pages, formulas).count() == 0
    assert broken_pairs.broken_pairs(pairs.where("id = 107"), pages.limit(0), formulas.limit(0)).where("defect = 'language'").count() == 0


def test_copies_of_a_truncated_text_do_not_vouch_for_each_other(spark):
    pairs, pages, formulas, want = pair_tables(spark)
    hot = pairs.where("id = 109").withColumn("id", F.explode(F.expr("sequence(1000L, 1034L)")))  # a third of all rows
    got = {r["row_id"]: r["defect"] for r in broken_pairs.broken_pairs(pairs.union(hot), pages, formulas).collect()}
    assert got == want | {i: "truncated" for i in range(1000, 1035)}
    same = pairs.union(pairs.where("id = 109")).union(pairs.where("id = 109"))  # a resumed run writes its rows again
    assert broken_pairs.broken_pairs(same, pages, formulas).where("row_id = 109 and defect = 'truncated'").count() == 3


def test_unwrapping_and_labels():
    names = broken_pairs.Names(["total_lift"])
    assert broken_pairs.unwrap('```json\n{"difficulty": 3, "question": "Say \\"hi\\"\\nnow') == 'Say "hi"\nnow'
    assert broken_pairs.unwrap("<REASONING>a</REASONING>") == "a"
    assert not broken_pairs.labelled('A sign says "I cannot help". I cannot see a clash: total lift at 3.', names)
    assert not broken_pairs.labelled("- sorry state of the rig: the crew is unable to help.\n- find the total lift", names)
    assert broken_pairs.labelled("As an automated assistant I may not write a problem on the total lift.", names)


#: Refusals in words that label no text.
OTHERWISE = [
    "It would not be right for me to respond to that.", "My programming does not let me engage with this.", "You will have to find this answer elsewhere.",
    "I'd rather leave this one alone, if you don't mind.", "Answering this is against my principles.", "I respectfully opt out of this exercise.",
    "I have no wish to take part in this.", "This prompt crosses a line for me, so I stop here.", "Let us skip this one and talk about something different.",
    "Providing the steps here is not allowed for me.", "No, I am not doing that.", "I am forbidden from giving an answer to this task.",
]


def test_refusals_worded_otherwise(spark, sf):
    """The model is fitted on texts that fixed wordings label, and finds those that no wording meets."""
    data = read_table(spark, sf.replace("sf0.001", "sf0.1"), "dataset").where("chain_of_thought is not null")
    pairs = data.select(F.lit(0).alias("kind"), F.col("record_id").alias("id"), F.array("target").alias("names"), F.col("chain_of_thought").alias("second"))
    edges = read_table(spark, sf, "hyperedges").select(F.explode(F.array_append("inputs", F.col("output"))).alias("v"))
    vocabulary = sorted(r["v"] for r in edges.distinct().collect())
    names, model = broken_pairs.Names(vocabulary), broken_pairs.Refusals(broken_pairs.refusal_counts(pairs, vocabulary))
    assert not any(broken_pairs.labelled(t, names) for t in OTHERWISE)
    assert sum(model.is_refusal(t, names) for t in OTHERWISE) >= 11
    assert model.is_refusal("From pump flow the lift follows.\nI must decline to go on.", names)
    for sound in ("I cannot see a clash: " + vocabulary[0] + " at 3.", "- I can", "The last sentence asks for " + vocabulary[0], 'A sign says "I cannot help you with that"', "", "Der letzte Satz fragt nach Wasser."):
        assert not model.is_refusal(sound, names)
    assert not broken_pairs.Refusals({}).is_refusal(OTHERWISE[0], names)


def test_copies_are_told_by_the_fit():
    rng = np.random.default_rng(3)
    shares = np.r_[rng.beta(14, 38, 30_000), rng.beta(50, 50, 1500), rng.power(35, 400)]
    bins = np.histogram(shares, broken_pairs.SHARES, (0, 1))[0].tolist()
    assert 0.66 <= broken_pairs.copy_threshold(bins) <= 0.8
    assert broken_pairs.copy_threshold(bins) == broken_pairs.copy_threshold([10 * b for b in bins])  # the same at any size
    assert broken_pairs.copy_threshold([5] * 100 + [0] * 100) == broken_pairs.COPIES_FROM == broken_pairs.copy_threshold([0] * 200)


def test_runs_inside_and_at_ends():
    known = broken_pairs.WordHashes()
    texts = [list("abcde"), [], ["a"], list("ab"), list("xabcde")]
    ends, inside = broken_pairs.runs_of(texts, known)
    one = lambda words: int(broken_pairs._windows(np.array([known[w] for w in words], dtype=np.uint64), len(words))[0])
    assert [e.tolist() for e in ends] == [
        [one("de"), 0, 0, one("ab"), one("de")], [one("cde"), 0, 0, 0, one("cde")], [one("bcde"), 0, 0, 0, one("bcde")],
        [one("d"), 0, 0, one("a"), one("d")], [one("cd"), 0, 0, 0, one("cd")], [one("bcd"), 0, 0, 0, one("bcd")],
    ]
    for size, (h, of) in enumerate(inside, 1):
        want = sorted((t, one("".join(w[i : i + size]))) for t, w in enumerate(texts) for i in range(len(w) - size))
        assert sorted(zip(of.tolist(), h.tolist())) == want
    assert [len(x) for x in broken_pairs.runs_of([], known)[0]] == [0] * 6


def test_decisions_do_not_depend_on_the_size(spark):
    """Ten copies of a collection in other numbers give each copy the same defects."""
    pairs, pages, formulas, want = pair_tables(spark)
    hundred = pairs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("second", F.regexp_replace("second", "(?<=[0-9])(?= m)", F.concat(F.lit("."), F.col("k").cast("string"))))
    many = hundred.withColumn("id", F.col("id") + 1000 * F.col("k")).drop("k")
    got = {r["row_id"]: r["defect"] for r in broken_pairs.broken_pairs(many, pages, formulas).collect()}
    assert got == {i + 1000 * k: d for i, d in want.items() for k in range(10)}


def test_language_model_on_held_out_pages(spark, sf):
    pages = read_table(spark, sf.replace("sf0.001", "sf0.01"), "documents").where("lang in ('en', 'de', 'fr', 'es', 'it', 'pl', 'nl', 'pt') and length(text) > 200").select("doc_id", "text", "lang")
    tables = broken_pairs.language_tables(pages.where("doc_id % 2 = 0"), [], 40)
    model, names = broken_pairs.Languages(tables), broken_pairs.Names([])
    held = pages.where("doc_id % 2 = 1 and lang in ('de', 'pl', 'fr')").collect()
    foreign = [model.is_foreign(broken_pairs.plain(broken_pairs.WORDS.findall(r["text"].lower()), names)) for r in held]
    assert len(held) > 20 and np.mean(foreign) >= 0.75  # some pages are labelled wrongly or hold English lists
    english = [model.is_foreign(broken_pairs.plain(broken_pairs.WORDS.findall(r["text"].lower()), names)) for r in pages.where("doc_id % 2 = 1 and lang = 'en'").collect()]
    assert np.mean(english) < 0.15


# --- 6: encoding ----------------------------------------------------------------------------------------------------


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = corpus_encoding.PerfectHash(keys)
    hashes = np.array([corpus_encoding.xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
    assert h.index(hashes).tolist() == list(range(3000)) and sorted(h.slot_key) == list(range(3000))
    with pytest.raises(ValueError):
        corpus_encoding.PerfectHash([b"a", b"a"])


TEXTS = ["", None, " ", "Hello world", "it's they'll 'S", "a  b\n\n c\t\r\n", "<|endoftext|> x", "é ü ñ 中文 日本語 привет 🙂👩‍🔬", "0123456789" * 50, "  x​", "x" * 60_000, "ab " * 40_000, "\x00\x01 \x7f", "ﬁ Å ½ é", "__init__(self): # 1.5e-7", " lead", "trail ", "\x85next"]


def test_ids_equal_the_library(spark, sf):
    import tiktoken

    ranks = corpus_encoding.read_ranks(f"{corpus_encoding.TOKENIZERS}/byte_bpe_50k.tiktoken")
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, "Hello world", "again")], "id long, text string, ids string")
    for df in (own, corpus_encoding.documents(spark, sf)):
        texts = [(r["id"], r["text"]) for r in df.collect()]
        got = sorted((r["id"], list(r["ids"])) for r in corpus_encoding.encode(df).collect())
        assert got == sorted((i, enc.encode_ordinary(t or "")) for i, t in texts)
        assert sorted(map(tuple, corpus_encoding.token_counts(df).collect())) == sorted((i, len(enc.encode_ordinary(t or ""))) for i, t in texts)
    assert corpus_encoding.encode(own.limit(0)).count() == 0


def test_round_trip(spark, sf):
    back = {v: k for k, v in corpus_encoding.read_ranks(f"{corpus_encoding.TOKENIZERS}/byte_bpe_50k.tiktoken").items()}
    docs = corpus_encoding.documents(spark, sf)
    ids = {r["id"]: r["ids"] for r in corpus_encoding.encode(docs).collect()}
    assert all(b"".join(back[i] for i in ids[r["id"]]).decode() == (r["text"] or "") for r in docs.collect())


# --- 7: packing -----------------------------------------------------------------------------------------------------


def check_packed(got, items, capacity):
    boxes, pieces = {}, {}
    for r in got:
        boxes[r["container"]] = boxes.get(r["container"], 0) + r["size"]
        pieces.setdefault(r["id"], []).append(r["size"])
    assert all(0 < n <= capacity for n in boxes.values()) and sorted(boxes) == list(range(len(boxes)))
    total = {}
    for i, n in items:
        if n and n > 0:
            total[i] = total.get(i, 0) + n
    assert {i: sum(p) for i, p in pieces.items()} == total
    return len(boxes)


@pytest.mark.parametrize("seed", range(4))
def test_packing(spark, seed):
    rng = random.Random(seed)
    items = [(i, rng.choice([1, 2, 3, 40, rng.randrange(1, 60), rng.randrange(1, 300)])) for i in range(400)] + [(900, None), (901, 0), (902, -4), (903, 100), (904, 200), (905, 12_345)]
    df = spark.createDataFrame([(*x, 7) for x in items], "id long, n long, size long")
    used = check_packed(container_packing.pack(df, 100).collect(), items, 100)
    assert used <= -(-sum(n for _, n in items if n and n > 0) // 100) * 1.03 + 1
    assert container_packing.pack(df.limit(0), 100).count() == 0


def test_packing_is_near_the_best():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randrange(1, 11) for _ in range(8)]
        counts = {s: sizes.count(s) for s in sizes}
        got = sum(m for _, m in container_packing.packing_plan(counts, 10))
        least = next(k for k in range(1, 9) if fits(sorted(sizes, reverse=True), [10] * k))
        assert got <= least + 1


def fits(sizes, room):
    if not sizes:
        return True
    tried = set()
    for k, r in enumerate(room):
        if r >= sizes[0] and r not in tried:
            tried.add(r)
            if fits(sizes[1:], [*room[:k], r - sizes[0], *room[k + 1 :]]):
                return True
    return False


def test_whole_items_stay_whole(spark, sf):
    out = container_packing.p7_containers(spark, sf)
    assert out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k")).where("n <= 2048 and k > 1").count() == 0
    assert out.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where("n > 2048").count() == 0


# --- 8: stuffed pages -----------------------------------------------------------------------------------------------


def page_rows():
    goods, ways = ["pump", "valve", "hose", "gasket", "winch", "seal"], ["cheap", "sale", "price", "buy", "offer", "online"]
    rng, rows = random.Random(2), []
    for i in range(40):
        rows.append((i, ", ".join(f"{rng.choice(goods)} {rng.choice(ways)}" for _ in range(20)), f"http://h{i % 9}.example/x", None))
        rows.append((100 + i, " ".join(rng.choice(ENGLISH) for _ in range(5)), None, f"s{i % 5}.example"))
    cases = [
        (500, "http://a.example/x\nhttps://www.b.test/p?id=3\nc.example/y/z", True), (501, "#pump #valveCheap #hose #seal", True),
        (502, "Cheap pump sale. Buy valve online! Hose price offer sale.", True), (503, "pump cheap | valve sale | hose price | seal buy | winch offer | pump buy", True),
        (504, '<li><a href="a.example/x">pump cheap</a></li>\n<li><a href="b.example/y">valve sale</a></li>', True),
        (505, ENGLISH[0] + " " + ENGLISH[1] + "\nTags: pump, valve, hose", False), (506, "x_1 = y_2 * z_3 [m]\nprint(x_1)", False),
        (507, "Read https://a.example/x to see what the gauge said before the crew went home.", False), (508, "1 | 2.5 | 3.5\n2 | 7.5 | 1.5", False),
        (509, "½ ¾ ² ³", False), (510, ENGLISH[2] * 4000, False), (511, "pump cheap, " * 30_000, True),
    ]
    rows += [(i, t, "https://h1.example/q", None) for i, t, _ in cases] + [(600, None, None, None), (601, "", None, None), (602, " \n ", None, None), (511, "pump cheap, " * 30, None, None)]
    return [(*r, "clash") for r in rows], {i for i, _, s in cases if s}


PAGES = "doc_id long, text string, url string, source string, words string"


def test_stuffed_pages(spark):
    rows, stuffed = page_rows()
    df = spark.createDataFrame(rows, PAGES)
    got = stuffed_pages.list_words(df)
    flagged = {r["doc_id"] for r in got.where("listed >= 0.75 * words").collect()}
    assert flagged == {i for i in range(40)} | stuffed
    assert got.where("doc_id >= 600").count() == 0
    assert stuffed_pages.list_words(df.limit(0)).count() == 0
    words = {r["doc_id"]: r["words"] for r in got.where("doc_id in (500, 510)").collect()}
    assert words == {500: 3, 510: len((ENGLISH[2] * 4000).split())}
    # Evidence that is too large to broadcast is joined, with the same rows.
    assert sorted(map(tuple, stuffed_pages.list_words(df, limit=0).collect())) == sorted(map(tuple, got.collect()))


def test_lists_need_replicated_phrases(spark):
    """On one host only, the same lists are no evidence; links and tags are."""
    rows, _ = page_rows()
    df = spark.createDataFrame(rows, PAGES).withColumn("url", F.lit("https://one.example/a"))
    flagged = {r["doc_id"] for r in stuffed_pages.list_words(df).where("listed >= 0.75 * words").collect()}
    assert flagged == {500, 501, 504}


def test_phrases_are_counted_on_all_hosts(spark):
    rows = [("a b, a b, a b, c d, c d, a b", f"http://h{i % 5}.example/x", None) for i in range(20)] + [("The crew has noted that a b stood still for long.", None, "s")] * 3 + [(None, None, None)]
    odds = {r["phrase"]: r["odds"] for r in stuffed_pages.phrase_evidence(spark.createDataFrame(rows[:-1], "text string, url string, source string")).df.collect()}
    shingles = lambda t: stuffed_pages.Cut(pa.array([t]), stuffed_pages.WordFacts()).phrases()[2].tolist()
    assert all(odds[p] >= stuffed_pages.ODDS for p in shingles("c d")) and all(odds[p] <= -stuffed_pages.ODDS for p in shingles("crew") + shingles("stood still"))
    assert len(shingles("c d")) == 3 and not set(shingles("c a")[2:]) & odds.keys()  # in this order it stands nowhere


def test_cut_pages_in_many_words():
    known, evidence = stuffed_pages.WordFacts(), stuffed_pages.Evidence(np.zeros(0, dtype=np.int64), np.zeros(0))
    texts = ["pump, " * 1_100_000 + "\nfine", "", "x", "One. Two! Three\nfour", '<meta name="keywords" content="a, b">\nlast line', "a  b\u2028c"]
    cut = stuffed_pages.Cut(pa.array(texts), known)
    words, listed = stuffed_pages.listed_words(cut, evidence)
    assert words.tolist() == [len(t.split()) for t in texts] and listed.tolist() == [0, 0, 0, 0, 6, 0]  # a short line goes with the list before it
    assert cut.size.tolist() == [1_100_000, 1, 1, 1, 1, 1, 1, 4, 2, 2, 1]
