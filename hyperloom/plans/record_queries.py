"""Projections, filters, joins, sets and scalar algebra over the question records."""

from __future__ import annotations

from pyspark.sql import functions as F


from hyperloom.dist import read_table, text_hash, text_hash_sql
from hyperloom.functions import rewards
from hyperloom.operators import records
from hyperloom.plans.registry import query

_CHAPTER = "coalesce(trace.chapters[1], '')"


def _data(spark, d):
    return read_table(spark, d, "dataset")


@query("project_trace", """
SELECT record_id, trace.target AS target, trace.hypernym AS hypernym, array_to_string(list_transform(trace.path, lambda e: e.id || '/' || coalesce(e.subdomain, e.domain)), ' ') AS steps
FROM dataset WHERE trace IS NOT NULL AND trace.path IS NOT NULL""")
def project_trace(spark, d):
    rows = _data(spark, d).where("trace is not null and trace.path is not null").select("record_id", records.project_trace(F.col("trace")).alias("t"))
    return rows.select("record_id", "t.target", "t.hypernym", F.array_join(F.transform("t.path", lambda e: F.concat(e["id"], F.lit("/"), e["subdomain"])), " ").alias("steps"))


@query("build_row", r"""
SELECT record_id, target, requested_difficulty, trim(question, ' ' || chr(9) || chr(10) || chr(13)) AS question, CASE WHEN regexp_matches(chain_of_thought, '[^\s\p{Z}]') THEN chain_of_thought END AS chain_of_thought FROM dataset""")
def build_row(spark, d):
    from hyperloom.functions.text import non_blank

    return _data(spark, d).select("record_id", "target", "requested_difficulty", F.regexp_replace("question", r"^[ \t\n\r]+|[ \t\n\r]+$", "").alias("question"), non_blank(F.col("chain_of_thought")).alias("chain_of_thought"))


@query("build_failed_row", """
SELECT failure_kind, attempt, nullif(error, '') AS error, coalesce(claude_faithfulness.variable_coverage, faithfulness_coverage) AS coverage, coalesce(claude_faithfulness.target_present, target_present) AS present,
       length(left(raw_generation, 8000)) AS raw_chars, count(*) AS n FROM dataset_failed GROUP BY ALL""")
def build_failed_row(spark, d):
    f = read_table(spark, d, "dataset_failed")
    rows = f.select("failure_kind", "attempt", F.nullif("error", F.lit("")).alias("error"), F.coalesce("claude_faithfulness.variable_coverage", "faithfulness_coverage").alias("coverage"), F.coalesce("claude_faithfulness.target_present", "target_present").alias("present"), F.length(F.left("raw_generation", F.lit(8000))).cast("long").alias("raw_chars"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@query("resolve_domain", """
SELECT record_id, coalesce(nullif(domain, ''), nullif(trace.chapters[1], ''), '') AS domain,
       coalesce(nullif(subdomain, ''), nullif(trace.subdomains[1], ''), nullif(domain, ''), nullif(trace.chapters[1], ''), '') AS subdomain FROM dataset""")
def resolve_domain(spark, d):
    chapter, sub = F.get("trace.chapters", F.lit(0)), F.get("trace.subdomains", F.lit(0))
    domain = records.first_of(F.col("domain"), chapter)
    return _data(spark, d).select("record_id", domain.alias("domain"), records.first_of(F.col("subdomain"), sub, domain).alias("subdomain"))


_FAILED = """concat_ws(', ', CASE WHEN NOT coalesce(claude_feasibility >= 7, false) THEN 'feas=' || coalesce(claude_feasibility, -1) || '<7' END,
  CASE WHEN NOT coalesce(claude_faithfulness.variable_coverage >= 1.0, false) THEN 'cov=' || printf('%.2f', coalesce(claude_faithfulness.variable_coverage, 0.0)) || '<1.0' END,
  CASE WHEN NOT coalesce(claude_faithfulness.target_present, false) THEN 'target_missing' END)"""


@query("quality_filter", f"SELECT record_id, {_FAILED} AS failed, {_FAILED} = '' AS kept FROM dataset")
def quality_filter(spark, d):
    f = F.col("claude_faithfulness")
    failed = records.quality_tests(F.col("claude_feasibility"), f["variable_coverage"], f["target_present"], 7, 1.0)
    return _data(spark, d).select("record_id", failed.alias("failed"), (failed == "").alias("kept"))


@query("classify_failure", """
WITH f AS (SELECT *, claude_faithfulness.variable_coverage AS cov, claude_faithfulness.target_present AS tgt FROM dataset_failed)
SELECT CASE WHEN coalesce(error, '') <> '' THEN 'gen_exception'
            WHEN len(parsed_difficulties) > 0 AND NOT coalesce(list_contains(parsed_difficulties, requested_difficulty), false) THEN 'wrong_difficulty'
            WHEN trim(coalesce(question, '')) = '' THEN 'parse_error'
            WHEN contains(coalesce(drop_reason, ''), 'attempts') THEN 'gave_up'
            WHEN NOT (coalesce(claude_feasibility >= 7, false) AND coalesce(cov >= 1.0, false) AND coalesce(tgt, false)) THEN 'quality_filter' ELSE 'kept' END AS kind, failure_kind, count(*) AS n
FROM f GROUP BY ALL""")
def classify_failure(spark, d):
    """The kind of each failure by what its row holds, beside the kind that was logged."""
    rows = read_table(spark, d, "dataset_failed")
    return rows.groupBy(records.failure_kind(7, 1.0).alias("kind"), "failure_kind").agg(F.count(F.lit(1)).alias("n"))


@query("single_domain_filter", "SELECT record_id FROM dataset WHERE len(trace.chapters) = 1 AND coalesce(len(trace.subdomains), 0) <= 1")
def single_domain_filter(spark, d):
    return _data(spark, d).where((F.size("trace.chapters") == 1) & (F.coalesce(F.size("trace.subdomains"), F.lit(0)) <= 1)).select("record_id")


@query("min_trace_filter", "SELECT record_id, len(trace.path) AS steps FROM dataset WHERE len(trace.path) >= 3")
def min_trace_filter(spark, d):
    return _data(spark, d).select("record_id", F.size("trace.path").cast("long").alias("steps")).where("steps >= 3")


@query("filter_records", f"""
SELECT record_id FROM dataset WHERE requested_difficulty IN (5, 8) AND {_CHAPTER} IN ('pump_hydraulics', 'belt_drives')
  AND contains(lower(concat_ws(chr(10), target, question, chain_of_thought)), 'shaft') AND coalesce(claude_faithfulness.faithful, false) AND trim(coalesce(chain_of_thought, ''), ' ') <> ''""")
def filter_records(spark, d):
    return records.browse(_data(spark, d), [5, 8], ["pump_hydraulics", "belt_drives"], "shaft", True, True).select("record_id")


@query("chapter_of", f"SELECT record_id, {_CHAPTER} AS chapter FROM dataset")
def chapter_of(spark, d):
    return _data(spark, d).select("record_id", F.coalesce(F.get("trace.chapters", F.lit(0)), F.lit("")).alias("chapter"))


@query("facets", f"SELECT DISTINCT requested_difficulty, {_CHAPTER} AS chapter FROM dataset")
def facets(spark, d):
    return _data(spark, d).select("requested_difficulty", F.coalesce(F.get("trace.chapters", F.lit(0)), F.lit("")).alias("chapter")).distinct()


@query("valid_score_filter", "SELECT eval_id, claude_faithfulness.variable_coverage AS score FROM eval_sft WHERE claude_faithfulness.variable_coverage IS NOT NULL")
def valid_score_filter(spark, d):
    return read_table(spark, d, "eval_sft").select("eval_id", F.col("claude_faithfulness.variable_coverage").alias("score")).where("score is not null")


@query("valid_judge_filter", "SELECT record_id, claude_difficulty FROM dataset WHERE claude_difficulty BETWEEN 1 AND 10")
def valid_judge_filter(spark, d):
    return _data(spark, d).where(F.col("claude_difficulty").between(1, 10)).select("record_id", "claude_difficulty")


@query("min_text_filter", r"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) >= 10")
def min_text_filter(spark, d):
    from hyperloom.functions.text import strip

    return read_table(spark, d, "documents").where(F.length(strip(F.col("text"))) >= 10).select("doc_id")


@query("has_prompt_filter", "SELECT eval_id FROM eval_sft WHERE trace IS NOT NULL AND coalesce(question, '') <> ''")
def has_prompt_filter(spark, d):
    return read_table(spark, d, "eval_sft").where(F.col("trace").isNotNull() & (F.coalesce("question", F.lit("")) != "")).select("eval_id")


@query("edge_lookup_join", """
SELECT e.id AS consumer, i.v AS variable, p.id AS producer FROM (SELECT id, unnest(inputs) AS v FROM hyperedges) i JOIN hyperedges e ON e.id = i.id JOIN hyperedges p ON p.output = i.v""")
def edge_lookup_join(spark, d):
    edges = read_table(spark, d, "hyperedges")
    inputs = edges.select(F.col("id").alias("consumer"), F.explode("inputs").alias("variable"))
    return inputs.join(edges.select(F.col("output").alias("variable"), F.col("id").alias("producer")), "variable").select("consumer", "variable", "producer")


@query("heldout_anti", """
WITH pool AS (SELECT DISTINCT output AS target FROM hyperedges), fresh AS (SELECT target FROM pool WHERE target NOT IN (SELECT target FROM dataset WHERE target IS NOT NULL))
SELECT target FROM fresh UNION ALL SELECT target FROM pool WHERE NOT EXISTS (SELECT 1 FROM fresh)""")
def heldout_anti(spark, d):
    pool = read_table(spark, d, "hyperedges").select(F.col("output").alias("target")).distinct()
    return records.held_out(pool, _data(spark, d), "target").select("target")


@query("semi_producible", """
SELECT e.id, coalesce(h.n, 0) AS producible FROM hyperedges e LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT id, unnest(inputs) AS v FROM hyperedges) WHERE v IN (SELECT output FROM hyperedges) GROUP BY id) h USING (id)""")
def semi_producible(spark, d):
    edges = read_table(spark, d, "hyperedges")
    made = edges.select(F.col("output").alias("v")).distinct()
    hits = edges.select("id", F.explode("inputs").alias("v")).join(made, "v").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return edges.select("id").join(hits, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("producible"))


@query("compare_positional", """
WITH b AS (SELECT row_number() OVER (ORDER BY eval_id) - 1 AS n, * FROM eval_sft WHERE model = 'base'), s AS (SELECT row_number() OVER (ORDER BY eval_id) - 1 AS n, * FROM eval_sft WHERE model IS NULL)
SELECT b.n, b.eval_id AS left_id, s.eval_id AS right_id, (b.target IS DISTINCT FROM s.target OR b.requested_difficulty IS DISTINCT FROM s.requested_difficulty) AS differs FROM b JOIN s USING (n)""")
def compare_positional(spark, d):
    rows = read_table(spark, d, "eval_sft")
    return records.positional_pairs(rows.where("model = 'base'"), rows.where("model is null"), "eval_id", "eval_id", ["target", "requested_difficulty"])


@query("unit_first_match", """
WITH own AS (SELECT output, arg_min(output_unit, id) AS unit FROM hyperedges GROUP BY output),
used AS (SELECT id, unnest(inputs) AS variable FROM hyperedges),
first AS (SELECT variable, arg_min(unit, id) AS unit FROM used JOIN own ON own.output = variable WHERE unit IS NOT NULL GROUP BY variable)
SELECT h.variable, coalesce(nullif(first.unit, ''), '(unit not specified)') AS unit FROM hypernyms h LEFT JOIN first ON first.variable = h.variable""")
def unit_first_match(spark, d):
    """The unit of each quantity as an input: that of the first formula, by id, whose input units name it."""
    edges = records.with_input_units(read_table(spark, d, "hyperedges"))
    first = records.first_input_unit(edges)
    return read_table(spark, d, "hypernyms").join(first, "variable", "left").select("variable", records.first_of(F.col("unit"), F.lit("(unit not specified)")).alias("unit"))


@query("given_values_left", """
SELECT r.record_id, l.leaf, coalesce(CAST(map_extract(r.claude_faithfulness.leaf_hits, l.leaf)[1] AS VARCHAR), '(value not specified)') AS value
FROM dataset r JOIN (SELECT record_id, unnest(list_distinct(trace.leafs)) AS leaf FROM dataset) l USING (record_id) WHERE l.leaf IS NOT NULL""")
def given_values_left(spark, d):
    rows = _data(spark, d).select("record_id", F.explode(F.array_distinct("trace.leafs")).alias("leaf"), F.col("claude_faithfulness.leaf_hits").alias("m")).where("leaf is not null")
    return rows.select("record_id", "leaf", F.coalesce(F.try_element_at("m", "leaf").cast("string"), F.lit("(value not specified)")).alias("value"))


@query("score_by_index", """
WITH item AS (SELECT eval_id AS i, trace IS NOT NULL AND coalesce(question, '') <> '' AS asked FROM eval_sft),
judged AS (SELECT eval_id AS i, greatest(0.0, least(10.0, claude_feasibility)) AS s FROM eval_sft WHERE claude_feasibility >= 0)
SELECT item.i AS eval_id, CAST(CASE WHEN NOT asked THEN 0.0 ELSE coalesce(s, 5.0) END AS DOUBLE) AS score,
       CAST(CASE WHEN NOT asked THEN -1.0 ELSE coalesce(s, 5.0) / 10 * 2 - 1 END AS DOUBLE) AS reward FROM item LEFT JOIN judged USING (i)""")
def score_by_index(spark, d):
    """Judges' scores written back by item: items without a prompt keep 0 and -1, unreadable scores count as 5."""
    rows = read_table(spark, d, "eval_sft")
    items = rows.select("eval_id", (F.col("trace").isNotNull() & (F.coalesce("question", F.lit("")) != "")).alias("asked"))
    judged = rows.where("claude_feasibility >= 0").select("eval_id", F.col("claude_feasibility").alias("score"))
    return records.scores_by_index(items, judged, "eval_id")


@query("difficulty_cross", "SELECT DISTINCT e.output AS target, r.d AS difficulty FROM hyperedges e CROSS JOIN (SELECT unnest(range(1, 11)) AS d) r")
def difficulty_cross(spark, d):
    return read_table(spark, d, "hyperedges").select(F.col("output").alias("target")).distinct().select("target", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("difficulty"))


@query("domain_compat_check", """
WITH s AS (SELECT record_id, unnest(trace.path) AS e FROM dataset), m AS (SELECT record_id, e.output AS v, e.domain AS p FROM s), u AS (SELECT record_id, unnest(e.inputs) AS v, e.domain AS c FROM s)
SELECT DISTINCT record_id AS trace FROM m JOIN u USING (record_id, v) WHERE p <> c AND NOT (p = 'pump_hydraulics' AND c = 'belt_drives')""")
def domain_compat_check(spark, d):
    steps = _data(spark, d).select(F.col("record_id").alias("trace"), F.explode("trace.path").alias("e")).select("trace", "e.output", "e.inputs", "e.domain")
    allowed = spark.createDataFrame([("pump_hydraulics", "belt_drives")], "producer string, consumer string")
    return records.incompatible_steps(steps, allowed)


@query("expected_vars_union", """
SELECT record_id, array_to_string(list_sort(list_distinct(list_filter(flatten([list_concat(coalesce(trace.leafs, []), [trace.target]), flatten(list_transform(coalesce(trace.path, []), lambda e: list_concat(coalesce(e.inputs, []), [e.output])))]), lambda x: x IS NOT NULL))), ' ') AS expected FROM dataset WHERE trace IS NOT NULL""")
def expected_vars_union(spark, d):
    names = F.flatten(F.transform(F.coalesce("trace.path", F.array()), lambda e: F.array_append(F.coalesce(e["inputs"], F.array().cast("array<string>")), e["output"])))
    every = F.array_union(F.array_append(F.coalesce("trace.leafs", F.array().cast("array<string>")), F.col("trace.target")), names)
    return _data(spark, d).where("trace is not null").select("record_id", F.array_join(F.array_sort(F.array_compact(F.array_distinct(every))), " ").alias("expected"))


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda t: length(t) > 2))"


@query("distractor_set", f"""
WITH vocabulary AS (SELECT DISTINCT unnest({_WORDS.format('variable')}) AS w FROM hypernyms),
t AS (SELECT record_id, unnest({_WORDS.format('question')}) AS w FROM dataset WHERE question IS NOT NULL AND trace IS NOT NULL),
e AS (SELECT record_id, unnest({_WORDS.format("concat_ws(' ', trace.target, array_to_string(trace.leafs, ' '), array_to_string(list_transform(trace.path, lambda p: p.output || ' ' || array_to_string(p.inputs, ' ')), ' '))")}) AS w FROM dataset WHERE trace IS NOT NULL)
SELECT record_id, count(*) AS distractors FROM t JOIN vocabulary USING (w) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.record_id = t.record_id AND e.w = t.w) GROUP BY record_id""")
def distractor_set(spark, d):
    from hyperloom.operators.metrics import with_distractors

    rows = with_distractors(_data(spark, d).where("question is not null and trace is not null"), read_table(spark, d, "hypernyms"))
    return rows.where("size(distractors) > 0").select("record_id", F.size("distractors").cast("long").alias("distractors"))


@query("set_diff_leaves", """
SELECT record_id, array_to_string(list_sort(list_filter(list_distinct(flatten(list_transform(trace.path, lambda e: e.inputs))), lambda x: NOT list_contains(list_transform(trace.path, lambda e: e.output), x) AND x <> trace.target)), ' ') AS leaves
FROM dataset WHERE len(trace.path) > 0 AND trace.target IS NOT NULL""")
def set_diff_leaves(spark, d):
    used = F.array_distinct(F.flatten(F.transform("trace.path", lambda e: e["inputs"])))
    made = F.array_append(F.transform("trace.path", lambda e: e["output"]), F.col("trace.target"))
    return _data(spark, d).where("size(trace.path) > 0 and trace.target is not null").select("record_id", F.array_join(F.array_sort(F.array_except(used, made)), " ").alias("leaves"))


@query("union_nodes", "SELECT output AS node FROM hyperedges UNION SELECT unnest(inputs) FROM hyperedges")
def union_nodes(spark, d):
    e = read_table(spark, d, "hyperedges")
    return e.select(F.col("output").alias("node")).union(e.select(F.explode("inputs"))).distinct()


# --- reward algebra -------------------------------------------------------------------------------------------------

_R = {
    "faith": "(coalesce(f.variable_coverage, 0) + 0.5 * coalesce(CAST(f.target_present AS INT), 0) + 0.5 * coalesce(CAST(f.faithful AS INT), 0))",
    "feas": "(CASE WHEN claude_feasibility BETWEEN 1 AND 10 THEN (claude_feasibility - 1) * 2.0 / 9 ELSE 0 END)",
    "diff": "(CASE WHEN requested_difficulty BETWEEN 1 AND 10 AND claude_difficulty BETWEEN 1 AND 10 THEN greatest(0.0, 2 * (1 - abs(requested_difficulty - claude_difficulty) / 9.0)) ELSE 0 END)",
}
_FROM = "FROM (SELECT *, claude_faithfulness AS f FROM dataset)"


def _sql(expr: str, name: str) -> str:
    return f"SELECT record_id, CAST({expr} AS DOUBLE) AS {name} {_FROM}"


def _faith():
    f = F.col("claude_faithfulness")
    return rewards.faithfulness_raw(f["variable_coverage"], f["target_present"], f["faithful"])


def _feas():
    return rewards.feasibility_raw(F.col("claude_feasibility"))


def _diff():
    return rewards.difficulty_raw(F.col("requested_difficulty"), F.col("claude_difficulty"))


@query("faith_raw", _sql(_R["faith"], "reward"))
def faith_raw(spark, d):
    return _data(spark, d).select("record_id", _faith().alias("reward"))


@query("feas_raw", _sql(_R["feas"], "reward"))
def feas_raw(spark, d):
    return _data(spark, d).select("record_id", _feas().alias("reward"))


@query("diff_align_raw", _sql(_R["diff"], "reward"))
def diff_align_raw(spark, d):
    return _data(spark, d).select("record_id", _diff().alias("reward"))


@query("scaled_reward", _sql(f"greatest(-1.0, least(1.0, {_R['faith']} - 1))", "reward"))
def scaled_reward(spark, d):
    return _data(spark, d).select("record_id", rewards.scaled(_faith()).alias("reward"))


@query("combined_raw", _sql(f"({_R['faith']} * 0.7 + {_R['feas']} * 0.5) / 1.2", "reward"))
def combined_raw(spark, d):
    return _data(spark, d).select("record_id", rewards.combined([_faith(), _feas()], [F.lit(0.7), F.lit(0.5)]).alias("reward"))


_ACTIVE = "CASE WHEN reward_kind = 'alternating' THEN CASE WHEN CAST(floor((greatest(1, step) - 1) / CAST(greatest(1, coalesce(reward_switch_steps, 1)) AS DOUBLE)) AS BIGINT) % 2 = 0 THEN 'faithfulness' ELSE 'feasibility' END ELSE reward_kind END"
#: Components of the adaptive reward: one mean a step for each signal that is logged, null where a step has none.
COMPONENTS_SQL = f"""(SELECT 'log' AS run, step, avg(mean_reward_raw) FILTER (a = 'faithfulness') AS f, avg(mean_reward_raw) FILTER (a = 'feasibility') AS e, avg(mean_reward_raw) FILTER (a = 'combined') AS d
  FROM (SELECT DISTINCT run_id, step, mean_reward_raw, {_ACTIVE} AS a FROM rl_steps WHERE step IS NOT NULL) GROUP BY step)"""
ADAPTIVE_SQL = f"""s AS (SELECT *, row_number() OVER (ORDER BY step) AS k FROM {COMPONENTS_SQL}),
r AS (SELECT step, f, e, d, k, CAST(1.0 AS DOUBLE) AS ef, CAST(1.0 AS DOUBLE) AS ee, CAST(1.0 AS DOUBLE) AS ed FROM s WHERE k = 1
  UNION ALL SELECT s.step, s.f, s.e, s.d, s.k, coalesce(0.9 * r.ef + 0.1 * r.f, r.ef), coalesce(0.9 * r.ee + 0.1 * r.e, r.ee), coalesce(0.9 * r.ed + 0.1 * r.d, r.ed) FROM r JOIN s ON s.k = r.k + 1),
w AS (SELECT *, 1 / (ef + 0.001) AS wf, 1 / (ee + 0.001) AS we, 1 / (ed + 0.001) AS wd FROM r)"""


def components(spark, d):
    """(run, step, f, e, d): the mean raw reward of each logged signal at each step."""
    rows = read_table(spark, d, "rl_steps").where("step is not null")
    rows = rows.select("run_id", "step", "mean_reward_raw", rewards.active_reward(F.col("reward_kind"), F.col("step"), F.col("reward_switch_steps")).alias("a")).distinct()
    own = lambda kind, name: F.avg(F.when(F.col("a") == kind, F.col("mean_reward_raw"))).alias(name)
    return rows.groupBy("step").agg(own("faithfulness", "f"), own("feasibility", "e"), own("combined", "d")).select(F.lit("log").alias("run"), "step", "f", "e", "d")


def adaptive(spark, d):
    """The components with their running means and weights before each step."""
    from hyperloom.operators.ordered import ema

    rows = components(spark, d)
    means = ema(rows, "run", "step", ["f", "e", "d"])
    weights = rewards.inverse_weights([F.col(f"ema_{c}") for c in "fed"])
    return rows.join(means, ["run", "step"]).withColumns({f"w{c}": w for c, w in zip("fed", weights)})


@query("adaptive_weights", f"WITH RECURSIVE {ADAPTIVE_SQL} SELECT step, wf / (wf + we + wd) AS faithfulness, we / (wf + we + wd) AS feasibility, wd / (wf + we + wd) AS difficulty FROM w")
def adaptive_weights(spark, d):
    """Weights in inverse proportion to the running means of the three signals, before each step."""
    return adaptive(spark, d).select("step", F.col("wf").alias("faithfulness"), F.col("we").alias("feasibility"), F.col("wd").alias("difficulty"))


@query("triple_raw", _sql(f"({_R['faith']} * 1 + {_R['feas']} * 2 + {_R['diff']} * 3) / 6", "reward"))
def triple_raw(spark, d):
    return _data(spark, d).select("record_id", rewards.combined([_faith(), _feas(), _diff()], [F.lit(1.0), F.lit(2.0), F.lit(3.0)]).alias("reward"))


@query("reward_switch", f"""
WITH s AS (SELECT DISTINCT run_id, step, {_ACTIVE} AS active FROM rl_steps WHERE step IS NOT NULL AND reward_kind IS NOT NULL),
v AS (SELECT record_id, {_R['faith']} AS a, {_R['feas']} AS b {_FROM})
SELECT run_id, step, active, CAST(CASE active WHEN 'faithfulness' THEN a WHEN 'feasibility' THEN b ELSE (a * 0.5 + b * 0.5) / 1.0 END AS DOUBLE) AS reward FROM s JOIN v ON v.record_id = s.step""")
def reward_switch(spark, d):
    """The raw reward of the rollout of each step (the record of that number) under the signal active at it."""
    rows = read_table(spark, d, "rl_steps").where("step is not null and reward_kind is not null")
    steps = rows.select("run_id", "step", rewards.active_reward(F.col("reward_kind"), F.col("step"), F.col("reward_switch_steps")).alias("active")).distinct()
    own = _data(spark, d).select(F.col("record_id").alias("step"), _faith().alias("a"), _feas().alias("b"))
    return steps.join(own, "step").select("run_id", "step", "active", rewards.switched(F.col("active"), F.col("a"), F.col("b"), 0.5, 0.5).alias("reward"))


@query("empty_rollout_default", "SELECT run_id, step, coalesce(mean_reward_raw, 0.0) AS raw, coalesce(mean_reward_scaled, -1.0) AS scaled, count(*) AS n FROM rl_steps GROUP BY ALL")
def empty_rollout_default(spark, d):
    return read_table(spark, d, "rl_steps").groupBy("run_id", "step", F.coalesce("mean_reward_raw", F.lit(0.0)).alias("raw"), F.coalesce("mean_reward_scaled", F.lit(-1.0)).alias("scaled")).agg(F.count(F.lit(1)).alias("n"))


@query("judge_reward", "SELECT eval_id, CAST(greatest(0.0, least(10.0, coalesce(claude_feasibility, 5.0))) / 10 * 2 - 1 AS DOUBLE) AS reward FROM eval_sft")
def judge_reward(spark, d):
    return read_table(spark, d, "eval_sft").select("eval_id", rewards.judge_reward(F.col("claude_feasibility")).alias("reward"))


@query("faith_reward_1_10", "SELECT eval_id, CAST((greatest(1.0, least(10.0, claude_feasibility)) - 1) / 9.0 * 2 - 1 AS DOUBLE) AS reward FROM eval_sft WHERE claude_feasibility IS NOT NULL")
def faith_reward_1_10(spark, d):
    return read_table(spark, d, "eval_sft").where("claude_feasibility is not null").select("eval_id", rewards.faithfulness_reward(F.col("claude_feasibility")).alias("reward"))


@query("length_reward", "SELECT record_id, len(trace.path) / CAST((SELECT max(len(trace.path)) FROM dataset) AS DOUBLE) * 2 - 1 AS reward FROM dataset WHERE trace.path IS NOT NULL")
def length_reward(spark, d):
    rows = _data(spark, d).where("trace.path is not null").select("record_id", F.size("trace.path").alias("n"))
    return rows.withColumn("most", rows.agg(F.max("n")).scalar()).select("record_id", rewards.length_reward(F.col("n"), F.col("most")).alias("reward"))


@query("token_budget", "SELECT record_id, 256 + 64 * greatest(0, requested_difficulty - 3) + CASE WHEN chain_of_thought IS NOT NULL THEN 512 ELSE 0 END AS budget FROM dataset WHERE requested_difficulty IS NOT NULL")
def token_budget(spark, d):
    return _data(spark, d).where("requested_difficulty is not null").select("record_id", rewards.token_budget(F.col("requested_difficulty"), 256, 64, F.col("chain_of_thought").isNotNull()).alias("budget"))


@query("gen_token_budget", "SELECT failure_kind, attempt, least(2048 + 700 * CAST(chain_of_thought IS NOT NULL AS INT) + 600 * attempt, 16384) AS budget, count(*) AS n FROM dataset_failed WHERE attempt IS NOT NULL GROUP BY ALL")
def gen_token_budget(spark, d):
    rows = read_table(spark, d, "dataset_failed").where("attempt is not null")
    return rows.groupBy("failure_kind", "attempt", F.least(2048 + 700 * F.col("chain_of_thought").isNotNull().cast("int") + 600 * F.col("attempt"), F.lit(16384)).alias("budget")).agg(F.count(F.lit(1)).alias("n"))


@query("uniform_value", f"SELECT variable, (100 + {text_hash_sql('variable', seed=42)} // 8 % 9901) / 100.0 AS value FROM hypernyms")
def uniform_value(spark, d):
    """A value of 1..100 for every variable, in cents, from a hash of its name (the same on every run)."""
    cents = 100 + F.shiftright(text_hash("variable", seed=42), 3) % 9901
    return read_table(spark, d, "hypernyms").select("variable", (cents / F.lit(100.0)).alias("value"))


#: Longest example that is trained on, as in the reference.
MAX_LEN = 2048


@query("encode_mask")
def encode_mask(spark, d):
    """Token ids and labels of every example; ids by a public tokenizer have no counterpart in SQL."""
    from hyperloom.functions.tokens import encoded

    rows = encoded(_data(spark, d).where("trace_str is not null and question is not null").select("record_id", "trace_str", "question"), "record_id", ["trace_str", "question"])
    rows = rows.select("record_id", rewards.loss_mask(F.col("trace_str"), F.col("question"), MAX_LEN).alias("m"))
    own = F.filter("m.labels", lambda x: x >= 0)
    return rows.select("record_id", F.size("m.input_ids").cast("long").alias("n"), F.size(own).cast("long").alias("trained"), F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x).alias("kept"))


@query("collate_pad", """
SELECT record_id, max(len(trace.leafs)) OVER (PARTITION BY requested_difficulty) AS width, max(len(trace.leafs)) OVER (PARTITION BY requested_difficulty) - len(trace.leafs) AS padded FROM dataset WHERE trace.leafs IS NOT NULL""")
def collate_pad(spark, d):
    rows = _data(spark, d).where("trace.leafs is not null").select("record_id", "requested_difficulty", F.transform("trace.leafs", lambda _: F.lit(1)).alias("ids"))
    width = rows.groupBy("requested_difficulty").agg(F.max(F.size("ids")).alias("width"))  # aggregated, so a hot batch key is not windowed
    joined = rows.alias("r").join(F.broadcast(width).alias("w"), F.col("r.requested_difficulty").eqNullSafe(F.col("w.requested_difficulty")))
    padded = joined.select("record_id", F.col("width").cast("long").alias("width"), rewards.right_pad(F.col("ids"), F.col("width"), 0).alias("ids"))
    return padded.select("record_id", "width", F.size(F.filter("ids", lambda x: x == 0)).cast("long").alias("padded"))


@query("logprob_sum", "SELECT run_id, step, sum(coalesce(list_sum(reward_raw[greatest(0, 2) + 1:]), 0)) AS tail FROM (SELECT DISTINCT run_id, step, reward_raw FROM rl_steps) WHERE reward_raw IS NOT NULL GROUP BY run_id, step")
def logprob_sum(spark, d):
    rows = read_table(spark, d, "rl_steps").select("run_id", "step", "reward_raw").distinct().where("reward_raw is not null")
    return rows.groupBy("run_id", "step").agg(F.sum(rewards.tail_sum(F.col("reward_raw"), F.lit(3))).alias("tail"))


@query("pg_loss", """
WITH r AS (SELECT DISTINCT run_id, step, kl_beta, mean_kl_sample, rewards FROM rl_steps WHERE rewards IS NOT NULL),
e AS (SELECT run_id, step, coalesce(kl_beta, 0) AS b, coalesce(mean_kl_sample, 0) AS k, unnest(rewards) AS x FROM r),
a AS (SELECT *, CASE WHEN stddev_pop(x) OVER w < 1e-8 THEN 0 ELSE x - avg(x) OVER w END AS adv FROM e WINDOW w AS (PARTITION BY run_id, step))
SELECT run_id, avg(l) AS loss FROM (SELECT run_id, step, avg(-adv * x + b * k) AS l FROM a WHERE b <> 0 OR abs(adv) >= 1e-12 GROUP BY run_id, step) GROUP BY run_id""")
def pg_loss(spark, d):
    from hyperloom.operators.ordered import group_advantage

    r = read_table(spark, d, "rl_steps").where("rewards is not null").select("run_id", "step", "kl_beta", "mean_kl_sample", "rewards").distinct()
    e = r.select("run_id", "step", F.coalesce("kl_beta", F.lit(0.0)).alias("b"), F.coalesce("mean_kl_sample", F.lit(0.0)).alias("k"), F.explode("rewards").alias("x"))
    a = group_advantage(e, ["run_id", "step"], "x").where((F.col("b") != 0) | (F.abs("advantage") >= 1e-12))
    per_step = a.groupBy("run_id", "step").agg(F.avg(-F.col("advantage") * F.col("x") + F.col("b") * F.col("k")).alias("l"))
    return per_step.groupBy("run_id").agg(F.avg("l").alias("loss"))


@query("mean_reward_weighted", """
SELECT requested_difficulty, avg(0.75 * (greatest(0.0, least(10.0, coalesce(claude_feasibility, 5.0))) / 10 * 2 - 1) + 0.25 * coalesce(claude_faithfulness.variable_coverage, 0)) AS reward FROM dataset GROUP BY 1""")
def mean_reward_weighted(spark, d):
    both = rewards.combined([rewards.judge_reward(F.col("claude_feasibility")), F.coalesce("claude_faithfulness.variable_coverage", F.lit(0.0))], [F.lit(3.0), F.lit(1.0)])
    return _data(spark, d).groupBy("requested_difficulty").agg(F.avg(both).alias("reward"))


@query("memory_budget", """
SELECT g AS gib, c AS copies, greatest(1, CAST(floor(g * 0.85 / c) AS BIGINT)) AS budget FROM (SELECT unnest([1, 8, 24, 80]) AS g) CROSS JOIN (SELECT unnest([1, 2]) AS c)""")
def memory_budget(spark, d):
    """GiB that each copy of a model may use on devices of several sizes."""
    devices = spark.createDataFrame([(g, c) for g in (1, 8, 24, 80) for c in (1, 2)], "gib int, copies int")
    return devices.select("gib", "copies", rewards.memory_budget(F.col("gib").cast("long") * (1 << 30), 0.85, F.col("copies")).alias("budget"))
