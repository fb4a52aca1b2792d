"""String and parsing operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyperloom.dist import read_table
from hyperloom.functions import parse, text
from hyperloom.operators import scoring
from hyperloom.plans.registry import query


@query("tokens", """SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))), ' ') AS tokens FROM documents WHERE text IS NOT NULL""")
def tokens(spark, d):
    docs = read_table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(F.array_sort(text.tokens(F.col("text"))), " ").alias("tokens"))


@query("variable_keywords", """SELECT variable, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(variable), '[a-z]+'), lambda t: length(t) > 2))), ' ') AS keywords FROM hypernyms""")
def variable_keywords(spark, d):
    return read_table(spark, d, "hypernyms").select("variable", F.array_join(F.array_sort(text.keywords(F.col("variable"))), " ").alias("keywords"))


@query("word_count", r"""SELECT record_id, len(list_filter(string_split_regex(question, '[\s\p{Z}]+'), lambda w: w <> '')) AS words FROM dataset""")
def word_count(spark, d):
    return read_table(spark, d, "dataset").select("record_id", text.word_count(F.col("question")).cast("long").alias("words"))


@query("strip_reasoning", r"""SELECT record_id, regexp_replace(regexp_replace(coalesce(chain_of_thought, ''), '(?is)^(.*?)<reasoning>.*?</reasoning>', '\1'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS rest FROM dataset""")
def strip_reasoning(spark, d):
    return read_table(spark, d, "dataset").select("record_id", text.strip_reasoning(F.col("chain_of_thought")).alias("rest"))


@query("extract_reasoning", r"""SELECT record_id, regexp_extract(coalesce(chain_of_thought, ''), '(?is)<reasoning>\s*(.*?)\s*</reasoning>', 1) AS reasoning FROM dataset""")
def extract_reasoning(spark, d):
    return read_table(spark, d, "dataset").select("record_id", text.reasoning(F.col("chain_of_thought")).alias("reasoning"))


@query("strip_code_fence", r"""SELECT eval_id, regexp_replace(regexp_replace(regexp_replace(question, '^[\s]+|[\s]+$', '', 'g'), '(?i)^```(?:json)?\s*', ''), '\s*```$', '') AS body FROM eval_sft WHERE question LIKE '%```%'""")
def strip_code_fence(spark, d):
    return read_table(spark, d, "eval_sft").where(F.col("question").contains("```")).select("eval_id", text.strip_code_fence(F.col("question")).alias("body"))


_WS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


@query("clean_decoded_text", rf"""
WITH a AS (SELECT failure_kind, attempt, failed_at, split_part(raw_generation, '<|eot_id|>', 1) AS x FROM dataset_failed WHERE raw_generation IS NOT NULL),
b AS (SELECT * REPLACE (split_part(split_part(x, '<|end_header_id|>', -1), '<|begin_of_text|>', -1) AS x) FROM a),
c AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '{_WS}', '', 'g'), '\\\(|\\\)', '', 'g'), '\\text\{{([^}}]+)\}}', '\1', 'g'), '\\[a-zA-Z]+\{{([^}}]+)\}}', '\1', 'g'), '\\[a-zA-Z]+', '', 'g') AS x) FROM b),
e AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[{{}}]', '', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '#+[\s\p{{Z}}]*', '', 'g') AS x) FROM c)
SELECT failure_kind, attempt, failed_at, regexp_replace(regexp_replace(regexp_replace(x, '\\+([a-zA-Z0-9/])', '\\\1', 'g'), '\\+([^a-zA-Z0-9/\\]|$)', '\1', 'g'), '{_WS}', '', 'g') AS cleaned FROM e""")
def clean_decoded_text(spark, d):
    """Generations as decoded text."""
    return read_table(spark, d, "dataset_failed").where("raw_generation is not null").select("failure_kind", "attempt", "failed_at", text.clean_generation(F.col("raw_generation")).alias("cleaned"))


@query("extract_question", r"""
WITH q AS (SELECT doc_id, text, instr(text, '?') AS p FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, text, p, regexp_replace(substr(text, 1, p + 49), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS head FROM q)
SELECT doc_id, CASE WHEN p = 0 THEN text ELSE regexp_replace(substr(head, 1, length(head) - instr(reverse(head), '?') + 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') END AS question FROM h""")
def extract_question(spark, d):
    docs = read_table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", text.first_question(F.col("text")).alias("question"))


@query("page_summary", """
SELECT record_id, target, requested_difficulty, coalesce(trace.chapters[1], '') AS chapter,
       translate(left(question, 100), chr(10), ' ') || CASE WHEN length(question) > 100 THEN '…' ELSE '' END AS preview,
       coalesce(length(chain_of_thought), 0) AS reasoning_chars
FROM dataset WHERE question IS NOT NULL""")
def page_summary(spark, d):
    rows = read_table(spark, d, "dataset").where("question is not null")
    return rows.select("record_id", "target", "requested_difficulty", F.coalesce(F.get("trace.chapters", F.lit(0)), F.lit("")).alias("chapter"), text.preview(F.col("question")).alias("preview"), F.coalesce(F.length("chain_of_thought"), F.lit(0)).cast("long").alias("reasoning_chars"))


@query("truncate_log", "SELECT failure_kind, attempt, left(raw_generation, 8000) AS raw, count(*) AS n FROM dataset_failed GROUP BY ALL")
def truncate_log(spark, d):
    return read_table(spark, d, "dataset_failed").groupBy("failure_kind", "attempt", F.left("raw_generation", F.lit(8000)).alias("raw")).agg(F.count(F.lit(1)).alias("n"))


@query("format_trace", """
SELECT record_id, array_to_string(list_transform(range(1, len(trace.path) + 1),
  lambda i: '  ' || i || '. ' || trace.path[i].output || ' = ' || trace.path[i].label || '  [uses: ' || array_to_string(trace.path[i].inputs, ', ') || ']  (' || trace.path[i].domain || ')'), chr(10)) AS lines
FROM dataset WHERE len(trace.path) > 0""")
def format_trace(spark, d):
    return read_table(spark, d, "dataset").where(F.size("trace.path") > 0).select("record_id", text.numbered_trace(F.col("trace.path")).alias("lines"))


@query("calc_steps_text", """
SELECT record_id, array_to_string(list_transform(range(1, len(trace.path) + 1),
  lambda i: i || ') ' || trace.path[i].output || ' from ' || array_to_string(trace.path[i].inputs, ', ') || ' by ' || trace.path[i].label), chr(10)) AS steps
FROM dataset WHERE len(trace.path) > 0""")
def calc_steps_text(spark, d):
    line = lambda e, i: F.format_string("%d) %s from %s by %s", i + 1, e["output"], F.array_join(e["inputs"], ", "), e["label"])
    return read_table(spark, d, "dataset").where(F.size("trace.path") > 0).select("record_id", F.array_join(F.transform("trace.path", line), "\n").alias("steps"))


@query("solution_trace_format", """
SELECT record_id, array_to_string(list_sort(list_filter(trace.leafs, lambda x: x IS NOT NULL)), '; ') AS given,
       array_to_string(list_transform(trace.path, lambda e: e.id || ':' || e.output), ' > ') AS steps
FROM dataset WHERE trace IS NOT NULL AND len(trace.path) > 0 AND trace.leafs IS NOT NULL""")
def solution_trace_format(spark, d):
    rows = read_table(spark, d, "dataset").where("size(trace.path) > 0 and trace.leafs is not null")
    return rows.select("record_id", F.array_join(F.array_sort(F.array_compact("trace.leafs")), "; ").alias("given"), F.array_join(F.transform("trace.path", lambda e: F.concat(e["id"], F.lit(":"), e["output"])), " > ").alias("steps"))


@query("si_unit_lookup", """
SELECT h.variable, coalesce(max(e.output_unit), '') AS unit FROM hypernyms h LEFT JOIN hyperedges e ON e.output = h.variable GROUP BY h.variable""")
def si_unit_lookup(spark, d):
    units = read_table(spark, d, "hyperedges").groupBy(F.col("output").alias("variable")).agg(F.max("output_unit").alias("unit"))
    names = read_table(spark, d, "hypernyms").select("variable").distinct()
    return names.join(units, "variable", "left").select("variable", F.coalesce("unit", F.lit("")).alias("unit"))


@query("leaf_hits_sorted", """
SELECT record_id, coalesce(array_to_string(list_sort(list_transform(map_entries(claude_faithfulness.leaf_hits), lambda e: e.key || '=' || CASE WHEN e.value THEN 'true' ELSE 'false' END)), ', '), '') AS hits FROM dataset""")
def leaf_hits_sorted(spark, d):
    entries = F.map_entries("claude_faithfulness.leaf_hits")
    return read_table(spark, d, "dataset").select("record_id", F.coalesce(F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ", "), F.lit("")).alias("hits"))


@query("stats_table_text", """
SELECT requested_difficulty, lpad(CAST(requested_difficulty AS VARCHAR), 6, ' ') || ' ' || lpad(CAST(count(*) AS VARCHAR), 8, ' ') || ' ' || lpad(CAST(max(claude_feasibility) AS VARCHAR), 6, ' ') AS line
FROM eval_sft WHERE requested_difficulty IS NOT NULL AND claude_feasibility IS NOT NULL GROUP BY requested_difficulty""")
def stats_table_text(spark, d):
    rows = read_table(spark, d, "eval_sft").where("requested_difficulty is not null and claude_feasibility is not null")
    stats = rows.groupBy("requested_difficulty").agg(F.count(F.lit(1)).alias("n"), F.max("claude_feasibility").alias("most"))
    return stats.select("requested_difficulty", F.format_string("%6d %8d %6d", "requested_difficulty", "n", "most").alias("line"))


@query("chat_messages", """
SELECT record_id, CASE WHEN trim(question) = '' THEN 2 ELSE 3 END AS messages, 'Write one problem.' || chr(10) || chr(10) || 'User: ' || trace_str || chr(10) || chr(10) || 'Assistant: ' || question AS text
FROM dataset WHERE question IS NOT NULL AND trace_str IS NOT NULL""")
def chat_messages(spark, d):
    rows = read_table(spark, d, "dataset").where("question is not null and trace_str is not null")
    system = F.lit("Write one problem.")
    return rows.select("record_id", F.size(text.chat_messages(system, F.col("trace_str"), F.col("question"))).alias("messages"), text.chat_text(system, F.col("trace_str"), F.col("question")).alias("text"))


@query("supervised_text", r"""
SELECT record_id, trace_str || chr(10) || 'Question:' || chr(10) AS prefix,
       CASE WHEN regexp_matches(chain_of_thought, '[^\s\p{Z}]') THEN '<reasoning>' || chr(10) || chain_of_thought || chr(10) || '</reasoning>' || chr(10) || chr(10) ELSE '' END || question || '<eos>' AS completion
FROM dataset WHERE question IS NOT NULL AND trace_str IS NOT NULL""")
def supervised_text(spark, d):
    rows = read_table(spark, d, "dataset").where("question is not null and trace_str is not null")
    thought = F.when(text.non_blank(F.col("chain_of_thought")).isNotNull(), F.concat(F.lit("<reasoning>\n"), "chain_of_thought", F.lit("\n</reasoning>\n\n"))).otherwise("")
    return rows.select("record_id", F.concat("trace_str", F.lit("\nQuestion:\n")).alias("prefix"), F.concat(thought, "question", F.lit("<eos>")).alias("completion"))


@query("build_prompt", """
SELECT record_id, 'Target: ' || trace.target || chr(10) || 'Given: ' || coalesce(nullif(array_to_string(list_filter(trace.leafs, lambda x: x IS NOT NULL), ', '), ''), '(none)') || chr(10) || 'Domain: ' || coalesce(nullif(domain, ''), '(unspecified)') || chr(10) || 'Difficulty: ' || requested_difficulty AS prompt
FROM dataset WHERE trace.target IS NOT NULL AND requested_difficulty IS NOT NULL""")
def build_prompt(spark, d):
    rows = read_table(spark, d, "dataset").where("trace.target is not null and requested_difficulty is not null")
    given = F.coalesce(F.nullif(F.array_join(F.array_compact("trace.leafs"), ", "), F.lit("")), F.lit("(none)"))
    domain = F.coalesce(F.nullif("domain", F.lit("")), F.lit("(unspecified)"))
    return rows.select("record_id", F.concat(F.lit("Target: "), F.col("trace.target"), F.lit("\nGiven: "), given, F.lit("\nDomain: "), domain, F.lit("\nDifficulty: "), F.col("requested_difficulty").cast("string")).alias("prompt"))


@query("faithfulness_principle", """
SELECT record_id, greatest(1, CAST(floor(0.8 * len(trace.leafs)) AS BIGINT)) AS most, greatest(1, CAST(floor(0.5 * len(trace.leafs)) AS BIGINT)) AS half FROM dataset WHERE trace.leafs IS NOT NULL""")
def faithfulness_principle(spark, d):
    n = F.size("trace.leafs")
    share = lambda x: F.greatest(F.lit(1).cast("long"), F.floor(F.lit(x) * n))
    return read_table(spark, d, "dataset").where("trace.leafs is not null").select("record_id", share(0.8).alias("most"), share(0.5).alias("half"))


@query("reward_candidates", """
SELECT e.eval_id, v.rank, CASE v.rank WHEN 1 THEN e.trace_str || chr(10) || 'Find ' || e.target || '.' WHEN 2 THEN 'Find ' || e.target || '.' ELSE 'No question.' END AS candidate
FROM eval_sft e CROSS JOIN (VALUES (1), (2), (3)) v(rank) WHERE e.trace_str IS NOT NULL AND e.target IS NOT NULL""")
def reward_candidates(spark, d):
    rows = read_table(spark, d, "eval_sft").where("trace_str is not null and target is not null")
    ask = F.concat(F.lit("Find "), "target", F.lit("."))
    ranked = rows.select("eval_id", F.posexplode(F.array(F.concat("trace_str", F.lit("\n"), ask), ask, F.lit("No question."))).alias("rank", "candidate"))
    return ranked.withColumn("rank", F.col("rank") + 1)


@query("extract_llm_text", r"""
SELECT record_id, regexp_replace(CASE WHEN regexp_matches(chain_of_thought, '[^\s\p{Z}]') THEN chain_of_thought ELSE question END, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text FROM dataset WHERE question IS NOT NULL""")
def extract_llm_text(spark, d):
    rows = read_table(spark, d, "dataset").where("question is not null")
    return rows.select("record_id", text.first_text_block(F.array("chain_of_thought", "question")).alias("text"))


@query("model_family_flag", "SELECT DISTINCT llm_model, regexp_matches(lower(trim(llm_model)), '^(gpt-5|o1|o3|o4)') AS completion_budget FROM rl_steps")
def model_family_flag(spark, d):
    return read_table(spark, d, "rl_steps").select("llm_model", text.prefers_completion_budget(F.col("llm_model")).alias("completion_budget")).distinct()


@query("formula_deps", r"""
SELECT id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(label, '\b[a-zA-Z_][a-zA-Z0-9_]*\b')), lambda x: x NOT IN
  ('math','abs','sqrt','sin','cos','tan','exp','log','log10','pi','e','and','or','not','if','else','for','while','def','import','from','as','in','is','None','True','False'))), ' ') AS names FROM hyperedges""")
def formula_deps(spark, d):
    return read_table(spark, d, "hyperedges").select("id", F.array_join(F.array_sort(text.formula_names(F.col("label"))), " ").alias("names"))


@query("parse_score", r"""
SELECT eval_id, coalesce(list_filter(list_transform(string_split_regex(replace(coalesce(question, ''), ',', ' '), '\s+'), lambda w: TRY_CAST(CASE WHEN regexp_full_match(trim(w, '().:/'), '[+-]?[0-9]{1,9}') THEN trim(w, '().:/') END AS INTEGER)), lambda n: n BETWEEN 1 AND 10)[1], -1) AS score FROM eval_sft""")
def parse_score(spark, d):
    return read_table(spark, d, "eval_sft").select("eval_id", parse.parse_score(F.col("question")).alias("score"))


@query("parse_faith_json", """
SELECT record_id, coalesce(claude_faithfulness.target_present, false) AS target_present, coalesce(len(list_filter(map_values(claude_faithfulness.leaf_hits), lambda h: coalesce(h, false))), 0) AS hits FROM dataset WHERE claude_faithfulness IS NOT NULL""")
def parse_faith_json(spark, d):
    """Verdicts as judges write them, in a fence and with prose after it, true and false in other values' clothes, read back."""
    rows = read_table(spark, d, "dataset").where("claude_faithfulness is not null")
    hits = F.array_join(F.transform(F.map_entries("claude_faithfulness.leaf_hits"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), F.when(e["value"], '"no"').otherwise("0"))), ", ")
    said = F.concat(F.lit('```json\n{"leaf_hits": {'), F.coalesce(hits, F.lit("")), F.lit('}, "target_present": '), F.when(F.col("claude_faithfulness.target_present"), '["x"]').otherwise("null"), F.lit("}\n``` that is {all}"))
    read = rows.select("record_id", parse.parse_verdict(said, F.map_keys("claude_faithfulness.leaf_hits")).alias("v"))
    return read.select("record_id", F.col("v.target_present"), F.size(F.filter(F.map_values("v.leaf_hits"), lambda h: h)).cast("long").alias("hits"))


@query("judge_faithfulness_algebra", """
SELECT record_id, CAST(len(list_filter(map_values(claude_faithfulness.leaf_hits), lambda h: h)) AS DOUBLE) / greatest(cardinality(claude_faithfulness.leaf_hits), 1) AS coverage,
       claude_faithfulness.target_present AND CAST(len(list_filter(map_values(claude_faithfulness.leaf_hits), lambda h: h)) AS DOUBLE) / greatest(cardinality(claude_faithfulness.leaf_hits), 1) >= 1 AS faithful
FROM dataset WHERE claude_faithfulness.leaf_hits IS NOT NULL""")
def judge_faithfulness_algebra(spark, d):
    rows = read_table(spark, d, "dataset").where("claude_faithfulness.leaf_hits is not null")
    v = parse.verdict(F.col("claude_faithfulness.leaf_hits"), F.col("claude_faithfulness.target_present"), F.map_keys("claude_faithfulness.leaf_hits"))
    return rows.select("record_id", v["variable_coverage"].alias("coverage"), v["faithful"].alias("faithful"))


@query("parse_question_list")
def parse_question_list(spark, d):
    """Questions read or salvaged from failed generations."""
    rows = read_table(spark, d, "dataset_failed").where("raw_generation is not null")
    return rows.select("failure_kind", "attempt", "failed_at", F.explode(parse.valid_items(parse.question_items(F.col("raw_generation")))).alias("q")).select("failure_kind", "attempt", "failed_at", "q.difficulty", "q.question")


@query("validate_items", """
SELECT record_id, CASE WHEN requested_difficulty BETWEEN 1 AND 10 AND trim(coalesce(question, '')) <> '' THEN 1 ELSE 0 END AS valid FROM dataset""")
def validate_items(spark, d):
    item = F.array(F.struct(F.col("requested_difficulty").alias("difficulty"), "question"))
    return read_table(spark, d, "dataset").select("record_id", F.size(parse.valid_items(item)).alias("valid"))


@query("pick_difficulty", """
SELECT target, max_by(question, record_id) AS question FROM dataset WHERE requested_difficulty = 5 AND target IS NOT NULL AND question IS NOT NULL GROUP BY target""")
def pick_difficulty(spark, d):
    rows = read_table(spark, d, "dataset").where("target is not null and question is not null and requested_difficulty = 5")
    last = rows.groupBy("target").agg(F.max_by(F.struct(F.col("requested_difficulty").alias("difficulty"), "question"), "record_id").alias("item"))
    return last.select("target", parse.pick_difficulty(F.array("item"), F.lit(5)).alias("question"))


@query("preview", "SELECT record_id, translate(left(question, 40), chr(10), ' ') || CASE WHEN length(question) > 40 THEN '…' ELSE '' END AS preview FROM dataset WHERE question IS NOT NULL")
def preview(spark, d):
    return read_table(spark, d, "dataset").where("question is not null").select("record_id", text.preview(F.col("question"), 40).alias("preview"))


_REQUIREMENTS = "'Difficulty: ' || requested_difficulty || chr(10) || 'Domain: ' || coalesce(nullif(domain, ''), '(unspecified)') || chr(10) || 'Given: ' || coalesce(nullif(array_to_string(list_filter(trace.leafs, lambda x: x IS NOT NULL), ', '), ''), '(none)')"
_WHOLE = "FROM dataset WHERE requested_difficulty IS NOT NULL AND trace_str IS NOT NULL AND question IS NOT NULL"


def _requirements():
    given = F.coalesce(F.nullif(F.array_join(F.array_compact("trace.leafs"), ", "), F.lit("")), F.lit("(none)"))
    return F.concat(F.lit("Difficulty: "), F.col("requested_difficulty").cast("string"), F.lit("\nDomain: "), F.coalesce(F.nullif("domain", F.lit("")), F.lit("(unspecified)")), F.lit("\nGiven: "), given)


def _whole(spark, d):
    return read_table(spark, d, "dataset").where("requested_difficulty is not null and trace_str is not null and question is not null")


@query("sft_text", f"SELECT record_id, {_REQUIREMENTS} || chr(10) || trace_str || chr(10) || 'Question: ' || question AS text {_WHOLE}")
def sft_text(spark, d):
    return _whole(spark, d).select("record_id", F.concat(_requirements(), F.lit("\n"), "trace_str", F.lit("\nQuestion: "), "question").alias("text"))


@query("inference_prompt", f"SELECT record_id, {_REQUIREMENTS} || chr(10) || trace_str || chr(10) || 'Question:' AS prompt {_WHOLE}")
def inference_prompt(spark, d):
    return _whole(spark, d).select("record_id", F.concat(_requirements(), F.lit("\n"), "trace_str", F.lit("\nQuestion:")).alias("prompt"))


@query("sft_user_message", f"SELECT record_id, 'Write a problem that asks for ' || coalesce(trace.target, target, '') || '.' || chr(10) || {_REQUIREMENTS} AS message {_WHOLE}")
def sft_user_message(spark, d):
    return _whole(spark, d).select("record_id", F.concat(F.lit("Write a problem that asks for "), F.coalesce("trace.target", "target", F.lit("")), F.lit(".\n"), _requirements()).alias("message"))


@query("chat_text", f"SELECT record_id, 'S' || chr(10) || chr(10) || 'User: ' || trace_str || chr(10) || chr(10) || 'Assistant: ' || question AS text {_WHOLE}")
def chat_text(spark, d):
    return _whole(spark, d).select("record_id", text.chat_text(F.lit("S"), F.col("trace_str"), F.col("question")).alias("text"))


_NUMBER = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"


@query("judge_scores", f"SELECT eval_id, CAST({_NUMBER.format('question')} % 10 + 1 AS INT) AS score FROM eval_sft WHERE question IS NOT NULL")
def judge_scores(spark, d):
    """Answers of the built-in judge to every evaluated question, parsed."""
    said = scoring.answers(read_table(spark, d, "eval_sft").select("eval_id", "question"), "eval_id", "question")
    return said.select("eval_id", parse.parse_score(F.col("answer")).alias("score"))


def _prompt_sql(task: str) -> str:
    return f"'{scoring.TASKS[task][0]}' || chr(10) || coalesce(trace_str, '') || chr(10) || 'Given: ' || coalesce(nullif(array_to_string(leafs, ', '), ''), '(none)') || chr(10) || 'Target: ' || coalesce(target, '') || chr(10) || 'Question: ' || coalesce(question, '')"


@query("judge_questions", f"""
WITH q AS (SELECT eval_id, trace_str, target, question, list_sort(list_distinct(list_filter(trace.leafs, lambda x: x IS NOT NULL))) AS leafs FROM eval_sft WHERE trace IS NOT NULL AND coalesce(question, '') <> ''),
j AS (SELECT eval_id, CAST({_NUMBER.format(_prompt_sql('difficulty'))} % 10 + 1 AS INT) AS difficulty, CAST({_NUMBER.format(_prompt_sql('feasibility'))} % 10 + 1 AS INT) AS feasibility, {_NUMBER.format(_prompt_sql('faithfulness'))} % 2 = 0 AS target_present,
  len(list_filter(leafs, lambda v: {_NUMBER.format('v')} % 2 = 0)) AS hits, len(leafs) AS n FROM q)
SELECT eval_id, difficulty, feasibility, target_present, hits, target_present AND hits / greatest(n, 1) >= 1 AS faithful FROM j""")
def judge_questions(spark, d):
    """The three judges asked side by side about every evaluated question, by the built-in clients."""
    rows = read_table(spark, d, "eval_sft").where("trace is not null and coalesce(question, '') <> ''")
    rows = rows.select("eval_id", "trace_str", "target", "question", F.array_sort(F.array_distinct(F.array_compact(F.coalesce("trace.leafs", F.array().cast("array<string>"))))).alias("leafs"))
    out = scoring.judge_questions(rows, "eval_id")
    hits = F.size(F.filter(F.map_values("verdict.leaf_hits"), lambda h: h)).cast("long")
    return out.select("eval_id", "difficulty", "feasibility", "verdict.target_present", hits.alias("hits"), "verdict.faithful")
