"""Window, ranking, limit and fold operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hyperloom.dist import read_table, text_hash, text_hash_sql
from hyperloom.functions import rewards
from hyperloom.operators import ordered, records
from hyperloom.plans.graph_queries import DEPTH_SQL
from hyperloom.plans.registry import query

_SERIES = "(SELECT run_id, step, avg(mean_reward_raw) AS v FROM rl_steps WHERE step IS NOT NULL AND mean_reward_raw IS NOT NULL AND run_id IS NOT NULL GROUP BY 1, 2)"


def _series(spark, d):
    """One value of each step of each run."""
    rows = read_table(spark, d, "rl_steps").where("step is not null and mean_reward_raw is not null and run_id is not null")
    return rows.groupBy("run_id", "step").agg(F.avg("mean_reward_raw").alias("v"))


@query("monotonicity", """
WITH o AS (SELECT target, claude_difficulty AS g, lead(claude_difficulty) OVER (PARTITION BY target ORDER BY requested_difficulty, claude_difficulty) AS nx FROM dataset WHERE claude_difficulty >= 1 AND target IS NOT NULL AND requested_difficulty IS NOT NULL)
SELECT target, avg(CAST(nx >= g AS INT)) AS share FROM o WHERE nx IS NOT NULL GROUP BY 1""")
def monotonicity(spark, d):
    return ordered.monotonicity(read_table(spark, d, "dataset"), "target", "requested_difficulty", "claude_difficulty", "record_id")


@query("rolling_same", f"SELECT run_id, step, v, sum(v) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS rolling FROM {_SERIES}")
def rolling_same(spark, d):
    return ordered.rolling_same(_series(spark, d), ["run_id"], "step", "v", 5)


@query("rolling_valid", f"SELECT run_id, step, v, m AS rolling FROM (SELECT *, avg(v) OVER w AS m, count(v) OVER w AS n FROM {_SERIES} WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE n = 20")
def rolling_valid(spark, d):
    return ordered.rolling_valid(_series(spark, d), ["run_id"], "step", "v", 20)


@query("group_advantage", """
WITH e AS (SELECT run_id, step, pos, reward_raw[pos] AS x FROM (SELECT *, unnest(range(1, len(reward_raw) + 1)) AS pos FROM (SELECT DISTINCT run_id, step, reward_raw FROM rl_steps WHERE reward_raw IS NOT NULL)))
SELECT run_id, step, pos, CASE WHEN stddev_pop(x) OVER w < 1e-8 THEN 0.0 ELSE x - avg(x) OVER w END AS advantage FROM e WINDOW w AS (PARTITION BY run_id, step)""")
def group_advantage(spark, d):
    rows = read_table(spark, d, "rl_steps").where("reward_raw is not null").select("run_id", "step", "reward_raw").distinct()
    e = rows.select("run_id", "step", F.posexplode("reward_raw").alias("p", "x"))
    return ordered.group_advantage(e, ["run_id", "step"], "x").select("run_id", "step", (F.col("p") + 1).cast("long").alias("pos"), "advantage")


@query("capped_sample_by_length", f"""
WITH r AS (SELECT eval_id, target, len(trace.path) AS length, {text_hash_sql('eval_id', seed=1)} AS h FROM eval_sft WHERE target IS NOT NULL AND trace.path IS NOT NULL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, length ORDER BY h, eval_id) AS k FROM r) WHERE k <= 2),
c AS (SELECT length, target, sum(count(*)) OVER (PARTITION BY length ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f GROUP BY 1, 2)
SELECT eval_id, target, CAST(length AS INT) AS length FROM f JOIN c USING (length, target) WHERE coalesce(before, 0) + k <= 20""")
def capped_sample_by_length(spark, d):
    rows = read_table(spark, d, "eval_sft").where("target is not null and trace.path is not null").select("eval_id", "target", F.size("trace.path").alias("length"))
    return ordered.capped_sample(rows, "target", "length", "eval_id", 2, 20)


@query("first_n_valid", "SELECT record_id FROM dataset WHERE claude_feasibility >= 7 ORDER BY generated_at, record_id LIMIT 50")
def first_n_valid(spark, d):
    return read_table(spark, d, "dataset").where("claude_feasibility >= 7").orderBy("generated_at", "record_id").limit(50).select("record_id")


@query("alternating_phase", "SELECT DISTINCT run_id, step, CAST(floor((greatest(1, step) - 1) / 25.0) AS BIGINT) % 2 AS phase FROM rl_steps WHERE step IS NOT NULL")
def alternating_phase(spark, d):
    return read_table(spark, d, "rl_steps").where("step is not null").select("run_id", "step", rewards.alternating_phase(F.col("step"), 25).cast("long").alias("phase")).distinct()


@query("ema_adaptive", f"""
WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS k FROM {_SERIES}),
r AS (SELECT run_id, step, v, k, CAST(1.0 AS DOUBLE) AS ema_v FROM s WHERE k = 1
      UNION ALL SELECT s.run_id, s.step, s.v, s.k, 0.9 * r.ema_v + 0.1 * r.v FROM r JOIN s ON s.run_id = r.run_id AND s.k = r.k + 1)
SELECT run_id, step, ema_v FROM r""")
def ema_adaptive(spark, d):
    return ordered.ema(_series(spark, d), "run_id", "step", ["v"])


@query("row_by_index", "SELECT record_id, target FROM dataset ORDER BY record_id LIMIT 1 OFFSET 7")
def row_by_index(spark, d):
    return ordered.page(read_table(spark, d, "dataset").select("record_id", "target"), ["record_id"], 7, 1)


@query("paginate", "SELECT record_id, target FROM dataset ORDER BY record_id LIMIT 25 OFFSET 50")
def paginate(spark, d):
    return ordered.page(read_table(spark, d, "dataset").select("record_id", "target"), ["record_id"], 2, 25)


@query("step_checkpoint", f"SELECT run_id, step FROM (SELECT run_id, step, greatest(1, max(step) OVER (PARTITION BY run_id) // 3) AS third FROM {_SERIES}) WHERE step % 50 = 0 OR step % third = 0")
def step_checkpoint(spark, d):
    s = _series(spark, d)
    third = s.groupBy("run_id").agg(F.greatest(F.lit(1), F.floor(F.max("step") / 3)).alias("third"))
    return s.join(third, "run_id").where("step % 50 = 0 or step % third = 0").select("run_id", "step")


@query("epoch_batches", f"SELECT record_id, (row_number() OVER (ORDER BY {text_hash_sql('record_id', seed=1)}, record_id) - 1) // 64 AS batch FROM dataset")
def epoch_batches(spark, d):
    return ordered.epoch_batches(read_table(spark, d, "dataset"), "record_id", 1, 64)


@query("retry_last_attempt", """
WITH f AS (SELECT target, requested_difficulty AS d, max(attempt) AS last, bool_or(contains(coalesce(drop_reason, ''), 'attempts')) AS gave_up FROM dataset_failed WHERE target IS NOT NULL AND requested_difficulty IS NOT NULL GROUP BY 1, 2),
p AS (SELECT DISTINCT target, requested_difficulty AS d, true AS passed FROM dataset WHERE target IS NOT NULL AND requested_difficulty IS NOT NULL),
a AS (SELECT target, d, coalesce(last, 0) AS last, coalesce(gave_up, false) AS gave_up, coalesce(passed, false) AS passed FROM f FULL JOIN p USING (target, d))
SELECT target, d AS requested_difficulty, last, passed, NOT passed AND NOT gave_up AND last < 3 AS remaining, CASE WHEN NOT passed AND NOT gave_up AND last < 3 THEN 600 * last END AS more_tokens FROM a""")
def retry_last_attempt(spark, d):
    """Of every target and difficulty the last attempt, whether one passed, and what the next attempt may use if there is one."""
    return records.retries(read_table(spark, d, "dataset_failed"), read_table(spark, d, "dataset"), 3, 600)


@query("sort_ranked_edges", """
WITH h AS (SELECT id, count(*) AS n FROM (SELECT id, unnest(inputs) AS v FROM hyperedges) WHERE v IN (SELECT output FROM hyperedges) GROUP BY id),
p AS (SELECT e.id, e.output, coalesce(h.n, 0) AS made FROM hyperedges e LEFT JOIN h USING (id))
SELECT output, id, row_number() OVER (PARTITION BY output ORDER BY made DESC, id) AS rank FROM p""")
def sort_ranked_edges(spark, d):
    edges = read_table(spark, d, "hyperedges")
    made = edges.select(F.col("output").alias("v")).distinct()
    hits = edges.select("id", F.explode("inputs").alias("v")).join(made, "v").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("output").orderBy(F.coalesce("n", F.lit(0)).desc(), "id")
    return edges.join(hits, "id", "left").select("output", "id", F.row_number().over(w).cast("long").alias("rank"))


@query("sort_coverage", "SELECT chapter, n, row_number() OVER (ORDER BY n, chapter) AS place FROM (SELECT chapter, count(*) AS n FROM (SELECT unnest(trace.chapters) AS chapter FROM dataset) WHERE chapter IS NOT NULL GROUP BY 1)")
def sort_coverage(spark, d):
    n = read_table(spark, d, "dataset").select(F.explode("trace.chapters").alias("chapter")).where("chapter is not null").groupBy("chapter").agg(F.count(F.lit(1)).alias("n"))
    return n.select("chapter", "n", F.row_number().over(Window.orderBy("n", "chapter")).cast("long").alias("place"))  # one row a chapter


@query("limit_attempts", """
WITH a AS (SELECT record_id, trace FROM dataset ORDER BY generated_at NULLS FIRST, record_id LIMIT 250)
SELECT record_id FROM (SELECT record_id, row_number() OVER () AS k, trace FROM a) WHERE len(trace.path) >= 5 AND len(trace.chapters) = 1 ORDER BY k LIMIT 50""")
def limit_attempts(spark, d):
    """The first fifty attempts that are accepted, of at most five times as many tries."""
    rows = read_table(spark, d, "dataset").select("record_id", "generated_at", F.size("trace.path").alias("steps"), F.size("trace.chapters").alias("chapters"))
    return ordered.first_accepted(rows, ["generated_at", "record_id"], (F.col("steps") >= 5) & (F.col("chapters") == 1), 50).select("record_id")


@query("sample_targets", f"SELECT target FROM (SELECT DISTINCT output AS target FROM hyperedges) WHERE {text_hash_sql('target', seed=3)} < {int(0.1 * 0x7FFFFFFFFFFFFFFF)}")
def sample_targets(spark, d):
    """A tenth of the producible targets, by hash."""
    t = read_table(spark, d, "hyperedges").select(F.col("output").alias("target")).distinct()
    return t.where(text_hash("target", seed=3) < F.lit(int(0.1 * 0x7FFFFFFFFFFFFFFF)))


@query("debug_subset", f"SELECT record_id FROM dataset ORDER BY {text_hash_sql('record_id', seed=5)}, record_id LIMIT 40")
def debug_subset(spark, d):
    """Forty records in the order of a hash, as a shuffled prefix."""
    return read_table(spark, d, "dataset").select("record_id", text_hash("record_id", seed=5).alias("o")).orderBy("o", "record_id").limit(40).select("record_id")


_U, _PICK = text_hash_sql("record_id", seed=9), text_hash_sql("record_id", seed=10)


@query("biased_choice", f"""
WITH w AS ({DEPTH_SQL}), deep AS (SELECT list(v ORDER BY v) AS p FROM w WHERE depth >= 3), every AS (SELECT list(v ORDER BY v) AS p FROM w)
SELECT record_id, CASE WHEN {_U} < {int(0.9 * 0x7FFFFFFFFFFFFFFF)} AND len(deep.p) > 0 THEN deep.p[{_PICK} // 8 % len(deep.p) + 1] ELSE every.p[{_PICK} // 8 % len(every.p) + 1] END AS target FROM dataset, deep, every""")
def biased_choice(spark, d):
    """A target for each record: nine times in ten one of the deep quantities, else any; by hash."""
    from hyperloom.operators import graph
    from hyperloom.plans.graph_queries import MOST_DEPTH

    depth = graph.depth(read_table(spark, d, "hyperedges"), MOST_DEPTH)
    u, pick = text_hash("record_id", seed=9), F.shiftright(text_hash("record_id", seed=10), 3)
    return ordered.biased_choice(read_table(spark, d, "dataset").select("record_id"), depth, u < F.lit(int(0.9 * 0x7FFFFFFFFFFFFFFF)), pick, 3).select("record_id", "target")


@query("dedup_traces", """
SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY array_to_string(list_transform(trace.path, lambda e: e.id), ','), array_to_string(list_sort(trace.leafs), ',') ORDER BY record_id) AS k FROM dataset WHERE trace.path IS NOT NULL AND trace.leafs IS NOT NULL) WHERE k = 1""")
def dedup_traces(spark, d):
    rows = read_table(spark, d, "dataset").where("trace.path is not null and trace.leafs is not null")
    key = rows.select("record_id", F.array_join(F.transform("trace.path", lambda e: e["id"]), ",").alias("p"), F.array_join(F.array_sort("trace.leafs"), ",").alias("l"))
    return key.groupBy("p", "l").agg(F.min("record_id").alias("record_id")).select("record_id")


@query("producible", "SELECT DISTINCT output FROM hyperedges")
def producible(spark, d):
    return read_table(spark, d, "hyperedges").select("output").distinct()
