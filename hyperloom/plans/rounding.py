"""Computed doubles are compared to six places: two engines add in different orders and differ in the last bits.

Values are moved off exact ties by 1e-9 first, so that both sides round alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

#: Query -> its computed doubles.
COLUMNS = {
    "judge_faithfulness_algebra": "coverage", "build_failed_row": "coverage", "valid_score_filter": "score", "faith_raw": "reward", "feas_raw": "reward",
    "diff_align_raw": "reward", "scaled_reward": "reward", "combined_raw": "reward", "adaptive_weights": "faithfulness feasibility difficulty", "triple_raw": "reward",
    "reward_switch": "reward", "empty_rollout_default": "raw scaled", "judge_reward": "reward", "faith_reward_1_10": "reward", "length_reward": "reward",
    "logprob_sum": "tail", "pg_loss": "loss", "mean_reward_weighted": "reward",
    "metrics_summary": "mean_coverage target_rate faithful_rate mean_feasibility median_feasibility mae mean_distractors mean_words pearson",
    "confusion_rownorm": "share", "faithfulness_rates": "coverage target_rate faithful_rate", "faithfulness_by_difficulty": "coverage target_rate faithful_rate",
    "distractor_stats": "mean median", "difficulty_alignment": "mae pearson", "mean_sem_by_group": "mean sem", "feasibility_summary": "mean median low high",
    "question_length": "mean sem", "score_stats_by_length": "mean", "score_stats_overall": "mean", "boxplot_by_length": "lo q1 q2 q3 hi",
    "episode_summary": "mean least most", "trace_length_stats": "mean median std", "rl_step_stats": "mean_raw mean_scaled std", "rl_flatten": "raw",
    "rl_combined_frame": "combined_mean scaled loss", "rl_adaptive_frame": "faithfulness_mean feasibility_mean difficulty_mean weight_faithfulness weight_feasibility weight_difficulty ema_faithfulness ema_feasibility ema_difficulty combined_mean scaled",
    "safe_eval": "value", "try_formulas": "value", "uniform_value": "value", "score_by_index": "score reward", "monotonicity": "share", "rolling_same": "v rolling", "rolling_valid": "v rolling",
    "group_advantage": "advantage", "ema_adaptive": "ema_v", "stream_rl_log": "mean", "stream_windowed": "mean", "stream_ema": "ema",
}


def rounded(name: str, f: Callable) -> Callable:
    names = COLUMNS.get(name, "").split()
    if not names:
        return f
    return lambda spark, folder: f(spark, folder).withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in names})


def rounded_sql(name: str, sql: str) -> str:
    names = COLUMNS.get(name, "").split()
    if not names:
        return sql
    parts = ", ".join(f'round(CAST("{c}" AS DOUBLE) + 1e-9, 6) AS "{c}"' for c in names)
    return f"SELECT * REPLACE ({parts}) FROM ({sql}) AS q"
