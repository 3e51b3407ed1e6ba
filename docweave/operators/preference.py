"""Preference data: tasks by prompt, rewards, chosen and rejected, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import leakage_penalty, long_output_penalty, long_phrase_penalty

MIN_RAW, MIN_CHOSEN, MIN_MARGIN = 0.30, 0.20, 0.10


def tasks(rows: DataFrame) -> DataFrame:
    """One task per prompt: the first record's data, and the distinct contexts in order.

    rows: (seq, prompt, record_id, node_id, question, section_title).
    """
    contexts = rows.groupBy("prompt", "question", "section_title").agg(F.min("seq").alias("seq"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "question", "section_title")))
    gathered = contexts.groupBy("prompt").agg(ordered.alias("c"))
    first = rows.groupBy("prompt").agg(F.min_by(F.struct("record_id", "node_id"), F.struct("seq", "node_id")).alias("f"))
    out = first.join(gathered, "prompt")
    return out.select("prompt", F.concat("f.record_id", F.lit("::node"), F.col("f.node_id").cast("string")).alias("id"), F.transform("c", lambda x: x["question"]).alias("scoring_questions"), F.transform("c", lambda x: x["section_title"]).alias("scoring_section_titles"), F.size("c").alias("prompt_group_size"))


def rewards(candidates: DataFrame, scores: DataFrame, raw: DataFrame, key: str = "id") -> DataFrame:
    """Reward of each candidate: mean similarity less the raw one and the penalties.

    candidates: (key, cand, output). scores: (key, cand, question_pos, score). raw: (key, raw_score).
    """
    mean = scores.groupBy(key, "cand").agg(F.avg("score").alias("mean_score"), F.min("score").alias("min_score"))
    out = candidates.join(mean, [key, "cand"]).join(raw, key)
    relevance = F.col("mean_score") - F.col("raw_score")
    pen = [leakage_penalty(F.col("output")), long_phrase_penalty(F.col("output")), long_output_penalty(F.col("output"))]
    out = out.withColumn("relevance", relevance).withColumn("leakage", pen[0]).withColumn("long_phrase", pen[1]).withColumn("long_output", pen[2])
    return out.withColumn("reward", F.col("relevance") - F.col("leakage") - F.col("long_phrase") - F.col("long_output"))


def pairs(rewarded: DataFrame, key: str = "id") -> DataFrame:
    """Chosen and rejected: first and last by reward, relevance, less leakage; ties by index.

    One aggregation, no sort: the ends of the order are a minimum and a maximum of structs.
    """
    order = F.struct((-F.col("reward")).alias("a"), (-F.col("relevance")).alias("b"), F.col("leakage").alias("c"), F.col("cand").alias("d"))
    value = F.struct("cand", "reward", "min_score")
    out = rewarded.groupBy(key).agg(F.min_by(value, order).alias("x"), F.max_by(value, order).alias("y"), F.count("*").alias("n"))
    return out.select(key, F.col("x.cand").alias("chosen_index"), F.col("y.cand").alias("rejected_index"), F.col("x.reward").alias("chosen_reward"), F.col("y.reward").alias("rejected_reward"), (F.col("x.reward") - F.col("y.reward")).alias("reward_margin"), F.col("x.min_score").alias("min_chosen_score"), "n")


def raw_gate(rows: DataFrame, least: float = MIN_RAW) -> DataFrame:
    """skip_reason 'raw_query_similarity' for tasks under the least raw score."""
    return rows.withColumn("skip_reason", F.when(F.col("raw_score") < least, "raw_query_similarity"))


def gates(rows: DataFrame, least_chosen: float = MIN_CHOSEN, least_margin: float = MIN_MARGIN) -> DataFrame:
    """skip_reason of the first gate that fails: tie, chosen_similarity, margin; null if kept."""
    reason = F.when(F.col("chosen_index") == F.col("rejected_index"), "tie").when(F.col("min_chosen_score") < least_chosen, "chosen_similarity").when(F.col("reward_margin") < least_margin, "margin")
    return rows.withColumn("skip_reason", reason)


def skip_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("skip_reason", F.lit("written")).alias("outcome")).agg(F.count("*").alias("n"))


def without_done(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows not written yet: resume by anti join."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
