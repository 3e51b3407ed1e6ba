"""Integrity checks: violations as rows (rule, n), counted in one pass per input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def no_truncation(max_section_chars: int) -> None:
    """Driver side: texts are never cut."""
    if max_section_chars > 0:
        raise ValueError("texts are not truncated; max_section_chars must be 0")


def budgets(fixed: int, picks: int, most: int, top_k: int, seeds: int, hops: int) -> None:
    """Driver side: ranges of the routing arguments and their relations."""
    if min(most, top_k, hops) < 1 or min(fixed, picks, seeds) < 0:
        raise ValueError("counts must be positive")
    if fixed + picks > most or most > top_k:
        raise ValueError("fixed + picks must be at most most, most at most top_k")
    if seeds and fixed > seeds:
        raise ValueError("fixed must be at most seeds")


def summary_integrity(nodes: DataFrame, summaries: DataFrame, key: list[str]) -> DataFrame:
    """Duplicate, unknown and missing summaries, and nodes of other types: (rule, n)."""
    n = nodes.groupBy(*key).agg(F.count("*").alias("nn"), F.count_if(F.coalesce("node_type", F.lit("")) != "paragraph").alias("bad"))
    s = summaries.groupBy(*key).agg(F.count("*").alias("ns"), F.count_if(F.coalesce("node_sum_text", F.lit("")) == "").alias("blank"))
    both = n.join(s, key, "full_outer")
    counted = both.agg(
        F.count_if(F.col("ns") > 1).alias("duplicate_summary"),
        F.count_if(F.col("nn").isNull()).alias("unknown_node"),
        F.count_if(F.col("ns").isNull()).alias("missing_summary"),
        F.sum(F.coalesce("bad", F.lit(0))).alias("node_type"),
        F.sum(F.coalesce("blank", F.lit(0))).alias("blank_summary"),
    )
    return counted.unpivot([], counted.columns, "rule", "n").select("rule", F.coalesce("n", F.lit(0)).alias("n"))


def score_coverage(records: DataFrame, scores: DataFrame) -> DataFrame:
    """Records without any score, and scores that are null or not finite: (rule, n)."""
    have = scores.groupBy(F.col("record_id").alias("id")).agg(F.count_if(F.col("score").isNull() | F.isnan("score")).alias("bad"))
    counted = records.select("id").distinct().join(have, "id", "left").agg(F.count_if(F.col("bad").isNull()).alias("no_scores"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad_score"))
    return counted.unpivot([], counted.columns, "rule", "n").select("rule", F.coalesce("n", F.lit(0)).alias("n"))


def gold_in_nodes(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """Gold evidence ids that are no node of the paper: (id, node_id)."""
    gold = records.select("id", "paper_id", F.explode("gold_evidence_node_ids").alias("node_id"))
    return gold.join(nodes.select("paper_id", "node_id"), ["paper_id", "node_id"], "left_anti").select("id", "node_id").distinct()


def gold_coverage(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """Gold evidence ids checked and those that are no node of the paper: (rule, n)."""
    gold = records.select("id", "paper_id", F.explode("gold_evidence_node_ids").alias("node_id")).distinct()
    known = nodes.select("paper_id", "node_id", F.lit(1).alias("known")).distinct()
    return _counted(gold.join(known, ["paper_id", "node_id"], "left").agg(F.count("*").alias("gold_checked"), F.count_if(F.col("known").isNull()).alias("gold_unknown")))


def _counted(counts: DataFrame) -> DataFrame:
    return counts.unpivot([], counts.columns, "rule", "n").select("rule", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def seed_coverage(records: DataFrame, seeds: DataFrame, nodes: DataFrame, record: str = "record_id") -> DataFrame:
    """Records without any seed, and with seeds none of which is a node: (rule, n).

    seeds and nodes are (record, paper_id, node_id) and (paper_id, node_id).
    """
    known = seeds.join(nodes.select("paper_id", "node_id", F.lit(1).alias("known")).distinct(), ["paper_id", "node_id"], "left")
    have = known.groupBy(record).agg(F.count("known").alias("valid"))
    both = records.select(record).distinct().join(have, record, "left")
    return _counted(both.agg(F.count_if(F.col("valid").isNull()).alias("no_seeds"), F.count_if(F.col("valid") == 0).alias("no_valid_seed")))


def link_integrity(links: DataFrame, nodes: DataFrame, key: str = "paper_id") -> DataFrame:
    """Links and those without tokens or with an end that is no node, nodes of larger papers without links: (rule, n).

    links: (key, src, dst, link_tokens).
    """
    end = lambda p: nodes.select(key, F.col("node_id").alias(p), F.lit(1).alias(f"{p}_known")).distinct()
    seen = links.join(end("src"), [key, "src"], "left").join(end("dst"), [key, "dst"], "left")
    of_links = seen.agg(
        F.count("*").alias("links"),
        F.count_if(F.size(F.coalesce("link_tokens", F.array().cast("array<string>"))) == 0).alias("empty_link_tokens"),
        F.count_if(F.col("src_known").isNull()).alias("unknown_source"),
        F.count_if(F.col("dst_known").isNull()).alias("unknown_destination"),
    )
    size = nodes.groupBy(key).agg(F.count("*").alias("n"))
    bare = nodes.select(key, F.col("node_id").alias("src")).join(links.select(key, "src").distinct(), [key, "src"], "left_anti").join(size.where("n > 1").select(key), key)
    return _counted(of_links).unionByName(_counted(bare.agg(F.count("*").alias("no_candidates"))))


def record_integrity(records: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Records with a blank id, question, answer or seed list, repeated ids, and papers without text: (rule, n).

    documents: (paper_id, raw_document_text).
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    counts = records.agg(
        F.count_if(blank("id")).alias("blank_id"),
        F.count_if(blank("query.question")).alias("blank_question"),
        F.count_if(blank("target_answer.normalized_answer")).alias("blank_answer"),
        F.count_if(F.size(F.coalesce("query.seed_candidates", F.array().cast(records.schema["query"].dataType["seed_candidates"].dataType))) == 0).alias("no_seeds"),
    )
    repeated = records.groupBy("id").count().where("count > 1").agg(F.count("*").alias("repeated_id"))
    out = _counted(counts).unionByName(_counted(repeated))
    if documents is not None:
        text = documents.select("paper_id", blank("raw_document_text").alias("blank"))
        of = records.select("paper_id").distinct().join(text, "paper_id", "left")
        out = out.unionByName(_counted(of.agg(F.count_if(F.col("blank").isNull()).alias("no_document"), F.count_if("blank").alias("blank_document"))))
    return out


def require_none(violations: DataFrame) -> None:
    """Raises with the first broken rules; ``violations`` is (rule, n)."""
    bad = violations.where("n > 0").orderBy("rule").limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r['rule']}: {r['n']}" for r in bad))


def overlength(rows: DataFrame, length: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows within the length, report with counts and the first five ids dropped)."""
    kept = rows.where(F.col(length) <= most)
    dropped = rows.where(F.col(length) > most)
    first = dropped.orderBy("id").limit(5).agg(F.sort_array(F.collect_list("id")).alias("first_ids"))
    report = rows.agg(F.count("*").alias("total"), F.count_if(F.col(length) > most).alias("dropped")).crossJoin(first)  # one row each
    return kept, report
