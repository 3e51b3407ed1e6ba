"""Model inputs: assembled records, packed token sequences, regions, summary bundles, payload joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import compact, memory_tokens, phrases

# Region ids of the raw form.
PREFIX_REGION, TARGET_REGION, QUERY_REGION = -1, -2, -3


def _required(c: Column, what: str) -> Column:
    return F.when(c.isNull(), F.raise_error(F.lit(what)).cast("string").isNotNull()).otherwise(F.lit(True))


def flatten_links(records: DataFrame, links: str, keys: list[str]) -> DataFrame:
    """One row per link of an array column."""
    return records.select(*keys, F.explode(links).alias("l")).select(*keys, "l.*")


def with_payload(links: DataFrame, payload: DataFrame, keys: list[str]) -> DataFrame:
    """Links with their generated payload; one without is an error."""
    out = links.join(payload.withColumn("__found", F.lit(1)), keys, "left")
    return out.where(_required(F.col("__found"), "a link has no payload")).drop("__found")


def with_scores(nodes: DataFrame, scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Nodes with their scores; a node without one is an error."""
    out = nodes.join(scores.select(*keys, score), keys, "left")
    return out.where(_required(F.col(score), "a node has no score"))


def summary_bundles(summaries: DataFrame, raw: str = "raw_output", most: int = 5) -> DataFrame:
    """Phrases, joined text, memory tokens and their text of generated summaries; an empty one is an error."""
    p = phrases(F.col(raw), most)
    ok = F.when(compact(F.col(raw)) == "", F.raise_error(F.lit("empty summary")).cast("string")).otherwise(F.array_join("__p", "; "))
    out = summaries.withColumn("__p", p).withColumn("node_sum_text", ok).withColumn("node_sum_tokens", memory_tokens(F.col("__p")))
    return out.withColumn("node_sum_tokens_text", F.array_join("node_sum_tokens", " ")).drop("__p")


def assembled(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, record: str = "record_id") -> DataFrame:
    """Records with ordered nodes, edges and seeds nested; per record they are bounded by its document."""
    n = nodes.groupBy(record).agg(F.array_sort(F.collect_list(F.struct("idx", "node_id", "score"))).alias("nodes"))
    e = edges.groupBy(record).agg(F.array_sort(F.collect_list(F.struct("src_idx", "dst_idx", "edge_idx"))).alias("edges"))
    s = seeds.groupBy(record).agg(F.array_sort(F.collect_list(F.struct("rank", "idx"))).alias("seeds"))
    return n.join(e, record, "left").join(s, record, "left")


def packed(prefix: Column, evidence: Column, query: Column, target: Column, most: int) -> Column:
    """Prefix, evidence in document order, query and target as one sequence; over ``most`` is an error, never cut."""
    ids = F.concat(prefix, F.flatten(evidence), query, target)
    return F.when(F.size(ids) > most, F.raise_error(F.lit("sequence is over the limit")).cast("array<int>")).otherwise(ids)


def raw_regions(prefix: Column, document: Column, query: Column, target: Column) -> Column:
    """Region ids of the whole-document form: document and target share one."""
    part = lambda c, r: F.array_repeat(F.lit(r), F.size(c))
    return F.concat(part(prefix, PREFIX_REGION), part(document, TARGET_REGION), part(query, QUERY_REGION), part(target, TARGET_REGION))


def suffix_labels(before: Column, target: Column, ignore: int = -100) -> Column:
    """Labels of a sequence: only the target counts."""
    return F.concat(F.array_repeat(F.lit(ignore), before), target)


def moving_average(values: Column, momentum: float = 0.9) -> Column:
    """Exponential moving average over an ordered array, from its first value; null for none."""
    start = F.get(values, F.lit(0))
    rest = F.slice(values, 2, F.greatest(F.size(values), F.lit(1)))
    return F.aggregate(rest, start, lambda a, x: momentum * a + (1 - momentum) * x)


def name_list(text: str) -> list[str]:
    """Names of a comma-separated parameter."""
    return [x.strip() for x in (text or "").split(",") if x.strip()]
