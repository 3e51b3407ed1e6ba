"""Edges over paragraph nodes: chain, dedup, order, pointers, labels, aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docweave.functions.text import link_label, link_phrase, memory_tokens

#: The order of edge types.
PRIORITY = {"paragraph_next": 0, "paragraph_prev": 1}


def relation_text(edge_type: Column) -> Column:
    return F.when(edge_type == "paragraph_next", "next paragraph in document order").when(edge_type == "paragraph_prev", "previous paragraph in document order").otherwise(F.replace(edge_type, F.lit("_"), F.lit(" ")))


def priority(edge_type: Column) -> Column:
    return F.when(edge_type == "paragraph_next", 0).when(edge_type == "paragraph_prev", 1).otherwise(99)


def chain(nodes: DataFrame, key: str = "paper_seq") -> DataFrame:
    """Next and previous edges in document order, over section borders; one window, no join."""
    order = W.partitionBy(key).orderBy("section_index", "paragraph_index", "node_id")
    both = nodes.select(key, F.col("node_id").alias("src"), F.lead("node_id").over(order).alias("n"), F.lag("node_id").over(order).alias("p"))
    edge = lambda dst, kind: F.struct(F.col(dst).alias("dst"), F.lit(kind).alias("edge_type"))
    out = both.select(key, "src", F.explode(F.array(edge("n", "paragraph_next"), edge("p", "paragraph_prev"))).alias("e")).where("e.dst IS NOT NULL")
    return out.select(key, "src", "e.dst", "e.edge_type", F.lit(1.0).alias("score"), relation_text(F.col("e.edge_type")).alias("relation_text"))


def dedupe(edges: DataFrame, key: str = "paper_seq", seq: str = "seq") -> DataFrame:
    """The best scored edge of each (src, dst, type): null lowest, the first of equals."""
    w = W.partitionBy(key, "src", "dst", "edge_type").orderBy(F.col("score").desc_nulls_last(), seq)
    return edges.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def adjacency(edges: DataFrame, key: str = "paper_seq") -> DataFrame:
    """edge_rank: place of an edge among those of its source."""
    w = W.partitionBy(key, "src").orderBy(priority(F.col("edge_type")), -F.coalesce("score", F.lit(0.0)), "dst")
    return edges.withColumn("edge_rank", F.row_number().over(w))


def normalized_pointers(edges: DataFrame) -> DataFrame:
    """Pointer form of edges: type, score 0 for null, never global."""
    return edges.withColumn("type", F.col("edge_type")).withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("candidate_source", F.lit("structural")).withColumn("is_global", F.lit(False))


def _pointer_order() -> list[Column]:
    return [F.col("is_global").cast("int"), priority(F.col("edge_type")), -F.coalesce("score", F.lit(0.0)), F.col("dst")]


def pointer_candidates(edges: DataFrame, k: int = 4, structural_k: int = 4, key: str = "paper_seq") -> DataFrame:
    """The best edge per destination, then the top k of each source."""
    if k < 1 or structural_k < 1:
        raise ValueError("k and structural_k must be positive")
    src = W.partitionBy(key, "src").orderBy(*_pointer_order())
    dst = W.partitionBy(key, "src", "dst").orderBy(*_pointer_order())
    capped = edges.withColumn("__s", F.row_number().over(src)).where(F.col("__s") <= structural_k).drop("__s")
    best = capped.withColumn("__d", F.row_number().over(dst)).where("__d = 1").drop("__d")
    return best.withColumn("rank", F.row_number().over(src)).where(F.col("rank") <= k)


def pointer_links(candidates: DataFrame, k: int = 4, key: str = "paper_seq") -> DataFrame:
    """The first k candidates of each source with distinct destinations."""
    return pointer_candidates(candidates.drop("rank"), k, 2**31 - 1, key)


def labelled_links(links: DataFrame, output: str = "raw_output") -> DataFrame:
    """Label, phrase and tokens of links from generated outputs."""
    label = link_label(F.col(output))
    made = links.withColumn("link_label", label).withColumn("link_phrase", link_phrase(F.col("edge_type"), F.col("link_label"), F.col(output)))
    return made.withColumn("link_tokens", memory_tokens(F.array("link_phrase")))


def with_endpoints(links: DataFrame, nodes: DataFrame, key: str = "paper_seq", strict: bool = False) -> DataFrame:
    """Links with texts and titles of both ends; dangling ones are dropped, if ``strict`` an error."""
    end = lambda p: nodes.select(key, F.col("node_id").alias(p), F.col("section_title").alias(f"{p}_title"), F.col("text").alias(f"{p}_text"))
    if not strict:
        return links.join(end("src"), [key, "src"]).join(end("dst"), [key, "dst"])
    both = links.join(end("src"), [key, "src"], "left").join(end("dst"), [key, "dst"], "left")
    missing = F.col("src_text").isNull() | F.col("dst_text").isNull()
    return both.withColumn("src_text", F.when(missing, F.raise_error(F.lit("an end of a link is no node")).cast("string")).otherwise(F.col("src_text")))


def mean_by_destination(edges: DataFrame, vectors: DataFrame, key: str = "paper_seq") -> DataFrame:
    """Mean of the source vectors per destination and dimension (message passing without weights)."""
    src = vectors.select(key, F.col("node_id").alias("src"), F.posexplode("vector").alias("dim", "x"))
    return edges.select(key, "src", "dst").join(src, [key, "src"]).groupBy(key, "dst", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
