"""Frontier routing over the node graph: expansion, selection, reading order.

All steps are joins and windows keyed by the record, with the paths as arrays. Hops are
bounded, so the expansion is unrolled and one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def valid_seeds(seeds: DataFrame, nodes: DataFrame, record: str = "record_id") -> DataFrame:
    """Seeds that are nodes, each at its first place: (record, idx, seed_rank from 1)."""
    known = seeds.join(nodes.select(record, "idx").distinct(), [record, "idx"], "left_semi")
    first = known.groupBy(record, "idx").agg(F.min("rank").alias("rank"))
    return first.withColumn("seed_rank", F.row_number().over(W.partitionBy(record).orderBy("rank", "idx"))).drop("rank")


def frontier(base: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int = 2, edge_prior: float = 0.0, query_weight: float = 0.0, record: str = "record_id") -> DataFrame:
    """The best path to every node that is no base node.

    base: (record, idx, seed_rank). edges: (record, edge_idx, src_idx, dst_idx, logit).
    nodes: (record, idx, start_logit, norm). Paths are simple. A path's score adds edge
    logits and prior; a node's adds its start logit to the mean over the depth. Of equal
    paths the one met first in breadth-first order wins.
    """
    prior = nodes.select(record, F.col("idx").alias("dst_idx"), "start_logit", "norm")
    steps = edges.select(record, "edge_idx", F.col("src_idx").alias("current"), "dst_idx", "logit").join(prior, [record, "dst_idx"])
    states = base.select(record, F.col("idx").alias("current"), F.col("idx").alias("root"), F.array("idx").alias("line"), F.array().cast("array<int>").alias("path"), F.lit(0.0).alias("path_score"), F.array("seed_rank").alias("met"))
    found = None
    for depth in range(1, max(1, hops) + 1):
        grown = states.join(steps, [record, "current"]).where(~F.array_contains("line", F.col("dst_idx")))
        grown = grown.select(
            record,
            F.col("dst_idx").alias("current"),
            "root",
            F.concat("line", F.array("dst_idx")).alias("line"),
            F.concat("path", F.array("edge_idx")).alias("path"),
            (F.col("path_score") + F.col("logit") + edge_prior * F.col("norm")).alias("path_score"),
            F.concat("met", F.array("edge_idx")).alias("met"),
            "start_logit",
            "norm",
        )
        scored = grown.withColumn("depth", F.lit(depth)).withColumn("score", F.col("start_logit") + F.col("path_score") / depth + query_weight * F.col("norm"))
        found = scored if found is None else found.unionByName(scored)
        states = grown.drop("start_logit", "norm")
    outside = found.join(base.select(record, F.col("idx").alias("current")), [record, "current"], "left_anti")
    best = W.partitionBy(record, "current").orderBy(F.desc("score"), "depth", "met")
    return outside.withColumn("__r", F.row_number().over(best)).where("__r = 1").select(record, "current", "root", "path", "depth", "score", F.lit("frontier").alias("source"))


def seed_tail(tail: DataFrame, nodes: DataFrame, start_weight: float = 0.0, query_weight: float = 0.0, record: str = "record_id") -> DataFrame:
    """Seeds beyond the fixed ones as candidates of depth 0."""
    s = tail.join(nodes.select(record, "idx", "start_logit", "norm"), [record, "idx"])
    return s.select(record, F.col("idx").alias("current"), F.col("idx").alias("root"), F.array().cast("array<int>").alias("path"), F.lit(0).alias("depth"), (F.col("start_logit") + (start_weight + query_weight) * F.col("norm")).alias("score"), F.lit("seed_tail").alias("source"))


def candidates(front: DataFrame, tail: DataFrame, record: str = "record_id") -> DataFrame:
    """The better candidate of each node; of equals that of the frontier."""
    both = front.unionByName(tail)
    w = W.partitionBy(record, "current").orderBy(F.desc("score"), "source")
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def select(cands: DataFrame, fixed: DataFrame, nodes: DataFrame, count: int = 3, per_seed: int = 0, record: str = "record_id") -> DataFrame:
    """The ``count`` best candidates that are no fixed seeds, at most ``per_seed`` frontier ones of a root (0: any).

    The same as picking greedily: the cap concerns frontier candidates of the same root only,
    so the allowed ones are the first of each root.
    """
    free = cands.join(fixed.select(record, F.col("idx").alias("current")), [record, "current"], "left_anti")
    order = [F.desc("score"), F.col("depth"), F.col("current")]
    if per_seed > 0:
        of_root = F.row_number().over(W.partitionBy(record, "root", "source").orderBy(*order))
        free = free.withColumn("__c", of_root).where((F.col("source") != "frontier") | (F.col("__c") <= per_seed)).drop("__c")
    budget = nodes.groupBy(record).agg(F.count("*").alias("n")).join(fixed.groupBy(record).agg(F.count("*").alias("f")), record, "left").na.fill(0, ["f"])
    budget = budget.select(record, F.least(F.lit(count), F.greatest(F.col("n") - F.col("f"), F.lit(0))).alias("budget"))
    placed = free.withColumn("place", F.row_number().over(W.partitionBy(record).orderBy(*order)))
    return placed.where(F.col("place") <= count).join(budget, record).where("place <= budget").drop("budget")


def route(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, fixed_count: int = 5, count: int = 3, top_k: int = 16, hops: int = 2, per_seed: int = 0, edge_prior: float = 0.0, start_weight: float = 0.0, query_weight: float = 0.0, record: str = "record_id") -> DataFrame:
    """Selected nodes of each record: fixed seeds, then picks; (record, idx, place, source, score, root, depth, path)."""
    good = valid_seeds(seeds, nodes, record)
    fixed, tail = good.where(F.col("seed_rank") <= fixed_count), good.where(F.col("seed_rank") > fixed_count)
    cands = candidates(frontier(fixed, edges, nodes, hops, edge_prior, query_weight, record), seed_tail(tail, nodes, start_weight, query_weight, record), record)
    picks = select(cands, fixed, nodes, count, per_seed, record)
    a = fixed.select(record, "idx", F.col("seed_rank").alias("place"), F.lit("fixed").alias("source"), F.lit(None).cast("double").alias("score"), F.col("idx").alias("root"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path"))
    n = fixed.groupBy(record).agg(F.count("*").cast("int").alias("f"))
    b = picks.join(n, record, "left").select(record, F.col("current").alias("idx"), (F.col("place") + F.coalesce("f", F.lit(0))).alias("place"), "source", "score", "root", "depth", "path")
    return a.unionByName(b).where(F.col("place") <= top_k)


def route_edges(routed: DataFrame, edges: DataFrame, record: str = "record_id") -> DataFrame:
    """Edges of the selected paths, each once, with the pick that used it first."""
    used = routed.select(record, "place", "root", "depth", "score", F.posexplode("path").alias("step", "edge_idx"))
    w = W.partitionBy(record, "edge_idx").orderBy("place", "step")
    first = used.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return first.join(edges, [record, "edge_idx"]).select(record, "edge_idx", "src_idx", "dst_idx", F.col("score").alias("routing_score"), "root", F.col("depth").alias("round"))


def seed_only(seeds: DataFrame, nodes: DataFrame, most: int = 8, record: str = "record_id") -> DataFrame:
    """The first seeds, in document order."""
    return valid_seeds(seeds, nodes, record).where(F.col("seed_rank") <= most).select(record, "idx", F.row_number().over(W.partitionBy(record).orderBy("idx")).alias("read_order"))


def reading_order(routed: DataFrame, most: int = 8, record: str = "record_id") -> DataFrame:
    """The first selected nodes, then sorted to document order."""
    return routed.where(F.col("place") <= most).select(record, "idx", F.row_number().over(W.partitionBy(record).orderBy("idx")).alias("read_order"))


def sampled(cands: DataFrame, count: int, seed: int = 42, record: str = "record_id") -> DataFrame:
    """Picks without replacement in proportion to exp(score), by Gumbel noise; with log probability and entropy.

    The log probability of a pick is its score less the log-sum-exp of it and those after it;
    the entropy is that of the choice among these. The noise follows from seed, record and
    node, so it's the same in every run and on every partitioning.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(record).cast("string"), F.col("current").cast("string")))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    noisy = cands.withColumn("key", F.col("score") - F.log(-F.log(u)))
    w = W.partitionBy(record).orderBy(F.desc("key"), "current")
    top = F.max("score").over(W.partitionBy(record))
    rest = F.sum(F.exp(F.col("score") - F.col("top"))).over(w.rowsBetween(0, W.unboundedFollowing))
    mean = F.sum(F.exp(F.col("score") - F.col("top")) * (F.col("score") - F.col("top"))).over(w.rowsBetween(0, W.unboundedFollowing))
    placed = noisy.withColumn("top", top).withColumn("place", F.row_number().over(w)).withColumn("log_prob", F.col("score") - F.col("top") - F.log(rest)).withColumn("entropy", F.log(rest) - mean / rest)
    return placed.where(F.col("place") <= count).drop("key", "top")
