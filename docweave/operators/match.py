"""Evidence texts to nodes, in tiers: equal, containing, similar.

Each tier sees only the evidence the tier before left. All joins have the paper as an equi
key, so that no nested loop join arises; distinct texts are matched once per paper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docweave.session import cut, sized_join

KEY = ["paper_seq", "norm"]


def evidence_rows(answers: DataFrame) -> DataFrame:
    """(paper_seq, question_index, answer_index, evidence_pos, norm) of answers."""
    return answers.select("paper_seq", "question_index", "answer_index", F.posexplode("evidence").alias("evidence_pos", "text")).withColumn("norm", F.lower("text")).drop("text")


def _paragraphs(nodes: DataFrame) -> DataFrame:
    return nodes.select("paper_seq", "node_id", F.lower("text").alias("p_norm"))


def exact(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """(paper_seq, norm, node_id): all equal paragraphs."""
    p = _paragraphs(nodes).withColumnRenamed("p_norm", "norm")
    return evidence.select(*KEY).distinct().join(p, KEY)


def contained(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """(paper_seq, norm, node_id): paragraphs in the evidence or around it."""
    either = F.contains(F.col("p_norm"), F.col("norm")) | F.contains(F.col("norm"), F.col("p_norm"))
    return evidence.select(*KEY).distinct().join(_paragraphs(nodes), "paper_seq").where(either).select(*KEY, "node_id")


def similar(evidence: DataFrame, nodes: DataFrame, least: float = 0.6) -> DataFrame:
    """(paper_seq, norm, node_id): word sets with a Jaccard similarity from ``least``, all ties at the best.

    Texts are shuffled once, by paper, and compared there as sets; words are never rows. Most
    pairs end at the bound that their sizes give.
    """
    tokens = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))
    e = evidence.select(*KEY).repartition("paper_seq").distinct().withColumn("t", tokens(F.col("norm"))).withColumn("ne", F.size("t")).where("ne > 0")
    p = _paragraphs(nodes).select("paper_seq", "node_id", tokens(F.col("p_norm")).alias("pt")).withColumn("np", F.size("pt")).where("np > 0")
    both, ne, np = F.size(F.array_intersect("t", "pt")), F.col("ne"), F.col("np")
    pairs = e.join(p, "paper_seq").where(F.least(ne, np) / F.greatest(ne, np) >= least)
    pairs = pairs.where(both >= F.greatest(F.lit(1.0), F.lit(least / (1 + least)) * (ne + np) - 1e-6))  # the sets are met once; the exact figure is for the few left
    score = pairs.select(*KEY, "node_id", (both / (ne + np - both)).alias("j")).where(F.col("j") >= least)
    best = F.rank().over(W.partitionBy(*KEY).orderBy(F.desc("j")))
    return score.withColumn("r", best).where("r = 1").select(*KEY, "node_id")


def _of_papers(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Paragraphs of papers that have evidence left, before anything of them is shuffled."""
    return sized_join(nodes, evidence.select("paper_seq").distinct(), ["paper_seq"])


def tiered(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """(paper_seq, norm, tier, node_id): the first tier that finds anything.

    What several tiers read is written once: the distinct evidence, the paragraphs, the hits.
    """
    nodes = cut(nodes.select("paper_seq", "node_id", "text"))
    distinct = cut(evidence.select(*KEY).distinct())
    one = cut(exact(distinct, nodes))
    rest = cut(distinct.join(one.select(*KEY).distinct(), KEY, "left_anti"))
    two = cut(contained(rest, _of_papers(nodes, rest)))
    rest = cut(rest.join(two.select(*KEY).distinct(), KEY, "left_anti"))
    three = similar(rest, _of_papers(nodes, rest))
    return one.withColumn("tier", F.lit(1)).unionByName(two.withColumn("tier", F.lit(2))).unionByName(three.withColumn("tier", F.lit(3)))


def evidence_nodes(answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(paper_seq, question_index, answer_index, node_ids): distinct, by evidence, then node order."""
    rows = cut(evidence_rows(answers))
    hits = rows.join(tiered(rows, nodes), KEY)
    first = hits.groupBy("paper_seq", "question_index", "answer_index", "node_id").agg(F.min("evidence_pos").alias("pos"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "node_id")))
    return first.groupBy("paper_seq", "question_index", "answer_index").agg(F.transform(ordered, lambda x: x["node_id"]).alias("node_ids"))
