"""Vector scores, rankings and score normalization per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docweave.session import cut, sized_join


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def text_dictionary(*texts: DataFrame) -> DataFrame:
    """Distinct texts of one-column frames, so that each is embedded once."""
    out = texts[0].toDF("text")
    for t in texts[1:]:
        out = out.unionByName(t.toDF("text"))
    return out.where("text IS NOT NULL").distinct()


def ranked(scores: DataFrame, record: str = "record_id", *node: str) -> DataFrame:
    """Rank from 1 by score, then node."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(record).orderBy(F.desc("score"), *(node or ("node_id",)))))


def top_k(scores: DataFrame, k: int = 12, record: str = "record_id", *node: str) -> DataFrame:
    """The best k nodes of each record; the rank filter limits groups before the shuffle."""
    return ranked(scores, record, *node).where(F.col("rank") <= k)


def min_max(scores: DataFrame, record: str = "record_id") -> DataFrame:
    """Scores of each record scaled to 0..1; all 0 if they are equal. Non-finite ones are an error.

    The bounds are aggregated before the shuffle and joined back, so a hot record stays spread.
    """
    s = F.col("score")
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    bounds = cut(scores.groupBy(record).agg(F.min("score").alias("__low"), F.max("score").alias("__high")))
    norm = (s - F.col("__low")) / F.greatest(F.col("__high") - F.col("__low"), F.lit(1e-6))
    held = sized_join(scores, bounds, [record])
    return held.withColumn("norm_score", F.when(bad, F.raise_error(F.lit("score is not finite")).cast("double")).otherwise(norm)).drop("__low", "__high")


def summary_text(title: Column, summary: Column) -> Column:
    """Section title and summary as one text, the title left out if blank."""
    return F.concat_ws(" ", F.when(F.trim(F.coalesce(title, F.lit(""))) != "", F.trim(title)), F.coalesce(summary, F.lit("")))


def question_scores(pairs: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Similarity of each (key, question, text) pair by a dictionary of distinct texts' vectors."""
    v = lambda name: vectors.select(F.col("text").alias(name), F.col("vector").alias(f"{name}_v"))
    both = pairs.join(v("question"), "question").join(v("passage"), "passage")
    return both.select(key, "question", "passage", dot(F.col("question_v"), F.col("passage_v")).alias("score"))


def mean_scores(scores: DataFrame, key: str = "id") -> DataFrame:
    """Mean over the questions of a key: the raw relevance of its passage."""
    return scores.groupBy(key).agg(F.avg("score").alias("raw_score"), F.count("*").alias("n"))
