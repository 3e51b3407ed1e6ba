"""Answer and evidence metrics, and losses, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docweave.functions.text import score_text, words


def exact_match(a: Column, b: Column) -> Column:
    return (score_text(a) == score_text(b)).cast("double")


def token_f1(prediction: Column, target: Column) -> Column:
    """F1 of the bags of words; 1 if both are empty, 0 if one is."""
    p, t = words(score_text(prediction)), words(score_text(target))
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    common = F.aggregate(F.array_intersect(p, t), F.lit(0), lambda n, x: n + F.least(count(p, x), count(t, x)))
    precision, recall = common / F.size(p), common / F.size(t)
    return F.when((F.size(p) == 0) & (F.size(t) == 0), 1.0).when((F.size(p) == 0) | (F.size(t) == 0) | (common == 0), 0.0).otherwise(2 * precision * recall / (precision + recall))


def set_f1(prediction: Column, target: Column) -> Column:
    """F1 of the sets; 1 if both are empty."""
    empty = F.array().cast("array<int>")
    p, t = F.array_distinct(F.coalesce(prediction, empty)), F.array_distinct(F.coalesce(target, empty))
    both = F.size(F.array_intersect(p, t))
    return F.when((F.size(p) == 0) & (F.size(t) == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(p) + F.size(t)))


def best_answer(prediction: Column, references: Column) -> tuple[Column, Column]:
    """(best F1, best exact match) over an array of reference answers, 0 without any."""
    f1 = F.coalesce(F.array_max(F.transform(references, lambda r: token_f1(prediction, r))), F.lit(0.0))
    em = F.coalesce(F.array_max(F.transform(references, lambda r: exact_match(prediction, r))), F.lit(0.0))
    return f1, em


def best_evidence(prediction: Column, references: Column) -> tuple[Column, Column]:
    """(best set F1, best set equality) over an array of evidence sets, 0 without any."""
    f1 = F.coalesce(F.array_max(F.transform(references, lambda r: set_f1(prediction, r))), F.lit(0.0))
    em = F.coalesce(F.array_max(F.transform(references, lambda r: (F.array_sort(F.array_distinct(r)) == F.array_sort(F.array_distinct(prediction))).cast("double"))), F.lit(0.0))
    return f1, em


def first_per_question(records: DataFrame, order: str = "record_seq") -> DataFrame:
    """The first record of each (paper, question), by an explicit order."""
    w = W.partitionBy("paper_id", "question_id").orderBy(order)
    return records.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def prediction_metrics(rows: DataFrame) -> DataFrame:
    """Macro means and the count of prediction rows; missing values count 0."""
    names = ("answer_f1", "answer_em", "evidence_f1", "evidence_em")
    return rows.agg(*[F.coalesce(F.avg(F.coalesce(F.col(n), F.lit(0.0))), F.lit(0.0)).alias(n) for n in names], F.count("*").cast("double").alias("count"))


def efficiency_means(rows: DataFrame, stats: str = "stats") -> DataFrame:
    """Means of a map column's keys over all rows; a missing key counts 0."""
    n = rows.agg(F.count("*").alias("n"))
    each = rows.select(F.explode(stats).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))
    return each.crossJoin(F.broadcast(n)).select(F.concat(F.lit("eff_"), "key", F.lit("_avg")).alias("metric"), (F.col("total") / F.col("n")).alias("value"))  # n is one row


def preference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1) -> Column:
    """-log sigmoid of beta times the margin over the reference, stable for any size."""
    x = beta * ((chosen - rejected) - (ref_chosen - ref_rejected))
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def policy_loss(route_loss: Column, reference_loss: Column, log_prob: Column, entropy: Column, weight: float = 1.0, entropy_weight: float = 0.01) -> Column:
    return weight * (route_loss - reference_loss) * log_prob - entropy_weight * entropy
