"""Incremental runs with Structured Streaming: append with resume, nodes of new papers, windows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import compact, is_routable, section_title, words


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str = "id"):
    """Appends rows whose key is not in the sink yet; each trigger is exactly once per key.

    Available data are processed, then the query ends: an incremental batch run.
    """

    def write(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        try:
            done = spark.read.parquet(path).select(key)
        except AnalysisException:  # nothing is written yet
            done = None
        if done is not None:
            rows = rows.join(done, key, "left_anti")
        rows.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def paragraph_stream(papers: DataFrame) -> DataFrame:
    """Routable paragraphs of a stream of papers; ids need the whole paper, so they come later."""
    none = F.array().cast("array<struct<section_name:string,paragraphs:array<string>>>")
    zipped = F.transform(
        F.arrays_zip(F.coalesce("full_text_cols.section_name", F.array().cast("array<string>")).alias("a"), F.coalesce("full_text_cols.paragraphs", F.array().cast("array<array<string>>")).alias("b")),
        lambda x: F.struct(x["a"].alias("section_name"), x["b"].alias("paragraphs")),
    )
    both = F.coalesce("full_text", F.when(F.col("full_text_cols").isNotNull(), zipped), none)
    s = papers.select("paper_seq", "loaded_at", F.posexplode(both).alias("section_index", "s"))
    p = s.select("paper_seq", "loaded_at", "section_index", section_title(F.col("s.section_name"), F.col("section_index")).alias("section_title"), F.posexplode("s.paragraphs").alias("paragraph_index", "raw"))
    p = p.withColumn("text", compact(F.col("raw"))).drop("raw")
    return p.where(is_routable(F.col("text"), F.col("section_title"))).withColumn("token_hint", F.greatest(F.size(words(F.col("text"))), F.lit(1)))


def event_windows(events: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Counts and sums per window and type, with a watermark for late rows."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )


def run_to_files(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Runs an aggregated stream over all available data in update mode; the last row of each key.

    Each trigger appends the rows that changed, with its number; nothing meets on the driver,
    and the state of windows behind the watermark is dropped.
    """
    spark: SparkSession = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("__epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{path}/epoch={epoch:012d}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    try:
        rows = spark.read.schema(stream.select("*", F.lit(0).cast("bigint").alias("__epoch")).schema).parquet(f"{path}/*")
    except AnalysisException:  # no trigger ran
        return spark.createDataFrame([], stream.schema)
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "__epoch").alias(c) for c in values]).select(*stream.columns)
