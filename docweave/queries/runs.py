"""Queries that run plans, plug-ins and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave.models.plugins import ExtractiveGenerator, HashingEmbedder, generate
from docweave.plans import pipeline
from docweave.queries.documents import DOCS
from docweave.session import shared_dir, table
from docweave.streaming import incremental


def _stream(spark, d, name):
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")


def stream_event_windows(spark, d):
    base = f"{shared_dir(spark)}/docweave-stream-{uuid.uuid4().hex}"
    out = incremental.run_to_files(incremental.event_windows(_stream(spark, d, "events")), f"{base}/rows", f"{base}/checkpoint", ["window_start", "event_type"])
    return out.select("window_start", "event_type", "n", F.round("total", 2).alias("total"))


def stream_paragraphs(spark, d):
    """Papers as a stream into a sink that takes each paragraph once, run twice."""
    base = f"{shared_dir(spark)}/docweave-stream-{uuid.uuid4().hex}".removeprefix("file:")
    for k in (0, 1):
        s = incremental.paragraph_stream(_stream(spark, d, "papers")).withColumn("id", F.concat_ws(":", "paper_seq", "section_index", "paragraph_index"))
        incremental.append_new(s, f"{base}/rows", f"{base}/checkpoint{k}").awaitTermination()
    return spark.read.parquet(f"{base}/rows").select("paper_seq", "section_index", "paragraph_index", "token_hint")


def pipeline_links(spark, d):
    made = pipeline.link(pipeline.prepare(table(spark, d, "papers")), ExtractiveGenerator())
    return made.select("paper_seq", "src", "dst", "edge_type", "link_phrase", "attempts")


def pipeline_link_keys(spark, d):
    """Links of the whole stage and how often each was asked for: the built-in generator never names a label."""
    return pipeline_links(spark, d).select("paper_seq", "src", "dst", "edge_type", "attempts")


def pipeline_route(spark, d):
    p = pipeline.prepare(table(spark, d, "papers"))
    return pipeline.route(p, pipeline.retrieve(p, HashingEmbedder())[0])


def generated_candidates(spark, d):
    prompts = table(spark, d, "nodes").select(F.col("text").alias("prompt"))
    return generate(prompts, ExtractiveGenerator(), 4, 2).groupBy("cand").agg(F.count("*").alias("n"), F.countDistinct("output").alias("distinct_outputs"))


QUERIES = {f.__name__: f for f in (stream_event_windows, stream_paragraphs, pipeline_links, pipeline_link_keys, pipeline_route, generated_candidates)}

SQL = {
    "pipeline_link_keys": DOCS
    + """, o AS (SELECT paper_seq, node_id AS src, lead(node_id) OVER w AS nx, lag(node_id) OVER w AS pv FROM nod WINDOW w AS (PARTITION BY paper_seq ORDER BY section_index, paragraph_index, node_id))
SELECT paper_seq, CAST(src AS INTEGER) AS src, CAST(nx AS INTEGER) AS dst, 'paragraph_next' AS edge_type, 3 AS attempts FROM o WHERE nx IS NOT NULL
UNION ALL SELECT paper_seq, CAST(src AS INTEGER), CAST(pv AS INTEGER), 'paragraph_prev', 3 FROM o WHERE pv IS NOT NULL""",
    "stream_event_windows": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(coalesce(value, 0)), 2) AS total FROM events GROUP BY ALL",
    "stream_paragraphs": DOCS + "SELECT paper_seq, CAST(section_index AS INTEGER) AS section_index, CAST(paragraph_index AS INTEGER) AS paragraph_index, CAST(token_hint AS INTEGER) AS token_hint FROM nod",
}
