"""Paper files: JSON or JSON lines, in both encodings of the nested fields.

``full_text``, ``qas`` and ``answers`` may be row lists or structs of parallel lists, from
row to row. They are read as VARIANT, so no schema is inferred, and brought to the two
typed columns per field that the operators take.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docweave.operators.documents import SPLITS
from docweave.session import cut, exists, sized_join

_ANSWER = "struct<unanswerable:boolean,extractive_spans:array<string>,free_form_answer:string,yes_no:boolean,evidence:array<string>>"
TYPES = {
    "full_text": "array<struct<section_name:string,paragraphs:array<string>>>",
    "full_text_cols": "struct<section_name:array<string>,paragraphs:array<array<string>>>",
    "qas": f"array<struct<question:string,question_id:string,answers:array<struct<annotation_id:string,worker_id:string,answer:{_ANSWER}>>>>",
    "qas_cols": f"struct<question:array<string>,question_id:array<string>,answers:array<struct<answer:array<{_ANSWER}>,annotation_id:array<string>,worker_id:array<string>>>>",
}


def _typed(v: Column, name: str) -> tuple[Column, Column]:
    """(row list, parallel lists) of a variant field, the other one null."""
    text = F.to_json(v)
    kind = F.substring(text, 1, 1)
    return (
        F.when(kind == "[", F.from_json(text, TYPES[name])).alias(name),
        F.when(kind == "{", F.from_json(text, TYPES[f"{name}_cols"])).alias(f"{name}_cols"),
    )


def from_variant(rows: DataFrame) -> DataFrame:
    """Typed papers of rows (paper_seq, v) with a VARIANT object each; other columns stay."""
    get = lambda p: F.try_variant_get("v", f"$.{p}", "string").alias(p)
    kept = [c for c in rows.columns if c not in ("paper_seq", "v")]
    return rows.select("paper_seq", *kept, *[get(p) for p in ("id", "paper_id", "title", "abstract")], *_typed(F.try_variant_get("v", "$.full_text", "variant"), "full_text"), *_typed(F.try_variant_get("v", "$.qas", "variant"), "qas"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One paper per line; blank and broken lines are skipped, paper_seq counts from 1 in file order.

    Lines are numbered where they are read; only the sizes of the files' parts meet.
    """
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.try_parse_json("value").alias("v"))
    lines = lines.where("v IS NOT NULL").withColumn("at", F.monotonically_increasing_id())
    sizes = lines.groupBy("file", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    rows = sized_join(lines, _offsets(sizes, ["file", "part"]), ["file", "part"])
    return from_variant(rows.select((F.col("before") + F.col("at") - F.col("first") + 1).alias("paper_seq"), "v"))


def _offsets(sizes: DataFrame, order: list[str]) -> DataFrame:
    """Rows before each part; one row a part, so one window holds them all."""
    before = F.coalesce(F.sum("n").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut(sizes.withColumn("before", before))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file documents: a list of papers, or an object of papers by id.

    Of an object, the key is taken where a paper lacks its own id; other values are dropped.
    paper_seq counts from 1 over the files in order of their paths. A file is read by one
    task, so large collections belong into JSON lines, whose files are split.
    """
    file = F.col("_metadata.file_path").alias("file")
    whole = spark.read.text(path, wholetext=True).select(file, F.try_parse_json("value").alias("v"))
    items = F.expr("filter(cast(v as array<variant>), x -> schema_of_variant(x) LIKE 'OBJECT%')")
    as_list = whole.where("schema_of_variant(v) LIKE 'ARRAY%'").select("file", F.posexplode(items).alias("at", "v"), F.lit(None).cast("string").alias("key"))
    entries = F.filter(F.map_entries(F.expr("cast(v as map<string, variant>)")), lambda e: F.schema_of_variant(e["value"]).like("OBJECT%"))
    as_map = whole.where("schema_of_variant(v) LIKE 'OBJECT%'").select("file", F.posexplode(entries).alias("at", "e"))
    rows = as_list.unionByName(as_map.select("file", "at", F.col("e.value").alias("v"), F.col("e.key").alias("key")))
    sizes = rows.groupBy("file").agg(F.count("*").alias("n"))
    rows = sized_join(rows, _offsets(sizes, ["file"]), ["file"])
    out = from_variant(rows.select((F.col("before") + F.col("at") + 1).alias("paper_seq"), "key", "v"))
    return out.withColumn("id", F.coalesce("id", "key")).withColumn("paper_id", F.coalesce("paper_id", "key")).drop("key")


def resolve(split: str, roots: list[str], folders: list[str] | None = None, pattern: str = "{split}.json", spark: SparkSession | None = None) -> str | None:
    """The first existing file of a split in the roots and their folders; with a session on any storage."""
    name = pattern.format(split=SPLITS.get(split.strip().lower(), split))
    for root in roots:
        for folder in folders or ["", "raw", "json", "data"]:
            path = os.path.join(root, folder, name)
            if exists(spark, path) if spark else os.path.exists(path):
                return path
    return None


def with_sequence(df: DataFrame, order: str, name: str = "record_seq") -> DataFrame:
    """A dense sequence number by an order column, from 1.

    Rows are range-partitioned and numbered in their parts; only the parts' sizes meet.
    """
    part = df.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    part = cut(part.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = part.groupBy("__p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a part
    start = sizes.select("__p", before.alias("__s"))
    return part.join(F.broadcast(start), "__p").withColumn(name, (F.col("__s") + F.col("__i") + 1).cast("bigint")).drop("__p", "__i", "__s")
