"""JSON lines sources and sinks, and small JSON documents."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docweave.session import cut, exists


def read(spark: SparkSession, path: str, schema: StructType | str, most: int = 0, order: str = "record_seq") -> DataFrame:
    """JSON lines with a fixed schema; ``most`` keeps a prefix by the sequence column."""
    df = spark.read.schema(schema).json(path)
    return df.where(F.col(order) <= most) if most else df


def write(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines with null fields kept."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_kept_and_skipped(df: DataFrame, kept: str, skipped: str, reason: str = "skip_reason") -> None:
    """Two sinks of one frame, evaluated once: rows without, and rows with a reason."""
    df = cut(df)
    write(df.where(F.col(reason).isNull()).drop(reason), kept)
    write(df.where(F.col(reason).isNotNull()), skipped)


def save_document(value: dict, path: str) -> None:
    """A small indented JSON file, such as a row of metrics."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(safe(value), f, ensure_ascii=False, indent=2)


def safe(value):
    """Values that JSON can hold: arrays to lists, numpy scalars to numbers, others to text."""
    if isinstance(value, dict):
        return {str(k): safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [safe(v) for v in value]
    if value is None or isinstance(value, (str, bool, int, float)):
        return value
    if hasattr(value, "tolist"):
        return safe(value.tolist())
    return str(value)


def count_lines(spark: SparkSession, path: str, most: int = 0) -> int:
    """Lines that are not blank, at most ``most`` if given."""
    n = spark.read.text(path).where("trim(value) <> ''").count()
    return min(n, most) if most else n


def jobs(inputs: list[str], outputs: list[str]) -> list[tuple[str, str]]:
    """Inputs with their outputs; as many of each."""
    if len(inputs) != len(outputs) or not inputs:
        raise ValueError("as many inputs as outputs are needed")
    return list(zip(inputs, outputs))


def require(paths: list[str], stage: str, spark: SparkSession | None = None) -> None:
    """All files a stage reads must be there; with a session on any storage."""
    missing = [p for p in paths if not (exists(spark, p) if spark else os.path.exists(p))]
    if missing:
        raise FileNotFoundError(f"{stage} needs {', '.join(missing)}")


def done_ids(spark: SparkSession, paths: list[str], key: str = "id") -> DataFrame:
    """Ids already written, on any storage; a row without one is an error that names the file and the row."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], f"{key} string")
    rows = spark.read.schema(f"`{key}` string, `__broken` string").option("columnNameOfCorruptRecord", "__broken").json(there)
    rows = rows.select(F.col(key), F.concat_ws(" ", F.lit("a written row has no id:"), F.col("_metadata.file_path"), F.substring("__broken", 1, 200)).alias("__error"))
    return rows.select(F.when(F.coalesce(F.col(key), F.lit("")) == "", F.raise_error(F.col("__error")).cast("string")).otherwise(F.col(key)).alias(key)).distinct()
