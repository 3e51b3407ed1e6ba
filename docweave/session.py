"""Session helpers: table access, lineage cuts, sized broadcasts, skew-proof joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    The setting of the session wins. Only where it is unset, as in local tests,
    a temporary folder of this machine is set as checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docweave-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder.

    A written table survives the loss of executors, is columnar (later reads prune
    columns) and carries sizes that the planner uses to choose joins.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_broadcast_rows: int = 200_000, salt: int = 16, max_broadcast_bytes: int = 16_000_000) -> DataFrame:
    """Join on keys that may be hot in ``big``; ``small`` has at most one row per key.

    ``small`` is measured first: up to ``max_broadcast_rows`` rows and ``max_broadcast_bytes``
    of them as text it is broadcast, as the driver holds all of a broadcast; beyond that ``big`` is salted and ``small`` repeated once per salt, so that a hot
    key is spread over ``salt`` tasks. ``how`` is inner or left.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in small.columns), F.lit(0).cast("bigint"))
    seen = small.select(width.alias("width")).limit(max_broadcast_rows + 1).agg(F.count("*").alias("n"), F.sum("width").alias("bytes")).first()
    if seen["n"] <= max_broadcast_rows and (seen["bytes"] or 0) <= max_broadcast_bytes:
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("__salt", (F.rand(7) * salt).cast("int"))
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return salted.join(spread, [*on, "__salt"], how).drop("__salt")


def hash_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """About ``n`` rows, never more, chosen by a hash of their keys; all rows if there are no more.

    A threshold on the hash comes first, so that no task sees more than a tenth above the sample.
    """
    total = df.count()
    if total <= n:
        return df
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
    few = df.where(place < int(1.1 * n / total * (1 << 30)))
    # the first n in order of the hash: the same rows whatever the order of the tasks
    return few.orderBy(place, *keys, F.xxhash64(*df.columns)).limit(n)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is at a path, on any storage that the session reads."""
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return True
