"""Problem 1: top N items within every group, by secondary sort.

Rows are sorted by (group, score, identifiers) inside each partition and streamed as
Arrow batches; a group's first N distinct items are emitted, the rest is skipped
without being held. The same streaming pass runs before the shuffle, where it acts as
a combiner: a group with a third of all rows leaves at most N rows per map partition,
so no task ever receives a hot group whole and one shuffle of the survivors is enough.

Defined results: rows whose score is null or NaN do not count; an item scored more than
once counts once, with its highest score; equal scores are ordered by the item columns,
ascending, nulls first; -0.0 equals 0.0; a null group key is a group of its own; other
columns are ignored; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NOTHING = object()


def _first_distinct(n: int, n_items: int):
    """Streams sorted (group, items..., score) batches, keeping N distinct items per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = _NOTHING, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = [batch.column(i).dictionary_encode() for i in range(1 + n_items)]
            codes = [c.indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in coded]
            values = [[*c.dictionary.to_pylist(), None] for c in coded]
            starts = np.concatenate(([0], np.flatnonzero(np.diff(codes[0])) + 1, [batch.num_rows]))
            keep: list[int] = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                group = values[0][codes[0][a]]
                if current is _NOTHING or group != current:
                    current, seen = group, set()
                j = a
                while j < b and len(seen) < n:
                    item = tuple(v[c[j]] for v, c in zip(values[1:], codes[1:]))
                    if item not in seen:
                        seen.add(item)
                        keep.append(j)
                    j += 1
            if keep:
                yield batch.take(pa.array(keep, pa.int64()))

    return run


def top_n_per_group(df: DataFrame, group: str, items: list[str], score: str, n: int = 12) -> DataFrame:
    """The N highest scored distinct items of each group: columns group, items, score."""
    if n < 1:
        raise ValueError("n must be positive")
    rows = df.select(group, *items, (F.col(score).cast("double") + F.lit(0.0)).alias(score))
    rows = rows.where(F.col(score).isNotNull() & ~F.isnan(score))
    order = [F.col(group), F.col(score).desc(), *[F.col(i).asc_nulls_first() for i in items]]
    step = _first_distinct(n, len(items))
    combined = rows.sortWithinPartitions(*order).mapInArrow(step, rows.schema)
    return combined.repartition(F.col(group)).sortWithinPartitions(*order).mapInArrow(step, rows.schema)


def seed_candidates(df: DataFrame, n: int = 12) -> DataFrame:
    """Per record the array<struct<paper_id,node_id,score,rank>> for ``query.seed_candidates``.

    Each array has at most N elements, so collecting it is bounded.
    """
    top = top_n_per_group(df, "record_id", ["paper_id", "node_id"], "score", n)
    key = F.struct((-F.col("score")).alias("o"), "paper_id", "node_id", "score")
    ranked = top.groupBy("record_id").agg(F.array_sort(F.collect_list(key)).alias("s"))
    made = F.transform("s", lambda x, i: F.struct(x["paper_id"].alias("paper_id"), x["node_id"].alias("node_id"), x["score"].alias("score"), (i + 1).alias("rank")))
    return ranked.select("record_id", made.alias("seed_candidates"))
