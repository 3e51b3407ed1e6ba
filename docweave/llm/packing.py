"""Problem 7: filling fixed-capacity containers with items, by minimum bin slack.

Sizes are counted on the JVM side with one regular expression. Items are dealt out
to tasks and each task packs blocks of a bounded number of items, independently of
the others. A block starts every container with its longest item and searches the
fullest feasible completion with a bitset subset-sum program over the available
lengths: bit s of the k-th set says that the first k candidates can fill exactly s
tokens. The best sum is traced back, its items are removed, and so on.

Defined results: null and blank texts hold no token and get no container; a document
over the capacity is cut into full pieces and one rest, all others stay whole; repeated
rows are packed once each; columns other than the id and the text are ignored; an empty
table gives no container.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HAN = r"\x{4E00}-\x{9FFF}"
SPACE = r"\s\p{Z}\x{85}\x0b\x1c-\x1f"
#: A Han character | a run of other letters and digits, format characters inside it dropped | another character.
WORD = rf"[{HAN}]|[\p{{L}}\p{{N}}&&[^{HAN}]][\p{{L}}\p{{N}}\p{{Cf}}&&[^{HAN}]]*|[^\p{{L}}\p{{N}}\p{{Cf}}{SPACE}]"
SCHEMA = "container string, id bigint, piece int, first_token bigint, n_tokens int, divided boolean"


def token_count(text: Column) -> Column:
    """Tokens by the word splitting of the public BERT tokenizer, without word pieces."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Packs sizes (each at most the capacity, any order) into containers: lists of positions."""
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        by_size.setdefault(s, []).append(i)
    lengths = sorted(by_size)
    whole = (1 << (capacity + 1)) - 1
    made = []
    while lengths:
        room = capacity - lengths[-1]
        chosen = [lengths[-1]]
        # longest first: the sums reached after each candidate, until one fills the room exactly
        if room and lengths[0] <= room:
            mask = whole >> (capacity - room)
            reached, sets, tried = 1, [1], []
            target = 1 << room
            for k in range(bisect_right(lengths, room) - 1, -1, -1):
                s = lengths[k]
                copies = min(len(by_size[s]) - (s == chosen[0]), room // s)
                for _ in range(copies):
                    more = reached | (reached << s) & mask
                    if more == reached:
                        break
                    reached = more
                    sets.append(reached)
                    tried.append(s)
                    if reached & target:
                        break
                if reached & target:
                    break
            left = reached.bit_length() - 1
            for k in range(len(tried), 0, -1):
                if not sets[k - 1] >> left & 1:
                    chosen.append(tried[k - 1])
                    left -= tried[k - 1]
        made.append([by_size[s].pop() for s in chosen])
        for s in set(chosen):
            if not by_size[s]:
                lengths.remove(s)
    return made


def _pack(capacity: int, block_items: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block = 0
        ids, sizes, pieces, firsts, divided = [], [], [], [], []

        def flush():
            out = [[], [], [], [], [], []]
            for c, at in enumerate(fill(sizes, capacity)):
                name = f"{part}-{block}-{c}"
                for i in at:
                    for col, v in zip(out, (name, ids[i], pieces[i], firsts[i], sizes[i], divided[i])):
                        col.append(v)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["container", "id", "piece", "first_token", "n_tokens", "divided"])

        for batch in batches:
            for i, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for p, at in enumerate(range(0, n, capacity)):
                    ids.append(i)
                    sizes.append(min(capacity, n - at))
                    pieces.append(p)
                    firsts.append(at)
                    divided.append(n > capacity)
                    if len(ids) >= block_items:
                        yield flush()
                        block += 1
                        ids, sizes, pieces, firsts, divided = [], [], [], [], []
        if ids:
            yield flush()

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, block_items: int = 20_000) -> DataFrame:
    """One row per document or piece with its container.

    ``block_items`` bounds the memory of a task, not the data: every item is packed.
    Only (id, size) pairs are shuffled, so that blocks hold a mixture of all sizes.
    """
    if capacity < 1 or block_items < 1:
        raise ValueError("capacity and block_items must be positive")
    sized = df.select(F.col(id_col).cast("bigint").alias("id"), token_count(F.col(text_col)).alias("n")).where("n > 0")
    # round robin over sorted rows: even tasks whatever repeats, the same on every attempt
    parts = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // block_items)))
    mixed = sized.repartition(parts).sortWithinPartitions(F.xxhash64("id"), "id", "n")
    return mixed.mapInArrow(_pack(capacity, block_items), SCHEMA)


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Containers, tokens, the least possible number of containers and the mean filling."""
    each = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"))
    made = each.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return made.withColumn("least_containers", F.ceil(F.col("tokens") / capacity)).withColumn("mean_fill", F.col("tokens") / (F.col("containers") * capacity))
