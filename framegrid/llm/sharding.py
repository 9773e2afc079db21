"""Sharding by jump consistent hashing.

The shard of a row follows from its key and the number of shards alone: no ring table, no state. When
one more shard is appended, a row either stays or moves into the new shard, and about one row in
``shards + 1`` moves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.llm.common import cut, map_batches

_MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to ``shards`` - 1, of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = keys.astype(np.uint64, copy=True)
    at, ahead = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * _MULTIPLIER + np.uint64(1)
        ratio = float(1 << 31) / ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[live] = ((at[live] + 1) * ratio).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard): one row per row of ``docs``.

    ``shard`` and ``grown_shard`` are the key's shards among ``shards`` and ``shards`` + 1; the key is
    the id (null: 0) as an unsigned 64-bit number. ``slot`` counts a shard's rows from 0 without gaps in
    the order of (id, text_crc32, size), nulls first; repeated rows take consecutive slots. ``size`` is
    the text's UTF-8 bytes plus 1 (null text: 1) and ``text_crc32`` its CRC-32 (null text: 0). An empty
    table gives an empty result; further columns are not read.

    Slots need no task that sees a whole shard: rows are dealt by ranges of the order, counted in their
    range, and shifted by the counts of the ranges before. Rows that repeat throughout are told apart by
    their place in the table, so that very many of them still go to several ranges.
    """
    text = F.col(text_col).cast("binary")
    thin = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("text_crc32"),
    )
    thin = thin.withColumn("place", F.monotonically_increasing_id())
    order = ["doc_id", "text_crc32", "size", "place"]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = thin.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("place")
    schema = "doc_id long, size long, text_crc32 long, shard int, grown_shard int, part int, rank long"

    def number(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            keys = batch.column(0).fill_null(0).to_numpy().view(np.uint64)
            own, grown = jump_hash(keys, shards), jump_hash(keys, shards + 1)
            rank = np.empty(len(own), np.int64)
            for k in np.unique(own):
                of = np.flatnonzero(own == k)
                rank[of] = seen[k] + np.arange(len(of))
                seen[k] += len(of)
            cols = [pa.array(own.astype(np.int32)), pa.array(grown.astype(np.int32)), pa.array(np.full(len(own), part, np.int32)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], ["doc_id", "size", "text_crc32", "shard", "grown_shard", "part", "rank"])

    ranked = cut(map_batches(dealt, number, schema))
    before = (
        ranked.groupBy("shard", "part")
        .agg(F.count("*").alias("n"))
        .selectExpr("shard", "part", "cast(coalesce(sum(n) over (partition by shard order by part rows between unbounded preceding and 1 preceding), 0) as bigint) as shift")
    )
    # One row for each shard and range: their number is bounded by shards * parts, so it is checked here.
    if shards * parts * 16 <= 8 << 20:
        before = F.broadcast(before)
    return ranked.join(before, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") + F.col("shift")).alias("slot"), "grown_shard"
    )
