"""Shards by jump consistent hashing: the id and the number of shards decide, no table does."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.store import shuffle_partitions, stored

_STEP = np.uint64(2862933555777941757)
_NO_ID = -1


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; with one more shard, keys only move into the new one."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    at = np.zeros(len(state), np.int64)
    while len(going):
        shard[going] = at
        state[going] = state[going] * _STEP + np.uint64(1)
        at = np.floor((shard[going] + 1) * (2.0**31 / ((state[going] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        more = at < shards
        going, at = going[more], at[more]
    return shard


def _number(shards: int):
    def number(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            keys = np.asarray(batch.column("doc_id").fill_null(_NO_ID))
            shard, grown = jump(keys, shards), jump(keys, shards + 1)
            nth = np.zeros(len(keys), np.int64)
            for s in range(shards):
                here = np.flatnonzero(shard == s)
                nth[here] = seen[s] + np.arange(len(here))
                seen[s] += len(here)
            new = [pa.array(shard, pa.int32()), pa.array(grown, pa.int32()), pa.array(np.full(len(keys), part), pa.int32()), pa.array(nth)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "shard", "grown_shard", "part", "nth"])

    return number


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the UTF-8 bytes of the text plus one (null: one), ``slot`` numbers a shard's
    rows from 0 without gaps by id, then checksum and size; rows equal in all three are
    interchangeable. ``grown_shard`` is the shard if there were one more. A null id
    counts as -1 and comes first. Numbers come from a range sort with one count per range and
    shard, so no task holds a shard.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    kinds = "doc_id long, size long, text_crc32 long, shard int, grown_shard int, part int, nth long"
    ranged = narrow.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    rows = stored(ranged.mapInArrow(_number(shards), kinds))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    # One row per shard and range partition: bounded by the settings, whatever the input.
    return rows.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("nth")).alias("slot"), "grown_shard"
    )
