"""Sharding by jump consistent hashing.

A stable key (a hash of the id) and the shard count alone decide a row's shard: no ring table, and one
more shard takes rows only into itself, about 1 in ``shards + 1`` of them.

One pass writes (id, size, crc, shard, place) where the place counts a task's rows of that shard; a
row's slot is its place plus the rows of the shard in earlier tasks, summed from the written table.
So no shard is sorted or gathered in one task, whatever its size.

Defined cases: null text has no bytes, size 1 and crc 0; null ids share one key; equal ids share a
shard; repeated rows each get a slot; an empty table gives no rows; texts of any length are rows like
others; columns of any name stay, but for ``shard`` and ``slot``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .scratch import Scratch, fresh, small


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Lamping and Veach's jump consistent hash of unsigned 64-bit keys, all at once."""
    key = keys.astype(np.uint64).copy()
    bucket, jump = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    while len(going):
        going = going[jump[going] < shards]
        bucket[going] = jump[going]
        key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
        jump[going] = ((bucket[going] + 1) * (float(1 << 31) / ((key[going] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
    return bucket


_ADDED = ("_shard", "_grown", "_part", "_place")


def _place(shards: int, added=_ADDED):
    """Adds to rows whose last column is the key: shard, the shard with one more, the task and the row's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(shards, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            key = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            now, grown = jump_hash(key, shards), jump_hash(key, shards + 1)
            order = np.argsort(now, kind="stable")
            count = np.bincount(now, minlength=shards)
            place = np.empty(len(now), np.int64)
            place[order] = np.arange(len(now)) - np.repeat(np.cumsum(count) - count, count)
            place += seen[now]
            seen += count
            cols = [*batch.columns[:-1], pa.array(now.astype(np.int32)), pa.array(grown.astype(np.int32)), pa.array(np.full(len(now), part, np.int32)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], *added])

    return run


def _slots(placed: DataFrame, scratch: Scratch, slot: str, added=_ADDED) -> DataFrame:
    """Adds ``slot``.  The offsets have one row for each task and shard."""
    shard, _, part, place = added
    n, before = fresh(placed, "_n", "_before")
    offsets = placed.groupBy(shard, part).agg(F.count("*").alias(n))
    earlier = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(shard, part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    offsets = scratch.write(offsets, "offsets")
    return placed.join(small(offsets, offsets.count()), [shard, part]).withColumn(slot, F.col(place) + F.col(before))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard); size is the text's UTF-8 bytes plus 1."""
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(F.col(id_col).cast("long")).alias("key"))
    placed = rows.mapInArrow(_place(shards), "doc_id long, size long, text_crc32 long, _shard int, _grown int, _part int, _place long")
    out = _slots(scratch.write(placed, "placed"), scratch, "_slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.col("_grown").alias("grown_shard"))


def with_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id") -> DataFrame:
    """The documents with two more columns, ``shard`` and ``slot``; columns of these names are replaced."""
    scratch = Scratch(docs.sparkSession, "shards")
    own = docs.drop("shard", "slot")
    key, slot, *added = fresh(own, "_key", "_slot", *_ADDED)
    schema = StructType([*own.schema.fields, *(StructField(c, t) for c, t in zip(added, (IntegerType(), IntegerType(), IntegerType(), LongType())))])
    placed = own.withColumn(key, F.xxhash64(F.col(id_col).cast("long"))).mapInArrow(_place(shards, added), schema)
    out = _slots(scratch.write(placed, "placed"), scratch, slot, added)
    return out.select(*(F.col(f"`{c}`") for c in own.columns), F.col(added[0]).alias("shard"), F.col(slot).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id") -> None:
    """Write the documents to one folder for each shard."""
    with_shards(docs, shards, id_col).write.mode("overwrite").partitionBy("shard").parquet(path)
