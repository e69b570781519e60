"""Bitmaps over 64-bit hashes: filters of fixed size, made by all tasks and merged piece by piece."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNKS = 64


def _marks(bits: int):
    """Of a column of longs one bitmap a task, in packed pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy() & ((1 << bits) - 1)
            np.bitwise_or.at(seen, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        parts = [(i, zlib.compress(p.tobytes(), 1)) for i, p in enumerate(np.split(seen, CHUNKS)) if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["chunk", "cells"])

    return run


def _or_marks(bits: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << bits) // CHUNKS // 8, np.uint8)
        for batch in batches:
            for x in batch.column(1):
                total |= np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "cells"])

    return run


def filter_of(longs: DataFrame, bits: int) -> np.ndarray:
    """A one-hash Bloom filter of 2^bits bits, packed: the same size for any input."""
    out = np.zeros((1 << bits) // 8, np.uint8)
    width = len(out) // CHUNKS
    for r in longs.mapInArrow(_marks(bits), "chunk int, cells binary").groupBy("chunk").applyInArrow(_or_marks(bits), "chunk int, cells binary").collect():
        out[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(r.cells, np.uint8)
    return out


def marked(packed: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = x & (8 * len(packed) - 1)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
