"""Pairs of rows by a grid of tiles.

Rows travel packed, blocks of arrays in a binary column.  Blocks belong to groups, and a task has two groups:
it holds the blocks of one and streams over those of the other.  The number of groups is bounded until one
outgrows what a task may hold, so what is shuffled grows as the rows do, while pairs grow as their square.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 512  # rows of a block; the products of two blocks stay in a core's cache
GROUPS = 16
HELD = 1 << 27  # bytes of a group

Block = dict[str, np.ndarray]
PACKED = "g int, n long, data binary"


def group_count(rows: int, row_bytes: int, size: int = PIECE) -> int:
    """Two blocks or more a group, 16 groups; more where a group would have more than 128 MB."""
    return max(1, min(GROUPS, -(-rows // (2 * size))), -(-rows * row_bytes // HELD))


def _rows(block: Block) -> int:
    return len(next(iter(block.values())))


def _cut(block: Block, size: int) -> Iterator[Block]:
    for k in range(0, _rows(block), size):
        yield {name: a[k : k + size] for name, a in block.items()}


def column(values: pd.Series) -> np.ndarray:
    """Arrays of one length as a matrix, others as they are."""
    if values.dtype != object or len({len(v) for v in values}) != 1:
        return values.to_numpy()
    return np.stack(values.to_numpy())


def _joined(blocks: Iterable[Block], size: int) -> Iterator[Block]:
    """The same rows in blocks of ``size``, but for the last; with ``size`` 0 the blocks as they are."""
    if not size:
        yield from blocks
        return
    wait: list[Block] = []
    for block in itertools.chain(blocks, [None]):
        if block is not None:
            wait.append(block)
        n = sum(map(_rows, wait))
        if wait and (block is None or n >= size):
            whole = wait[0] if len(wait) == 1 else {name: np.concatenate([w[name] for w in wait]) for name in wait[0]}
            done = n if block is None else n - n % size
            yield from _cut({name: a[:done] for name, a in whole.items()}, size)
            wait = [{name: a[done:] for name, a in whole.items()}] if done < n else []


def pack(rows: DataFrame, arrays: Callable[[pd.DataFrame], Block], groups: int, size: int = PIECE) -> DataFrame:
    """Blocks (g, n, data) of rows with a column vid.  Groups are ranges of it, in order; each row also has a ``key`` of its own."""
    at = np.unique(rows.approxQuantile("vid", [k / groups for k in range(1, groups)], 0.001)) if groups > 1 else np.zeros(0)

    def run(batches):
        part, done = TaskContext.get().partitionId(), 0
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.sort_values("vid")
            block = arrays(pdf)
            block["key"] = (part << 40) + done + np.arange(len(pdf))
            done += len(pdf)
            ends = np.searchsorted(pdf.vid.to_numpy(), at, side="left")
            out = [(g, b) for g, (i, j) in enumerate(zip([0, *ends], [*ends, len(pdf)])) if i < j for b in _cut({name: a[i:j] for name, a in block.items()}, size)]
            yield pd.DataFrame({"g": [g for g, _ in out], "n": [_rows(b) for _, b in out], "data": [pickle.dumps(b, protocol=5) for _, b in out]})

    return rows.mapInPandas(run, PACKED)


def grid(left: DataFrame, right: DataFrame | None, groups: int, others: int = 0) -> DataFrame:
    """(tile, side, same, data): a partition for each pair of groups, of each pair once where ``right`` is None (side 1 has the later group)."""

    def dealt(blocks, n, tile, side, same):
        o = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        return blocks.select("*", o.alias("o")).select(tile.cast("int").alias("tile"), side.cast("int").alias("side"), same.alias("same"), "data")

    g, o = F.col("g"), F.col("o")
    if right is None:
        low, high, tiles = F.least(g, o), F.greatest(g, o), groups * (groups + 1) // 2
        t = dealt(left, groups, F.floor(high * (high + 1) / 2) + low, o < g, o == g)
    else:
        tiles = groups * others
        t = dealt(left, others, g * others + o, F.lit(0), F.lit(False)).unionByName(dealt(right, groups, o * others + g, F.lit(1), F.lit(False)))
    return t.repartitionById(tiles, "tile").sortWithinPartitions("side")


def copies(blocks: DataFrame, n: int) -> DataFrame:
    """(tile, data): all blocks in each of n partitions."""
    return blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tile"), "data").repartitionById(n, "tile")


def over(tiles: DataFrame, f: Callable[[list[Block], Iterable[Block], bool], Iterator[pd.DataFrame]], schema: str, size: int = PIECE) -> DataFrame:
    """What f(held, streamed, same) yields of each tile.  Of a group with itself the streamed blocks are the held ones, in order."""

    def run(batches):
        rows = ((side, same, pickle.loads(data)) for pdf in batches for side, same, data in zip(pdf.side, pdf.same, pdf.data))
        mine, first, alike = [], [], False
        for side, same, block in rows:
            if side:
                first = [block]
                break
            mine.append(block)
            alike = bool(same)
        held = list(_joined(mine, size))
        if held and (alike or first):
            yield from f(held, held if alike else _joined(itertools.chain(first, (b for _, _, b in rows)), size), alike)

    return tiles.select("side", "same", "data").mapInPandas(run, schema)


def pairs(held: list[Block], streamed: Iterable[Block], same: bool) -> Iterator[tuple[list[Block], Block]]:
    """Each streamed block with the held ones it meets: those up to itself, where it is one of them."""
    for j, b in enumerate(streamed):
        yield (held[: j + 1] if same else held), b
