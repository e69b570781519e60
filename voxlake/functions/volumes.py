"""Volumes: sparse rows (b, r, c, value) as DataFrames, dense arrays inside one task.

0 is missing: rows of 0 may be left out and an absent row is 0.  A stencil is a table of offsets; pure
DataFrame stencils explode offsets and join by equality, so they shuffle by voxel and never by range.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOXEL = ("b", "r", "c")
TINY = 1e-6


def offsets(kind: int | str, radius: int = 1) -> list[tuple[int, int, int]]:
    """Neighbours with the centre: 6, 18, 26, ``sphere`` of a radius, or ``cube`` without its far corners."""
    reach = range(-radius, radius + 1)
    every = list(itertools.product(reach, reach, reach))
    near = {6: 1, 18: 2, 26: 3}
    if kind in near:
        return [o for o in itertools.product((-1, 0, 1), repeat=3) if sum(map(abs, o)) <= near[kind]]
    if kind == "sphere":
        return [o for o in every if sum(x * x for x in o) <= radius * radius]
    if kind == "cube":
        return [o for o in every if min(map(abs, o)) < radius]
    raise ValueError(kind)


def dense(pdf: pd.DataFrame, shape: tuple[int, int, int], value: str = "value") -> np.ndarray:
    out = np.zeros(shape)
    out[pdf.b.to_numpy(), pdf.r.to_numpy(), pdf.c.to_numpy()] = pdf[value].to_numpy()
    return out


def sparse(a: np.ndarray, every: bool = False) -> pd.DataFrame:
    b, r, c = np.indices(a.shape).reshape(3, -1) if every else np.nonzero(a)
    return pd.DataFrame({"b": b.astype(np.int32), "r": r.astype(np.int32), "c": c.astype(np.int32), "value": a[b, r, c].astype(float)})


def per_volume(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int, int], keys: Iterable[str] = (), every: bool = False) -> DataFrame:
    """``f`` of each volume as a dense array; a volume is a group of ``keys`` and stays in one task."""
    keys = list(keys)
    df = df if keys else df.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    types = dict(df.dtypes)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = sparse(f(dense(pdf, shape)), every)
        for name, k in zip(by, key):
            out.insert(0, name, k)
        return out[[*by, "b", "r", "c", "value"]]

    out = df.groupBy(*by).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in by) + ", b int, r int, c int, value double")
    return out if keys else out.drop("_all")


def shift(df: DataFrame, table: list[tuple[int, int, int]], keys: Iterable[str] = ()) -> DataFrame:
    """One row for each voxel and offset, at the voxel that has it as a neighbour: (keys, b, r, c, value, db, dr, dc)."""
    o = F.explode(F.array(*(F.struct(F.lit(x).alias("db"), F.lit(y).alias("dr"), F.lit(z).alias("dc")) for x, y, z in table)))
    out = df.select(*keys, "b", "r", "c", "value", o.alias("o"))
    return out.select(*keys, (F.col("b") - F.col("o.db")).alias("b"), (F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c"), "value", "o.db", "o.dr", "o.dc")


def stencil(df: DataFrame, table: list[tuple[int, int, int]], aggs: list[Column], keys: Iterable[str] = (), centres: DataFrame | None = None) -> DataFrame:
    """Aggregates over the present neighbours of each centre (of ``df`` itself by default)."""
    keys = list(keys)
    at = [*keys, *VOXEL]
    centres = (centres if centres is not None else df).select(*at, F.col("value").alias("centre"))
    return shift(df, table, keys).join(centres, at).groupBy(*at).agg(F.first("centre").alias("centre"), *aggs)


def inside(df: DataFrame, shape: tuple[int, int, int], margin: int) -> Column:
    """Whether a voxel is at least ``margin`` from every face."""
    return F.lit(True) if not margin else (F.least(*(F.least(F.col(x), F.lit(n - 1) - F.col(x)) for x, n in zip(VOXEL, shape))) >= margin)


def roll(a: np.ndarray, o: tuple[int, ...], fill: float = 0.0) -> np.ndarray:
    """out[x] = a[x + o], ``fill`` beyond the edge."""
    out = np.full_like(a, fill)
    src = tuple(slice(max(0, d), a.shape[i] + min(0, d)) for i, d in enumerate(o))
    dst = tuple(slice(max(0, -d), a.shape[i] + min(0, -d)) for i, d in enumerate(o))
    out[dst] = a[src]
    return out


def neighbours(a: np.ndarray, table: Iterable[tuple[int, int, int]], fill: float = 0.0) -> np.ndarray:
    """One array for each offset, stacked first."""
    return np.stack([roll(a, o, fill) for o in table])
