"""Spatial smoothing, masks and voxel arithmetic."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.volumes import TINY, VOXEL, inside, offsets, per_volume, roll, stencil


# -- on dense arrays -------------------------------------------------------------------------------


def lower_median(a: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Along the first axis, of the present values only; 0 where none is."""
    n = present.sum(axis=0)
    s = np.sort(np.where(present, a, np.inf), axis=0)
    out = np.take_along_axis(s, np.maximum((n - 1) // 2, 0)[None], 0)[0]
    return np.where(n > 0, out, 0.0)


def median_neighbours(x: np.ndarray, kind: int = 18) -> np.ndarray:
    """Lower median of present neighbours; 0 unless more than 9 (18) or 3 (6) are present.  With 6 the centre counts twice."""
    table = offsets(kind) + ([(0, 0, 0)] if kind == 6 else [])
    near = np.stack([roll(x, o) for o in table])
    on = np.abs(near) > 1e-10
    return np.where(on.sum(axis=0) > (9 if kind == 18 else 3), lower_median(near, on), 0.0)


def bilateral(x: np.ndarray, radius: int = 2, rvar: float = 2.0, svar: float = 2.0, iterations: int = 2) -> np.ndarray:
    """Edge-preserving mean: weights fall with the difference in value and with distance.

    Neighbours are the cube without its far corners, present values only.  Where half of them or fewer are
    present the median of 18 takes over.  Voxels within the radius of a face become 0.  The input stays as
    it is.
    """
    table = offsets("cube", radius)
    core = np.zeros(x.shape, bool)
    core[tuple(slice(radius, n - radius) for n in x.shape)] = True
    for _ in range(iterations):
        top, bottom, count = (np.zeros(x.shape) for _ in range(3))
        for o in table:
            u = roll(x, o)
            on = np.abs(u) >= 1e-10
            w = np.where(on, (1 - ((x - u) ** 2 / rvar + sum(d * d for d in o) / svar) / 2048) ** 2048, 0.0)  # about exp(-z)
            top, bottom, count = top + u * w, bottom + w, count + on
        full = (bottom > 0) & (count / len(table) > 0.5)
        out = np.where(full, top / np.where(bottom > 0, bottom, 1), median_neighbours(x))
        x = np.where(core & (np.abs(x) >= 1e-10), out, 0.0)
    return x


def gauss_kernel(sigma: float) -> np.ndarray:
    """Half-width int(3 sigma + 1), sum 1."""
    n = int(3 * sigma + 1)
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    return k / k.sum()


def convolve_axis(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Along one axis; at the faces the kernel's part inside, renormalised."""
    half = len(kernel) // 2
    top, weight = np.zeros(x.shape), np.zeros(x.shape)
    one = np.ones(x.shape)
    for i, k in enumerate(kernel):
        o = tuple(i - half if a == axis else 0 for a in range(x.ndim))
        top, weight = top + k * roll(x, o), weight + k * roll(one, o)
    return top / weight


def gauss3d(x: np.ndarray, fwhm: float, pixdim: tuple[float, float, float] = (1, 1, 1)) -> np.ndarray:
    for axis, d in enumerate(pixdim):
        if fwhm > 0:
            x = convolve_axis(x, gauss_kernel(fwhm / 2.355 / d), axis)
    return x


# -- on DataFrames ---------------------------------------------------------------------------------


def bilateral_filter(maps: DataFrame, shape: tuple[int, int, int], keys: Iterable[str] = (), **options) -> DataFrame:
    """The bilateral filter of each volume; volumes (permutations) are the unit of work."""
    return per_volume(maps, lambda a: bilateral(a, **options), shape, keys)


def bilateral_stencil(volume: DataFrame, shape: tuple[int, int, int], radius: int = 2, rvar: float = 2.0, svar: float = 2.0) -> DataFrame:
    """One pass of the bilateral mean in DataFrame operations alone, for volumes too large for one task.

    Voxels with half of their neighbours or fewer are left out (the dense form takes their median).
    """
    table = offsets("cube", radius)
    z = (F.col("centre") - F.col("value")) ** 2 / rvar + (F.col("db") ** 2 + F.col("dr") ** 2 + F.col("dc") ** 2) / svar
    w = F.pow(1 - z / 2048, F.lit(2048))
    out = stencil(volume, table, [F.count("*").alias("n"), (F.sum(F.col("value") * w) / F.sum(w)).alias("value")])
    return out.filter(inside(out, shape, radius) & (F.col("n") / len(table) > 0.5)).select(*VOXEL, "value")


def smooth(volume: DataFrame, shape: tuple[int, int, int], fwhm: float, pixdim=(1, 1, 1), keys: Iterable[str] = ()) -> DataFrame:
    return per_volume(volume, lambda a: gauss3d(a, fwhm, pixdim), shape, keys)


def median_filter(volume: DataFrame, shape: tuple[int, int, int], kind: int = 18, keys: Iterable[str] = ()) -> DataFrame:
    return per_volume(volume, lambda a: median_neighbours(a, kind), shape, keys)


def apply_mask(df: DataFrame, mask: DataFrame | None = None, minval: float | None = None) -> DataFrame:
    """Keeps voxels where the mask's magnitude is 1e-6 or more; with no mask, values of at least ``minval``."""
    if mask is not None:
        return df.join(mask.filter(F.abs("value") >= TINY).select(*VOXEL), list(VOXEL), "left_semi")
    return df.filter(F.col("value") >= minval) if minval is not None else df


def apply_positive_mask(df: DataFrame, mask: DataFrame) -> DataFrame:
    """Keeps voxels (all time steps) where the mask is 1e-6 or more, sign included."""
    return df.join(mask.filter(F.col("value") >= TINY).select(*VOXEL), list(VOXEL), "left_semi")


def binarize(volume: DataFrame, low: float = -1e16, high: float = 1e16) -> DataFrame:
    """1 where low <= value <= high (both ends count), values taken as single precision; other voxels go."""
    v = F.col("value").cast("float")
    return volume.filter(v.between(F.lit(low).cast("float"), F.lit(high).cast("float"))).withColumn("value", F.lit(1.0))


def foreground(series: DataFrame, norm: int = 0) -> DataFrame:
    """Series (ts array) of variance 1e-6 or more; norm 1 takes the mean off, 2 also divides by the deviation."""
    n = F.size("ts")
    # a one-element array holds what the inner function would work out again for each step
    let = lambda value, then: F.get(F.transform(F.array(value), then), 0)
    mean = F.aggregate("ts", F.lit(0.0), lambda a, x: a + x) / F.when(n > 0, n)
    var = let(mean, lambda m: F.aggregate("ts", F.lit(0.0), lambda a, x: a + (x - m) ** 2)) / F.when(n > 1, n - 1)
    s = series.filter(var >= TINY)
    if norm == 1:
        s = s.withColumn("ts", let(mean, lambda m: F.transform("ts", lambda x: x - m)))
    elif norm == 2:
        own = F.struct(mean.alias("m"), F.sqrt(F.when(var >= TINY, var)).alias("d"))  # null, so that no plan divides by 0
        s = s.withColumn("ts", let(own, lambda o: F.transform("ts", lambda x: (x - o.m) / o.d)))
    return s


def mean_minval(series: DataFrame, minval: float) -> DataFrame:
    return series.filter(F.aggregate("ts", F.lit(0.0), lambda a, x: a + x) / F.size("ts") >= minval)


def mask_coverage(mask: DataFrame, data: DataFrame) -> tuple[DataFrame, int]:
    """Mask voxels over 0.3 that have data at the first step, and how many have none."""
    on = mask.filter("value > 0.3")
    have = data.filter("value <> 0").select(*VOXEL).distinct()
    return on.join(have, list(VOXEL), "left_semi"), on.join(have, list(VOXEL), "left_anti").count()


def select_edges_by_mask(edges: DataFrame, mask: DataFrame, mode: str = "or") -> DataFrame:
    """Edges (i, j) by whether their ends are in the mask (vid): ``or``, ``and``, ``none`` or ``notboth``."""
    on = mask.select("vid").distinct()
    e = edges.join(on.select(F.col("vid").alias("i"), F.lit(True).alias("_a")), "i", "left").join(on.select(F.col("vid").alias("j"), F.lit(True).alias("_b")), "j", "left")
    a, b = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    return e.filter({"or": a | b, "and": a & b, "none": ~a & ~b, "notboth": ~(a & b)}[mode]).drop("_a", "_b")


def threshold_edges(edges: DataFrame, low: float, high: float, roi: DataFrame | None = None, column: str = "ted") -> DataFrame:
    """low <= value <= high, and with a region either end inside it."""
    e = edges.filter(F.col(column).between(low, high))
    return e if roi is None else select_edges_by_mask(e, roi, "or")


def select_volume(series: DataFrame, t: int) -> DataFrame:
    return series.filter(F.col("t") == t).drop("t")


def invert(volume: DataFrame) -> DataFrame:
    return volume.withColumn("value", -F.col("value"))


def two_volumes(a: DataFrame, b: DataFrame, how: str = "full") -> DataFrame:
    """(voxel, x, y) with 0 for absent voxels."""
    out = a.select(*VOXEL, F.col("value").alias("x")).join(b.select(*VOXEL, F.col("value").alias("y")), list(VOXEL), how)
    return out.fillna(0.0, ["x", "y"])


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return two_volumes(a, b).select(*VOXEL, (F.col("x") - F.col("y")).alias("value"))


def conjunction_of(x: Column, y: Column) -> Column:
    """The value nearer 0 where both have one sign, else 0."""
    return F.when(x * y > 0, F.when(x > 0, F.least(x, y)).otherwise(F.greatest(x, y))).otherwise(0.0)


def conjunction(a: DataFrame, b: DataFrame) -> DataFrame:
    return two_volumes(a, b, "inner").select(*VOXEL, conjunction_of(F.col("x"), F.col("y")).alias("value"))


def pick_volume(volumes: DataFrame, how: str) -> DataFrame:
    """Over volumes t = 0, 1, ...: ``max_id`` and ``min_id`` the number from 1 of the largest and smallest value, first of equals; ``maxabs`` the value of largest magnitude."""
    if how == "maxabs":
        return volumes.groupBy(*VOXEL).agg(F.max_by("value", F.struct(F.abs("value"), "value")).alias("value"))
    key = F.struct(-F.col("value") if how == "max_id" else F.col("value"), F.col("t"))
    return volumes.groupBy(*VOXEL).agg((F.min_by("t", key) + 1).cast("double").alias("value"))


_UNARY = {"abs": F.abs, "exp": F.exp, "log": F.log, "not": lambda v: F.when(v == 0, 1.0).otherwise(0.0), "sqrt": F.sqrt, "square": lambda v: v * v}
_BINARY = {
    "add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mult": lambda x, y: x * y, "div": lambda x, y: F.when(y != 0, x / y).otherwise(0.0), "max": F.greatest, "min": F.least, "dist": lambda x, y: F.abs(x - y),
    "and": lambda x, y: x.cast("long").bitwiseAND(y.cast("long")).cast("double"), "or": lambda x, y: x.cast("long").bitwiseOR(y.cast("long")).cast("double"), "xor": lambda x, y: x.cast("long").bitwiseXOR(y.cast("long")).cast("double"),
}


def arithmetic(a: DataFrame, op: str, b: DataFrame | float | None = None) -> DataFrame:
    """A unary operation, or one with a constant or another volume."""
    if b is None:
        return a.withColumn("value", _UNARY[op](F.col("value")))
    if isinstance(b, DataFrame):
        return two_volumes(a, b).select(*VOXEL, _BINARY[op](F.col("x"), F.col("y")).alias("value"))
    return a.withColumn("value", _BINARY[op](F.col("value"), F.lit(float(b))))


#: Pixel types and their ranges.
RANGES = {"bit": (0, 1), "ubyte": (0, 255), "sbyte": (-128, 127), "short": (-32768, 32767), "ushort": (0, 65535), "integer": (-(2**31), 2**31 - 1), "uinteger": (0, 2**32 - 1), "long": (-(2**63), 2**63 - 1)}


def convert(volume: DataFrame, kind: str, how: str = "copy", source: tuple[float, float] | None = None, a: float = 1.0, b: float = 0.0) -> DataFrame:
    """To a pixel type: ``copy`` rounds and clips, ``linear`` takes a v + b first, ``range`` maps a source range onto the type's, ``opt`` the range found."""
    v = F.col("value")
    if kind in ("float", "double"):
        return volume.withColumn("value", (a * v + b if how == "linear" else v).cast(kind).cast("double"))
    lo, hi = RANGES[kind]
    if how == "linear":
        v = a * v + b
    elif how in ("range", "opt"):
        if how == "opt":
            r = volume.agg(F.min("value").alias("a"), F.max("value").alias("b")).first()
            source = (r.a, r.b)
        width = (source[1] - source[0]) or 1.0
        v = (v - source[0]) / width * float(hi - lo) + lo
    return volume.withColumn("value", F.least(F.greatest(F.round(v), F.lit(float(lo))), F.lit(float(hi))))


def crop(volume: DataFrame, start: tuple[int, int, int], shape: tuple[int, int, int]) -> DataFrame:
    v = volume
    for x, s, n in zip(VOXEL, start, shape):
        v = v.filter(F.col(x).between(s, s + n - 1)).withColumn(x, F.col(x) - s)
    return v


def flip(volume: DataFrame, axis: str, size: int) -> DataFrame:
    return volume.withColumn(axis, F.lit(size - 1) - F.col(axis))


def transpose(volume: DataFrame, x: str = "r", y: str = "c") -> DataFrame:
    """Two axes exchanged."""
    return volume.withColumn("_x", F.col(x)).withColumn(x, F.col(y)).withColumn(y, F.col("_x")).drop("_x")


def fill(volume: DataFrame, value: float) -> DataFrame:
    return volume.withColumn("value", F.lit(float(value)))


def invert_range(volume: DataFrame, high: float) -> DataFrame:
    return volume.withColumn("value", F.lit(float(high)) - F.col("value"))


def select_band(volume: DataFrame, band: int) -> DataFrame:
    return volume.filter(F.col("b") == band).withColumn("b", F.lit(0))


def combine_bands(volumes: list[tuple[DataFrame, int]]) -> DataFrame:
    """Volumes with their numbers of bands, one after another along b."""
    out, at = None, 0
    for v, n in volumes:
        v = v.withColumn("b", F.col("b") + at)
        out, at = (v if out is None else out.unionByName(v)), at + n
    return out


def concatenate(volumes: list[DataFrame]) -> DataFrame:
    """Volumes as steps t = 0, 1, ... of one series."""
    out = volumes[0].withColumn("t", F.lit(0))
    for t, v in enumerate(volumes[1:], 1):
        out = out.unionByName(v.withColumn("t", F.lit(t)))
    return out
