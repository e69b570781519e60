"""Cortical layers: rim, depth, cylinders between the rims, and models of activation over depth.

rim: 1 next to CSF, 2 next to white matter, 3 grey matter between.  Depth (metric) runs from 0 at white
matter to 1 at CSF.  Cylinders are rows (cid, vid), voxels in any number of cylinders.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import p_to_z
from ..functions.volumes import VOXEL, inside, offsets, shift
from .imaging import chamfer, euclidean

MIN_POINTS = 20
DEPTH = (0.05, 0.95)
TINY = 1e-6


# -- geometry --------------------------------------------------------------------------------------


def rim(labels: DataFrame, shape: tuple[int, int, int], gm: int = 2, wm: int = 1, csf: int = 0) -> DataFrame:
    """Grey voxels with a CSF neighbour (of 6) are 1, or 2 where more neighbours are white matter; others 3.  The outer shell has none.

    labels: rows of every voxel (the label 0 may be CSF, so no row may be left out).
    """
    near = [o for o in offsets(6) if any(o)]
    grey = labels.filter(F.col("value") == gm)
    other = labels.filter(F.col("value").isin(csf, wm))
    n = shift(other, near).groupBy(*VOXEL).agg(F.sum((F.col("value") == csf).cast("int")).alias("nc"), F.sum((F.col("value") == wm).cast("int")).alias("nw"))
    out = grey.select(*VOXEL).join(n, list(VOXEL), "left").fillna(0, ["nc", "nw"])
    v = F.when((F.col("nw") > 0) & (F.col("nw") > F.col("nc")), 2.0).when(F.col("nc") > 0, 1.0).otherwise(3.0)
    return out.filter(inside(out, shape, 1)).select(*VOXEL, v.alias("value"))


def depth(a: np.ndarray, kind: str = "chamfer", pixdim=(1.0, 1.0, 1.0)) -> np.ndarray:
    """Of a rim volume the relative distance d(wm) / (d(wm) + d(csf)) within it; rim 1 is 1, rim 2 is 0.0001.

    ``chamfer`` measures paths inside the rim; ``euclidean`` straight lines, as y / (y + 1) of the ratio y.
    """
    on = a > 0
    if kind == "euclidean":
        d1, d2 = euclidean(a == 2), euclidean(a == 1)
    else:
        d1, d2 = chamfer(a == 2, on, pixdim=pixdim), chamfer(a == 1, on, pixdim=pixdim)
    good = on & np.isfinite(d1) & np.isfinite(d2) & (d1 + d2 > 0)
    out = np.where(good, np.where(good, d1, 0) / np.where(good, d1 + d2, 1), 0)
    out[a == 1] = 1
    out[a == 2] = 0.0001
    return np.where(on, out, 0)


def _cells(volume: DataFrame, side: int) -> DataFrame:
    """Each voxel in its own cell and those around it."""
    o = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(p, ("x", "y", "z")))) for p in itertools.product((-1, 0, 1), repeat=3))))
    v = volume.withColumn("_o", o)
    return v.select(*volume.columns, *((F.floor(F.col(n) / side).cast("int") + F.col(f"_o.{o}")).alias(f"_{n}") for n, o in zip(VOXEL, ("x", "y", "z"))), (F.struct(F.lit(0), F.lit(0), F.lit(0)) == F.struct("_o.x", "_o.y", "_o.z")).alias("_own"))


def _clear(box: np.ndarray, p: np.ndarray, q: np.ndarray) -> bool:
    """Whether the straight way from p to q stays inside the rim."""
    t = np.linspace(0, 1, 51)[:, None]
    at = (p + (q - p) * t + 0.5).astype(int)
    return bool((box[tuple(at.T)] > 0).all())


def cylinders(rims: DataFrame, shape: tuple[int, int, int], pixdim=(1.0, 1.0, 1.0), radius: float = 2.0, reach: float = 6.0, longest: float = 10.0, include_rim: bool = False) -> DataFrame:
    """(cid, vid, b, r, c): from each voxel of one rim to the nearest visible one of the other, both ways, each line once.

    A cylinder has the voxels of its centre line and, nearest first and in two rounds, those within
    ``radius`` that touch (6) a grey member.  Fewer than 5 voxels make none.  Work goes by cells of space
    with their neighbours; a line and its cylinder lie within reach of the cell of its first end.
    """
    px = np.array(pixdim[::-1], float)  # by band, row, column
    side = int(np.ceil((reach + abs(radius)) / px.min())) + 2
    nb, nr, nc = shape
    cells = _cells(rims.withColumn("value", F.col("value").cast("int")), side)

    def local(pdf: pd.DataFrame):
        at = pdf[["b", "r", "c"]].to_numpy()
        low = at.min(0) - 1
        box = np.zeros(at.max(0) - low + 2, int)
        box[tuple((at - low).T)] = pdf.value.to_numpy()
        return at - low, low, box

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        at, low, box = local(pdf)
        value, own = pdf.value.to_numpy(), pdf._own.to_numpy()
        out = []
        for mine, theirs in ((1, 2), (2, 1)):
            goal = at[value == theirs]
            for p in at[(value == mine) & own]:
                d = np.sqrt((((goal - p) * px) ** 2).sum(1))
                for k in np.lexsort((*goal.T[::-1], d)):
                    if d[k] >= longest or np.abs(goal[k] - p).max() > reach / px.min():
                        break
                    if _clear(box, p, goal[k]):
                        q = goal[k]
                        x, y = (p, q) if mine == 1 else (q, p)
                        out.append([*(x + low), *(y + low)])
                        break
        return pd.DataFrame(np.array(out, int).reshape(-1, 6), columns=["b1", "r1", "c1", "b2", "r2", "c2"])

    ends = cells.groupBy("_b", "_r", "_c").applyInPandas(match, "b1 int, r1 int, c1 int, b2 int, r2 int, c2 int").distinct()
    index = lambda x: F.expr(f"(b{x} * {nr}L + r{x}) * {nc}L + c{x}")
    ends = ends.withColumn("cid", index(1) * F.lit(nb * nr * nc) + index(2))
    ends = ends.select("*", *(F.floor(F.col(f"{n}1") / side).cast("int").alias(f"_{n}") for n in VOXEL))

    def grow(key, lines: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(lines) and len(pdf):
            at, low, box = local(pdf)
            able = (box > 0) if include_rim else (box == 3)
            places = np.argwhere(able)
            for line in lines.itertuples():
                p, q = np.array([line.b1, line.r1, line.c1]) - low, np.array([line.b2, line.r2, line.c2]) - low
                x, d = p * px, (q - p) * px
                if (d * d).sum() < 1e-10:
                    continue
                taken = np.zeros(box.shape, bool)
                middle = ((p + (q - p) * np.arange(0, 1.05, 0.03)[:, None]) + 0.5).astype(int)
                middle = middle[np.all((middle >= 0) & (middle < box.shape), axis=1)]
                middle = middle[able[tuple(middle.T)]]
                taken[tuple(middle.T)] = True
                if radius > 0 and len(places):
                    z = places * px - x
                    far, along = (np.cross(z, d) ** 2).sum(1) / (d * d).sum(), (z @ d) / (d * d).sum()
                    near = np.flatnonzero((far <= radius * radius) & (along >= -0.03) & (along <= 1.03))
                    near = near[np.argsort(far[near], kind="stable")]
                    for _ in range(2):
                        for k in near:
                            b, r, c = places[k]
                            if taken[b, r, c]:
                                continue
                            grey = [(b + i, r + j, c + m) for i, j, m in offsets(6) if any((i, j, m))]
                            if any(taken[g] and box[g] == 3 for g in grey if all(0 <= g[i] < box.shape[i] for i in range(3))):
                                taken[b, r, c] = True
                got = np.argwhere(taken) + low
                if len(got) >= 5:
                    rows.append(np.column_stack([np.full(len(got), line.cid), (got[:, 0] * nr + got[:, 1]) * nc + got[:, 2], got]))
        out = np.concatenate(rows) if rows else np.zeros((0, 5), int)
        return pd.DataFrame(out, columns=["cid", "vid", "b", "r", "c"])

    return ends.groupBy("_b", "_r", "_c").cogroup(cells.groupBy("_b", "_r", "_c")).applyInPandas(grow, "cid long, vid long, b int, r int, c int")


def equivolume(cyl: DataFrame, metric: DataFrame, bins: int = 10_000) -> DataFrame:
    """(b, r, c, value): depth as the share of a cylinder's voxels at or below it, plus half a bin, averaged over cylinders of 10 voxels or more."""
    low, high = -0.0001, 1.02
    half = (high - low) / bins / 2
    x = cyl.select("cid", *VOXEL).join(metric, list(VOXEL)).withColumn("bin", F.floor((F.col("value") - low) / ((high - low) / bins)).cast("int"))
    n = x.groupBy("cid", "bin").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    whole = Window.partitionBy("cid")  # a cylinder has 100,000 voxels at most
    n = n.withColumn("all", F.sum("n").over(whole)).withColumn("cdf", F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.col("all")).filter("all >= 10")
    out = x.join(n.select("cid", "bin", "cdf"), ["cid", "bin"]).groupBy(*VOXEL).agg(F.avg(F.col("cdf") + half).alias("value"))
    return out.withColumn("value", F.greatest("value", F.lit(0.0001)))


# -- models of one cylinder ------------------------------------------------------------------------


def samples(cyl: DataFrame, zmap: DataFrame, metric: DataFrame) -> DataFrame:
    """(cid, u, z): present values at depths within .05 .. .95; cylinders of 20 points or more that vary."""
    x = cyl.select("cid", *VOXEL).join(metric.select(*VOXEL, F.col("value").alias("u")), list(VOXEL)).join(zmap.select(*VOXEL, F.col("value").alias("z")), list(VOXEL))
    return usable(x)


def usable(points: DataFrame) -> DataFrame:
    x = points.filter(F.col("u").between(*DEPTH) & (F.abs("z") > TINY))
    ok = x.groupBy("cid").agg(F.count("*").alias("n"), F.var_pop("z").alias("v")).filter((F.col("n") >= MIN_POINTS) & (F.col("v") * F.col("n") > TINY)).select("cid")
    return x.join(ok, "cid", "left_semi")


def _median(x: np.ndarray) -> float:
    s = np.sort(x)
    return float(s[(len(s) - 1) // 2]) if len(s) > 10 else float(np.median(s))


def median_test(x: np.ndarray, y: np.ndarray) -> float:
    """z of the counts above and below the common median."""
    m = _median(np.concatenate([x, y]))
    a, c, b, d = (x > m).sum(), (x < m).sum(), (y > m).sum(), (y < m).sum()
    s = float(a + b) * (c + d) * (a + c) * (b + d)
    z = ((a + b + c + d) * (a * d - b * c) ** 2 / s) ** 0.5 if s > 0 else 0.0
    return -float(z) if a < b else float(z)


@lru_cache(maxsize=64)
def _orders(seed: int, perms: int, n: int) -> np.ndarray:
    """Shuffles of n points, the same for all cylinders of that size."""
    return np.argsort(np.random.default_rng(seed).random((perms, n)), axis=1)


def three_bins(u: np.ndarray, z: np.ndarray, perms: int = 1000, seed: int = 5555) -> np.ndarray:
    """Medians of the deep, middle and superficial third, and z of deep-middle, deep-superficial, middle-superficial by permutation (median tests with ``perms`` 0)."""
    parts = [z[u < 1 / 3], z[(u >= 1 / 3) & (u <= 2 / 3)], z[u > 2 / 3]]
    if min(map(len, parts)) < 3:
        return np.zeros(6)
    out = [_median(p) for p in parts]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        x, y = parts[i], parts[j]
        if not perms:
            out.append(median_test(x, y))
            continue
        both, n = np.concatenate([x, y]), len(x)
        mixed = both[_orders(seed, perms, len(both))]
        mid = lambda a: np.partition(a, (a.shape[1] - 1) // 2, axis=1)[:, (a.shape[1] - 1) // 2] if a.shape[1] > 10 else np.median(a, axis=1)
        null, seen = mid(mixed[:, :n]) - mid(mixed[:, n:]), out[i] - out[j]
        p0, p1 = ((null > seen).sum() + 1) / (perms + 1), ((null < seen).sum() + 1) / (perms + 1)
        v = float(p_to_z(min(p0, 1 - 1e-12))) if p0 < p1 else -float(p_to_z(min(p1, 1 - 1e-12)))
        out.append(v if np.isfinite(v) else 0.0)
    return np.array(out)


def mean_bins(u: np.ndarray, z: np.ndarray, n: int) -> np.ndarray:
    """Means of bins ((j - 1) / n, j / n], 0 where empty."""
    k = np.clip(np.ceil(u * n).astype(int) - 1, -1, n - 1)
    return np.array([z[k == j].mean() if (k == j).any() else 0.0 for j in range(n)])


def _legendre(u: np.ndarray, order: int) -> np.ndarray:
    return np.polynomial.legendre.legvander(2 * u - 1, order)


def _fitted(u: np.ndarray, z: np.ndarray, low: float, high: float, order: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(depths, coefficients of 1, u, u^2, ...) of a fit over low .. high; None of too few points or of constant values."""
    on = (u >= low) & (u <= high)
    u, z = u[on], z[on]
    if len(z) < MIN_POINTS or ((z - z.mean()) ** 2).sum() < 1e-6:
        return None
    return u, np.linalg.lstsq(np.vander(u, order + 1, increasing=True), z, rcond=None)[0]


def _first_low(y: np.ndarray) -> np.ndarray:
    """Along the last axis the first of the smallest; values 1e-9 of the largest apart are equal but for rounding."""
    slack = 1e-9 * np.abs(np.where(np.isfinite(y), y, 0)).max(axis=-1, keepdims=True)
    return (y <= y.min(axis=-1, keepdims=True) + slack).argmax(axis=-1)


def peak(u: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Depths of the points, in order of depth, at which a fourth-order fit over .1 .. .9 is smallest and largest; of equals the deeper one, nearer to 0."""
    if (fit := _fitted(u, z, 0.1, 0.9, 4)) is None:
        return np.zeros(2)
    at, beta = fit
    y = np.vander(at, 5, increasing=True) @ beta
    return np.array([at[_first_low(y)], at[_first_low(-y)]])


def concave(u: np.ndarray, z: np.ndarray, legendre: bool = False) -> float:
    """The signed larger share of depths on one side of the inflection of a cubic fit over .2 .. .8.

    With a and b the coefficients of the second and third Legendre polynomial of u the side is parted at
    -a / (6 b), or -a / (5 b) where the polynomials' own inflection is meant.
    """
    if (fit := _fitted(u, z, 0.2, 0.8, 3)) is None:
        return 0.0
    a, b = fit[1][2] / 1.5, fit[1][3] / 2.5
    share = 0.0
    if abs(b) >= 1e-10:
        x = -a / ((5.0 if legendre else 6.0) * b)
        share = min(max(1 - x if b > 0 else x, 0.0), 1.0)
    return -(1 - share) if 1 - share > share else share


def slope(u: np.ndarray, z: np.ndarray) -> float:
    return float(np.polyfit(u, z, 1)[0])


def fit_r2(u: np.ndarray, z: np.ndarray) -> np.ndarray:
    """R^2 of Legendre fits of orders 1 to 6; the sixth has an empty last column and equals the fifth."""
    tss = ((z - z.mean()) ** 2).sum()
    out = []
    for k in range(1, 7):
        x = _legendre(u, min(k, 5))
        out.append(1 - ((z - x @ np.linalg.lstsq(x, z, rcond=None)[0]) ** 2).sum() / tss if tss > 0 else 0.0)
    return np.array(out)


def max_abs(u: np.ndarray, z: np.ndarray) -> float:
    k = np.lexsort((-z, -np.abs(z)))[0]
    return float(z[k])


# -- models of many cylinders at once -------------------------------------------------------------------
#
# A cylinder is a row of arrays u, z and on, padded where on is False.


def _groups(*sizes: np.ndarray):
    """Rows of the same sizes, together."""
    both = np.stack(sizes, axis=1)
    order = np.lexsort(both.T[::-1])
    cuts = np.flatnonzero((both[order][1:] != both[order][:-1]).any(axis=1)) + 1
    return ((tuple(both[part[0]]), part) for part in np.split(order, cuts) if len(part))


@lru_cache(maxsize=1024)
def _taken(seed: int, perms: int, n: int, first: int) -> np.ndarray:
    """(point, shuffle): whether it is among the first so many of the shuffle."""
    out = np.zeros((n, perms), np.uint8)
    out[_orders(seed, perms, n)[:, :first].T, np.arange(perms)] = 1
    return out


def _middle(n: int) -> list[int]:
    """Places of the values that make the median of n."""
    return [(n - 1) // 2] if n > 10 or n % 2 else [n // 2 - 1, n // 2]


def _shuffled_difference(both: np.ndarray, n: int, perms: int, seed: int) -> np.ndarray:
    """Of each row and shuffle the median of its first n values less that of the others.

    Counts of the values taken run over the row in order of size; the median is where they pass its place.
    """
    size = both.shape[1]
    order = np.argsort(both, axis=1, kind="stable")
    ranked, taken = np.take_along_axis(both, order, axis=1), _taken(seed, perms, size, n)
    kind = np.uint8 if size < 255 else np.int32
    places = [(k, True) for k in _middle(n)] + [(k, False) for k in _middle(size - n)]
    at = [np.zeros((len(both), perms), kind) for _ in places]
    run = np.zeros((len(both), perms), kind)
    for t in range(size):
        run += taken[order[:, t]]
        for (k, own), a in zip(places, at):
            a += (run <= k) if own else (run >= kind(t + 1 - k) if t + 1 > k else True)
    x, y = [], []
    for (_, own), a in zip(places, at):
        (x if own else y).append(np.take_along_axis(ranked, a.astype(np.intp), axis=1))
    return sum(x) / len(x) - sum(y) / len(y)


def three_bins_many(u: np.ndarray, z: np.ndarray, on: np.ndarray, perms: int = 1000, seed: int = 5555) -> np.ndarray:
    """``three_bins`` of each row."""
    parts = [on & (u < 1 / 3), on & (u >= 1 / 3) & (u <= 2 / 3), on & (u > 2 / 3)]
    counts = [p.sum(axis=1) for p in parts]
    out, full = np.zeros((len(u), 6)), np.minimum.reduce(counts) >= 3
    for k, (part, count) in enumerate(zip(parts, counts)):
        for (n,), rows in _groups(np.where(full, count, 0)):
            if n:
                v = np.sort(z[rows][part[rows]].reshape(len(rows), n), axis=1)
                out[rows, k] = sum(v[:, i] for i in _middle(n)) / len(_middle(n))
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        for (n, m), rows in _groups(np.where(full, counts[i], 0), np.where(full, counts[j], 0)):
            if not n:
                continue
            step = max(1, (1 << 21) // perms // (n + m) if perms else len(rows))
            for some in np.split(rows, range(step, len(rows), step)):
                x, y = z[some][parts[i][some]].reshape(-1, n), z[some][parts[j][some]].reshape(-1, m)
                if not perms:
                    out[some, 3 + k] = [median_test(a, b) for a, b in zip(x, y)]
                    continue
                null, seen = _shuffled_difference(np.concatenate([x, y], axis=1), n, perms, seed), (out[some, i] - out[some, j])[:, None]
                p0, p1 = (((null > seen).sum(axis=1) + 1) / (perms + 1), ((null < seen).sum(axis=1) + 1) / (perms + 1))
                v = np.where(p0 < p1, 1, -1) * p_to_z(np.minimum(np.minimum(p0, p1), 1 - 1e-12))
                out[some, 3 + k] = np.where(np.isfinite(v), v, 0)
    return out


def _fitted_many(u: np.ndarray, z: np.ndarray, on: np.ndarray, low: float, high: float, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points of the fits, coefficients of 1, u, u^2, ..., which rows have a fit) of ``_fitted`` of each row."""
    on = on & (u >= low) & (u <= high)
    n = on.sum(axis=1)
    mean = np.where(on, z, 0).sum(axis=1) / np.maximum(n, 1)
    good = (n >= MIN_POINTS) & ((np.where(on, z - mean[:, None], 0) ** 2).sum(axis=1) >= 1e-6)
    beta = np.zeros((len(u), order + 1))
    beta[good] = _least_squares(u[good, :, None] ** np.arange(order + 1) * on[good, :, None], np.where(on, z, 0)[good], n[good])
    return on, beta, good


def _least_squares(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The shortest solution of each system, as ``lstsq`` gives; rows of zeros don't count among the n."""
    if not len(x):
        return np.zeros((0, x.shape[2]))
    a, s, b = np.linalg.svd(x, full_matrices=False)
    keep = s > np.finfo(float).eps * np.maximum(n, x.shape[2])[:, None] * s[:, :1]
    part = np.einsum("cij,ci->cj", a, y) * np.where(keep, 1 / np.where(keep, s, 1), 0)
    return np.einsum("cji,cj->ci", b, part)


def peak_many(u: np.ndarray, z: np.ndarray, on: np.ndarray) -> np.ndarray:
    on, beta, good = _fitted_many(u, z, on, 0.1, 0.9, 4)
    y = np.einsum("cnk,ck->cn", u[:, :, None] ** np.arange(5), beta)
    at = [_first_low(np.where(on, s * y, np.inf)) for s in (1, -1)]
    return np.where(good[:, None], np.take_along_axis(u, np.stack(at, axis=1), axis=1), 0)


def concave_many(u: np.ndarray, z: np.ndarray, on: np.ndarray, legendre: bool = False) -> np.ndarray:
    _, beta, good = _fitted_many(u, z, on, 0.2, 0.8, 3)
    a, b = beta[:, 2] / 1.5, beta[:, 3] / 2.5
    bent = np.abs(b) >= 1e-10
    x = -a / np.where(bent, (5.0 if legendre else 6.0) * b, 1)
    share = np.where(bent, np.clip(np.where(b > 0, 1 - x, x), 0, 1), 0)
    return np.where(good, np.where(1 - share > share, share - 1, share), 0)[:, None]


def fit_r2_many(u: np.ndarray, z: np.ndarray, on: np.ndarray) -> np.ndarray:
    n, y = on.sum(axis=1), np.where(on, z, 0)
    tss = (np.where(on, z - (y.sum(axis=1) / n)[:, None], 0) ** 2).sum(axis=1)
    p = _legendre(u, 5) * on[:, :, None]
    rss = [((y - np.einsum("cnk,ck->cn", p[:, :, : k + 1], _least_squares(p[:, :, : k + 1], y, n))) ** 2).sum(axis=1) for k in range(1, 6)]
    return np.stack([np.where(tss > 0, 1 - rss[min(k, 4)] / np.where(tss > 0, tss, 1), 0) for k in range(6)], axis=1)


MANY: dict[str, Callable] = {"3bins": three_bins_many, "peak": peak_many, "concave": concave_many, "R2": fit_r2_many}

MODELS: dict[str, Callable] = {"3bins": three_bins, "nbins": lambda u, z: mean_bins(u, z, 5), "peak": peak, "concave": concave, "linear": slope, "R2": fit_r2, "maxabs": max_abs}


def per_cylinder(points: DataFrame, model: str | Callable, at_once: int = 1 << 17, **options) -> DataFrame:
    """(cid, t, value): the model's outputs of each cylinder.  Points come in order of cylinders, some 100,000 at a time."""
    one = MODELS[model] if isinstance(model, str) else model
    many = MANY.get(model) if isinstance(model, str) else None

    def outputs(cid: np.ndarray, u: np.ndarray, z: np.ndarray) -> pd.DataFrame:
        start = np.flatnonzero(np.append(True, cid[1:] != cid[:-1]))
        n, names = np.diff(np.append(start, len(cid))), cid[start]
        if many is None:
            got = [np.atleast_1d(one(u[i : i + k], z[i : i + k], **options)) for i, k in zip(start, n)]
            size = [len(g) for g in got]
            return pd.DataFrame({"cid": np.repeat(names, size), "t": np.concatenate([np.arange(k, dtype=np.int32) for k in size]), "value": np.concatenate(got)})
        out, rows = [], []
        for _, some in _groups(np.ceil(np.log2(n) * 4).astype(int)):  # of about one length, so that little is padding
            place = np.arange(n[some].max())
            on = place < n[some, None]
            at = start[some, None] + np.where(on, place, 0)
            out.append(many(u[at], z[at], on, **options))
            rows.append(some)
        out = np.concatenate(out)
        return pd.DataFrame({"cid": np.repeat(names[np.concatenate(rows)], out.shape[1]), "t": np.tile(np.arange(out.shape[1], dtype=np.int32), len(out)), "value": out.ravel()})

    def run(batches):
        wait, n = [], 0
        for pdf in batches:
            wait.append(pdf)
            n += len(pdf)
            if n < at_once:
                continue
            pdf = pd.concat(wait, ignore_index=True)
            cut = np.searchsorted(pdf.cid.to_numpy(), pdf.cid.iloc[-1])  # the last cylinder may go on
            if cut:
                yield outputs(*(pdf[c].to_numpy()[:cut] for c in ("cid", "u", "z")))
            wait, n = [pdf[cut:]], len(pdf) - cut
        if n:
            pdf = pd.concat(wait, ignore_index=True)
            yield outputs(*(pdf[c].to_numpy() for c in ("cid", "u", "z")))

    rows = points.select(F.col("cid").cast("long").alias("cid"), *(F.col(c).cast("double").alias(c) for c in ("u", "z")))
    # by a hash: the exchange of a join by cid would do for cid itself, until the join is made another while it runs
    return rows.repartition(F.xxhash64("cid")).sortWithinPartitions("cid", "u", "z").mapInPandas(run, "cid long, t int, value double")


def mean_bins_rows(points: DataFrame, n: int = 5) -> DataFrame:
    """``mean_bins`` in DataFrame operations: (cid, bin, value) of bins that have points."""
    k = F.greatest(F.ceil(F.col("u") * n), F.lit(1)).cast("int")
    return points.filter("u > 0 and u <= 1").groupBy("cid", k.alias("bin")).agg(F.avg("z").alias("value"), F.count("*").alias("n"))


def slope_rows(points: DataFrame) -> DataFrame:
    return points.groupBy("cid").agg(F.regr_slope("z", "u").alias("value"))


def max_abs_rows(points: DataFrame) -> DataFrame:
    return points.groupBy("cid").agg(F.max_by("z", F.struct(F.abs("z"), "z")).alias("value"))


def thirds_rows(points: DataFrame) -> DataFrame:
    """(cid, deep, middle, superficial): lower medians of thirds with three points or more each."""
    third = lambda c: F.expr(f"percentile_disc(0.5) within group (order by z) filter (where {c})")
    parts = {"deep": "u < 1.0D / 3", "middle": "u >= 1.0D / 3 and u <= 2.0D / 3", "superficial": "u > 2.0D / 3"}
    g = points.groupBy("cid").agg(*(third(c).alias(k) for k, c in parts.items()), *(F.expr(f"count_if({c})").alias(f"n_{k}") for k, c in parts.items()))
    return g.filter(" and ".join(f"n_{k} >= 3" for k in parts)).select("cid", *parts)


def scatter_average(cyl: DataFrame, values: DataFrame, rims: DataFrame | None = None) -> DataFrame:
    """(b, r, c, t, value): each voxel's sum over its cylinders by the number of its cylinders, modelled or not; grey voxels only."""
    count = cyl.groupBy(*VOXEL).agg(F.countDistinct("cid").alias("n"))
    total = cyl.select("cid", *VOXEL).join(values, "cid").groupBy(*VOXEL, "t").agg(F.sum("value").alias("s"))
    out = total.join(count, list(VOXEL)).select(*VOXEL, "t", (F.col("s") / F.col("n")).alias("value"))
    return out if rims is None else out.join(rims.filter("value = 3").select(*VOXEL), list(VOXEL), "left_semi")


def best_cylinder(cyl: DataFrame, seed: tuple[int, int, int]) -> DataFrame:
    """The cylinder of largest mean exp(-d^2) to the seed, the smallest id of equals."""
    d2 = sum((F.col(x) - s) ** 2 for x, s in zip(VOXEL, seed))
    best = cyl.groupBy("cid").agg(F.avg(F.exp(-d2)).alias("w")).orderBy(F.desc("w"), "cid").limit(1).select("cid")
    return cyl.join(F.broadcast(best), "cid", "left_semi")  # one row


def roi_profile(points: DataFrame, n: int = 5, least: int = 5) -> DataFrame:
    """(bin, mean, sd, count) of values by depth ((j - 1) / n, j / n]; all 0 where fewer than ``least``."""
    k = F.greatest(F.ceil(F.col("u") * n), F.lit(1)).cast("int")
    g = points.filter("u > 0 and u <= 1").groupBy(k.alias("bin")).agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s"), F.count("*").alias("count"))
    ok = F.col("count") >= least
    return g.select("bin", F.when(ok, F.col("m")).otherwise(0.0).alias("mean"), F.when(ok, F.col("s")).otherwise(0.0).alias("sd"), "count")


def seed_profile(u: np.ndarray, z: np.ndarray, order: int = 4, steps: int = 101) -> np.ndarray:
    """Columns depth, value and Chebyshev fit of the points of a cylinder."""
    x = np.polynomial.chebyshev.chebvander(2 * u - 1, order)
    fit = x @ np.linalg.lstsq(x, z, rcond=None)[0]
    i = np.argsort(u, kind="stable")
    return np.stack([u[i], z[i], fit[i]], axis=1)


def depth_volume(rims: DataFrame, shape: tuple[int, int, int], kind: str = "chamfer", pixdim=(1.0, 1.0, 1.0)) -> DataFrame:
    from ..functions.volumes import per_volume

    return per_volume(rims, lambda a: depth(a, kind, pixdim), shape)


