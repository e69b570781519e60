"""Task-related edge density: where neighbourhoods of an edge also grow stronger in one of two conditions.

Voxels are rows (vid, b, r, c, x array, y array), numbered densely: average series of both conditions.  Pairs go by blocks; a
block carries its voxels' neighbourhoods, so a task needs two blocks and their neighbours only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.volumes import offsets
from .networks import pair_blocks, ranks

Z_RANGE, Z_BINS = (-2.001, 2.001), 25_000
TED_RANGE, TED_BINS = (0.0, 1.001), 10_000
NOISE = 0.01


def adjacency(kind: int | str = 26) -> list[tuple[int, int, int]]:
    """7, 19, 27 or (sphere of radius 2) 33 places, the centre among them."""
    return offsets("sphere", 2) if kind == "sphere" else offsets(kind)


def prepare(series: DataFrame, metric: str = "pearson") -> DataFrame:
    """z-scores or ranks of both series; column names stay."""

    def run(batches):
        for pdf in batches:
            for name in ("x", "y"):
                a = np.stack(pdf[name].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 1))
                if metric == "spearman":
                    a = ranks(a).astype(float)
                sd = a.std(1, ddof=1, keepdims=True)
                pdf[name] = list((a - a.mean(1, keepdims=True)) / np.where(sd > 1e-10, sd, 1) * (sd > 1e-10))
            yield pdf

    return series.select("vid", "b", "r", "c", "x", "y").mapInPandas(run, "vid long, b int, r int, c int, x array<double>, y array<double>")


def _difference(x1, x2, y1, y2) -> np.ndarray:
    """max(corr, 0) of the first condition less that of the second, all pairs."""
    n = x1.shape[1] - 1
    return np.maximum(x1 @ x2.T / n, 0) - np.maximum(y1 @ y2.T / n, 0)


def _stack(pdf: pd.DataFrame, name: str) -> np.ndarray:
    return np.stack(pdf[name].to_numpy()).astype(float)


def _blocked(prepared: DataFrame, size: int) -> DataFrame:
    return prepared.withColumn("blk", F.floor(F.col("vid") / size).cast("int")).withColumn("pos", (F.col("vid") % size).cast("int"))


def _eligible(at: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """Voxels that may have a neighbourhood: 1 from the low and 2 from the high faces."""
    return np.all((at >= 1) & (at < np.array(shape) - 2), axis=1)


def difference_histogram(prepared: DataFrame, shape: tuple[int, int, int], length: int = 5, step: int = 2, size: int = 512) -> DataFrame:
    """(bin, n) of z over pairs j < i of every ``step``-th voxel, at a distance of ``length`` or more."""
    x = _blocked(prepared, size)

    def run(key, a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({"bin": [], "n": []})
        pa_, pb = a[["b", "r", "c"]].to_numpy(), b[["b", "r", "c"]].to_numpy()
        ia, ib = key[0] * size + a.pos.to_numpy(), key[1] * size + b.pos.to_numpy()
        ok = (ia[:, None] < ib[None, :]) & (ia % step == 0)[:, None] & (ib % step == 0)[None, :] & _eligible(pa_, shape)[:, None] & _eligible(pb, shape)[None, :]
        ok &= ((pa_[:, None] - pb[None]) ** 2).sum(2) >= length * length
        z = _difference(_stack(a, "x"), _stack(b, "x"), _stack(a, "y"), _stack(b, "y"))[ok]
        k = np.clip(((z - Z_RANGE[0]) / (Z_RANGE[1] - Z_RANGE[0]) * Z_BINS).astype(int), 0, Z_BINS - 1)
        v, n = np.unique(k, return_counts=True)
        return pd.DataFrame({"bin": v, "n": n})

    return pair_blocks(x, x, run, "bin int, n long", triangle=True).groupBy("bin").agg(F.sum("n").alias("n"))


def quantile_threshold(hist: DataFrame, quantile: float = 0.99) -> float:
    """Upper edge of the last bin whose running share is below the quantile."""
    rows = hist.orderBy("bin").collect()  # 25,000 bins at most
    total, run, last = sum(r.n for r in rows), 0, -1
    for r in rows:
        if total and run / total < quantile:
            last = r.bin - 1
        run += r.n
        if total and run / total < quantile:
            last = r.bin
    return Z_RANGE[0] + (last + 1) * (Z_RANGE[1] - Z_RANGE[0]) / Z_BINS


def _neighbourhoods(pdf: pd.DataFrame, at: np.ndarray, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a block's centres that may have a neighbourhood, in order: ids, own rows, and for each place the rows of the neighbours there (len(pdf): none)."""
    vid = pdf.vid.to_numpy()
    count = pdf.of.map(len).to_numpy()
    row, centre = np.repeat(np.arange(len(pdf)), count), np.concatenate([*pdf.of.to_list(), np.zeros(0, np.int64)]).astype(np.int64)
    own = row[(vid[row] == centre) & _eligible(at, shape)[row]]
    own = own[np.argsort(vid[own], kind="stable")]
    order = np.argsort(centre, kind="stable")
    row, centre = row[order], centre[order]
    lo, hi = np.searchsorted(centre, vid[own], side="left"), np.searchsorted(centre, vid[own], side="right")
    places = [np.where(lo + k < hi, np.append(row, 0)[np.minimum(lo + k, len(row))], len(pdf)) for k in range(int((hi - lo).max(initial=0)))]
    return vid[own], own, places


def _gathered(m: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """Sums of the rows of each neighbourhood."""
    m = np.concatenate([m, np.zeros((1, m.shape[1]), m.dtype)]).astype(np.uint16)
    out = np.zeros((len(places[0]) if places else 0, m.shape[1]), np.uint16)
    for rows in places:
        out += m[rows]
    return out


def edge_density(prepared: DataFrame, shape: tuple[int, int, int], threshold: float, kind: int | str = 26, length: int = 5, size: int = 256) -> DataFrame:
    """(i, j, z, ted) of edges with z at the threshold or above: the share above it of pairs of neighbours at a distance."""
    x = _blocked(prepared, size)
    near = adjacency(kind)
    # a block's voxels and all their neighbours, with the centre's block
    o = F.explode(F.array(*(F.struct(*(F.lit(d).alias(n) for n, d in zip(("db", "dr", "dc"), p))) for p in near)))
    centres = x.select("vid", "blk", "pos", "b", "r", "c").withColumn("o", o).select(F.col("vid").alias("centre"), "blk", (F.col("b") + F.col("o.db")).alias("b"), (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))
    around = centres.join(prepared, ["b", "r", "c"]).select("blk", "centre", "vid", "b", "r", "c", "x", "y").withColumn("pos", F.lit(0))
    packed = around.groupBy("blk", "vid").agg(F.first("b").alias("b"), F.first("r").alias("r"), F.first("c").alias("c"), F.first("x").alias("x"), F.first("y").alias("y"), F.collect_set("centre").alias("of")).withColumn("pos", F.lit(0))

    def run(key, a, b):
        out = []
        if len(a) and len(b):
            va, vb = a.vid.to_numpy(), b.vid.to_numpy()
            pa_, pb = a[["b", "r", "c"]].to_numpy(), b[["b", "r", "c"]].to_numpy()
            z = _difference(_stack(a, "x"), _stack(b, "x"), _stack(a, "y"), _stack(b, "y"))
            far = ((pa_[:, None] - pb[None]) ** 2).sum(2) >= length * length
            (u, ka, na), (v, kb, nb) = (_neighbourhoods(pdf, p, shape) for pdf, p in ((a, pa_), (b, pb)))
            some = (np.abs(z) >= 1e-6) & far
            i, j = np.nonzero((u[:, None] < v[None]) & far[np.ix_(ka, kb)] & (z[np.ix_(ka, kb)] >= threshold))
            n, above = (_gathered(_gathered(m, na).T, nb).T[i, j].astype(int) for m in (some, some & (z > threshold)))
            i, j, n, above = (w[n > 0] for w in (i, j, n, above))
            out.append(pd.DataFrame({"i": v[j], "j": u[i], "z": z[ka[i], kb[j]], "ted": np.minimum(above / n, TED_RANGE[1] - 1e-6)}))
        if out:
            return out[0]
        return pd.DataFrame(out, columns=["i", "j", "z", "ted"])

    return pair_blocks(packed, packed, run, "i long, j long, z double, ted double", triangle=True)


def density_histogram(edges: DataFrame) -> DataFrame:
    """(bin, n) over [0, 1.001) in 10,000 bins."""
    k = F.least(F.floor(F.col("ted") / (TED_RANGE[1] / TED_BINS)), F.lit(TED_BINS - 1)).cast("int")
    return edges.groupBy(k.alias("bin")).agg(F.count("*").alias("n"))


def kernel_density(hist: np.ndarray, low: float, high: float) -> np.ndarray:
    """At each bin's lower edge the Gaussian density of the histogram, width 1.06 sigma n^-0.2."""
    n = len(hist)
    mid = low + (np.arange(n) + 0.5) * (high - low) / n
    total = hist.sum()
    if not total:
        return np.zeros(n)
    mean = (hist * mid).sum() / total
    h = 1.06 * np.sqrt((hist * (mid - mean) ** 2).sum() / total) * total**-0.2
    if h <= 0:
        return np.zeros(n)
    at, full = low + np.arange(n) * (high - low) / n, np.flatnonzero(hist)
    out = np.zeros(n)
    for s in range(0, n, 500):
        out[s : s + 500] = (hist[full] * np.exp(-0.5 * ((at[s : s + 500, None] - mid[full]) / h) ** 2)).sum(1)
    return out / (h * total * np.sqrt(2 * np.pi))


def histogram_table(hist: DataFrame, bins: int = TED_BINS, low: float = TED_RANGE[0], high: float = TED_RANGE[1]) -> DataFrame:
    """(lower, kde, count) of every bin, as it is written to text."""
    n = np.zeros(bins)
    for r in hist.collect():  # a row a bin
        n[r.bin] = r.n
    rows = pd.DataFrame({"lower": low + np.arange(bins) * (high - low) / bins, "kde": kernel_density(n, low, high), "count": n})
    return hist.sparkSession.createDataFrame(rows)


def hub_map(edges: DataFrame, low: float, high: float, voxels: DataFrame, roi: DataFrame | None = None) -> DataFrame:
    """(b, r, c, value): how many edges with low <= ted <= high end at each voxel."""
    from .filters import threshold_edges
    from .networks import hubness

    return hubness(threshold_edges(edges, low, high, roi)).join(voxels.select("vid", "b", "r", "c"), "vid").select("b", "r", "c", F.col("degree").cast("double").alias("value"))
