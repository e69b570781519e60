"""Linear models over many series with one small design: the design's inverse is made once, the series are multiplied in batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import t_to_z


def pseudo_inverse(x: np.ndarray, least: float = 1e-6) -> np.ndarray:
    """Singular values of ``least`` or below, in absolute size, are dropped."""
    u, s, v = np.linalg.svd(np.asarray(x, float), full_matrices=False)
    return (v.T * np.where(s > least, 1 / np.where(s > least, s, 1), 0)) @ u.T


def degrees_of_freedom(x: np.ndarray) -> tuple[float, float]:
    """(trace R, trace(R)^2 / trace(R^2)) of the residual matrix R."""
    r = np.eye(len(x)) - x @ pseudo_inverse(x)
    return float(np.trace(r)), float(np.trace(r) ** 2 / np.trace(r @ r))


def _map(series: DataFrame, f, names: list[str]) -> DataFrame:
    keys = [c for c in series.columns if c != "ts"]
    types = dict(series.dtypes)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                out = f(np.stack(pdf.ts.to_numpy()).astype(float))
                yield pd.DataFrame({**{k: pdf[k] for k in keys}, **{n: out[:, i] for i, n in enumerate(names)}})

    return series.mapInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"{n} double" for n in names)]))


def betas(series: DataFrame, x: np.ndarray) -> DataFrame:
    p = pseudo_inverse(x)
    return _map(series, lambda y: y @ p.T, [f"beta{i}" for i in range(x.shape[1])])


def contrast_map(series: DataFrame, x: np.ndarray, contrast: np.ndarray) -> DataFrame:
    """The raw contrast c'beta of each series."""
    w = np.asarray(contrast, float) @ pseudo_inverse(x)
    return _map(series, lambda y: (y @ w)[:, None], ["value"])


def second_level(series: DataFrame, x: np.ndarray, contrast: np.ndarray) -> DataFrame:
    """(key, t, df, z) of subjects' values: t = c'beta / sqrt(err / trace(R) * c'X+X+'c); 0 where more than two subjects are missing."""
    x, c = np.asarray(x, float), np.asarray(contrast, float)
    p = pseudo_inverse(x)
    r = np.eye(len(x)) - x @ p
    trace, df = degrees_of_freedom(x)
    scale = float(c @ p @ p.T @ c)

    def f(y: np.ndarray) -> np.ndarray:
        err = (((y @ r.T) ** 2).sum(1)) / trace
        sd = np.sqrt(np.maximum(err * scale, 0))
        ok = ((np.abs(y) > 1e-8).sum(1) >= len(x) - 2) & (sd > 1e-10)
        t = np.where(ok, (y @ p.T @ c) / np.where(sd > 0, sd, 1), 0)
        return np.stack([t, np.full(len(t), df), np.where(ok, t_to_z(t, df), 0)], axis=1)

    return _map(series, f, ["t", "df", "z"])


def autocorrelation_bias(x: np.ndarray) -> np.ndarray:
    """The matrix that takes (variance, first covariance) of a process to those of its residuals."""
    r = np.eye(len(x)) - x @ pseudo_inverse(x)
    d = np.eye(len(x), k=1) + np.eye(len(x), k=-1)
    rd = r @ d
    return np.array([[np.trace(r), np.trace(rd)], [np.trace(rd) / 2, np.trace(rd @ rd) / 2]])


def residual_rho(y: np.ndarray, x: np.ndarray, order: int = 1) -> np.ndarray:
    """Autocorrelations 1 .. order of residuals; the first corrected for the design's bias where it is alone."""
    res = y - (x @ (pseudo_inverse(x) @ y.T)).T
    cov = np.stack([(res[:, k:] * res[:, : res.shape[1] - k]).sum(1) for k in range(order + 1)], axis=1)
    if order == 1:
        cov = cov @ np.linalg.pinv(autocorrelation_bias(x)).T
    return np.where(cov[:, :1] > 0, cov[:, 1:] / np.where(cov[:, :1] > 0, cov[:, :1], 1), 0)


def whitener(n: int, rho: np.ndarray) -> np.ndarray:
    """The n x n matrix that whitens an autoregression with these autocorrelations."""
    p = len(rho)
    if p == 1:
        a = np.eye(n) - rho[0] * np.eye(n, k=-1)
        a[1:] /= math.sqrt(1 - rho[0] ** 2)
        a[0] = 0
        a[0, 0] = 1
        return a
    full = np.concatenate([[1.0], rho])
    toeplitz = full[np.abs(np.subtract.outer(np.arange(p + 1), np.arange(p + 1)))]
    start = np.linalg.inv(np.linalg.cholesky(toeplitz + 1e-9 * np.eye(p + 1)))
    a = np.zeros((n, n))
    a[: p + 1, : p + 1] = start
    for i in range(p + 1, n):
        a[i, i - p : i + 1] = start[-1]
    return a


def effective_df(x: np.ndarray, contrast: np.ndarray, rho: float) -> tuple[float, float]:
    """(df for z: residual over 1 + 2 sum of squared correlations, rounded; residual df)."""
    resid = len(x) - np.linalg.matrix_rank(x)
    w = np.asarray(contrast, float) @ pseudo_inverse(x)
    n = len(w)
    size = float(w @ w)
    cor = np.array([(w[k:] * w[: n - k]).sum() / size for k in range(1, 2)]) if size > 0 else np.zeros(1)
    return float(round(resid / (1 + 2 * (rho * cor[0]) ** 2))) if size > 0 else float(resid), float(resid)


def prewhitened(series: DataFrame, x: np.ndarray, contrast: np.ndarray, order: int = 1) -> DataFrame:
    """(key, t, z): residual autocorrelation, whitening of series and design by voxels of one rounded rho together, refit, and the logarithmic z."""
    x, c = np.asarray(x, float), np.asarray(contrast, float)

    def f(y: np.ndarray) -> np.ndarray:
        rho = residual_rho(y, x, order)
        rho = np.clip(np.round(rho, 2), -0.99, 0.99)
        t, df = np.zeros(len(y)), np.ones(len(y))
        for row in np.unique(rho, axis=0):
            at = np.flatnonzero((rho == row).all(1))
            a = whitener(len(x), row)
            xs, ys = a @ x, y[at] @ a.T
            p = pseudo_inverse(xs)
            z_df, resid = effective_df(x, c, row[0])
            err = ((ys - (xs @ (p @ ys.T)).T) ** 2).sum(1)
            sd = np.sqrt(err / max(resid, 1)) * math.sqrt(max(float(c @ p @ p.T @ c), 0))
            t[at] = np.where(sd > 1e-10, (ys @ p.T @ c) / np.where(sd > 0, sd, 1), 0)
            df[at] = z_df
        with np.errstate(all="ignore"):
            z = np.sign(t) * np.sqrt(df * np.log(1 + t * t / df) * (1 - 0.5 / df))
        return np.stack([t, np.where(np.isfinite(z), z, 0)], axis=1)

    return _map(series, f, ["t", "z"])


def read_rows(matrix: DataFrame, key: str = "row", value: str = "x") -> np.ndarray:
    """A design table (row, array) as a matrix: as many rows as images."""
    return np.array([r[value] for r in matrix.orderBy(key).select(value).collect()], float)


def demean_columns(x: np.ndarray) -> np.ndarray:
    """Columns less their means; a constant column is an error."""
    out = x - x.mean(0)
    if (np.abs(out).max(0, initial=0) < 1e-10).any():
        raise ValueError("a covariate is constant")
    return out


def toeplitz(v: np.ndarray) -> np.ndarray:
    return np.asarray(v)[np.abs(np.subtract.outer(np.arange(len(v)), np.arange(len(v))))]


def rank(x: np.ndarray) -> int:
    return int(np.linalg.matrix_rank(x))


def as_series(subjects: DataFrame, n: int) -> DataFrame:
    """Subject maps to one array a voxel, subject by subject, 0 where missing."""
    m = F.map_from_entries(F.collect_list(F.struct("subj", "value")))
    return subjects.groupBy("b", "r", "c").agg(m.alias("m")).select("b", "r", "c", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("ts"))
