"""Prediction from connectomes: ensembles of partial least squares, with side information on the test set.

Connectomes are rows (subj, feats array), of one length.  Ensemble members are tasks; the data matrix goes
to the executors where it fits a stated size, which a cohort's edges do.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .networks import ranks

#: Largest data matrix that goes to every executor.
MATRIX_BYTES = 512 << 20


def load_connectomes(rows: DataFrame, name: str = "Correlation", n_side: int | None = None) -> DataFrame:
    """Non-finite features become 0; ``Ricci`` ones change sign and are divided by the root of the number of regions."""
    fine = lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    out = F.transform(F.transform("feats", lambda x: x.cast("double")), fine)
    if name == "Ricci":
        out = F.transform(out, lambda x: -x / math.sqrt(n_side or 1))
    return rows.withColumn("feats", out)


def zscore_rows(rows: DataFrame, column: str = "feats") -> DataFrame:
    n = F.size(column)
    r = rows.withColumn("_m", F.aggregate(column, F.lit(0.0), lambda a, x: a + x) / n)
    r = r.withColumn("_d", F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + (x - F.col("_m")) ** 2) / (n - 1)))
    return r.withColumn(column, F.transform(column, lambda x: F.when(F.col("_d") < 1e-6, 0.0).otherwise((x - F.col("_m")) / F.col("_d")))).drop("_m", "_d")


def double_center(x: np.ndarray) -> np.ndarray:
    return x - x.mean(1, keepdims=True) - x.mean(0, keepdims=True) + x.mean()


def double_center_rows(cells: DataFrame, row: str, col: str, value: str = "value") -> DataFrame:
    """``double_center`` of long rows."""
    v = F.col(value)
    return cells.withColumn(value, v - F.avg(v).over(Window.partitionBy(row)) - F.avg(v).over(Window.partitionBy(col)) + F.lit(cells.agg(F.avg(v)).first()[0]))


def simpls(x: np.ndarray, y: np.ndarray, components: int) -> np.ndarray:
    """Coefficients of a partial least squares fit of one standardised target."""
    s = x.T @ y
    beta, basis = np.zeros(x.shape[1]), []
    for _ in range(min(components, x.shape[1])):
        r = (s @ s) * s
        t = x @ r
        t = t - t.mean()
        size = np.linalg.norm(t)
        if size < 1e-12:
            break
        t, r = t / size, r / size
        p = x.T @ t
        v = p.copy()
        for b in basis:
            v -= b * (b @ p)
        norm = np.linalg.norm(v)
        if norm < 1e-12:
            break
        v /= norm
        s = s - v * (v @ s)
        basis.append(v)
        beta += r * (y @ t)
    return beta


def collect_matrix(rows: DataFrame, key: str = "subj", column: str = "feats") -> tuple[np.ndarray, np.ndarray]:
    """(keys, matrix) in order of key, if it is within the stated size."""
    size = rows.agg(F.sum(F.size(column)).alias("n")).first().n or 0
    if size * 4 > MATRIX_BYTES:
        raise ValueError(f"a matrix of {size * 4} bytes is over {MATRIX_BYTES}; select features first")
    got = rows.select(key, column).orderBy(key).collect()
    return np.array([r[0] for r in got]), np.array([r[1] for r in got], np.float32)


def simpls_moments(gram: np.ndarray, xy: np.ndarray, components: int) -> np.ndarray:
    """``simpls`` of columns without means, from x'x and x'y alone."""
    s = xy.copy()
    beta, basis = np.zeros(len(xy)), []
    for _ in range(min(components, len(xy))):
        r = (s @ s) * s
        g = gram @ r
        size = math.sqrt(max(r @ g, 0.0))
        if size < 1e-12:
            break
        r, v = r / size, g / size
        p = v.copy()
        for b in basis:
            v -= b * (b @ p)
        norm = np.linalg.norm(v)
        if norm < 1e-12:
            break
        v /= norm
        s = s - v * (v @ s)
        basis.append(v)
        beta += r * (xy @ r)
    return beta


def ensemble(spark, x: np.ndarray, y: np.ndarray, train: np.ndarray, test: np.ndarray, samples: np.ndarray, components: int = 10) -> np.ndarray:
    """Predictions of the test rows, averaged over members; ``samples`` has the features of each member."""
    if x.shape[1] <= len(train):
        return _ensemble_moments(spark, x, y, train, test, samples, components)
    shared = spark.sparkContext.broadcast((x, y, train, test, samples))  # within MATRIX_BYTES

    def run(batches):
        x, y, train, test, samples = shared.value
        total, n = np.zeros(len(test)), 0
        for pdf in batches:
            for i in pdf.id:
                f = samples[i]
                a, b = double_center(x[np.ix_(train, f)].astype(float)), double_center(x[np.ix_(test, f)].astype(float))
                total += b @ simpls(a, y, components)
                n += 1
        if n:
            yield pd.DataFrame({"k": np.arange(len(test)), "p": total, "n": n})

    got = spark.range(len(samples)).repartition(min(len(samples), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "k long, p double, n long").groupBy("k").agg((F.sum("p") / F.sum("n")).alias("p")).collect()
    out = np.zeros(len(test))
    for r in got:
        out[r.k] = r.p
    return out


def _ensemble_moments(spark, x: np.ndarray, y: np.ndarray, train: np.ndarray, test: np.ndarray, samples: np.ndarray, components: int) -> np.ndarray:
    """The same where rows outnumber features: members need the moments of the training rows only, and give a coefficient a feature."""
    a = x[train].astype(float)
    a -= a.mean(0)
    shared = spark.sparkContext.broadcast((a.T @ a, a.T @ y, samples))

    def run(batches):
        gram, xy, samples = shared.value
        total, n = np.zeros(len(xy)), 0
        for pdf in batches:
            for i in pdf.id:
                f = samples[i]
                # rows less their means over the member's features
                beta = simpls_moments(double_center(gram[np.ix_(f, f)]), xy[f] - xy[f].mean(), components)
                np.add.at(total, f, beta - beta.mean())
                n += 1
        if n:
            yield pd.DataFrame({"k": np.arange(len(xy)), "p": total, "n": n})

    got = spark.range(0, len(samples), 1, min(len(samples), spark.sparkContext.defaultParallelism)).mapInPandas(run, "k long, p double, n long").groupBy("k").agg((F.sum("p") / F.sum("n")).alias("p")).collect()
    beta = np.zeros(x.shape[1])
    for r in got:
        beta[r.k] = r.p
    b = x[test].astype(float)
    return (b - b.mean(0)) @ beta


def edge_correlations(rows: DataFrame, target: DataFrame, key: str = "subj", y: str = "y") -> DataFrame:
    """(edge, r): correlation of each feature with the target over subjects."""
    return rows.join(target.select(key, F.col(y).alias("_y")), key).select(F.posexplode("feats").alias("edge", "_x"), "_y").groupBy("edge").agg(F.corr("_x", "_y").alias("r"))


def correlate_columns(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = x - x.mean(0), y - y.mean()
    bottom = np.sqrt((a * a).sum(0) * (b * b).sum())
    return np.where(bottom > 1e-12, a.T @ b / np.where(bottom > 0, bottom, 1), 0)


def selection_probability(r_side: np.ndarray, r_target: np.ndarray, alpha: float) -> np.ndarray:
    """1 / (1 + exp(-alpha z)) of the product of both correlations, z-scored over edges."""
    w = r_side * r_target
    z = (w - w.mean()) / max(w.std(ddof=1), 1e-12)
    return 1 / (1 + np.exp(-np.clip(alpha * z, -700, 700)))


def selection_probability_rows(side: DataFrame, target: DataFrame, alpha: float) -> DataFrame:
    """The same on rows (edge, r)."""
    w = side.select("edge", F.col("r").alias("_a")).join(target.select("edge", F.col("r").alias("_b")), "edge").select("edge", (F.col("_a") * F.col("_b")).alias("w"))
    s = w.agg(F.avg("w").alias("m"), F.stddev_samp("w").alias("s")).first()
    return w.select("edge", (1 / (1 + F.exp(-alpha * (F.col("w") - s.m) / s.s))).alias("p"))


def side_information_baseline(x_train: np.ndarray, y_train: np.ndarray, x_test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b, a = np.polyfit(x_train, y_train, 1)
    return a + b * x_train, a + b * x_test


def predict(spark, x: np.ndarray, train: np.ndarray, test: np.ndarray, y_train: np.ndarray, side_train: np.ndarray, side_test: np.ndarray, features: int = 500, members: int = 1000, components: int = 10, seed: int = 601931) -> dict:
    """Predictions of standardised targets for the test rows: blind (``bml``), from side information (``si``) and controlled (``sml``), with the final alpha.

    Side information of test rows steers which edges are drawn; alpha grows or shrinks until predictions
    correlate with it as the targets of training rows do.
    """
    n_train, n_test = len(train), len(test)
    y = (y_train - y_train.mean()) / y_train.std(ddof=1)
    both = np.concatenate([side_train, side_test])
    side_train, side_test = ((s - both.mean()) / both.std(ddof=1) for s in (side_train, side_test))
    rng = np.random.default_rng(seed)
    n_edges = x.shape[1]
    k = min(features, n_edges)
    blind = np.stack([rng.choice(n_edges, k, replace=False) for _ in range(members)])
    out = {"bml": ensemble(spark, x, y, train, test, blind, components)}
    fit_train, fit_test = side_information_baseline(side_train, y, side_test)
    out["si"] = fit_test
    goal = float(np.corrcoef(y, fit_train)[0, 1])
    alpha, up, down, rounds = 1.0, 1.2, 0.8, 0
    splits = 1 if n_train == n_test else 3
    gap = 100.0
    while abs(gap) > 0.02 and alpha > 0.01 and rounds < 30:
        total = np.zeros(n_test)
        for _ in range(splits):
            a, b, ya, xb = _split(rng, train, test, y, fit_test, fit_train, splits)
            w = selection_probability(correlate_columns(x[b], xb), correlate_columns(x[a], ya), alpha)
            draws = np.searchsorted(np.cumsum(w), rng.random((members // splits, k)) * w.sum(), side="right").clip(0, n_edges - 1)
            total += ensemble(spark, x, y, train, test, draws, components)
        out["sml"] = total / splits
        gap = float(np.corrcoef(out["sml"], fit_test)[0, 1]) - goal
        if rounds > 1:
            up, down = 1.1, 0.9
        alpha *= down if gap > 0 else up
        rounds += 1
    return out | {"alpha": alpha}


def _split(rng, train, test, y, fit_test, fit_train, splits):
    """Rows for target and for side correlations: with unequal sets, training rows move over so that both are near half of all."""
    if splits == 1:
        return train, test, y, fit_test
    n = len(train) + len(test)
    order = rng.permutation(len(train))
    keep = order[: int(0.5 * n)]
    move = order[int(0.5 * n) :]
    return train[keep], np.concatenate([test, train[move]]), y[keep], np.concatenate([fit_test, fit_train[move]])


def residualise(train: np.ndarray, test: np.ndarray, c_train: np.ndarray, c_test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both less the fit of confounds on the training rows."""
    a = np.column_stack([np.ones(len(c_train)), c_train])
    beta = np.linalg.lstsq(a, train, rcond=None)[0]
    return train - a @ beta, test - np.column_stack([np.ones(len(c_test)), c_test]) @ beta


def multi_fit(x: np.ndarray, y: np.ndarray, x_test: np.ndarray) -> np.ndarray:
    """Least squares on columns centred in either set."""
    a, b = x - x.mean(0), x_test - x_test.mean(0)
    return b @ np.linalg.lstsq(a, y - y.mean(), rcond=None)[0] + y.mean()


def resampled_statistics(spark, x: np.ndarray, y: np.ndarray, side: np.ndarray, samples: int = 50, n_train: int = 200, n_test: int = 100, seed: int = 601931, **options) -> pd.DataFrame:
    """Of each train / test sample the correlation, determination and sign accuracy of bml, si and sml, and alpha."""
    rows = []
    for s in range(samples):
        order = np.random.default_rng([seed, s]).permutation(len(y))
        train, test = np.sort(order[:n_train]), np.sort(order[n_train : n_train + n_test])
        got = predict(spark, x, train, test, y[train], side[train], side[test], seed=seed + s, **options)
        truth = (y[test] - y[train].mean()) / y[train].std(ddof=1)
        row = {"sample": s, "alpha": got["alpha"]}
        for name in ("bml", "si", "sml"):
            p = got[name]
            row |= {f"{name}_corr": float(np.corrcoef(truth, p)[0, 1]), f"{name}_cod": 1 - ((truth - p) ** 2).sum() / ((truth - truth.mean()) ** 2).sum(), f"{name}_sign": float((np.sign(truth) == np.sign(p)).mean())}
        rows.append(row)
    return pd.DataFrame(rows)


def normalise(x: np.ndarray, how: str) -> np.ndarray:
    """Rows by ``z``, ``mean``, ``rank01``, ``rank11``, ``gauss`` (ranks to normal scores) or ``fisher``."""
    n = x.shape[-1]
    if how == "z":
        sd = x.std(-1, ddof=1, keepdims=True)
        return np.where(sd > 1e-12, (x - x.mean(-1, keepdims=True)) / np.where(sd > 0, sd, 1), 0)
    if how == "mean":
        return x - x.mean(-1, keepdims=True)
    if how == "fisher":
        return np.arctanh(np.clip(x, -0.999999, 0.999999))
    r = ranks(x)
    if how == "rank01":
        return r / n
    if how == "rank11":
        return 2 * r / (n - 1) - 1
    if how == "gauss":
        from ..functions.distributions import p_to_z

        return -p_to_z((r + 0.5) / n)
    raise ValueError(how)


def rank_match(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """x with the distribution of ``target``, by ranks."""
    return np.interp(ranks(x) / max(len(x) - 1, 1), np.linspace(0, 1, len(target)), np.sort(target))


def rank01_column(value: str, by: list[str], tie: str) -> Column:
    w = Window.partitionBy(*by)
    return (F.row_number().over(w.orderBy(value, tie)) - 1) / F.count("*").over(w)
