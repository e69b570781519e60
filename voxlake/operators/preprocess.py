"""Time series: trends, band-pass, haemodynamic design, trial cuts; slices: denoising."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.volumes import roll


def per_series(series: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``f`` of stacked series (rows x steps), batch by batch; other columns stay."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                out = np.empty(len(pdf), object)
                lengths = pdf.ts.map(len).to_numpy()
                for n in np.unique(lengths):
                    at = np.flatnonzero(lengths == n)
                    y = f(np.stack(pdf.ts.iloc[at].to_numpy()).astype(float)) if n else np.zeros((len(at), 0))
                    for i, row in zip(at, y):
                        out[i] = row
                pdf = pdf.assign(ts=list(out))
            yield pdf

    return series.mapInPandas(run, series.withColumn("ts", F.col("ts").cast("array<double>")).schema)


def subtract_moving_average(rows: DataFrame, key: list[str], window: float = 60, tr: float = 1.0, skip: int = 0, low: float | None = None, high: float | None = None) -> DataFrame:
    """rows (key, t, value): less the mean of steps within int(window / 2 / tr), plus the overall mean; the first ``skip`` steps count in neither."""
    half = int(0.5 * window / tr)
    v = F.when(F.col("t") >= skip, F.col("value"))
    part = Window.partitionBy(*key)
    out = F.col("value") - F.avg(v).over(part.orderBy("t").rowsBetween(-half, half)) + F.avg(v).over(part)
    if low is not None and high is not None:
        out = F.greatest(F.lit(low), F.least(F.lit(high), out))
    return rows.withColumn("value", out)


def polynomial_detrend(x: np.ndarray, order: int, skip: int = 0, low: float = -np.inf, high: float = np.inf) -> np.ndarray:
    """1.25 times the residual of a weighted fit plus the mean.  The first skip + 1 steps weigh 0.01; the mean is over all steps' count from ``skip`` on; the first ``skip`` steps become the mean of the result."""
    n = x.shape[1]
    t = np.arange(n) / max(n - 1, 1)
    design = np.stack([t**k for k in range(order + 1)], axis=1)
    w = np.where(np.arange(n) < skip + 1, 0.1, 1.0)  # the root of the weight
    beta = np.linalg.lstsq(design * w[:, None], (x * w).T, rcond=None)[0]
    mean = x[:, skip:].sum(1, keepdims=True) / n
    out = 1.25 * (x - (design @ beta).T) + mean
    if skip:
        out[:, :skip] = out[:, skip:].mean(1, keepdims=True)
    return np.clip(out, low, high)


def detrend(series: DataFrame, kind: str = "demean", linear: bool = True, window: float = 60, tr: float = 1.0, skip: int = 0) -> DataFrame:
    """A linear trend first, if asked; then ``demean`` (moving average), ``linear``, ``cubic`` or ``order5``."""

    def f(x: np.ndarray) -> np.ndarray:
        if linear and kind != "linear":
            x = polynomial_detrend(x, 1, skip)
        if kind != "demean":
            return polynomial_detrend(x, {"linear": 1, "cubic": 3, "order5": 5}[kind], skip)
        half, n = int(0.5 * window / tr), x.shape[1]
        total = np.concatenate([np.zeros((len(x), 1)), np.cumsum(np.where(np.arange(n) >= skip, x, 0), axis=1)], axis=1)
        lo, hi = np.maximum(np.arange(n) - half, skip), np.minimum(np.arange(n) + half + 1, n)
        lo = np.minimum(lo, hi)
        mean = np.divide(total[:, hi] - total[:, lo], hi - lo, out=np.zeros_like(x), where=(hi > lo)[None, :])
        return x - mean + x[:, skip:].mean(1, keepdims=True)

    return per_series(series, f)


def band_pass(x: np.ndarray, tr: float, highpass: float = 0, lowpass: float = 0, stop: bool = False) -> np.ndarray:
    """Logistic band edges in seconds of period: z-score, reflect 40 steps at either end (none of shorter series), pad to a power of two, weigh bins, restore mean and deviation.  Constant series become 0."""
    n = x.shape[1]
    mean, sd = x.mean(1, keepdims=True), x.std(1, ddof=1, keepdims=True) if n > 1 else np.zeros((len(x), 1))
    z = np.where(sd > 1e-6, (x - mean) / np.where(sd > 1e-6, sd, 1), 0)
    tail = 40 if n > 40 else 0
    if tail:
        z = np.concatenate([z[:, tail:0:-1], z, z[:, -2 : -tail - 2 : -1]], axis=1)
    size = 1 << max(z.shape[1] - 1, 1).bit_length()
    f = np.fft.rfft(z, size, axis=1)
    i = np.arange(1, f.shape[1])
    period = size * tr / i
    w = np.ones(len(i))
    if lowpass > 0:
        w = w / (1 + np.exp(np.clip(lowpass - period, -700, 700)))
    if highpass > 0:
        w = w / (1 + np.exp(np.clip(period - highpass, -700, 700)))
    f[:, 1:] *= 1 - w if stop else w
    out = np.fft.irfft(f, size, axis=1)[:, tail : tail + n] * sd + mean
    return np.where(sd > 1e-6, out, 0)


def frequency_filter(series: DataFrame, tr: float, highpass: float = 0, lowpass: float = 0, stop: bool = False) -> DataFrame:
    return per_series(series, lambda x: band_pass(x, tr, highpass, lowpass, stop))


# -- design of events ------------------------------------------------------------------------------


def gamma(x: np.ndarray) -> np.ndarray:
    """Response of two gamma curves; 0 outside 0 .. 50 s."""
    a1, b1, a2, b2, c, scale = 6.0, 0.9, 12.0, 0.9, 0.35, 20.0
    d1, d2 = a1 * b1, a2 * b2
    u = np.clip(x, 1e-12, None)
    y = (u / d1) ** a1 * np.exp(-(u - d1) / b1) - c * (u / d2) ** a2 * np.exp(-(u - d2) / b2)
    return np.where((x < 0) | (x > 50), 0, y / scale)


def kernels(hemo: str, dt: float, length: float = 30.0) -> list[np.ndarray]:
    """``gamma_0``, with the first (``gamma_1``) and second derivative (``gamma_2``), or ``gauss``."""
    t = np.arange(0, length, dt)
    if hemo == "gauss":
        return [np.exp(-0.5 * (t - 5 * dt) ** 2)]
    h = 1e-4
    one = (gamma(t + h) - gamma(t - h)) / (2 * h)
    two = (gamma(t + h) - 2 * gamma(t) + gamma(t - h)) / (h * h)
    return [gamma(t), one, two][: int(hemo[-1]) + 1]


def design_matrix(trials: pd.DataFrame, n_steps: int, tr: float, hemo: str = "gamma_0", covariates: np.ndarray | None = None) -> np.ndarray:
    """Constant, blocks of columns for each event 1 .. K, covariates.  trials: id, onset, duration, height, in seconds."""
    factor = max(1, int(tr / 0.5))
    dt = tr / factor
    n = n_steps * factor
    cols = [np.ones(n_steps)]
    for event in range(1, int(trials.id.max()) + 1):
        box = np.zeros(n)
        for t in trials[trials.id == event].itertuples():
            a, b = int(t.onset / dt + 0.5), int((t.onset + t.duration) / dt + 0.5)
            box[max(a, 0) : max(min(b + 1, n), 0)] = t.height
        for k in kernels(hemo, dt):
            cols.append(np.convolve(box, k)[:n][::factor] / factor)
    if covariates is not None:
        cols += list(np.asarray(covariates, float).T)
    return np.stack(cols, axis=1)


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The natural cubic spline through (x, y) at the given places."""
    n = len(x)
    if n < 3:
        return np.interp(at, x, y)
    h = np.diff(x)
    a = np.zeros((n, n))
    a[0, 0] = a[-1, -1] = 1
    r = np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 3 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    c = np.linalg.solve(a, r)
    b = np.diff(y) / h - h * (2 * c[:-1] + c[1:]) / 3
    d = np.diff(c) / (3 * h)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    u = at - x[i]
    return y[i] + u * (b[i] + u * (c[i] + u * d[i]))


def cut_trial(series: DataFrame, onset: float, tr: float, start: float = 0, length: float = 20, resolution: float = 1.0) -> DataFrame:
    """Each series on a grid of ``resolution`` seconds from onset + start, cut at its end."""

    def f(x: np.ndarray) -> np.ndarray:
        t = np.arange(x.shape[1]) * tr
        at = np.arange(onset + start, onset + start + length, resolution)
        at = at[(at >= 0) & (at <= t[-1])]
        return np.stack([natural_spline(t, row, at) for row in x])

    return per_series(series, f)


def concatenate_runs(trials: DataFrame, durations: DataFrame) -> DataFrame:
    """Onsets of later runs after the durations (run, duration) of the earlier."""
    before = durations.withColumn("_at", F.coalesce(F.sum("duration").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("run", "_at")
    return trials.join(before, "run").withColumn("onset", F.col("onset") + F.col("_at")).drop("_at")


def check_labels(trials: DataFrame) -> dict:
    """Counts by label; labels must run from 1 without a gap.  ``few``: labels with less than four trials."""
    counts = {r.id: r.n for r in trials.groupBy("id").agg(F.count("*").alias("n")).collect()}  # one row an event type
    if counts and sorted(counts) != list(range(1, max(counts) + 1)):
        raise ValueError("labels must be 1, 2, ... without a gap")
    return {"counts": counts, "few": sorted(k for k, n in counts.items() if n < 4)}


def average_trials(rows: DataFrame, how: str = "snr") -> DataFrame:
    """rows (vid, t, trial, value): mean over deviation (0 where it has none), or median, of trials at each step."""
    g = rows.groupBy("vid", "t")
    if how == "median":
        return g.agg(F.median("value").alias("value"))
    sd = F.stddev_samp("value")
    return g.agg(F.when(sd > 0, F.avg("value") / sd).otherwise(0.0).alias("value"))


# -- slices ----------------------------------------------------------------------------------------

_DB4 = [(1 + math.sqrt(3)), (3 + math.sqrt(3)), (3 - math.sqrt(3)), (1 - math.sqrt(3))]
#: Scaling filters of orthogonal wavelets by number of coefficients.
WAVELETS = {
    "haar": np.array([1, 1]) / math.sqrt(2),
    "daub4": np.array(_DB4) / (4 * math.sqrt(2)),
    "daub6": np.array([0.33267055295, 0.80689150931, 0.45987750212, -0.13501102001, -0.08544127388, 0.03522629188]),
    "daub8": np.array([0.23037781331, 0.71484657055, 0.63088076793, -0.02798376942, -0.18703481172, 0.03084138184, 0.03288301167, -0.01059740178]),
}


def _dwt(x: np.ndarray, h: np.ndarray, axis: int, back: bool) -> np.ndarray:
    """One level along an axis, periodic: the first half smooth, the second half detail."""
    x = np.moveaxis(x, axis, -1)
    n = x.shape[-1]
    g = h[::-1] * (-1.0) ** np.arange(len(h))
    at = (2 * np.arange(n // 2)[:, None] + np.arange(len(h))[None, :]) % n
    if back:
        out = np.zeros_like(x)
        for k in range(len(h)):
            np.add.at(np.moveaxis(out, -1, 0), at[:, k], np.moveaxis(h[k] * x[..., : n // 2] + g[k] * x[..., n // 2 :], -1, 0))
    else:
        out = np.concatenate([x[..., at] @ h, x[..., at] @ g], axis=-1)
    return np.moveaxis(out, -1, axis)


def wavelet(x: np.ndarray, h: np.ndarray, back: bool = False) -> np.ndarray:
    """The square transform of an n x n slice, n a power of two."""
    n, sizes = len(x), []
    while n >= 2:
        sizes.append(n)
        n //= 2
    x = x.copy()
    for n in reversed(sizes) if back else sizes:
        part = x[:n, :n]
        x[:n, :n] = _dwt(_dwt(part, h, 0, back), h, 1, back)
    return x


def denoise(a: np.ndarray, name: str = "haar", method: int = 0, shift: int = 1, level: float = 0.5) -> np.ndarray:
    """Wavelet shrinkage of each slice: Wiener (0), soft (1) or hard (2), averaged over cyclic shifts; deviation of noise = MAD of the finest details / 0.455."""
    h, out = WAVELETS[name], np.zeros(a.shape)
    for b in range(len(a)):
        x = a[b]
        on = x != 0
        if on.sum() < 2 or x[on].std() == 0:
            continue
        mean, sd = x[on].mean(), x[on].std(ddof=1)
        n = 1 << (max(x.shape) - 1).bit_length()
        pad = np.zeros((n, n))
        pad[: x.shape[0], : x.shape[1]] = np.where(on, (x - mean) / sd, 0)
        total, count = np.zeros((n, n)), 0
        for i in range(-shift, shift + 1):
            for j in range(-shift, shift + 1):
                w = wavelet(np.roll(pad, (i, j), (0, 1)), h)
                fine = w[n // 2 :, n // 2 :]
                sigma = np.median(np.abs(fine - np.median(fine))) / 0.455
                cut = level * sigma
                keep = w.copy()
                if method == 0:
                    keep = w * np.maximum(w * w - cut * cut, 0) / np.maximum(w * w, 1e-12)
                elif method == 1:
                    keep = np.sign(w) * np.maximum(np.abs(w) - cut, 0)
                else:
                    keep[np.abs(w) < cut] = 0
                keep[0, 0] = w[0, 0]
                total += np.roll(wavelet(keep, h, True), (-i, -j), (0, 1))
                count += 1
        out[b] = np.where(on, total[: x.shape[0], : x.shape[1]] / count * sd + mean, 0)
    return out


def _repair(x: np.ndarray) -> None:
    """The border of each slice takes the values beside it."""
    x[:, :, 0], x[:, :, -1] = x[:, :, 1], x[:, :, -2]
    x[:, 0, :], x[:, -1, :] = x[:, 1, :], x[:, -2, :]


def speckle_reduction(a: np.ndarray, iterations: int = 7, rho: float = 0.1666, kind: int = 0, dt: float = 0.05) -> np.ndarray:
    """Speckle-reducing diffusion of each slice; conductivity rational (0) or exponential (1).

    Zero pixels are left alone; the speckle scale falls by exp(-rho t) from round to round; each neighbour's
    flow has that neighbour's conductivity.  The border keeps its own values.
    """
    now, new, scale = a.astype(float).copy(), np.zeros(a.shape), 1.0
    conductivity = np.zeros(a.shape)
    inner = (slice(None), slice(1, -1), slice(1, -1))
    beside = [(slice(None), slice(1 + i, a.shape[1] - 1 + i), slice(1 + j, a.shape[2] - 1 + j)) for i, j in ((1, 0), (0, 1), (-1, 0), (0, -1))]
    for k in range(iterations):
        u = now[inner]
        on = np.abs(u) >= 1e-6
        some = np.where(on, u, 1.0)
        step = [now[n] - u for n in beside]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            rough, bend = sum(x * x for x in step) / some**2, sum(step) / some**2
            q = (0.5 * rough - 0.0625 * bend) / (1 + 0.25 * bend) ** 2
            excess = np.where(q > 0, (q - scale**2) / (scale**2 * (1 + scale**2)), 0)
            c = 1 / (1 + excess) if kind == 0 else np.exp(-excess)
        conductivity[inner] = np.where(on, np.where(np.isfinite(c), c, 0), conductivity[inner])
        _repair(conductivity)
        v = u + 0.25 * dt * sum(conductivity[n] * x for n, x in zip(beside, step))
        new[inner] = np.where(on, np.where(np.isfinite(v), v, 0), new[inner])
        scale *= math.exp(-rho * k * dt)
        _repair(new)
        now = new.copy()
    out = a.astype(float).copy()
    out[inner] = new[inner]
    return out


def diffuse(a: np.ndarray, iterations: int = 5, kappa: float = 1.0, alpha: float | None = None, dt: float = 1 / 7) -> np.ndarray:
    """Anisotropic diffusion in three dimensions: conductivity exp(-g^2 / kappa^2), or 1 / (1 + (g / kappa)^(1 + alpha)).

    g is the length of the gradient: along the flow the difference of the two voxels, across it central
    differences.  Zero voxels are left alone; the outer shell keeps its values and counts as 0 after the
    first round.
    """
    now = a.astype(float)
    inner = (slice(1, -1),) * 3
    at = lambda x, axis, d: x[tuple(slice(1 + d, x.shape[k] - 1 + d) if k == axis else slice(1, -1) for k in range(3))]
    for _ in range(iterations):
        u, new = now[inner], np.zeros(a.shape)
        ahead, behind = ([at(now, k, d) for k in range(3)] for d in (1, -1))
        central = [(x - y) ** 2 for x, y in zip(ahead, behind)]
        flow = np.zeros(u.shape)
        for k in range(3):
            across = sum(central[i] for i in range(3) if i != k)
            for x in (ahead[k] - u, behind[k] - u):
                g2 = x * x + across
                flow += x * (np.exp(-g2 / kappa**2) if alpha is None else 1 / (1 + (np.sqrt(g2) / kappa) ** (1 + alpha)))
        new[inner] = np.where(np.abs(u) >= 1e-10, u + dt * flow, u)
        now = new
    out = a.astype(float).copy()
    out[inner] = now[inner]
    return out
