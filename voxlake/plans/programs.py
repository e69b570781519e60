"""Whole programs: the steps of each analysis in order, DataFrames in and out.

Each function has the parameters of a command of that analysis with their defaults.  ``PROGRAMS`` lists all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import t_to_z
from ..functions.volumes import VOXEL, dense, per_volume, sparse
from ..operators import edge_density as ted
from ..operators import filters, glm, laminar, learning, networks, preprocess, stats
from ..operators.permutation import SEED, condition_swaps, draw_value
from ..sources import files, text
from .store import settle

SHAPE = tuple[int, int, int]


# -- inference with permutations -------------------------------------------------------------------


def _finish(maps: DataFrame, shape: SHAPE, alpha: float, radius: int, rvar: float, svar: float, iterations: int, cleanup: bool, bins: int = stats.BINS) -> DataFrame:
    """maps (perm, b, r, c, value), perm 0 the observed one: scaled by the null's deviation, smoothed, and turned into 1 - Fdr."""
    sd = stats.null_sd(maps)
    smooth = filters.bilateral_filter(stats.z_scale(maps, sd), shape, ["perm"], radius=radius, rvar=rvar, svar=svar, iterations=iterations) if iterations else stats.z_scale(maps, sd)
    smooth = settle(smooth)
    real = smooth.filter("perm = 0").drop("perm")
    lo, hi = stats.histogram_range(real)
    h = stats.histogram(smooth, lo, hi, bins, [(F.col("perm") > 0).alias("is_null")])
    curve = stats.fdr_curve(h.filter("is_null"), h.filter("not is_null"), bins)
    out = stats.fdr_map(real, curve, lo, hi, bins, alpha)
    return stats.drop_isolated(out, 1 - alpha, shape) if cleanup else out


def _permuted(series: DataFrame, tables: np.ndarray, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(perm, b, r, c, value) of voxels' subject arrays: f(values [voxels, subjects], table row); no row where 0 or not finite."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            y = np.stack(pdf.ts.to_numpy()).astype(float)
            for p, row in enumerate(tables):
                z = f(y, row)
                keep = np.flatnonzero(np.isfinite(z) & (z != 0))
                if len(keep):
                    yield pd.DataFrame({"perm": np.int32(p), "b": pdf.b.to_numpy()[keep], "r": pdf.r.to_numpy()[keep], "c": pdf.c.to_numpy()[keep], "value": z[keep]})

    return series.select("b", "r", "c", "ts").mapInPandas(run, "perm int, b int, r int, c int, value double")


def _moments(y: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = on.sum(1)
    mean = np.where(on, y, 0).sum(1) / np.maximum(k, 1)
    var = (np.where(on, y - mean[:, None], 0) ** 2).sum(1) / np.maximum(k - 1, 1)
    return k, mean, var


def one_sample_z(y: np.ndarray, flips: np.ndarray) -> np.ndarray:
    u = y * np.where(flips > 0, -1, 1)
    k, mean, var = _moments(u, np.abs(y) > 1e-8)
    ok = (k >= y.shape[1] - 2) & (k > 1) & (var >= 1e-8)
    t = np.where(ok, np.sqrt(k) * mean / np.sqrt(np.where(ok, var, 1)), 0)
    return np.where(ok, t_to_z(t, np.maximum(k - 1, 1)), 0)


def two_sample_z(y: np.ndarray, group: np.ndarray, kind: str = "pooled") -> np.ndarray:
    on = np.abs(y) > 1e-8
    (n1, m1, v1), (n2, m2, v2) = (_moments(y[:, group == g], on[:, group == g]) for g in (1, 2))
    ok = (n1 >= (group == 1).sum() - 2) & (n2 >= (group == 2).sum() - 2) & (n1 > 1) & (n2 > 1)
    a, b = np.maximum(n1, 2), np.maximum(n2, 2)
    if kind == "welch":
        s1, s2 = v1 / a, v2 / b
        ok &= (v1 >= 1e-10) & (v2 >= 1e-10)
        sd, df = np.sqrt(s1 + s2), (s1 + s2) ** 2 / np.maximum(s1**2 / (a - 1) + s2**2 / (b - 1), 1e-300)
    else:
        ok &= (np.abs(m1 * n1) >= 1e-10) & (np.abs(m2 * n2) >= 1e-10)
        df = (a + b - 2).astype(float)
        sd = np.sqrt((1 / a + 1 / b) * (v1 * (a - 1) + v2 * (b - 1)) / df)
    ok &= sd >= 1e-10
    t = np.where(ok, (m1 - m2) / np.where(ok, sd, 1), 0)
    return np.where(ok, t_to_z(t, np.where(ok, df, 1)), 0)


def paired_z(y: np.ndarray, swaps: np.ndarray) -> np.ndarray:
    n = y.shape[1] // 2
    a, b = y[:, :n], y[:, n:]
    on = (np.abs(a) > 1e-8) & (np.abs(b) > 1e-8)
    k, mean, var = _moments((a - b) * np.where(swaps > 0, -1, 1), on)
    ok = (k >= n - 2) & (k > 1) & (var >= 1e-10)
    t = np.where(ok, np.sqrt(k) * mean / np.sqrt(np.where(ok, var, 1)), 0)
    return np.where(ok, t_to_z(t, np.maximum(k - 1, 1)), 0)


def flip_table(n: int, perms: int, seed: int = SEED) -> np.ndarray:
    return np.array([[0 if p == 0 else draw_value(seed, p, i) % 2 for i in range(n)] for p in range(perms + 1)])


def shuffle_table(n: int, perms: int, seed: int = SEED, blocks: np.ndarray | None = None) -> np.ndarray:
    """Row 0 the identity, then orders of 0 .. n - 1, within blocks."""
    blocks = np.zeros(n, int) if blocks is None else np.asarray(blocks)
    out = np.tile(np.arange(n), (perms + 1, 1))
    for p in range(1, perms + 1):
        key = np.array([draw_value(seed, p, i) for i in range(n)])
        for g in np.unique(blocks):
            at = np.flatnonzero(blocks == g)
            out[p, at] = at[np.argsort(key[at], kind="stable")]
    return out


def inference_generic(observed: DataFrame, permutations: DataFrame, shape: SHAPE, alpha: float = 0.05, radius: int = 2, rvar: float = 2.0, svar: float = 2.0, filteriterations: int = 2, cleanup: bool = True) -> DataFrame:
    """Inference for any statistic: an observed map and maps (perm, b, r, c, value) under the null."""
    maps = observed.select(F.lit(0).alias("perm"), *VOXEL, "value").unionByName(permutations.select((F.col("perm") + 1 - F.lit(int(permutations.agg(F.min("perm")).first()[0] or 0))).alias("perm"), *VOXEL, "value"))
    return _finish(maps, shape, alpha, radius, rvar, svar, filteriterations, cleanup)


def inference_onesample(subjects: DataFrame, n: int, shape: SHAPE, mask: DataFrame | None = None, alpha: float = 0.05, perm: int = 5000, seed: int = SEED, radius: int = 2, rvar: float = 2.0, svar: float = 2.0, filteriterations: int = 2, cleanup: bool = True) -> DataFrame:
    maps = _permuted(glm.as_series(filters.apply_mask(subjects, mask), n), flip_table(n, perm, seed), one_sample_z)
    return _finish(settle(maps), shape, alpha, radius, rvar, svar, filteriterations, cleanup)


def inference_twosample(subjects: DataFrame, groups: np.ndarray, shape: SHAPE, test: str = "pooled", mask: DataFrame | None = None, alpha: float = 0.05, perm: int = 5000, seed: int = SEED, radius: int = 2, rvar: float = 2.0, svar: float = 2.0, filteriterations: int = 2, cleanup: bool = True) -> DataFrame:
    """groups: 1 or 2 of each subject.  ``paired``: subject k of group 1 with subject k of group 2."""
    groups = np.asarray(groups)
    n = len(groups)
    series = glm.as_series(filters.apply_mask(subjects, mask), n)
    if test == "paired":
        order = np.concatenate([np.flatnonzero(groups == 1), np.flatnonzero(groups == 2)])
        maps = _permuted(series, flip_table(n // 2, perm, seed), lambda y, row: paired_z(y[:, order], row))
    else:
        maps = _permuted(series, groups[shuffle_table(n, perm, seed)], lambda y, g: two_sample_z(y, g, test))
    return _finish(settle(maps), shape, alpha, radius, rvar, svar, filteriterations, cleanup)


def inference_2ndlevel(subjects: DataFrame, design: np.ndarray, contrast: np.ndarray, shape: SHAPE, groups: np.ndarray | None = None, nuisance: np.ndarray | None = None, demean: bool = True, mask: DataFrame | None = None, alpha: float = 0.05, perm: int = 5000, seed: int = SEED, radius: int = 2, rvar: float = 2.0, svar: float = 2.0, filteriterations: int = 2, cleanup: bool = True) -> DataFrame:
    """A linear model over subjects.  Design columns are permuted within exchange groups, nuisance columns never; one constant contrast column has its sign switched instead."""
    design, contrast = np.asarray(design, float), np.asarray(contrast, float)
    n = len(design)
    x = design if nuisance is None else np.column_stack([design, glm.demean_columns(np.asarray(nuisance, float)) if demean else nuisance])
    c = np.concatenate([contrast, np.zeros(x.shape[1] - len(contrast))])
    constant = [k for k in range(design.shape[1]) if contrast[k] != 0 and design[:, k].std() < 1e-10]
    if len(constant) > 1:
        raise ValueError("two contrast columns are constant")
    tables = flip_table(n, perm, seed) if constant else shuffle_table(n, perm, seed, groups)
    fitted: list = []
    for row in tables:
        xs = x.copy()
        if constant:
            xs[:, constant[0]] *= np.where(row > 0, -1, 1)
        else:
            xs[row, : design.shape[1]] = design
        p = glm.pseudo_inverse(xs)
        trace, df = glm.degrees_of_freedom(xs)
        fitted.append((p, np.eye(n) - xs @ p, trace, df, float(c @ p @ p.T @ c)))

    def z(y: np.ndarray, k: np.ndarray) -> np.ndarray:
        p, r, trace, df, scale = fitted[int(k)]
        sd = np.sqrt(np.maximum(((y @ r.T) ** 2).sum(1) / trace * scale, 0))
        ok = ((np.abs(y) > 1e-8).sum(1) >= n - 2) & (sd > 1e-10)
        return np.where(ok, t_to_z(np.where(ok, (y @ p.T @ c) / np.where(ok, sd, 1), 0), df), 0)

    maps = _permuted(glm.as_series(filters.apply_mask(subjects, mask), n), np.arange(len(tables)), z)
    return _finish(settle(maps), shape, alpha, radius, rvar, svar, filteriterations, cleanup)


def _first_level(series: DataFrame, trials: pd.DataFrame, contrast: np.ndarray, n_steps: int, tr: float, f: Callable, shape: SHAPE, hemo: str, nuisance, perm: int, seed: int, **options) -> DataFrame:
    """Maps of the model of each shuffle of trial labels within runs, and inference on them."""
    run = trials["run"].to_numpy() if "run" in trials else np.zeros(len(trials), int)
    maps = None
    for p, row in enumerate(shuffle_table(len(trials), perm, seed, run)):
        x = preprocess.design_matrix(trials.assign(id=trials.id.to_numpy()[row], height=trials.height.to_numpy()[row]), n_steps, tr, hemo, nuisance)
        c = np.concatenate([np.asarray(contrast, float), np.zeros(x.shape[1] - len(contrast))])
        one = f(series, x, c).select(F.lit(p).alias("perm"), *VOXEL, "value")
        maps = one if maps is None else maps.unionByName(one)
    return _finish(settle(maps), shape, options.get("alpha", 0.05), options.get("radius", 2), options.get("rvar", 2.0), options.get("svar", 2.0), options.get("filteriterations", 2), options.get("cleanup", True))


def inference_precoloring(series: DataFrame, trials: pd.DataFrame, contrast: np.ndarray, n_steps: int, tr: float, shape: SHAPE, hemo: str = "gamma_0", nuisance=None, perm: int = 5000, seed: int = SEED, mask: DataFrame | None = None, **options) -> DataFrame:
    return _first_level(filters.apply_mask(series, mask), trials, contrast, n_steps, tr, glm.contrast_map, shape, hemo, nuisance, perm, seed, **options)


def inference_prewhitening(series: DataFrame, trials: pd.DataFrame, contrast: np.ndarray, n_steps: int, tr: float, shape: SHAPE, hemo: str = "gamma_0", nuisance=None, order: int = 1, perm: int = 5000, seed: int = SEED, **options) -> DataFrame:
    white = lambda s, x, c: glm.prewhitened(s, x, c, order).withColumnRenamed("z", "value")
    return _first_level(series, trials, contrast, n_steps, tr, white, shape, hemo, nuisance, perm, seed, **options)


# -- networks --------------------------------------------------------------------------------------


def _window(series: DataFrame, first: int, length: int) -> DataFrame:
    stop = F.size("ts") if length < 1 else F.least(F.size("ts"), F.lit(first + length))
    return series.withColumn("ts", F.slice("ts", first + 1, stop - first))


def ecm(series: DataFrame, mask: DataFrame | None = None, first: int = 0, length: int = 0, metric: str = "rlc", iterations: int = 20, project: bool = False, seed: int = SEED) -> DataFrame:
    s = _window(filters.apply_mask(series, mask), first, length)
    if project:
        return networks.projected_ecm(s, metric, seed)
    return networks.ecm(s, metric, iterations) if metric in ("rlc", "add", "none", "neg_rlc") else networks.dense_ecm(s, metric, iterations)


def spectral_ecm(series: DataFrame, tr: float, wavelength: float, mask: DataFrame | None = None, first: int = 0, length: int = 0, nlags: int = 10, type: str = "freq") -> DataFrame:
    return networks.spectral_ecm(_window(filters.apply_mask(series, mask), first, length), tr, wavelength, nlags, type)


def bipartite(series: DataFrame, roi1: DataFrame | None = None, roi2: DataFrame | None = None, seed1=None, seed2=None, radius: int = 5, type: int = 1, threshold: float = 0.0, metric: str = "pearson", normalize: bool = True) -> DataFrame:
    """(side, vid, value).  type 0 degree, 1 centrality, 2 projection on the first region, 3 on the second."""
    a = filters.apply_positive_mask(series, roi1) if roi1 is not None else networks.spherical_roi(series, seed1, radius)
    b = filters.apply_positive_mask(series, roi2) if roi2 is not None else networks.spherical_roi(series, seed2, radius)
    e = settle(networks.bipartite_edges(a, b, metric, threshold))
    na, nb = a.count(), b.count()
    if type == 0:
        out = networks.bipartite_degree(e, na, nb)
    elif type == 1:
        out = networks.bipartite_centrality(e, a, b)
    else:
        side = type - 1
        out = networks.network_projection(e, side, nb if side == 1 else na).select(F.lit(side).alias("side"), "vid", "value")
    if normalize:
        m = out.groupBy("side").agg(F.max(F.abs("value")).alias("_m"))
        out = out.join(m, "side").withColumn("value", F.when(F.col("_m") > 0, 100 * F.col("value") / F.col("_m")).otherwise(0.0)).drop("_m")
    return out


def ccm(cohort: DataFrame, mask: DataFrame | None = None, first: int = 2, length: int = 0, type: str = "kendall", gauss: bool = False) -> DataFrame:
    return networks.concordance_map(filters.apply_mask(cohort, mask), type, gauss, first, length)


# -- edge density ----------------------------------------------------------------------------------


def task_edge_density(trials: DataFrame, shape: SHAPE, permutations: int = 0, qthreshold: float = 0.99, adj: int | str = 26, type: str = "snr", metric: str = "pearson", edgelength: int = 5, seed: int = SEED) -> dict:
    """trials (cond 1 / 2, trial, vid, b, r, c, t, value).  ``edges`` of the observed data, ``real`` and ``null`` histograms."""
    n = int(trials.agg(F.max("trial")).first()[0]) + 1
    table = condition_swaps(n, permutations, seed)

    def averaged(row: np.ndarray) -> DataFrame:
        swap = F.array(*(F.lit(int(s)) for s in row))
        cond = F.when(swap[F.col("trial")] > 0, 3 - F.col("cond")).otherwise(F.col("cond"))
        means = [preprocess.average_trials(trials.withColumn("cond", cond).filter(F.col("cond") == k), type).groupBy("vid").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias(name)) for k, name in ((1, "x"), (2, "y"))]
        places = trials.select("vid", "b", "r", "c").distinct()
        return settle(ted.prepare(places.join(means[0], "vid").join(means[1], "vid"), metric))

    out: dict = {}
    for p, row in enumerate(table):
        x = averaged(row)
        z = ted.quantile_threshold(ted.difference_histogram(x, shape, edgelength), qthreshold)
        e = settle(ted.edge_density(x, shape, z, adj, edgelength))
        h = ted.density_histogram(e)
        if p == 0:
            out |= {"edges": e.filter(F.col("ted") >= ted.NOISE), "real": h, "threshold": z}
        else:
            out["null"] = h if "null" not in out else out["null"].unionByName(h).groupBy("bin").agg(F.sum("n").alias("n"))
    return out


def edge_density_fdr(real: DataFrame, null: DataFrame, alpha: float = 0.05) -> tuple[DataFrame, float | None]:
    """The table, with each bin's middle, and the cutoff."""
    t, b = stats.tail_fdr_table(null, real, ted.TED_BINS, alpha)
    width = (ted.TED_RANGE[1] - ted.TED_RANGE[0]) / ted.TED_BINS
    return t.withColumn("ted", (F.col("bin") + 0.5) * width), None if b is None else (b + 0.5) * width


def edge_hubs(edges: DataFrame, voxels: DataFrame, min: float = 0.5, max: float = 1.0, roi: DataFrame | None = None) -> DataFrame:
    return ted.hub_map(edges, min, max, voxels, roi)


def cut_trials(series: DataFrame, trials: pd.DataFrame, tr: float, cond: int = 1, trial: int = 0, resolution: float = 1.0, start: float = 0.0, length: float = 20.0) -> DataFrame:
    chosen = trials[trials.id == cond].sort_values("onset")
    return preprocess.cut_trial(series, float(chosen.onset.iloc[trial]), tr, start, length, resolution)


# -- learning --------------------------------------------------------------------------------------


def semi_blind_prediction(train: DataFrame, test: DataFrame, y: DataFrame, side: DataFrame, dimX: int = 500, ensembles: int = 1000, npls: int = 10, seed: int = 601931) -> pd.DataFrame:
    """id, Observed, SI, BML, SML of the test subjects; ``y`` (subj, y) and ``side`` (subj, x) of all."""
    spark = train.sparkSession
    rows = learning.zscore_rows(learning.load_connectomes(train.select("subj", "feats").unionByName(test.select("subj", "feats"))))
    ids, x = learning.collect_matrix(rows)
    target, extra = ({r[0]: r[1] for r in d.collect()} for d in (y.select("subj", "y"), side.select("subj", "x")))  # a number a subject
    own = {r.subj for r in train.select("subj").collect()}
    a, b = (np.array([i for i, s in enumerate(ids) if (s in own) is want]) for want in (True, False))
    yt = np.array([target[s] for s in ids[a]], float)
    got = learning.predict(spark, x, a, b, yt, np.array([extra[s] for s in ids[a]], float), np.array([extra[s] for s in ids[b]], float), dimX, ensembles, npls, seed)
    seen = np.array([(target.get(s, np.nan) - yt.mean()) / yt.std(ddof=1) for s in ids[b]])
    return pd.DataFrame({"id": ids[b], "Observed": seen, "SI": got["si"], "BML": got["bml"], "SML": got["sml"]})


def semi_blind_statistics(rows: DataFrame, y: np.ndarray, side: np.ndarray, confounds: np.ndarray | None = None, nsamples: int = 50, ntrain: int = 200, ntest: int = 100, seed: int = 601931, **options) -> pd.DataFrame:
    _, x = learning.collect_matrix(learning.zscore_rows(learning.load_connectomes(rows)))
    if confounds is not None:
        y, _ = learning.residualise(y, y, confounds, confounds)
    return learning.resampled_statistics(rows.sparkSession, x, y, side, nsamples, ntrain, ntest, seed, **options)


# -- layers ----------------------------------------------------------------------------------------


def cortical_layers(zmap: DataFrame, metric: DataFrame, rims: DataFrame, shape: SHAPE, analyses: tuple[str, ...] = ("3bins",), equivol: bool = False, radius: float = 2.0, nperm: int = 1000, seed: int = 5555, pixdim=(1.0, 1.0, 1.0)) -> dict[str, DataFrame]:
    """Maps (b, r, c, t, value) of each analysis: 3bins, nbins, peak, concave, linear, R2, maxabs."""
    cyl = settle(laminar.cylinders(rims, shape, pixdim, radius))
    if equivol:
        metric = settle(laminar.equivolume(cyl, metric))
    points = settle(laminar.samples(cyl, zmap, metric))
    extra = {"3bins": {"perms": nperm, "seed": seed}}
    return {a: laminar.scatter_average(cyl, laminar.per_cylinder(points, a, **extra.get(a, {})), rims) for a in analyses}


def layers_getmask(zmap: DataFrame, metric: DataFrame, rims: DataFrame, shape: SHAPE, **options) -> DataFrame:
    """The signed largest magnitude of each cylinder, averaged where cylinders overlap."""
    return cortical_layers(zmap, metric, rims, shape, ("maxabs",), **options)["maxabs"]


def layers_equivolume(metric: DataFrame, rims: DataFrame, shape: SHAPE, radius: float = 2.0, pixdim=(1.0, 1.0, 1.0)) -> DataFrame:
    return laminar.equivolume(laminar.cylinders(rims, shape, pixdim, radius), metric)


def layers_probe(volumes: DataFrame, type: str = "volume", volume: int = 0, xinvert: bool = False) -> DataFrame:
    """Of volumes t: one of them, ``max_id``, ``min_id``, ``maxabs``; of z of 3bins ``top_d`` / ``top_m`` / ``top_s`` or ``bottom_*``: the layer beats (or is below) both others."""
    if xinvert:
        volumes = filters.invert(volumes)
    if type == "volume":
        return filters.select_volume(volumes, volume)
    if type in ("max_id", "min_id", "maxabs"):
        return filters.pick_volume(volumes, type)
    kind, layer = type.split("_")
    dm, ds, ms = (filters.select_volume(volumes, t) for t in (3, 4, 5))
    a, b = {"d": (dm, ds), "m": (filters.invert(dm), ms), "s": (filters.invert(ds), filters.invert(ms))}[layer]
    if kind == "bottom":
        a, b = filters.invert(a), filters.invert(b)
    return filters.conjunction(a, b)


def layers_roi(zmap: DataFrame, metric: DataFrame, mask: DataFrame, nbins: int = 5) -> DataFrame:
    x = filters.apply_positive_mask(zmap, mask).filter("value <> 0").select(*VOXEL, F.col("value").alias("z"))
    return laminar.roi_profile(x.join(metric.select(*VOXEL, F.col("value").alias("u")), list(VOXEL)), nbins)


def layers_seed(zmap: DataFrame, metric: DataFrame, rims: DataFrame, shape: SHAPE, seed: SHAPE, radius: float = 2.0, type: str = "3bins", equivol: bool = True) -> DataFrame:
    """The profile of the cylinder nearest to a seed: bins, or depth, value and fit (``peak``)."""
    cyl = settle(laminar.cylinders(rims, shape, radius=radius))
    if equivol:
        metric = laminar.equivolume(cyl, metric)
    points = laminar.usable(laminar.best_cylinder(cyl, seed).select("cid", *VOXEL).join(metric.select(*VOXEL, F.col("value").alias("u")), list(VOXEL)).join(zmap.select(*VOXEL, F.col("value").alias("z")), list(VOXEL)))
    if type == "peak":
        return laminar.per_cylinder(points, lambda u, z: laminar.seed_profile(u, z).ravel())
    return laminar.per_cylinder(points, type)


def rim(labels: DataFrame, shape: SHAPE, gm: int = 2, wm: int = 1, csf: int = 0) -> DataFrame:
    return laminar.rim(labels, shape, gm, wm, csf)


def metric(rims: DataFrame, shape: SHAPE, gm: int = 3, wm: int = 2, csf: int = 1, pixdim=(1.0, 1.0, 1.0), type: str = "chamfer") -> DataFrame:
    """``chamfer`` (paths inside) or ``euclidean``."""
    code = F.when(F.col("value") == csf, 1.0).when(F.col("value") == wm, 2.0).when(F.col("value") == gm, 3.0).otherwise(0.0)
    return laminar.depth_volume(rims.withColumn("value", code), shape, type, pixdim)


def fdr(zmap: DataFrame, alpha: float = 0.05, dependence: bool = False) -> DataFrame:
    return stats.benjamini_hochberg(zmap, alpha, dependence)


# -- preparation and files -------------------------------------------------------------------------


def detrend(series: DataFrame, type: str = "demean", linear: bool = True, window: float = 60, delete: int = 0, tr: float = 1.0, mask: DataFrame | None = None, minval: float = -1e6) -> DataFrame:
    s = filters.apply_mask(series, mask) if mask is not None else filters.mean_minval(series, minval)
    return preprocess.detrend(s, type, linear, window, tr, delete)


def preprocess_series(series: DataFrame, shape: SHAPE, tr: float, fwhm: float = 0, highpass: float = 0, lowpass: float = 0, stop: bool = False, mask: DataFrame | None = None, pixdim=(1.0, 1.0, 1.0)) -> DataFrame:
    """Band-pass, then smoothing of each time step."""
    s = filters.apply_mask(series, mask)
    if highpass > 0 or lowpass > 0:
        s = preprocess.frequency_filter(s, tr, highpass, lowpass, stop)
    if fwhm <= 0:
        return s
    long = s.select("b", "r", "c", F.posexplode("ts").alias("t", "value"))
    out = filters.smooth(long, shape, fwhm, pixdim, ["t"]).join(s.select("b", "r", "c"), list(VOXEL), "left_semi")
    return out.groupBy("b", "r", "c").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("ts"))


def denoise(volume: DataFrame, shape: SHAPE, wavelet: str = "haar", filter: int = 0, shift: int = 1, level: float = 0.5) -> DataFrame:
    return per_volume(volume, lambda a: preprocess.denoise(a, wavelet, filter, shift, level), shape)


def reduce_speckle(volume: DataFrame, shape: SHAPE, iter: int = 7, type: int = 0, rho: float = 0.1666) -> DataFrame:
    return per_volume(volume, lambda a: preprocess.speckle_reduction(a, iter, rho, type), shape)


def convert_files(spark, path: str, out: str | None = None, shape: SHAPE | None = None, kind: str = "nii") -> DataFrame:
    """Any readable files as rows, or as (path, content) of another format."""
    rows = files.read_volumes(spark, path)
    return rows if out is None else files.encode_volumes(rows, shape, kind)


#: Programs by what they do; the values are functions of this module or of the sources.
PROGRAMS: dict[str, Callable] = {
    "inference_generic": inference_generic, "inference_onesample": inference_onesample, "inference_twosample": inference_twosample, "inference_2ndlevel": inference_2ndlevel, "inference_precoloring": inference_precoloring,
    "inference_prewhitening": inference_prewhitening, "inference_applythreshold": stats.apply_threshold, "ecm": ecm, "spectralecm": spectral_ecm, "bcm": bipartite, "ccm": ccm, "ted": task_edge_density,
    "tedfdr": edge_density_fdr, "hubness": edge_hubs, "cuttrials": cut_trials, "semi_blind_prediction": semi_blind_prediction, "semi_blind_statistics": semi_blind_statistics, "readconnectome": text.read_connectomes,
    "layers": cortical_layers, "layers_probe": layers_probe, "layers_roi": layers_roi, "layers_seed": layers_seed, "layers_equivol": layers_equivolume, "layers_getmask": layers_getmask,
    "rim": rim, "metric": metric, "metric_euclid": lambda rims, shape, **k: metric(rims, shape, type="euclidean", **k), "fdr": fdr, "detrend": detrend, "preprocess": preprocess_series,
    "denoise": denoise, "srad": reduce_speckle, "nifti": convert_files, "dicom": files.read_dicom, "applymask": filters.apply_positive_mask, "binarize": filters.binarize,
}

__all__ = ["PROGRAMS", "dense", "sparse", *[k for k in dir() if k.startswith("inference_")]]
