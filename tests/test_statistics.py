import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxlake import queries
from voxlake.functions import distributions as dist
from voxlake.functions.volumes import offsets
from voxlake.operators import filters, glm, imaging, laminar, learning, networks, preprocess, stats, tiles
from voxlake.plans import programs

RNG = np.random.default_rng(3)


def test_stencil_sizes():
    assert [len(offsets(k)) for k in (6, 18, 26)] == [7, 19, 27]
    assert len(offsets("sphere", 2)) == 33 and len(offsets("cube", 2)) == 117


def test_t_to_p_known_values():
    # Cauchy and two degrees of freedom have closed forms
    t = np.array([0.1, 1.0, 5.0, 30.0])
    assert np.allclose(dist.t_to_p(t, 1), 0.5 - np.arctan(t) / math.pi)
    assert np.allclose(dist.t_to_p(t, 2), 0.5 - t / (2 * np.sqrt(2 + t * t)))


def test_t_to_z_is_odd_and_grows():
    t = np.linspace(-8, 8, 33)
    z = dist.t_to_z(t, 9.0)
    assert np.allclose(z, -z[::-1]) and (np.diff(z) > 0).all() and abs(z[16]) < 1e-12
    assert np.allclose(dist.t_to_z(t, 1e7), t, atol=1e-4)
    assert np.allclose(dist.p_to_t(dist.t_to_p(t[20:], 7), 7), t[20:], atol=1e-6)


def test_one_sample_matches_numpy(spark):
    y = RNG.normal(0.5, 1, (20, 6))
    y[3, :3] = 0  # too few subjects
    y[4, :2] = 0  # two missing are allowed
    y[5] = 2.0  # no variance
    rows = pd.DataFrame([(v, 0, 0, s, y[v, s]) for v in range(20) for s in range(6)], columns=["b", "r", "c", "subj", "value"])
    got = {r.b: r for r in stats.one_sample_t(spark.createDataFrame(rows), 6).collect()}
    z = programs.one_sample_z(y, np.zeros(6))
    assert 3 not in got and 5 not in got and 4 in got and z[3] == z[5] == 0
    for v in got:
        x = y[v][y[v] != 0]
        assert got[v].t == pytest.approx(math.sqrt(len(x)) * x.mean() / x.std(ddof=1))
        assert z[v] == pytest.approx(dist.t_to_z(got[v].t, got[v].df))


def test_two_sample_identical_groups_are_zero():
    y = RNG.normal(1, 1, (5, 4))
    both = np.concatenate([y, y], axis=1)
    g = np.array([1] * 4 + [2] * 4)
    assert np.allclose(programs.two_sample_z(both, g), 0) and np.allclose(programs.two_sample_z(both, g, "welch"), 0)


def test_fdr_curve_never_rises(spark):
    null = spark.createDataFrame([(i, 10) for i in range(50)], "bin int, n long")
    real = spark.createDataFrame([(i, 10 + i) for i in range(50)], "bin int, n long")
    c = [r.fdr for r in stats.fdr_curve(null, real, 50).orderBy("bin").collect()]
    assert c[0] == 1 and all(a >= b for a, b in zip(c, c[1:])) and c[-2] < 1


def test_benjamini_hochberg_matches_sorting(spark):
    z = np.abs(np.concatenate([RNG.normal(0, 1, 300), RNG.normal(4, 1, 40)]))
    rows = spark.createDataFrame(pd.DataFrame({"b": np.arange(len(z)), "r": 0, "c": 0, "value": z}))
    for alpha in (0.01, 0.05, 0.2):
        p = np.sort(dist.z_to_p(z))
        i = np.flatnonzero(p <= alpha * np.arange(1, len(p) + 1) / len(p))
        cut = np.sort(z)[::-1][i[-1]] if len(i) else np.inf
        assert stats.benjamini_hochberg(rows, alpha).count() == (z > cut).sum()


def brute_bilateral(x, radius=2, rvar=2.0, svar=2.0):
    out = np.zeros(x.shape)
    for at in np.ndindex(*x.shape):
        if any(p < radius or p >= n - radius for p, n in zip(at, x.shape)) or x[at] == 0:
            continue
        top = bottom = count = 0
        for o in offsets("cube", radius):
            u = x[tuple(np.add(at, o))]
            if u:
                w = (1 - ((x[at] - u) ** 2 / rvar + np.dot(o, o) / svar) / 2048) ** 2048
                top, bottom, count = top + u * w, bottom + w, count + 1
        if count / 117 > 0.5:
            out[at] = top / bottom
        else:
            near = sorted(x[tuple(np.add(at, o))] for o in offsets(18) if x[tuple(np.add(at, o))])
            out[at] = near[(len(near) - 1) // 2] if len(near) > 9 else 0
    return out


def test_bilateral_filter_matches_loops():
    x = RNG.normal(0, 2, (7, 6, 8))
    x[RNG.random(x.shape) < 0.4] = 0
    keep = x.copy()
    assert np.allclose(filters.bilateral(x, iterations=1), brute_bilateral(x))
    assert np.allclose(filters.bilateral(x, iterations=2), brute_bilateral(brute_bilateral(x)))
    assert (x == keep).all()


def test_band_pass_keeps_the_mean_and_drops_constants():
    x = RNG.normal(5, 1, (3, 100))
    x[1] = 7
    y = preprocess.band_pass(x, 2.0, highpass=90, lowpass=5)
    assert abs(y[0].mean() - x[0].mean()) < 0.3 and (y[1] == 0).all()


def test_spline_passes_through_its_points():
    x, y = np.arange(10.0), RNG.normal(size=10)
    assert np.allclose(preprocess.natural_spline(x, y, x), y)
    assert np.allclose(preprocess.natural_spline(x, 2 * x + 1, np.array([0.5, 3.3])), [2.0, 7.6])


def test_wavelets_invert():
    for name, h in preprocess.WAVELETS.items():
        x = RNG.normal(size=(16, 16))
        assert np.allclose(preprocess.wavelet(preprocess.wavelet(x, h), h, True), x, atol=1e-6), name


def test_pseudo_inverse_drops_small_values_absolutely():
    x = np.array([[1.0, 1.0], [1.0, 1.0], [1.0, 1.0]])
    assert np.allclose(glm.pseudo_inverse(x), np.linalg.pinv(x))
    assert np.allclose(glm.pseudo_inverse(1e-8 * np.eye(3)), 0)


def test_second_level_matches_least_squares(spark):
    x = np.column_stack([np.ones(9), np.arange(9.0)])
    y = RNG.normal(size=9)
    df = spark.createDataFrame([(1, y.tolist())], "vid int, ts array<double>")
    got = glm.second_level(df, x, [0, 1]).first()
    beta, err = np.linalg.lstsq(x, y, rcond=None)[:2]
    sd = math.sqrt(err[0] / 7 * np.linalg.inv(x.T @ x)[1, 1])
    assert got.t == pytest.approx(beta[1] / sd) and got.df == pytest.approx(7)


def test_whitening_removes_correlation():
    for rho in (np.array([0.5]), np.array([0.6, 0.3])):
        a = glm.whitener(60, rho)
        e, p = np.zeros((400, 60)), len(rho)
        full = np.concatenate([[1.0], rho])
        phi = np.linalg.solve(glm.toeplitz(full[:p]), rho)
        noise = RNG.normal(size=(400, 260))
        y = np.zeros((400, 260))
        for t in range(p, 260):
            y[:, t] = noise[:, t] + sum(phi[k] * y[:, t - k - 1] for k in range(p))
        e = y[:, 200:] @ a.T
        r = (e[:, 6:] * e[:, 5:-1]).mean() / (e[:, 5:] ** 2).mean()
        assert abs(r) < 0.03


def test_ecm_without_the_matrix_equals_the_matrix(spark):
    x = RNG.normal(size=(30, 12))
    z = (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)
    s = spark.createDataFrame([(i, x[i].tolist()) for i in range(30)], "vid long, ts array<double>")
    for metric, scale, f in (("add", 12, lambda a: a + 1), ("rlc", 24, None), ("neg_rlc", 24, None)):
        r, m = z @ z.T / scale, np.abs(z) @ np.abs(z).T / scale
        a = f(r) if f else (r + m if metric == "rlc" else m - r)
        v = np.full(30, 1 / math.sqrt(30))
        for _ in range(5):
            v = a @ v
            v /= np.linalg.norm(v)
        got = {r.vid: r.value for r in networks.ecm(s, metric, 5, converge=False).collect()}
        assert np.allclose([got[i] for i in range(30)], v * math.sqrt(30)), metric


def test_dense_ecm_matches_numpy(spark):
    x = RNG.normal(size=(25, 10))
    z = (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)
    s = spark.createDataFrame([(i, x[i].tolist()) for i in range(25)], "vid long, ts array<double>")
    a = networks.similarity(z, z, "gauss")
    np.fill_diagonal(a, 0)
    v = np.full(25, 0.2)
    for _ in range(3):
        v = a @ v
        v /= np.linalg.norm(v)
    got = {r.vid: r.value for r in networks.dense_ecm(s, "gauss", 3, size=10, converge=False).collect()}
    assert np.allclose([got[i] for i in range(25)], v * 5)


def test_concordance_of_equal_rankings_is_one():
    row = RNG.normal(size=40)
    data = np.stack([row, 2 * row + 1, row**3])
    assert networks.kendall_w(data) == pytest.approx(1.0)
    assert networks.occc(np.stack([row, row])) == pytest.approx(1.0)
    assert networks.ccc(row, row) == pytest.approx(1.0)


def test_simpls_with_all_components_is_least_squares():
    x = RNG.normal(size=(40, 5))
    x -= x.mean(0)
    y = x @ RNG.normal(size=5) + 0.1 * RNG.normal(size=40)
    y -= y.mean()
    assert np.allclose(learning.simpls(x, y, 5), np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-6)


def test_prediction_finds_a_linear_target(spark):
    x = RNG.normal(size=(80, 40)).astype(np.float32)
    y = x[:, :5].sum(1)
    side = y + RNG.normal(size=80)
    got = learning.predict(spark, x, np.arange(50), np.arange(50, 80), y[:50], side[:50], side[50:], features=20, members=20, components=4)
    assert np.corrcoef(got["bml"], y[50:])[0, 1] > 0.6


def test_prediction_from_moments_equals_prediction_from_rows():
    x, y = RNG.normal(size=(60, 12)), RNG.normal(size=60)
    x -= x.mean(0)
    f = np.array([0, 3, 3, 5, 7, 8, 11])
    a = learning.double_center(x[:, f])
    got = learning.simpls_moments(learning.double_center((x.T @ x)[np.ix_(f, f)]), (x.T @ y)[f] - (x.T @ y)[f].mean(), 4)
    assert np.allclose(got, learning.simpls(a, y, 4))


def test_linear_depth_profile():
    u = np.linspace(0.06, 0.94, 40)
    z = 3 * u - 1
    assert laminar.slope(u, z) == pytest.approx(3)
    assert np.allclose(laminar.fit_r2(u, z), 1)
    assert laminar.peak(u, z)[1] > laminar.peak(u, z)[0]
    assert laminar.max_abs(u, -z) == pytest.approx(-z.max())
    m = laminar.three_bins(u, z, 200)
    assert m[0] < m[1] < m[2] and (m[3:] < 0).all()


def test_slab_cortex(spark):
    grid = pd.DataFrame([(b, r, c, 0.0 if c < 2 else 1.0 if c > 7 else 2.0) for b in range(8) for r in range(8) for c in range(10)], columns=["b", "r", "c", "value"])
    rims = laminar.rim(spark.createDataFrame(grid), (8, 8, 10))
    by = {x.c: x.value for x in rims.collect()}
    assert by[2] == 1 and by[7] == 2 and by[4] == 3
    d = laminar.depth_volume(rims, (8, 8, 10)).filter("b = 4 and r = 4").orderBy("c").collect()
    v = [x.value for x in d]
    assert v[0] == 1 and v == sorted(v, reverse=True) and v[-1] == pytest.approx(0.0001)
    cyl = laminar.cylinders(rims, (8, 8, 10), radius=1.0)
    assert cyl.select("cid").distinct().count() > 0
    assert set(cyl.select("c").distinct().toPandas().c) <= {3, 4, 5, 6}


def test_morphology_and_labels():
    a = np.zeros((6, 7, 8))
    a[1:4, 1:4, 1:4] = 1
    a[5, 6, 7] = 1
    assert imaging.erode(imaging.dilate(a, offsets(6)), offsets(6))[2, 2, 2] == 1
    assert imaging.label(a).max() == 2 and imaging.select_big(imaging.label(a)).sum() == 27
    assert imaging.delete_small(imaging.label(a), 2).max() == 1
    assert imaging.euler(a, 26) == 2 and imaging.euler(a, 6) == 2
    ring = np.ones((1, 3, 3))
    ring[0, 1, 1] = 0
    assert imaging.euler(ring, 26) == 0
    brute = np.min([np.sqrt(sum((np.indices(a.shape)[k] - p[k]) ** 2 for k in range(3))) for p in np.argwhere(a)], axis=0)
    assert np.allclose(imaging.euclidean(a), brute)


def test_resampling_keeps_linear_ramps():
    a = np.indices((5, 6, 7))[2].astype(float)
    for how in ("linear", "cubic"):
        got = imaging.resample(a, np.eye(3), (0, 0, 0.5), how=how)
        assert np.allclose(got[:, :, 1:5], a[:, :, 1:5] + 0.5), how
    x = RNG.normal(size=(5, 6, 7))
    assert np.allclose(imaging.resample(x, np.eye(3), (0, 0, 0), how="spline"), x)
    assert np.allclose(imaging.rotation(0.1, 0.2, 0.3) @ imaging.inverse(imaging.rotation(0.1, 0.2, 0.3)), np.eye(3))
    assert np.allclose(imaging.euler_angles(imaging.rotation(0.1, 0.2, 0.3)), (0.1, 0.2, 0.3))


def test_edges_of_a_step_and_cluster_enhancement():
    a = np.zeros((9, 9, 12))
    a[:, :, 6:] = 1
    e = imaging.edges(a)
    assert set(np.nonzero(e[4, 4])[0]) <= {5, 6} and e[4, 4].sum() == 1
    x = np.zeros((5, 5, 5))
    x[1:3, 1, 1] = 1.0
    x[4, 4, 4] = 1.0
    t = imaging.cluster_enhance(x, 0.5)
    assert t[1, 1, 1] == pytest.approx(2**0.5 * (0.25 + 1) * 0.5) and t[4, 4, 4] == pytest.approx((0.25 + 1) * 0.5)


def test_z_scores_take_a_series_once(spark):
    """Means and deviations of 2,000 steps, not again for each step; nulls stay as in SQL."""
    x = RNG.normal(size=2_000)
    s = spark.createDataFrame([(0, x.tolist()), (1, [1.0, None, 3.0]), (2, [5.0, 5.0]), (3, [5.0]), (4, [])], "vid long, ts array<double>")
    start = time.monotonic()
    got = {r.vid: r.ts for r in networks.z_scored(s).select("vid", F.posexplode("ts").alias("t", "x")).groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("e")).select("vid", F.transform("e", lambda e: e.x).alias("ts")).collect()}
    assert time.monotonic() - start < 30
    assert np.allclose(got[0], (x - x.mean()) / x.std(ddof=1))
    assert got[1] == [pytest.approx(-math.sqrt(0.5)), None, pytest.approx(math.sqrt(0.5))] and got[2] == [0.0, 0.0] and got[3] == [None] and 4 not in got


def _pairs_fixture(spark, n=700):
    """Series with numbers that are neither dense nor in order, over three partitions."""
    x = RNG.normal(size=(n, 16)) + RNG.normal(size=16)
    vid = RNG.permutation(5 * n)[:n]
    rows = [(int(v), t.tolist()) for v, t in zip(vid, x)]
    z = (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)
    return vid, z, spark.createDataFrame(rows, "vid long, ts array<double>").repartition(3)


def test_edge_sums_match_all_pairs(spark):
    """By tiles of several groups and blocks, without edges as rows."""
    vid, z, s = _pairs_fixture(spark)
    w = np.maximum(z @ z.T / 16, 0)
    np.fill_diagonal(w, 0)
    got = {r.vid: r.value for r in networks.edge_sums(s, "pos", size=20).collect()}
    assert np.allclose([got[v] for v in vid], w.sum(1))
    later = vid[:, None] > vid[None, :]
    rows = {r.i: r for r in networks.later_sums(s, "pos", 0.25, size=20).collect()}
    assert set(rows) == set(vid.tolist()) - {vid.min()}
    total, strong = (w * later).sum(1), ((w >= 0.25) & later).sum(1)
    assert all(np.isclose(rows[v].total, t) and rows[v].strong == k for v, t, k in zip(vid.tolist(), total, strong) if v in rows)


def test_tiles_shuffle_a_bounded_number_of_copies():
    """Copies of a row are as many as groups; they were as many as blocks, so shuffles grew as the square."""
    assert [tiles.group_count(n, 600) for n in (100, 20_000, 100_000, 600_000)] == [1, 16, 16, 16]
    assert tiles.group_count(10_000_000, 600) < 50 and tiles.group_count(100_000, 1 << 20) > 700


def test_concordance_map_matches_each_seed_in_turn(spark):
    """Three subjects, equal series among them, more voxels than one task's seeds."""
    n = 200
    at, data = RNG.integers(0, 12, (n, 3)), RNG.normal(size=(3, n, 14))
    data[:, 60:75] = data[:, 40:55]
    data[1, 7] = 4.0
    vid = np.sort(RNG.permutation(900)[:n])
    rows = [(s, int(vid[v]), *map(int, at[v]), data[s, v].tolist()) for s in range(3) for v in range(n)]
    cohort = spark.createDataFrame(rows, "subj int, vid long, b int, r int, c int, ts array<double>").repartition(3)
    p = data[:, :, 2:]
    p = p - p.mean(2, keepdims=True)
    size = np.sqrt((p * p).sum(2, keepdims=True))
    r = np.einsum("sit,sjt->sij", p / np.maximum(size, 1e-12), p / np.maximum(size, 1e-12))
    far = ((at[:, None] - at[None]) ** 2).sum(2) >= 27
    for kind, f in (("kendall", networks.kendall_w), ("occc", networks.occc)):
        got = {x.vid: x.concordant for x in networks.concordance_map(cohort, kind, seeds_per_task=16).collect()}
        assert np.allclose([got[v] for v in vid], [f(np.round(r[:, i, far[i]], 12)) for i in range(n)], atol=1e-6), kind


def test_concordance_cohort_goes_to_a_bounded_number_of_tasks(spark, monkeypatch):
    """It went once to each group of 64 seeds, so what was shuffled grew as the square."""
    asked = []
    monkeypatch.setattr(networks.tiles, "copies", lambda blocks, n: asked.append(n) or blocks.select(F.lit(0).alias("tile"), "data"))
    rows = spark.range(4000).select(F.lit(0).alias("subj"), F.col("id").alias("vid"), *(F.lit(0).alias(c) for c in "brc"), F.array(*(F.rand(i) for i in range(4))).alias("ts"))
    networks.concordance_map(rows)
    assert asked == [48]


def test_models_of_many_cylinders_equal_those_of_each(spark):
    """Lengths, ties and values in few places of depth; batches end within cylinders, and the join by cylinder is changed as it runs."""
    rng, points = np.random.default_rng(8), []
    for cid in range(250):
        n = int(rng.integers(20, 60))
        u = rng.choice((np.arange(11) + 0.5) / 11, n) if cid % 3 else rng.random(n)
        z = np.round(rng.normal(2 * u, 1), 1 if cid % 2 else 9) * (cid % 41 > 0)
        if cid % 50 == 1:
            u = rng.choice([0.3, 0.5, 0.7], n)
        points.append(pd.DataFrame({"cid": cid * 7, "u": u, "z": z}).sort_values(["u", "z"]))
    rows = spark.createDataFrame(pd.concat(points).sample(frac=1, random_state=1)).repartition(5)
    kept = laminar.usable(rows).select("cid", "u", "z")
    by = {k: p.sort_values(["u", "z"]) for k, p in kept.toPandas().groupby("cid")}
    assert 200 < len(by) < 250
    for model, options in (("3bins", {"perms": 50}), ("3bins", {"perms": 0}), ("peak", {}), ("concave", {}), ("concave", {"legendre": True}), ("R2", {}), ("nbins", {}), ("linear", {})):
        got = laminar.per_cylinder(kept, model, at_once=200, **options).toPandas()
        assert not got.duplicated(["cid", "t"]).any() and set(got.cid) == set(by)
        for cid, g in got.groupby("cid"):
            want = np.atleast_1d(laminar.MODELS[model](by[cid].u.to_numpy(), by[cid].z.to_numpy(), **options))
            assert np.allclose(g.sort_values("t").value, want, atol=1e-7), (model, cid)


def test_model_of_many_cylinders_makes_no_group_each(spark):
    """Python started anew for each cylinder, at 2 to 5 ms."""
    plan = laminar.per_cylinder(spark.createDataFrame([(1, 0.5, 1.0)], "cid long, u double, z double"), "concave")
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()


def test_peak_of_equal_values_is_the_deeper_one(spark):
    """Fits through five depths are the means there, of which two are the smallest: the SQL gives either, by rounding."""
    u = np.repeat([0.3181818181818182, 0.4090909090909091, 0.5, 0.6818181818181818, 0.8636363636363636], 5)
    z = np.repeat([-16.5, 2.0, 4.5, 3.5, -16.5], 5) + np.tile([-2.0, -1.0, 0.0, 1.0, 2.0], 5)
    for scale in (1.0, 0.1, 1 / 3, 7.7):
        assert np.allclose(laminar.peak(u, scale * z), [u[0], 0.5])
    rows = pd.concat([pd.DataFrame({"cid": k, "u": u, "z": s * z}) for k, s in enumerate((1.0, 0.1, 1 / 3, 7.7))])
    got = laminar.per_cylinder(spark.createDataFrame(rows), "peak").filter("t = 0").toPandas()
    assert len(got) == 4 and np.allclose(got.value, u[0])


def test_r2_of_few_depths_is_that_of_the_means():
    """Five depths: the fifth order adds nothing to the fourth, and both have the means' R^2 exactly."""
    u = np.repeat((np.array([1, 4, 6, 7, 9]) + 0.5) / 11, 4)
    z = np.round(RNG.normal(0, 15, 20)) + 0.5
    mean = np.repeat(z.reshape(5, 4).mean(1), 4)
    exact = ((mean - z.mean()) ** 2).sum() / ((z - z.mean()) ** 2).sum()
    assert np.allclose(laminar.fit_r2(u, z)[3:], exact) and np.allclose(laminar.fit_r2_many(u[None], z[None], np.ones((1, 20), bool))[0], laminar.fit_r2(u, z))


def test_projected_ecm_matches_the_matrix(spark):
    """By factors where the metric has them (no pairs are made), else by tiles."""
    vid, z, s = _pairs_fixture(spark, 300)
    blk = vid // 400
    draws = np.zeros((300, 32))
    for b in set(blk.tolist()):
        at = np.flatnonzero(blk == b)
        draws[at[np.argsort(vid[at])]] = np.random.default_rng([9, b]).standard_normal((len(at), 32))
    for metric in ("rlc", "neg_rlc", "add", "none", "abs"):
        a = networks.similarity(z, z, metric)
        y = a @ draws
        q = np.linalg.svd(y, full_matrices=False)
        q = q[0][:, q[1] > q[1][0] * 1e-6]
        w, u = np.linalg.eigh(q.T @ a @ q)
        want = q @ u[:, np.argmax(w)] * 300**0.5
        got = {r.vid: r.value for r in networks.projected_ecm(s, metric, 9, size=400).collect()}
        got = np.array([got[v] for v in vid])
        assert np.sign(got).sum() >= 0 and np.allclose(got, want * np.sign(got @ want), atol=1e-6), metric


def test_projected_ecm_of_factors_makes_no_pairs(spark, monkeypatch):
    """Blocks went to tasks for each pair of them, so shuffles grew as the square."""
    monkeypatch.setattr(networks, "pair_blocks", None)
    monkeypatch.setattr(networks.tiles, "grid", None)
    assert networks.projected_ecm(_pairs_fixture(spark, 60)[2], "rlc", size=100).count() == 60


def test_bipartite_sums_match_the_edges(spark):
    """Of several groups and blocks on each side, near voxels left out; edges are rows only where they are asked for."""
    n = 260
    x, at, vid = RNG.normal(size=(n, 20)) + 0.4 * RNG.normal(size=20), RNG.integers(0, 9, (n, 3)), RNG.permutation(4 * n)[:n]
    rows = [(int(v), *map(int, p), t.tolist()) for v, p, t in zip(vid, at, x)]
    s = spark.createDataFrame(rows, "vid long, b int, r int, c int, ts array<double>").repartition(3)
    left, right = np.flatnonzero(vid % 2 == 0), np.flatnonzero(vid % 2)
    far = ((at[left][:, None] - at[right][None]) ** 2).sum(2) >= 9
    sides = s.filter("vid % 2 = 0"), s.filter("vid % 2 = 1")
    order = np.argsort(np.argsort(x, axis=1, kind="stable"), axis=1)
    for metric, r in (("pearson", np.corrcoef(x)), ("spearman", np.corrcoef(order)), ("MI", -0.5 * np.log(np.maximum(1 - np.corrcoef(x) ** 2, 1e-12)))):
        w = r[np.ix_(left, right)]
        edge = far & (w >= 0.2 + 1e-6)
        got = {(e.i, e.j): e.w for e in networks.bipartite_edges(*sides, metric, 0.2, size=15).collect()}
        assert set(got) == {(vid[left[i]], vid[right[j]]) for i, j in np.argwhere(edge)}
        assert all(np.isclose(got[vid[left[i]], vid[right[j]]], w[i, j]) for i, j in np.argwhere(edge))
        w = w * edge
        rows = {(e.side, e.vid): e.value for e in networks.bipartite_degrees(*sides, 7, 11, metric, 0.2, size=15).collect()}
        want = {(1, vid[left[i]]): w[i].sum() / 11 for i in np.flatnonzero(edge.any(1))} | {(2, vid[right[j]]): w[:, j].sum() / 7 for j in np.flatnonzero(edge.any(0))}
        assert rows.keys() == want.keys() and all(np.isclose(rows[k], want[k]) for k in want)
        hubs = {e.vid: e.value for e in networks.projected_hubs(*sides, 11, metric, 0.2, size=15).collect()}
        assert hubs.keys() == {vid[left[i]] for i in np.flatnonzero(edge.any(1))} and all(np.isclose(hubs[vid[left[i]]], (w[i] * w.sum(0)).sum() / 121) for i in np.flatnonzero(edge.any(1)))


def test_bipartite_queries_keep_their_edges_in_tiles(spark, tmp_path, monkeypatch):
    """Blocks went to a task for each pair of them, and edges to the sums as rows."""
    monkeypatch.setattr(networks, "bipartite_edges", None)
    monkeypatch.setattr(networks, "pair_blocks", None)
    spark.createDataFrame([(i, RNG.normal(size=8).tolist()) for i in range(600)], "vec_id long, embedding array<double>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    assert queries.QUERIES["bipartite_degree"](spark, f"file://{tmp_path}").count() == 600 and queries.QUERIES["network_projection"](spark, f"file://{tmp_path}").count() == 300


def test_pairs_of_blocks_send_each_block_to_few_tasks(spark):
    """Every pair once, with columns of lists; of 40 blocks each went to 41 tasks, now to 16."""
    rows = spark.createDataFrame([(v // 5, v % 5, v, [float(v), 1.0], list(range(v % 3))) for v in range(200)], "blk int, pos int, vid long, x array<double>, of array<long>").repartition(4)
    pairs = lambda key, a, b: pd.DataFrame([(i, j, float(np.dot(x, y)), len(o)) for i, x in zip(a.vid, a.x) for j, y, o in zip(b.vid, b.x, b.of)], columns=["i", "j", "w", "n"]).assign(bi=key[0], bj=key[1])[["i", "j", "w", "n", "bi", "bj"]]
    schema = "i long, j long, w double, n long, bi int, bj int"
    for triangle in (True, False):
        out = networks.pair_blocks(rows, rows, pairs, schema, triangle)
        got = out.toPandas()
        want = {(i, j) for i in range(200) for j in range(200) if not triangle or i // 5 <= j // 5}
        assert len(got) == len(want) and set(zip(got.i, got.j)) == want
        assert (got.w == got.i * got.j + 1).all() and (got.n == got.j % 3).all() and (got.bi == got.i // 5).all() and (got.bj == got.j // 5).all()
        assert out.rdd.getNumPartitions() == (136 if triangle else 256)
    assert networks.pair_blocks(rows.limit(0), rows, pairs, schema).count() == 0


def test_edges_match_all_pairs(spark):
    vid, z, s = _pairs_fixture(spark, 120)
    w = np.maximum(z @ z.T / 16, 0)
    at = {v: k for k, v in enumerate(vid.tolist())}
    got = networks.edges(s, "pos", size=10).collect()
    assert len({(e.i, e.j) for e in got}) == len(got) == 120 * 119 // 2 and all(e.j < e.i and np.isclose(e.w, w[at[e.i], at[e.j]]) for e in got)
