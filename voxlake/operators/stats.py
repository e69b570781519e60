"""Statistics of subject maps, null distributions and false discovery rates, as DataFrames.

Subject maps are rows (subj, b, r, c, value) with an optional group; 0 is missing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import t_to_z_column, z_to_p_column
from ..functions.volumes import VOXEL, offsets, shift
from ..plans.store import settle

SMALL = 1e-8
BINS = 20_000


def _present(df: DataFrame) -> DataFrame:
    return df.filter(F.abs("value") > SMALL)


def with_z(df: DataFrame, t: str = "t", df_col: str = "df") -> DataFrame:
    """Adds ``z`` for columns of t and degrees of freedom."""
    return df.withColumn("z", t_to_z_column(F.col(t), F.col(df_col)))


def one_sample_t(subjects: DataFrame, n_subjects: int, by: Iterable[str] = VOXEL) -> DataFrame:
    """(voxel, k, mean, var, t, df): of voxels present in all but two subjects or more; none where the variance is below 1e-8."""
    g = _present(subjects).groupBy(*by).agg(F.count("*").alias("k"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    g = g.filter((F.col("k") >= n_subjects - 2) & (F.col("k") > 1) & (F.col("var") >= SMALL))
    return g.withColumn("t", F.sqrt(F.col("k").cast("double")) * F.col("mean") / F.sqrt("var")).withColumn("df", F.col("k").cast("double") - 1)


def _two_groups(subjects: DataFrame, by: Iterable[str]) -> DataFrame:
    """Moments of groups 1 and 2 (column ``grp``) side by side."""
    aggs = []
    for g in (1, 2):
        v = F.when(F.col("grp") == g, F.col("value"))
        aggs += [F.count(v).alias(f"n{g}"), F.avg(v).alias(f"m{g}"), F.var_samp(v).alias(f"v{g}"), F.sum(v).alias(f"s{g}")]
    return _present(subjects).groupBy(*by).agg(*aggs)


def two_sample_t(subjects: DataFrame, kind: str = "pooled", n1: int | None = None, n2: int | None = None, by: Iterable[str] = VOXEL) -> DataFrame:
    """(voxel, n1, n2, m1, m2, t, df).  ``pooled`` or ``welch``; with n1 and n2, voxels lacking more than two of a group drop out."""
    g = _two_groups(subjects, by).filter("n1 > 1 and n2 > 1")
    if n1 is not None and n2 is not None:
        g = g.filter((F.col("n1") >= n1 - 2) & (F.col("n2") >= n2 - 2))
    if kind == "pooled":
        g = g.filter("abs(s1) >= 1e-10 and abs(s2) >= 1e-10").withColumn("df", (F.col("n1") + F.col("n2") - 2).cast("double"))
        g = g.withColumn("sd", F.expr("sqrt((1.0D / n1 + 1.0D / n2) * (v1 * (n1 - 1) + v2 * (n2 - 1)) / df)"))
    elif kind == "welch":
        g = g.filter("v1 >= 1e-10 and v2 >= 1e-10").withColumn("sd", F.expr("sqrt(v1 / n1 + v2 / n2)"))
        g = g.withColumn("df", F.expr("pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))"))
    else:
        raise ValueError(kind)
    return g.filter("sd >= 1e-10").withColumn("t", F.expr("(m1 - m2) / sd")).select(*by, "n1", "n2", "m1", "m2", "t", "df")


def paired_t(subjects: DataFrame, n_pairs: int | None = None, by: Iterable[str] = VOXEL) -> DataFrame:
    """(voxel, k, mean, t, df) of differences of groups 1 and 2 of a subject, where both are present."""
    by = list(by)
    one = _present(subjects).groupBy(*by, "subj").agg(F.max(F.when(F.col("grp") == 1, F.col("value"))).alias("x"), F.max(F.when(F.col("grp") == 2, F.col("value"))).alias("y"))
    d = one.filter("x is not null and y is not null").withColumn("d", F.expr("x - y"))
    g = d.groupBy(*by).agg(F.count("*").alias("k"), F.avg("d").alias("mean"), F.var_samp("d").alias("var")).filter("k > 1 and var >= 1e-10")
    if n_pairs is not None:
        g = g.filter(F.col("k") >= n_pairs - 2)
    return g.withColumn("t", F.expr("sqrt(double(k)) * mean / sqrt(var)")).withColumn("df", F.col("k").cast("double") - 1).drop("var")


def paired_t_covariance(subjects: DataFrame, by: Iterable[str] = VOXEL) -> DataFrame:
    """The paired t from variances and covariance: sd^2 = (v1 + v2 - 2 cov) / n."""
    by = list(by)
    one = _present(subjects).groupBy(*by, "subj").agg(F.max(F.when(F.col("grp") == 1, F.col("value"))).alias("x"), F.max(F.when(F.col("grp") == 2, F.col("value"))).alias("y")).filter("x is not null and y is not null")
    g = one.groupBy(*by).agg(F.count("*").alias("k"), F.avg("x").alias("m1"), F.avg("y").alias("m2"), F.var_samp("x").alias("v1"), F.var_samp("y").alias("v2"), F.covar_samp("x", "y").alias("cov"))
    g = g.filter("k > 1 and v1 >= 1e-10 and v2 >= 1e-10 and v1 + v2 - 2 * cov >= 1e-10")
    return g.select(*by, "k", F.expr("(m1 - m2) / sqrt((v1 + v2 - 2 * cov) / k)").alias("t"), (F.col("k").cast("double") - 1).alias("df"))


def image_variance(volume: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Sample variance over present voxels, where there are three or more."""
    return volume.filter(F.abs("value") >= SMALL).groupBy(*by).agg(F.count("*").alias("n"), F.var_samp("value").alias("var")).filter("n >= 3")


def image_stats(volume: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Minimum, maximum, mean and sample variance."""
    return volume.groupBy(*by).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))


def mode_estimate(volume: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """3 median - 2 mean of present voxels, with the lower median."""
    return _present(volume).groupBy(*by).agg((3 * F.expr("percentile_disc(0.5) within group (order by value)") - 2 * F.avg("value")).alias("mode"))


def kth_smallest(df: DataFrame, k: float, by: Iterable[str] = ()) -> DataFrame:
    """The value at quantile k of each group, always a value of the group (the lower median at 0.5)."""
    return df.groupBy(*by).agg(F.expr(f"percentile_disc({k}) within group (order by value)").alias("value"))


def null_sd(maps: DataFrame, n: int = 30) -> float:
    """Root of the mean variance of permutations 1 .. n (column ``perm``)."""
    row = image_variance(maps.filter(F.col("perm").between(1, n)), ["perm"]).agg(F.avg("var").alias("v")).first()
    return float(row.v) ** 0.5 if row.v else 1.0


def z_scale(maps: DataFrame, sd: float, mode: float = 0.0) -> DataFrame:
    return maps.withColumn("value", F.when(F.abs("value") > SMALL, (F.col("value") - mode) / sd).otherwise(F.col("value")))


def histogram_range(volume: DataFrame) -> tuple[float, float]:
    """(-10, 10), or (-20, 20) where more than 1 % of the voxels lie beyond on either side."""
    r = volume.agg(F.sum((F.col("value") < -10).cast("int")).alias("low"), F.sum((F.col("value") > 10).cast("int")).alias("high"), F.sum((F.col("value") != 0).cast("int")).alias("n")).first()
    if not r.n:
        raise ValueError("no voxel is present")
    return (-20.0, 20.0) if max(r.low, r.high) / r.n > 0.01 else (-10.0, 10.0)


def bin_of(value, lo: float, hi: float, bins: int, edge: float = 1e-6):
    """The bin of a value, those beyond the range in the outermost bins."""
    v = F.when(value > hi, hi - edge).when(value < lo, lo + edge).otherwise(value)
    return F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")


def histogram(volume: DataFrame, lo: float, hi: float, bins: int = BINS, by: Iterable[str] = ()) -> DataFrame:
    """(by, bin, n) of present values; bins without a value have no row.  Mergeable: sum n of equal bins."""
    v = volume.filter(F.abs("value") >= 1e-6)
    return v.groupBy(*by, bin_of(F.col("value"), lo, hi, bins).alias("bin")).agg(F.count("*").alias("n"))


def fdr_curve(null: DataFrame, real: DataFrame, bins: int = BINS) -> DataFrame:
    """(bin, fdr) for every bin, from histograms (bin, n): (1 - F0) / (1 - Fz) within [0, 1], 1 at the first bin, never rising.

    There is one row a bin whatever the number of voxels, so the running sums need no partition.
    """
    every = null.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = every.join(null.select("bin", F.col("n").alias("n0")), "bin", "left").join(real.select("bin", F.col("n").alias("nz")), "bin", "left").fillna(0, ["n0", "nz"])
    total = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = h.select("bin", (F.sum("n0").over(up) / F.sum("n0").over(total)).alias("f0"), (F.sum("nz").over(up) / F.sum("nz").over(total)).alias("fz"))
    raw = F.when(F.col("bin") == 0, 1.0).when(F.col("fz") < 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - F.col("f0")) / (1 - F.col("fz"))))).otherwise(1.0)
    return h.select("bin", "f0", "fz", raw.alias("raw")).select("bin", "f0", "fz", F.min("raw").over(up).alias("fdr"))


def fdr_map(volume: DataFrame, curve: DataFrame, lo: float, hi: float, bins: int = BINS, alpha: float = 0.05) -> DataFrame:
    """1 - Fdr at each present voxel; below 1 - alpha it goes, unless alpha is 0.99 or more."""
    v = volume.filter("value <> 0").withColumn("bin", bin_of(F.col("value"), lo, hi, bins, 0.002))
    out = v.join(curve.select("bin", "fdr"), "bin").withColumn("value", 1 - F.col("fdr")).drop("bin", "fdr")
    return out.filter(F.col("value") >= 1 - alpha) if alpha < 0.99 else out


def apply_threshold(volume: DataFrame, alpha: float = 0.05) -> DataFrame:
    return volume.filter(F.col("value") >= 1 - alpha)


def drop_isolated(volume: DataFrame, threshold: float, shape: tuple[int, int, int]) -> DataFrame:
    """Voxels with fewer than two of their 27 neighbours, themselves included, above the threshold go; the outermost shell stays."""
    hot = volume.filter(F.col("value") > threshold)
    n = shift(hot, offsets(26)).groupBy(*VOXEL).agg(F.count("*").alias("_n"))
    out = volume.join(n, list(VOXEL), "left")
    shell = F.least(*(F.least(F.col(x), F.lit(s - 1) - F.col(x)) for x, s in zip(VOXEL, shape))) < 1
    return out.filter(shell | (F.coalesce("_n", F.lit(0)) >= 2)).drop("_n")


def benjamini_hochberg(volume: DataFrame, alpha: float = 0.05, dependence: bool = False) -> DataFrame:
    """Positive z that pass the step-up rule p(i) <= alpha i / (c n): those strictly above the z of the last such i.

    Ranks come from a histogram-free two-level count: p-values are ranged by Spark's sort and numbered
    within their range, with the ranges' counts added, so no task holds all voxels.
    """
    pos = volume.filter("value > 0").withColumn("p", z_to_p_column(F.col("value")))
    ranked = rank_globally(pos, ["p"], "i")
    n = volume.filter("value > 0").count()
    c = sum(1.0 / k for k in range(1, n + 1)) if dependence and n < 10**6 else 1.0
    if dependence and n >= 10**6:
        import math

        c = math.log(n) + 0.5772156649015329 + 1 / (2 * n)
    cut = ranked.filter(F.col("p") <= alpha * F.col("i") / (c * n)).agg(F.min("value").alias("z")).first().z if n else None
    return volume.filter(F.lit(False)) if cut is None else volume.filter(F.col("value") > cut)


def running_total(df: DataFrame, order: list, weight, name: str) -> DataFrame:
    """The sum of ``weight`` over all rows up to each, in order: sums within ranges, and one window row for each range."""
    parted = df.withColumn("_w", weight).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    up = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = settle(parted.withColumn("_k", F.sum("_w").over(up)))  # ranges are sampled, so they are made once
    sizes = within.groupBy("_part").agg(F.sum("_w").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return within.join(before, "_part").withColumn(name, F.col("_k") + F.col("_before")).drop("_part", "_k", "_before", "_w")


def rank_globally(df: DataFrame, order: list, name: str) -> DataFrame:
    """A gapless rank from 1 over all rows."""
    return running_total(df, order, F.lit(1).cast("long"), name)


def empirical_p(null: DataFrame, real: DataFrame, key: str = "id") -> DataFrame:
    """P(null >= value), at least 1 / n.  Null values meet real ones in one sorted order, not as pairs."""
    both = null.select(F.lit(None).cast("string").alias(key), "value", F.lit(1).cast("long").alias("is_null")).unionByName(real.select(F.col(key).cast("string").alias(key), "value", F.lit(0).cast("long").alias("is_null")))
    n = null.count()
    total = running_total(both, [F.desc("value"), F.desc("is_null")], F.col("is_null"), "above")
    return total.filter("is_null = 0").select(key, "value", F.greatest(F.col("above") / n, F.lit(1.0 / n)).alias("p"))


def tail_fdr_table(null: DataFrame, real: DataFrame, bins: int = 10_000, alpha: float = 0.05) -> tuple[DataFrame, int | None]:
    """(bin, f0, fz, fdr) by upper tails, and the first bin after the tenth whose rate is below alpha."""
    every = null.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    h = every.join(null.select("bin", F.col("n").alias("n0")), "bin", "left").join(real.select("bin", F.col("n").alias("nz")), "bin", "left").fillna(0, ["n0", "nz"])
    up, whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tail = lambda x: 1 - F.sum(x).over(up) / F.sum(x).over(whole)
    t = h.select("bin", tail("n0").alias("f0"), tail("nz").alias("fz"))
    t = t.withColumn("fdr", F.when(F.col("fz") > 1e-8, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("f0") / F.col("fz")))).otherwise(0.0))
    row = t.filter((F.col("bin") > 10) & (F.col("fdr") < alpha)).agg(F.min("bin").alias("b")).first()
    return t, row.b


def model_metrics(rows: DataFrame, y: str = "y", f: str = "pred", by: Iterable[str] = ()) -> DataFrame:
    """Coefficient of determination, errors, Pearson correlation, fit and share of equal signs of predictions."""
    m = Window.partitionBy(*by) if list(by) else Window.partitionBy(F.lit(0))
    d = rows.withColumn("_m", F.avg(y).over(m)) if list(by) else rows.crossJoin(F.broadcast(rows.agg(F.avg(y).alias("_m"))))
    e = F.col(y) - F.col(f)
    return d.groupBy(*by).agg(
        (1 - F.sum(e * e) / F.sum((F.col(y) - F.col("_m")) ** 2)).alias("cod"), (F.sum(F.abs(e)) / F.sum(F.abs(F.col(y)))).alias("wmape"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"), F.corr(y, f).alias("pearson"), F.regr_r2(y, f).alias("r2fit"), F.avg((F.signum(F.col(y)) == F.signum(F.col(f))).cast("double")).alias("accuracy"))


def spearman(rows: DataFrame, x: str, y: str, by: Iterable[str] = ()) -> DataFrame:
    """Rank correlation with ties broken by the other columns' order: 1 - 6 sum d^2 / (n (n^2 - 1))."""
    by = list(by)
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    r = rows.withColumn("_a", F.row_number().over(part.orderBy(x, y))).withColumn("_b", F.row_number().over(part.orderBy(y, x)))
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.sum((F.col("_a") - F.col("_b")) ** 2).alias("_d")).select(*by, (1 - 6 * F.col("_d") / (F.col("n") * (F.col("n") * F.col("n") - 1))).alias("spearman"))
