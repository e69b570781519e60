"""Networks of time series: centrality, concordance, spectral coherence, bipartite graphs.

Series are rows (vid, ts array<double>), all of one length.  Matrices of N x N similarities are made in
blocks by a grid of tasks and kept as rows, never in one place.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import settle
from . import tiles

BLOCK = 1024
TINY = 1e-6


def _once(value, f: Callable):
    """f of a value that is worked out once, where a column named in a lambda may be worked out for each element."""
    return F.transform(F.array(value), f)[0]


def z_scored(series: DataFrame) -> DataFrame:
    """Each series less its mean over its sample deviation; all 0 where the deviation is below 1e-6.  Nulls count in neither and stay."""
    some = F.filter("ts", lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(some, F.lit(0.0), lambda a, x: a + x), F.size(some))
    spread = lambda m: F.sqrt(F.try_divide(F.aggregate(some, F.lit(0.0), lambda a, x: a + (x - m) ** 2), F.size(some) - 1))
    scaled = lambda m, d: F.transform("ts", lambda x: F.when(d < TINY, 0.0).otherwise(F.try_divide(x - m, d)))
    return series.withColumn("ts", _once(mean, lambda m: _once(spread(m), lambda d: scaled(m, d))))


def _matrix(pdf: pd.DataFrame, column: str = "ts") -> np.ndarray:
    return np.stack(pdf[column].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 0))


def summed(rows: DataFrame, f: Callable) -> np.ndarray:
    """The sum of the matrices f(rows) over parts of the rows; its size is that of a matrix, not of the data."""

    def part(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                g = f(pdf)
                total = g if total is None else total + g
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "row": [np.sum(np.stack(pdf.row.to_numpy()), axis=0)]})

    got = rows.mapInPandas(part, "i long, row array<double>").groupBy("i").applyInPandas(add, "i long, row array<double>").collect()
    return np.array([r.row for r in sorted(got, key=lambda r: r.i)])


def gram(series: DataFrame, left: Callable, right: Callable) -> np.ndarray:
    """sum over voxels of left(x) outer right(x), by rows of the matrix."""

    def product(pdf: pd.DataFrame) -> np.ndarray:
        x = _matrix(pdf)
        return left(x).T @ right(x)

    return summed(series.select("ts"), product)


def widen(x: np.ndarray, metric: str) -> np.ndarray:
    """Rows whose inner products are the metric's sums: [x, |x|] for rlc, [|x|, x] for its negative form."""
    return np.concatenate({"rlc": [x, np.abs(x)], "neg_rlc": [np.abs(x), x]}.get(metric, [x]), axis=1)


def flip_signs(x: np.ndarray) -> np.ndarray:
    """The second half of each row with its sign turned."""
    return np.concatenate([x[:, : x.shape[1] // 2], -x[:, x.shape[1] // 2 :]], axis=1)


def ecm(series: DataFrame, metric: str = "rlc", iterations: int = 20, converge: bool = True) -> DataFrame:
    """Eigenvector centrality (vid, value) of rlc, add, none or neg_rlc, without the N x N matrix.

    An iterate is y = X z / nt + s for a vector z of a series' length, so the iteration runs on z with the
    Gram matrix of the series: one pass over the voxels for the matrix, one for the result.  The diagonal
    counts.  Unit norm, times the root of the number of voxels.
    """
    x = z_scored(series)
    n = x.count()
    one = x.select("ts").first()
    if one is None:
        return series.sparkSession.createDataFrame([], "vid long, value double")
    nt = len(one.ts)
    scale = widen(np.zeros((1, nt)), metric).shape[1]  # both halves count in the widened form
    wide = lambda a: widen(a, metric)
    turned = (lambda a: flip_signs(wide(a))) if metric == "neg_rlc" else wide
    with_one = lambda f: lambda a: np.concatenate([f(a), np.ones((len(a), 1))], axis=1)
    # of coordinates (x, 1): y = p . (turned x, 1) and the next z from q = sum (x, 1) y
    cross = gram(x, with_one(wide), with_one(turned))
    same = gram(x, with_one(turned), with_one(turned))
    p = np.append(np.zeros(scale), 1 / math.sqrt(n))
    stages = [("add", iterations), ("none", iterations)] if metric == "none" else [(metric, iterations)]
    for kind, rounds in stages:
        for i in range(rounds):
            q = cross @ p
            new = np.append(q[:-1] / scale, same[-1] @ p if kind == "add" else 0.0)
            new /= math.sqrt(max(new @ same @ new, 1e-300))
            d = (new - p) @ same @ (new - p)
            p = new
            if converge and i > 2 and d < 1e-6:
                break
    out = math.sqrt(n) * p

    def project(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"vid": pdf.vid, "value": turned(_matrix(pdf)) @ out[:-1] + out[-1]})

    return x.select(F.col("vid").cast("long").alias("vid"), "ts").mapInPandas(project, "vid long, value double")


def similarity(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """The metric of all pairs of rows of two blocks of z-scored series."""
    nt = x.shape[1]
    r = x @ y.T
    r /= nt
    if metric == "rlc" or metric == "neg_rlc":
        a = np.abs(x) @ np.abs(y).T / nt
        return (r + a) / 2 if metric == "rlc" else (a - r) / 2
    if metric == "gauss":
        m = ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]) / nt - 2 * r
        return np.exp(-0.5 * m * m)
    if metric == "neg":
        np.negative(r, out=r)
    if metric in ("pos", "neg"):
        return np.maximum(r, 0, out=r)
    return {"add": lambda: r + 1, "abs": lambda: np.abs(r, out=r), "none": lambda: r}[metric]()


def blocked(series: DataFrame, size: int = BLOCK) -> DataFrame:
    """Series with a block, of ``size`` voxel numbers, and a place in it.  Voxel numbers are dense, as a mask numbers its voxels."""
    blk = series.withColumn("blk", F.floor(F.col("vid") / size).cast("int"))
    return blk.withColumn("pos", F.row_number().over(Window.partitionBy("blk").orderBy("vid")) - 1)


def pair_blocks(left: DataFrame, right: DataFrame, f: Callable, schema: str, triangle: bool = False) -> DataFrame:
    """f(key, left block, right block) of all pairs of blocks, a task for each two groups of blocks.

    With ``triangle`` both sides are one table and pairs are i <= j.  Blocks (rows of one blk) travel packed, in groups of following ones.
    """

    def packed(rows: DataFrame) -> DataFrame:
        def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
            # arrays of columns: a list column of one length as a matrix
            block = {c: tiles.column(pdf[c]) for c in pdf.columns}
            return pd.DataFrame({"blk": [key[0]], "data": [pickle.dumps(block, protocol=5)]})

        return settle(rows.groupBy("blk").applyInPandas(one, "blk int, data binary"))

    sides = [packed(left)] if triangle else [packed(left), packed(right)]
    stats = [d.agg(F.max("blk").alias("m"), F.sum(F.length("data")).alias("b")).first() for d in sides]
    if any(t.m is None for t in stats):
        return left.sparkSession.createDataFrame([], schema)
    groups = [max(min(tiles.GROUPS, t.m + 1), -(-t.b // tiles.HELD)) for t in stats]
    sides = [d.withColumn("g", F.least(F.floor(F.col("blk") * F.lit(float(g) / (t.m + 1))), F.lit(g - 1)).cast("int")) for d, g, t in zip(sides, groups, stats)]

    def run(held, streamed, same):
        frames = {id(a): pd.DataFrame({c: list(v) if v.ndim > 1 else v for c, v in a.items()}).sort_values("pos") for a in held}
        for b in sorted(streamed, key=lambda b: b["blk"][0]) if same else streamed:
            fb = frames[id(b)] if same else pd.DataFrame({c: list(v) if v.ndim > 1 else v for c, v in b.items()}).sort_values("pos")
            for a in held:
                if not triangle or a["blk"][0] <= b["blk"][0]:
                    yield f((int(a["blk"][0]), int(b["blk"][0])), frames[id(a)], fb)

    return tiles.over(tiles.grid(sides[0], None if triangle else sides[1], *groups), run, schema, 0)


def edges(series: DataFrame, metric: str = "pos", size: int = tiles.PIECE) -> DataFrame:
    """(i, j, w) with j < i of all pairs of voxels."""
    x, n, width = _scored(series)
    schema = "i long, j long, w double"

    def run(held, streamed, same):
        for before, b in tiles.pairs(held, streamed, same):
            for a in before:
                w = similarity(a["x"], b["x"], metric)
                va, vb = a["vid"][:, None], b["vid"][None, :]
                k, m = np.nonzero(va < vb)
                yield pd.DataFrame({"i": b["vid"][m], "j": a["vid"][k], "w": w[k, m]})
                if same and a is not b:
                    k, m = np.nonzero(va > vb)
                    yield pd.DataFrame({"i": a["vid"][k], "j": b["vid"][m], "w": w[k, m]})

    return tiles.over(_tiles(x, n, width, size), run, schema, size) if n > 1 else series.sparkSession.createDataFrame([], schema)


def _scored(series: DataFrame) -> tuple[DataFrame, int, int]:
    """z-scored (vid, ts), their number and their length."""
    x = z_scored(series).select(F.col("vid").cast("long").alias("vid"), "ts")
    one = x.select("ts").first()
    return x, x.count(), len(one.ts) if one else 0


def _arrays(pdf: pd.DataFrame) -> tiles.Block:
    return {"vid": pdf.vid.to_numpy(np.int64), "x": _matrix(pdf)}


def _tiles(x: DataFrame, n: int, width: int, size: int, arrays: Callable = _arrays) -> DataFrame:
    groups = tiles.group_count(n, 8 * width + 16, size)
    return tiles.grid(tiles.pack(x, arrays, groups, size), None, groups)


def edge_sums(series: DataFrame, metric: str = "pos", size: int = tiles.PIECE) -> DataFrame:
    """(vid, value): the weights of each voxel's ``edges`` summed.  Tiles send sums, the edges are never rows."""
    x, n, width = _scored(series)

    def run(held, streamed, same):
        for a in held:
            a["sum"] = np.zeros(len(a["x"]))
        for before, b in tiles.pairs(held, streamed, same):
            total = np.zeros(len(b["x"]))
            for a in before:
                w = similarity(b["x"], a["x"], metric)
                if same:
                    w[b["vid"][:, None] == a["vid"][None, :]] = 0
                total += w.sum(1)
                if a is not b:
                    a["sum"] += w.sum(0)
            if same:
                b["sum"] += total
            else:
                yield pd.DataFrame({"vid": b["vid"], "value": total})
        yield from (pd.DataFrame({"vid": a["vid"], "value": a["sum"]}) for a in held)

    return over_sums(_tiles(x, n, width, size), run, size) if n > 1 else series.sparkSession.createDataFrame([], "vid long, value double")


def over_sums(grid: DataFrame, run: Callable, size: int) -> DataFrame:
    return tiles.over(grid, run, "vid long, value double", size).groupBy("vid").agg(F.sum("value").alias("value"))


def later_sums(series: DataFrame, metric: str = "pos", strong: float = 0.25, size: int = tiles.PIECE) -> DataFrame:
    """(i, total, strong): of the ``edges`` to each later voxel the sum of weights and how many are ``strong`` or above."""
    x, n, width = _scored(series)
    schema = "i long, total double, strong long"

    def run(held, streamed, same):
        if same:
            for a in held:
                a["sum"], a["many"] = np.zeros(len(a["x"])), np.zeros(len(a["x"]), np.int64)
        for before, b in tiles.pairs(held, streamed, same):
            total, many = np.zeros(len(b["x"])), np.zeros(len(b["x"]), np.int64)
            for a in before:
                w = similarity(a["x"], b["x"], metric)
                above = w >= strong
                if same:  # voxels of a group come in any order
                    after = a["vid"][:, None] < b["vid"][None, :]
                    if a is not b:
                        back = a["vid"][:, None] > b["vid"][None, :]
                        a["sum"] += (w * back).sum(1)
                        a["many"] += (above & back).sum(1)
                    w, above = w * after, above & after
                total += w.sum(0)
                many += above.view(np.uint8).sum(0, dtype=np.uint32)
            if same:
                b["sum"] += total
                b["many"] += many
            else:
                yield pd.DataFrame({"i": b["vid"], "total": total, "strong": many})
        if same:
            first = min(a["vid"].min() for a in held)
            for a in held:
                later = a["vid"] > first
                yield pd.DataFrame({"i": a["vid"][later], "total": a["sum"][later], "strong": a["many"][later]})

    if n < 2:
        return series.sparkSession.createDataFrame([], schema)
    return tiles.over(_tiles(x, n, width, size), run, schema, size).groupBy("i").agg(F.sum("total").alias("total"), F.sum("strong").alias("strong"))


def dense_ecm(series: DataFrame, metric: str = "pos", iterations: int = 20, size: int = tiles.PIECE, converge: bool = True) -> DataFrame:
    """Centrality (vid, value) from the similarity matrix with a 0 diagonal.  Its blocks are made anew for each product and never kept."""
    x, n, width = _scored(series)
    return _iterate(x, n, width, _arrays, lambda a, b: similarity(a["x"], b["x"], metric), iterations, size, converge)


def _iterate(x: DataFrame, n: int, width: int, arrays: Callable, block: Callable, iterations: int, size: int, converge: bool) -> DataFrame:
    """(vid, value) of the leading vector, of norm root n, of a symmetric matrix with a 0 diagonal that block(a, b) gives by parts.

    The driver has the vector, 16 bytes a voxel; the series are packed and dealt to tiles once.
    """
    if not n:
        return x.sparkSession.createDataFrame([], "vid long, value double")
    groups = tiles.group_count(n, 8 * width + 16, size)
    blocks = settle(tiles.pack(x, arrays, groups, size))
    grid = settle(tiles.grid(blocks, None, groups))

    def product(keys, v):
        at = (lambda b: v[np.searchsorted(keys, b["key"])]) if keys is not None else (lambda b: np.full(len(b["key"]), v))

        def run(held, streamed, same):
            for a in held:
                a["v"], a["y"] = at(a), np.zeros(len(a["key"]))
            for before, b in tiles.pairs(held, streamed, same):
                u, y = at(b), np.zeros(len(b["key"]))
                for a in before:
                    w = block(a, b)
                    if a is b:
                        np.fill_diagonal(w, 0)
                    else:
                        a["y"] += w @ u
                    y += a["v"] @ w
                if same:
                    b["y"] += y
                else:
                    yield pd.DataFrame({"key": b["key"], "y": y})
            yield from (pd.DataFrame({"key": a["key"], "y": a["y"]}) for a in held)

        got = tiles.over(grid, run, "key long, y double", size).groupBy("key").agg(F.sum("y").alias("y")).toPandas()
        order = np.argsort(got.key.to_numpy())
        return got.key.to_numpy()[order], got.y.to_numpy()[order]

    keys, v = None, 1 / math.sqrt(n)
    for i in range(iterations):
        keys, y = product(keys, v)
        y /= np.linalg.norm(y) or 1.0
        d = ((y - v) ** 2).sum()
        v = y
        if converge and i > 2 and d < 1e-6:
            break

    def out(batches):
        for pdf in batches:
            for b in map(pickle.loads, pdf.data):
                yield pd.DataFrame({"vid": b["vid"], "value": (v if keys is None else v[np.searchsorted(keys, b["key"])]) * math.sqrt(n)})

    return blocks.mapInPandas(out, "vid long, value double")


def factors(x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows l and r of z-scored series with l . r' the metric of two of them; None of a metric that has none."""
    nt, one = x.shape[1], np.ones((len(x), 1))
    if metric in ("rlc", "neg_rlc"):
        w = widen(x, metric)
        return (flip_signs(w) if metric == "neg_rlc" else w) / (2 * nt), w
    return {"none": (x / nt, x), "add": (np.concatenate([x / nt, one], axis=1), np.concatenate([x, one], axis=1))}.get(metric)


def projected_ecm(series: DataFrame, metric: str = "rlc", seed: int = 99402622, dims: int = 32, size: int = BLOCK) -> DataFrame:
    """Centrality by random projection: the similarity times a Gaussian N x 32, an orthogonal basis, and the leading left vector of a second pass; signs so that most are positive.

    Metrics with ``factors`` take passes over the voxels; of others every tile sends its part of the products.
    """
    x = settle(blocked(z_scored(series), size).select(F.col("vid").cast("long").alias("vid"), "blk", "pos", "ts"))
    n = x.count()
    if not n:
        return series.sparkSession.createDataFrame([], "vid long, value double")

    def draws(pdf: pd.DataFrame) -> np.ndarray:
        """The block's numbers at each row's place."""
        out = np.zeros((len(pdf), dims))
        for b, at in pdf.groupby("blk").indices.items():
            pos = pdf.pos.to_numpy()[at]
            out[at] = np.random.default_rng([seed, b]).standard_normal((pos.max() + 1, dims))[pos]
        return out

    if factors(np.zeros((1, 1)), metric):
        half = summed(x, lambda pdf: factors(_matrix(pdf), metric)[1].T @ draws(pdf))
        y_of = lambda pdf: factors(_matrix(pdf), metric)[0] @ half
        rows = x

        def moments(pdf: pd.DataFrame) -> np.ndarray:
            y, (l, r) = y_of(pdf), factors(_matrix(pdf), metric)  # noqa: E741
            return np.concatenate([y, l, r], axis=1).T @ y

        m = summed(x, moments)
        same, (l, r) = m[:dims], np.split(m[dims:], 2)  # noqa: E741
        again = l.T @ r
    else:
        rows = settle(_tile_product(x, n, metric, draws, dims))
        y_of = lambda pdf: _matrix(pdf, "y")
        same = summed(rows, lambda pdf: _matrix(pdf, "y").T @ _matrix(pdf, "y"))
        twice = _tile_product(rows, n, metric, y_of, dims).withColumnRenamed("y", "ay").join(rows.select("vid", "blk", "pos", "y"), ["vid", "blk", "pos"])
        again = summed(twice, lambda pdf: _matrix(pdf, "y").T @ _matrix(pdf, "ay"))
    # orthogonal columns Y R^-1 by the Gram matrix of 32 columns
    val, vec = np.linalg.eigh((same + same.T) / 2)
    keep = val > max(val.max(), 1e-300) * 1e-12
    basis = (vec[:, keep] / np.sqrt(val[keep]))[:, -min(dims, n) :]
    small = basis.T @ again @ basis
    w, u = np.linalg.eigh((small + small.T) / 2)
    lead = basis @ u[:, np.argmax(w)]

    def out(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"vid": pdf.vid, "value": y_of(pdf) @ lead * math.sqrt(n)})

    v = rows.mapInPandas(out, "vid long, value double")
    row = v.agg(F.sum(F.signum("value")).alias("s")).first()
    return v.withColumn("value", -F.col("value")) if (row.s or 0) < 0 else v


def _tile_product(x: DataFrame, n: int, metric: str, right: Callable, dims: int) -> DataFrame:
    """(vid, blk, pos, ts, y): the rows of the similarity times those that right(rows) gives."""

    def arrays(pdf: pd.DataFrame) -> tiles.Block:
        return {"vid": pdf.vid.to_numpy(np.int64), "blk": pdf.blk.to_numpy(np.int64), "pos": pdf.pos.to_numpy(np.int64), "x": _matrix(pdf), "f": right(pdf)}

    groups = tiles.group_count(n, 8 * (len(x.first().ts) + dims) + 40)

    def run(held, streamed, same):
        for a in held:
            a["y"] = np.zeros_like(a["f"])
        for before, b in tiles.pairs(held, streamed, same):
            y = np.zeros_like(b["f"])
            for a in before:
                w = similarity(a["x"], b["x"], metric)
                y += w.T @ a["f"]
                if a is not b:
                    a["y"] += w @ b["f"]
            if same:
                b["y"] += y
            else:
                yield from parts({**b, "y": y})
        for a in held:
            yield from parts(a)

    def parts(b: tiles.Block):
        yield pd.DataFrame({"blk": b["blk"], "pos": b["pos"], "y": list(b["y"])})

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"blk": key[0], "pos": (s := pdf.groupby("pos").y.sum()).index, "y": list(s)})

    y = tiles.over(tiles.grid(tiles.pack(x, arrays, groups), None, groups), run, "blk int, pos int, y array<double>").groupBy("blk").applyInPandas(add, "blk int, pos int, y array<double>")
    return x.select("vid", "blk", "pos", "ts").join(y, ["blk", "pos"])


def isolated_voxels(edge_table: DataFrame, voxels: DataFrame) -> DataFrame:
    """Voxels without an edge of positive weight: the matrix is reducible if there are any."""
    e = edge_table.filter("w > 0")
    return voxels.select("vid").join(e.select(F.explode(F.array("i", "j")).alias("vid")).distinct(), "vid", "left_anti")


def degree_centrality(edge_table: DataFrame, n: int) -> DataFrame:
    """100 times the mean weight of a voxel's edges over all n voxels."""
    both = edge_table.select(F.explode(F.array(F.struct(F.col("i").alias("vid"), "w"), F.struct(F.col("j").alias("vid"), "w"))).alias("e")).select("e.*")
    return both.groupBy("vid").agg((100 * F.sum("w") / n).alias("value"))


def hubness(edge_table: DataFrame) -> DataFrame:
    """How many edges end at each voxel."""
    return edge_table.select(F.explode(F.array("i", "j")).alias("vid")).groupBy("vid").agg(F.count("*").alias("degree"))


def spherical_roi(voxels: DataFrame, seed: tuple[int, int, int], radius: int) -> DataFrame:
    """Voxels with squared distance to the seed of at most radius^2 + 1."""
    d = sum((F.col(x) - s) ** 2 for x, s in zip(("b", "r", "c"), seed))
    return voxels.filter(d <= radius * radius + 1)


# -- concordance -----------------------------------------------------------------------------------


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 0 along the last axis; of equals the first comes first."""
    return np.argsort(np.argsort(x, axis=-1, kind="stable"), axis=-1, kind="stable")


def kendall_w(data: np.ndarray, gauss: bool = False) -> float:
    """Concordance of m rows over n columns; as ((n - 1) m W - n) / sqrt(2 n) with ``gauss``."""
    m, n = data.shape
    total = ranks(data).sum(axis=0)
    w = 12 * ((total - total.mean()) ** 2).sum() / (m * m * n * (n * n - 1.0))
    return ((n - 1) * m * w - n) / math.sqrt(2 * n) if gauss else w


def occc(data: np.ndarray) -> float:
    """Overall concordance: 2 sum cov / ((m - 1) sum var + sum (mean - mean')^2)."""
    m = len(data)
    cov = np.cov(data)
    mean = data.mean(axis=1)
    upper = np.triu_indices(m, 1)
    bottom = (m - 1) * np.trace(cov) + ((mean[:, None] - mean[None, :])[upper] ** 2).sum()
    return 2 * cov[upper].sum() / bottom if bottom >= 1e-6 else 0.0


def ccc(x: np.ndarray, y: np.ndarray) -> float:
    """Lin's concordance from population moments."""
    bottom = x.var() + y.var() + (x.mean() - y.mean()) ** 2
    return 2 * ((x - x.mean()) * (y - y.mean())).mean() / bottom if bottom > 0 else 0.0


def kendall_w_rows(rows: DataFrame, judge: str, item: str, value: str) -> DataFrame:
    """(w, n, m) in DataFrame operations: ranks of each judge, ties by item."""
    r = rows.withColumn("_r", F.row_number().over(Window.partitionBy(judge).orderBy(value, item)) - 1)
    s = r.groupBy(item).agg(F.sum("_r").alias("s"), F.count("*").alias("m"))
    return s.agg(F.count("*").alias("n"), F.max("m").alias("m"), F.sum((F.col("s") * F.col("s")).cast("double")).alias("q"), F.sum("s").cast("double").alias("t")).select(
        "n", "m", (12 * (F.col("q") - F.col("t") * F.col("t") / F.col("n")) / (F.col("m") * F.col("m") * F.col("n") * (F.col("n") * F.col("n") - 1.0))).alias("w"))


def _order(values: np.ndarray, many: int) -> np.ndarray:
    """Places of the ``many`` smallest in order; of equals the first comes first."""
    at = np.argsort(values)
    found = values[at]
    new = found[1:] != found[:-1]
    if not new[: many - 1].all():
        start = np.append(0, np.cumsum(new)) * len(values)
        at = np.sort(start + at) - start
    return at[:many]


def concordance_map(cohort: DataFrame, kind: str = "kendall", gauss: bool = False, first: int = 2, length: int = 0, near: int = 27, seeds_per_task: int = 64) -> DataFrame:
    """(vid, concordant, discordant): of each seed voxel how far subjects agree on its correlations to voxels of squared distance ``near`` or more.

    cohort: (subj, vid, b, r, c, ts), of every subject the same voxels.  Each of 48 tasks at most has the
    cohort's series and every 48th voxel as a seed, and keeps the maps of a few seeds at a time, 64 MB.
    """
    shortest = cohort.agg(F.min(F.size("ts")).alias("n")).first().n or 0
    length = length if length >= 1 else shortest - 2
    stop = min(first + length, shortest)
    x = cohort.withColumn("ts", F.slice("ts", first + 1, max(stop - first, 0))).select("subj", F.col("vid").cast("long").alias("vid"), "b", "r", "c", "ts")
    tasks = max(1, min(48, -(-x.select("vid").distinct().count() // seeds_per_task)))

    def arrays(pdf: pd.DataFrame) -> tiles.Block:
        return {"subj": pdf.subj.to_numpy(), "vid": pdf.vid.to_numpy(np.int64), "at": pdf[["b", "r", "c"]].to_numpy(float), "x": _matrix(pdf)}

    def run(batches):
        mine, blocks = 0, []
        for pdf in batches:
            for mine, data in zip(pdf.tile, pdf.data):
                blocks.append(pickle.loads(data))
        if not blocks:
            return
        subj, vid, at, p = (np.concatenate([b[name] for b in blocks]) for name in ("subj", "vid", "at", "x"))
        del blocks
        order, m = np.lexsort((vid, subj)), len(np.unique(subj))
        n = len(vid) // m
        ids = vid[order].reshape(m, n)  # voxels are the same in all subjects
        if (ids != ids[0]).any():
            raise ValueError("subjects have other voxels")
        at, p = at[order[:n]], p[order].reshape(m, n, -1)
        p -= p.mean(2, keepdims=True)
        size = (p * p).sum(2)
        p /= np.sqrt(np.where(size > 0, size, 1))[:, :, None]
        flat, long2, width = size.min(1) ** 2 <= 1e-20, (at * at).sum(1), max(1, min(64, (1 << 26) // (8 * m * n)))
        seeds = np.arange(mine, n, tasks)
        for k in range(0, len(seeds), width):
            some = seeds[k : k + width]
            r = np.stack([q[some] @ q.T for q in p])
            for s in np.flatnonzero(flat):
                r[s][size[s, some][:, None] * size[s][None, :] <= 1e-20] = 0
            close = long2[some][:, None] + long2[None, :] - 2 * (at[some] @ at.T) < near
            out = np.zeros(len(some))
            for i in range(len(some)):
                many = n - int(close[i].sum())
                if many < 2:
                    continue
                if kind != "kendall":
                    out[i] = occc(r[:, i, ~close[i]])
                    continue
                total = np.zeros(n, np.int64)
                for s in range(m):
                    row = r[s, i]
                    row[close[i]] = np.inf
                    total[_order(row, many)] += np.arange(many)
                total = total[~close[i]]
                w = 12 * ((total - total.mean()) ** 2).sum() / (m * m * many * (many * many - 1.0))
                out[i] = ((many - 1) * m * w - many) / math.sqrt(2 * many) if gauss else w
            yield pd.DataFrame({"vid": ids[0, some], "concordant": out})

    got = tiles.copies(tiles.pack(x, arrays, 1), tasks).mapInPandas(run, "vid long, concordant double")
    return got.withColumn("discordant", 1 - F.col("concordant"))


# -- spectra ---------------------------------------------------------------------------------------


def taper(p: int) -> np.ndarray:
    """Cosine weights of lags 0 .. p - 1, over 2 pi times their sum."""
    w = 0.5 * (1 + np.cos(math.pi * np.arange(p) / p))
    return w / (2 * math.pi * w.sum())


def coherence_factors(x: np.ndarray, k0: int, p: int) -> np.ndarray:
    """Complex amplitudes at the 2 p + 1 bins about k0, folded at the ends, times the root of their weight."""
    n = x.shape[1]
    x = (x - x.mean(1, keepdims=True)) / np.maximum(x.std(1, ddof=1, keepdims=True), 1e-12)
    lag = np.arange(-p, p + 1)
    bins = np.abs(lag + k0)
    bins = np.where(bins >= n, 2 * n - bins - 1, bins)
    w = np.append(taper(p), 0.0)[np.abs(lag)]
    phase = np.exp(-2j * math.pi * np.outer(np.arange(n), bins) / n)
    return 2 * (x @ phase) * np.sqrt(2 * w / n)


def spectral_ecm(series: DataFrame, tr: float, wavelength: float, nlags: int = 10, kind: str = "freq", iterations: int = 50, size: int = tiles.PIECE) -> DataFrame:
    """Centrality (vid, value) of spectral coherence (``freq``) or phase synchrony (``sync``) at a wavelength in seconds."""
    one = series.select(F.size("ts").alias("n")).first()
    if one is None:
        return series.sparkSession.createDataFrame([], "vid long, value double")
    p = one.n // 15 if nlags < 0 else nlags
    if p < 3:
        raise ValueError("nlags must be 3 or more")
    k0 = int(one.n / (wavelength / tr) + 0.5)

    def factors(pdf: pd.DataFrame) -> tiles.Block:
        """Amplitudes over the root of their power as rows (real, imaginary), and turned by 90 degrees."""
        f = coherence_factors(_matrix(pdf), k0, p)
        power = (np.abs(f) ** 2).sum(1)
        f = f / np.sqrt(np.where(power > 0, power, 1))[:, None]
        return {"vid": pdf.vid.to_numpy(np.int64), "f": np.concatenate([f.real, f.imag], axis=1), "turned": np.concatenate([f.imag, -f.real], axis=1), "power": power}

    def block(a: tiles.Block, b: tiles.Block) -> np.ndarray:
        re, im = a["f"] @ b["f"].T, a["turned"] @ b["f"].T
        if kind == "freq":
            re *= re
            im *= im
            re += im
            v = np.sqrt(re, out=re)
            if a["power"].min() * b["power"].min() <= 1e-10:
                v[a["power"][:, None] * b["power"][None, :] <= 1e-10] = 0
        else:
            v = np.cos(np.arctan2(-im, re) / math.pi)
        return np.maximum(v, 1e-10, out=v)

    x = series.select(F.col("vid").cast("long").alias("vid"), "ts")
    n = x.count()
    out = _iterate(x, n, 4 * (2 * p + 1), factors, block, iterations, size, True)
    return out.withColumn("value", F.col("value") / math.sqrt(max(n, 1)) * 100)


# -- bipartite graphs ------------------------------------------------------------------------------


def edge_rows(x: np.ndarray, metric: str) -> np.ndarray:
    """Ranks less their mean, or z-scores, of unit length: their inner products are correlations."""
    n = x.shape[1]
    if metric == "spearman":
        return (ranks(x) - (n - 1) / 2) / math.sqrt(n * (n * n - 1.0) / 12)
    return (x - x.mean(1, keepdims=True)) / np.maximum(x.std(1, ddof=1, keepdims=True), 1e-12) / math.sqrt(n - 1)


def edge_product(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    r = x @ y.T
    return -0.5 * np.log(np.maximum(1 - r * r, 1e-12)) if metric == "MI" else r


def edge_value(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Pearson and Spearman correlation or mutual information of all pairs of rows."""
    return edge_product(edge_rows(x, metric), edge_rows(y, metric), metric)


def _side(metric: str) -> Callable:
    return lambda pdf: {"vid": pdf.vid.to_numpy(np.int64), "at": pdf[["b", "r", "c"]].to_numpy(float), "x": edge_rows(_matrix(pdf), metric)}


def _bipartite_tiles(left: DataFrame, right: DataFrame, metric: str, size: int) -> DataFrame | None:
    one = left.select(F.size("ts").alias("n")).first()
    if one is None or right.first() is None:
        return None
    groups = [tiles.group_count(side.count(), 8 * one.n + 40, size) for side in (left, right)]
    packed = [tiles.pack(side.select("vid", "b", "r", "c", "ts"), _side(metric), g, size) for side, g in zip((left, right), groups)]
    return tiles.grid(packed[0], packed[1], *groups)


def _bipartite_weights(a: tiles.Block, b: tiles.Block, metric: str, threshold: float, least_distance2: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, which pairs are edges) of two blocks; distances only where the boxes around the blocks are near."""
    w = edge_product(a["x"], b["x"], metric)
    edge = w >= threshold + 1e-6
    apart = np.maximum(np.maximum(a["at"].min(0) - b["at"].max(0), b["at"].min(0) - a["at"].max(0)), 0)
    if (apart * apart).sum() < least_distance2:
        edge &= (a["at"] ** 2).sum(1)[:, None] + (b["at"] ** 2).sum(1)[None, :] - 2 * (a["at"] @ b["at"].T) >= least_distance2
    return w, edge


def bipartite_edges(left: DataFrame, right: DataFrame, metric: str = "pearson", threshold: float = 0.0, least_distance2: int = 9, size: int = tiles.PIECE) -> DataFrame:
    """(i, j, w) between voxels (vid, b, r, c, ts) of two regions at squared distance 9 or more; values at or below the threshold are left out."""

    def run(held, streamed, same):
        for b in streamed:
            for a in held:
                w, edge = _bipartite_weights(a, b, metric, threshold, least_distance2)
                k, m = np.nonzero(edge)
                yield pd.DataFrame({"i": a["vid"][k], "j": b["vid"][m], "w": w[k, m]})

    grid = _bipartite_tiles(left, right, metric, size)
    schema = "i long, j long, w double"
    return left.sparkSession.createDataFrame([], schema) if grid is None else tiles.over(grid, run, schema, size)


def bipartite_sums(left: DataFrame, right: DataFrame, metric: str = "pearson", threshold: float = 0.0, weights: DataFrame | None = None, least_distance2: int = 9, size: int = tiles.PIECE) -> DataFrame:
    """(side, vid, value): of each voxel with ``bipartite_edges`` the sum of their weights, without edges as rows.

    With ``weights`` (vid, value) of voxels on the right, only side 1, and each edge counts as many times as its voxel there says;
    the driver has them, 16 bytes a voxel.
    """
    ids = by = None
    if weights is not None:
        rows = weights.select("vid", "value").toPandas().sort_values("vid")
        ids, by = rows.vid.to_numpy(np.int64), rows.value.to_numpy(float)

    def run(held, streamed, same):
        for a in held:
            a["sum"], a["any"] = np.zeros(len(a["x"])), np.zeros(len(a["x"]), bool)
        for b in streamed:
            total, some, times = np.zeros(len(b["x"])), np.zeros(len(b["x"]), bool), np.ones(len(b["x"]))
            if ids is not None:
                place = np.minimum(np.searchsorted(ids, b["vid"]), len(ids) - 1)
                times = np.where(ids[place] == b["vid"], by[place], 0.0) if len(ids) else np.zeros(len(b["x"]))
            for a in held:
                w, edge = _bipartite_weights(a, b, metric, threshold, least_distance2)
                w *= edge
                a["sum"] += w @ times
                a["any"] |= edge.any(1)
                if ids is None:
                    total += np.ones(len(w)) @ w
                    some |= edge.any(0)
            if ids is None:
                yield pd.DataFrame({"side": 2, "vid": b["vid"][some], "value": total[some]})
        for a in held:
            yield pd.DataFrame({"side": 1, "vid": a["vid"][a["any"]], "value": a["sum"][a["any"]]})

    grid = _bipartite_tiles(left, right, metric, size)
    schema = "side int, vid long, value double"
    if grid is None:
        return left.sparkSession.createDataFrame([], schema)
    return tiles.over(grid, run, schema, size).groupBy("side", "vid").agg(F.sum("value").alias("value"))


def bipartite_degrees(left: DataFrame, right: DataFrame, na: int, nb: int, metric: str = "pearson", threshold: float = 0.0, size: int = tiles.PIECE) -> DataFrame:
    """``bipartite_degree`` of the edges of two regions."""
    return bipartite_sums(left, right, metric, threshold, size=size).withColumn("value", F.col("value") / F.when(F.col("side") == 1, float(nb)).otherwise(float(na)))


def projected_hubs(left: DataFrame, right: DataFrame, n_other: int, metric: str = "pearson", threshold: float = 0.0, size: int = tiles.PIECE) -> DataFrame:
    """``network_projection`` on the left region of the edges of two."""
    totals = bipartite_sums(left, right, metric, threshold, size=size).filter("side = 2")
    return bipartite_sums(left, right, metric, threshold, totals, size=size).select("vid", (F.col("value") / float(n_other) ** 2).alias("value"))


def bipartite_centrality(edge_table: DataFrame, left: DataFrame, right: DataFrame, iterations: int = 100) -> DataFrame:
    """(side, vid, value): leading singular vectors by alternating products, both sides under one norm."""
    e = settle(edge_table)
    v = left.select(F.lit(1).alias("side"), F.col("vid").cast("long").alias("vid")).unionByName(right.select(F.lit(2).alias("side"), F.col("vid").cast("long").alias("vid")))
    n, last = v.count(), 0.0
    v = v.withColumn("value", F.lit(1.0 / max(n, 1)))
    all_ = settle(v)
    for i in range(iterations):
        ya = e.join(v.filter("side = 2").select(F.col("vid").alias("j"), "value"), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("value")).alias("y")).select(F.lit(1).alias("side"), F.col("i").alias("vid"), "y")
        yb = e.join(v.filter("side = 1").select(F.col("vid").alias("i"), "value"), "i").groupBy("j").agg(F.sum(F.col("w") * F.col("value")).alias("y")).select(F.lit(2).alias("side"), F.col("j").alias("vid"), "y")
        y = settle(all_.select("side", "vid").join(ya.unionByName(yb), ["side", "vid"], "left").fillna(0.0, ["y"]))
        norm = math.sqrt(y.agg(F.sum(F.col("y") ** 2).alias("s")).first().s or 1.0)
        v = y.select("side", "vid", (F.col("y") / norm).alias("value"))
        if (abs(norm - last) < 1e-8 and i > 3) or (i > 5 and norm > last):
            break
        last = norm
    return v


def bipartite_degree(edge_table: DataFrame, na: int, nb: int) -> DataFrame:
    """(side, vid, value): the mean weight to the other side."""
    a = edge_table.groupBy("i").agg((F.sum("w") / nb).alias("value")).select(F.lit(1).alias("side"), F.col("i").alias("vid"), "value")
    b = edge_table.groupBy("j").agg((F.sum("w") / na).alias("value")).select(F.lit(2).alias("side"), F.col("j").alias("vid"), "value")
    return a.unionByName(b)


def network_projection(edge_table: DataFrame, side: int, n_other: int) -> DataFrame:
    """(vid, value): hubs of the graph projected on a side, sum over k of w(i,k) w(j,k) over n^2.  The sum over j first: no pairs are made."""
    own, other = ("i", "j") if side == 1 else ("j", "i")
    total = edge_table.groupBy(other).agg(F.sum("w").alias("t"))
    return edge_table.join(total, other).groupBy(F.col(own).alias("vid")).agg((F.sum(F.col("w") * F.col("t")) / float(n_other) ** 2).alias("value"))
