"""Random tables by keyed hashes: each draw is a function of (seed, permutation, index), so it can be redone anywhere.

A draw is the first 32 bits of ``md5('seed:perm:index')``.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEED = 99402622


def draw(*parts) -> Column:
    """An unsigned 32-bit draw as a long, from columns and values."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def draw_value(*parts) -> int:
    """The same draw on the driver."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def sign_flips(spark: SparkSession, n: int, perms: int, seed: int = SEED) -> DataFrame:
    """(perm, subj, flip): perm 0 flips nothing, the others each subject with probability one half."""
    grid = spark.range(perms + 1).select(F.col("id").cast("int").alias("perm")).withColumn("subj", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.withColumn("flip", F.when(F.col("perm") == 0, 0).otherwise(draw(seed, F.col("perm"), F.col("subj")) % 2).cast("int"))


def group_shuffles(spark: SparkSession, groups: list[int], perms: int, seed: int = SEED) -> DataFrame:
    """(perm, subj, grp): group labels dealt anew to subjects 0 .. n - 1."""
    n = len(groups)
    labels = F.array(*(F.lit(int(g)) for g in groups))
    grid = spark.range(perms + 1).select(F.col("id").cast("int").alias("perm")).withColumn("subj", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    w = Window.partitionBy("perm").orderBy(draw(seed, F.col("perm"), F.col("subj")), "subj")
    k = F.when(F.col("perm") == 0, F.col("subj") + 1).otherwise(F.row_number().over(w))
    return grid.withColumn("k", k).select("perm", "subj", F.element_at(labels, F.col("k").cast("int")).alias("grp"))


def block_shuffles(rows: DataFrame, perms: int, block: str, index: str, seed: int = SEED) -> DataFrame:
    """(perm, index, block, source): within each block the row that takes the place of each row."""
    grid = rows.select(block, index).crossJoin(F.broadcast(rows.sparkSession.range(perms + 1).select(F.col("id").cast("int").alias("perm"))))
    part = Window.partitionBy("perm", block)
    grid = grid.withColumn("_i", F.row_number().over(part.orderBy(index)))
    grid = grid.withColumn("_k", F.when(F.col("perm") == 0, F.col("_i")).otherwise(F.row_number().over(part.orderBy(draw(seed, F.col("perm"), F.col(index)), index))))
    source = grid.select("perm", block, F.col("_k").alias("_i"), F.col(index).alias("source"))
    return grid.drop("_k").join(source, ["perm", block, "_i"]).drop("_i")


def condition_swaps(n: int, perms: int, seed: int = SEED) -> np.ndarray:
    """Table perms x n of swaps: 3 to n - 3 of them each (half, where fewer than ten permutations are asked); row 0 has none."""
    out = np.zeros((perms + 1, n), np.int64)
    for p in range(1, perms + 1):
        for attempt in range(100):
            row = np.array([draw_value(seed, p, i, attempt) & 1 for i in range(n)])
            if perms < 10:
                row = (np.argsort(np.argsort([draw_value(seed, p, i, attempt) for i in range(n)])) < n // 2).astype(int)
            if n < 6 or 3 <= row.sum() <= n - 3:
                break
        out[p] = row
    return out


def folds(rows: DataFrame, k: int, key: str, seed: int = SEED) -> DataFrame:
    """Adds ``fold`` 0 .. k - 1 by a keyed hash: near-equal sizes, decided by the key alone."""
    return rows.withColumn("fold", (draw(seed, F.col(key)) % k).cast("int"))


def train_test(rows: DataFrame, samples: int, n_train: int, n_test: int, key: str, seed: int = SEED) -> DataFrame:
    """(sample, key, part): for each sample the first n_train rows of a keyed order to train, the next n_test to test."""
    grid = rows.select(key).crossJoin(F.broadcast(rows.sparkSession.range(samples).select(F.col("id").cast("int").alias("sample"))))
    k = F.row_number().over(Window.partitionBy("sample").orderBy(draw(seed, F.col("sample"), F.col(key)), key))
    return grid.withColumn("k", k).filter(F.col("k") <= n_train + n_test).select("sample", key, F.when(F.col("k") <= n_train, "train").otherwise("test").alias("part"))


def sample_without(n: int, k: int, seed: int) -> np.ndarray:
    return np.sort(np.random.default_rng(seed).choice(n, min(k, n), replace=False))


def sample_weighted(weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k draws with replacement, by search in the running sum of the weights."""
    total = np.cumsum(np.asarray(weights, float))
    return np.searchsorted(total, np.random.default_rng(seed).random(k) * total[-1], side="right")


def combinations(n: int, k: int) -> np.ndarray:
    """All choices of k of n as rows of 0 and 1."""
    from itertools import combinations as choose

    out = np.array([[1 if i in set(c) else 0 for i in range(n)] for c in choose(range(n), k)], np.int64)
    return out.reshape(-1, n)
