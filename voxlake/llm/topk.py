"""Exact top-k search by inner product of integer vectors, with multi-resolution segment statistics.

Each vector is cut into segments; a segment keeps its mean and deviation.  With lengths m and means a,
b and deviations s, t of two vectors' segments,  ``sum m (a-b)^2 + m (s-t)^2`` is at most their squared
distance, so  ``sum m a b + m s t`` is at least their inner product.  Bounds go coarse to fine (4 then
16 segments); a pair whose bound falls below the query's k-th best score so far is done.  Exact integer
products follow for survivors.

Queries and vectors meet in a grid of blocks, each a task of bounded size; a task returns the best k of
its block for each query, and these few rows are merged.  No side is broadcast or collected.

Products of large components, where doubles are not exact, are taken of Python's integers; these vectors
skip the bounds.  Scores beyond 64 bits are returned as the nearest long.

Defined cases: null vectors and vectors with null or non-finite components take no part; vectors meet
those of their own length only; ties go to the smaller id; rows of the query's own id are no candidates;
fewer candidates than k are all returned; repeated rows each count, as candidates and as queries with
answers of their own; rows with a null id take no part; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (4, 16)
QUERY_BLOCK = 4096
VECTOR_BLOCK = 8192


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(id, dim, v array<double>) of the rows that take part: floor(scale * x) of each component, a whole number."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = F.lit(float(np.finfo(float).max))
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(F.least(F.greatest(x * scale, -most), most))
    return df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(fine.isNull() | fine).filter(
        ~F.exists("v", lambda x: x.isNull())).select("id", F.size("v").alias("dim"), F.transform("v", whole).alias("v"))


def segment_bounds(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows such that the inner product of two of them bounds their vectors' from above."""
    d = x.shape[1]
    cuts = np.linspace(0, d, min(segments, d) + 1).astype(int)
    m = np.diff(cuts)
    sums = np.add.reduceat(x, cuts[:-1], axis=1)
    mean = sums / m
    var = np.maximum(np.add.reduceat(x * x, cuts[:-1], axis=1) / m - mean * mean, 0)
    root = np.sqrt(m)
    return np.concatenate([mean * root, np.sqrt(var) * root], axis=1)


def block_topk(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """(query index, vector index, score): the best k of this block for each query, ids of its own left out.  q, v: whole numbers as doubles."""
    limit = (2.0**52 / max(q.shape[1], 1)) ** 0.5
    big_q, big_v = (np.abs(x).max(axis=1, initial=0) >= limit for x in (q, v))
    best: dict[int, list[tuple[int, int, int]]] = {}
    at, to = np.flatnonzero(~big_q), np.flatnonzero(~big_v)
    for i, j, s in zip(*_exact_block(qid[at], q[at], vid[to], v[to], k)):
        best.setdefault(int(at[i]), []).append((-int(s), int(vid[to[j]]), int(to[j])))
    whole = lambda x: np.array([[int(c) for c in r] for r in x.tolist()], object).reshape(x.shape)
    for at, to in ((np.flatnonzero(big_q), np.arange(len(v))), (np.flatnonzero(~big_q), np.flatnonzero(big_v))):
        if len(at) and len(to):
            rows, cols = whole(q[at]), whole(v[to])
            for i, r in zip(at.tolist(), rows):
                own = [(-int(s), int(vid[j]), int(j)) for s, j in zip(cols @ r, to) if vid[j] != qid[i]]
                best[i] = sorted(best.get(i, []) + own)[:k]
    out = [(i, j, -s) for i, rows in best.items() for s, _, j in rows]
    return tuple([o[c] for o in out] for c in range(3))


def _exact_block(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same where doubles hold every sum."""
    dim, out = q.shape[1], []
    order = np.argsort(vid, kind="stable")  # ties go to the smaller id
    vid, v = vid[order], v[order]
    levels = [s for s in LEVELS if s < dim]
    bounds = [(segment_bounds(q, s), segment_bounds(v, s)) for s in levels]
    slack = 1e-6 * (1 + np.linalg.norm(q, axis=1)) * (1 + np.linalg.norm(v, axis=1).max(initial=0))
    for a in range(0, len(q) if len(v) else 0, 256):
        rows = np.arange(a, min(a + 256, len(q)))
        if levels:
            upper = bounds[0][0][rows] @ bounds[0][1].T
            first = np.argpartition(-upper, min(4 * k, upper.shape[1] - 1), axis=1)[:, : 4 * k]
        for r, i in enumerate(rows):
            keep = np.arange(len(v))
            if levels and len(v) > 8 * k:
                seen = first[r][vid[first[r]] != qid[i]]
                got = np.sort(v[seen] @ q[i])
                if len(got) >= k:
                    low = got[-k] - slack[i]
                    keep = np.flatnonzero(upper[r] >= low)
                    for x, y in bounds[1:]:
                        keep = keep[y[keep] @ x[i] >= low]
            keep = keep[vid[keep] != qid[i]]
            s = v[keep] @ q[i]
            best = np.argsort(-s, kind="stable")[:k]
            out.append((np.full(len(best), i), order[keep[best]], s[best]))
    return tuple(np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3))


def _stack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, keys, vectors), ordered by id and key."""
    ids, keys = table.column("id").to_numpy(), table.column("key").to_numpy()
    rows = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
    order = np.lexsort((keys, ids))
    return ids[order], keys[order], rows[order]


def _meet(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (qid, key, q), (vid, _, v) = _stack(left), _stack(right)
        i = j = s = place = np.zeros(0, np.int64)
        if len(qid) and len(vid):
            if q.shape[1] == 0:
                q, v = np.zeros((len(qid), 1)), np.zeros((len(vid), 1))
            i, j, s = block_topk(qid, q, vid, v, k)
            # of equal query rows the first, the second, ...
            place = np.arange(len(qid))
            new = np.concatenate(([True], (qid[1:] != qid[:-1]) | (key[1:] != key[:-1])))
            place = place - np.maximum.accumulate(np.where(new, place, 0))
        i, most = np.array(i, np.int64), 2**63 - 1
        return pa.table({"query_id": pa.array(qid[i], pa.int64()), "key": pa.array(key[i], pa.int64()), "nth": pa.array(place[i], pa.int64()), "vec_id": pa.array([int(vid[x]) for x in j], pa.int64()), "score": pa.array([max(-most, min(most, int(x))) for x in s], pa.int64())})

    return run


def exact_topk(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the queries, the rows whose id is divisible by ``every``, against all rows."""
    x = integer_vectors(vectors, id_col, vec_col).withColumn("key", F.xxhash64("v"))
    sizes = x.agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q")).first()
    nq, nv = max(1, -(-sizes.q // query_block)), max(1, -(-sizes.n // vector_block))
    block = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    queries = x.filter(F.col("id") % every == 0).withColumn("qb", block(nq)).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1)))).select("qb", "vb", "id", "key", "dim", "v")
    rows = x.withColumn("vb", block(nv)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).select("qb", "vb", "id", "key", "dim", "v")
    met = queries.groupBy("qb", "vb", "dim").cogroup(rows.groupBy("qb", "vb", "dim")).applyInArrow(_meet(k), "query_id long, key long, nth long, vec_id long, score long")
    best = Window.partitionBy("query_id", "key", "nth").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
