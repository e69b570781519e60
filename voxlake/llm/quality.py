"""Quality by ordinal regression: a cumulative-link model of graded ratings on hashed text.

Of K grades, ``P(grade <= k) = sigmoid(threshold[k] - score)`` with ordered thresholds and one score, a
sum of weights that all grades share: one weight for each hashed feature that a text has.  Features are
words (A-Z folded), the shapes of words (which kinds of bytes they end and begin with) and the length
of the text by doublings.  The model gives the expected grade and tail probabilities for selection.

Fitted on at most ``sample`` labelled rows, those of smallest keyed hash of the id, by full-batch
gradient steps; all documents are scored.

Defined cases: null and empty texts are scored by their length feature alone; unlabelled rows, labels
without a grade and labels of absent documents teach nothing; repeated labels each count; no labels give
the middle of the scale for all; rows with a null id are scored; of several texts of a labelled id that of
the smallest hash teaches; a very long text is a slice of its own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .scratch import bounded

BITS = 18
SAMPLE = 12_000
STEPS = 250
PENALTY = 3e-5
LEAST = 12
KEEP = 512

#: Kinds of bytes at the ends of words: lower case, upper case, digit, other ASCII, not ASCII.
_KIND = np.array([2 if 48 <= b <= 57 else 1 if 65 <= b <= 90 else 0 if 97 <= b <= 122 else 3 if b < 128 else 4 for b in range(256)], np.uint64)


def features(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, cell) of each distinct feature of a slice's documents, in order of documents."""
    docs = len(off) - 1
    w = tb.words(off, data, tb.NOT_SPACE)
    bare = tb.words(off, data, tb.ALNUM)
    owner, mask = w.doc().astype(np.int64), np.uint64((1 << BITS) - 1)
    shape = np.zeros(0, np.uint64)
    if len(w.starts):
        ends = [data[w.starts], data[np.maximum(w.ends - 3, w.starts)], data[np.maximum(w.ends - 2, w.starts)], data[w.ends - 1]]
        shape = sum((_KIND[b] + np.uint64(1)) * np.uint64(7**i) for i, b in enumerate(ends))
        odd = ends[3] * (_KIND[ends[3]] == 3)  # the last byte itself, where it is a sign
        shape = tb.mix(shape + odd.astype(np.uint64) * np.uint64(100_003) + np.uint64(0xABCDEF))
    length = tb.mix(np.floor(np.log2(np.diff(w.first) + 1)).astype(np.uint64) + np.uint64(0x77777777))
    cell = np.concatenate([bare.hashes, shape, length]) & mask
    doc = np.concatenate([bare.doc().astype(np.int64), owner, np.arange(docs)])
    key = tb.distinct((doc << BITS) | cell.astype(np.int64))
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K - 1, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def telling(cell: np.ndarray, grade: np.ndarray, size: np.ndarray, least: int, keep: int) -> np.ndarray:
    """Marks of the ``keep`` cells, of those in ``least`` texts or more, whose presence depends most on the grade (chi-square)."""
    seen = np.bincount(grade * (1 << BITS) + cell, minlength=len(size) << BITS).reshape(len(size), -1).astype(float)
    n, total = seen.sum(axis=0), size.sum()
    want = n[None, :] * size[:, None] / total
    other = size[:, None] - want
    chi = np.where(n >= least, ((seen - want) ** 2 * (1 / np.maximum(want, 1e-9) + 1 / np.maximum(other, 1e-9))).sum(axis=0), 0)
    out = np.zeros(1 << BITS, bool)
    out[np.argsort(-chi, kind="stable")[:keep]] = True
    return out & (chi > 0)


def fit(docs: list[np.ndarray], grades: np.ndarray, n_grades: int, steps: int = STEPS, penalty: float = PENALTY, least: int = LEAST, keep: int = KEEP) -> Ordinal:
    """docs: cells of each labelled text; grades 0 .. n_grades - 1."""
    w = np.zeros(1 << BITS)
    share = np.cumsum(np.bincount(grades, minlength=n_grades) + 1.0)[:-1]
    base = np.log(share / (len(grades) + n_grades - share)) if len(grades) else np.linspace(-1, 1, n_grades - 1)
    first, gaps = base[0], np.log(np.maximum(np.diff(base), 1e-2))
    if not len(docs):
        return Ordinal(w, base)
    cell = np.concatenate(docs)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    told = telling(cell, grades[row], np.bincount(grades, minlength=n_grades), least, keep)[cell]
    row, cell = row[told], cell[told]
    used, cell = np.unique(cell, return_inverse=True)
    p = np.concatenate([np.zeros(len(used)), [first], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for t in range(1, steps + 1):
        u, first, gaps = p[: len(used)], p[len(used)], p[len(used) + 1 :]
        theta = np.concatenate([[-np.inf], first + np.concatenate([[0], np.cumsum(np.exp(gaps))]), [np.inf]])
        score = np.bincount(row, weights=u[cell], minlength=len(docs))
        high, low = sigmoid(theta[grades + 1] - score), sigmoid(theta[grades] - score)
        high[grades == n_grades - 1], low[grades == 0] = 1, 0
        mass = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / mass, low * (1 - low) / mass  # of the log likelihood by either threshold
        by_theta = np.bincount(grades, weights=dh, minlength=n_grades)[:-1] - np.bincount(grades, weights=dl, minlength=n_grades)[1:]
        grad = np.concatenate([np.bincount(cell, weights=(dl - dh)[row], minlength=len(used)) / len(docs) - penalty * u, [by_theta.sum() / len(docs)], np.cumsum(by_theta[::-1])[::-1][1:] * np.exp(gaps) / len(docs)])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        p = p + 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    w[used] = p[: len(used)]
    return Ordinal(w, p[len(used)] + np.concatenate([[0], np.cumsum(np.exp(p[len(used) + 1 :]))]))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, off, data in tb.slices(batch.column(1)):
            doc, cell = features(off, data)
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            packed = [cell[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(packed, pa.binary())], names=["id", "cells"])


def learn(docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """labels: rows of ``id_col``; ``grade``: an int column of theirs, 0 the worst."""
    spark = bounded(docs.sparkSession)
    own = labels.select(F.col(id_col).cast("long").alias("_id"), grade.cast("int").alias("_grade")).filter(f"_id is not null and _grade >= 0 and _grade < {n_grades}")
    chosen = own.orderBy(F.xxhash64("_id"), "_id", "_grade").limit(sample).collect()  # ``sample`` pairs of numbers at most
    grades: dict[int, list[int]] = {}
    for r in chosen:
        grades.setdefault(r._id, []).append(r._grade)
    ids = spark.createDataFrame(pa.table({"_id": pa.array(list(grades), pa.int64())}))  # a list of rows would start Python workers of its own, which stay
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # one text of each id, so ``sample`` rows at most
    texts = texts.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("t"))
    rows = sorted(texts.select("_id", "t._text").mapInArrow(_cells, "id long, cells binary").collect(), key=lambda r: r.id)
    cells = [(np.frombuffer(r.cells, "<i4"), g) for r in rows for g in grades[r.id]]
    return fit([c for c, _ in cells], np.array([g for _, g in cells], np.int64), n_grades)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j, off, data in tb.slices(batch.column(1)):
                doc, cell = features(off, data)
                score = np.bincount(doc, weights=model.weights[cell], minlength=j - i)
                tails = model.tails(score)
                at = np.arange(j - i + 1, dtype=np.int32) * tails.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score), pa.array(tails.sum(axis=1)), pa.ListArray.from_arrays(pa.array(at), pa.array(tails.ravel()))], names=["doc_id", "score", "expected_grade", "tails"])

    return run


def grade_documents(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, expected_grade, tails): ``tails[k - 1]`` is the probability of grade k or better."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = bounded(docs.sparkSession).sparkContext.broadcast(model)
    return own.mapInArrow(_score(shared), "doc_id long, score double, expected_grade double, tails array<double>")
