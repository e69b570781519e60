"""Language identification with spans: scripts narrow candidates, Viterbi labels words.

A word is a run of letters (and marks).  Each language is learned as frequencies of hashed 3-byte
grams of words, case of A-Z folded, a blank at both ends, and as its share of letters by script.  Of a
word, only languages that write in its script are candidates (all, where none does).  A word's score
for a language is the sum of its grams' log frequencies.  Viterbi finds the labels of best total score
where each switch between neighbouring words costs a penalty, so single odd words don't flip a span and
longer foreign passages do.

Learning counts all rows given; the counts are a table of fixed size for each language.

Defined cases: null text and text without a letter are ``und`` with score 0; rows whose language is
null teach nothing; no rows to learn from leave every text ``und``; equal scores go to the language that
sorts first; a very long text is a slice of its own; the score is the share of the text's letters, by bytes, in words of the predicted language.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .scratch import bounded

GRAM_BITS = 15
PENALTY = 6.0
CHUNK = 64

#: Scripts by their first code points; a code point belongs to the last start at or below it.
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x323B0, "other"),
)
SCRIPTS = tuple(dict.fromkeys(name for _, name in SCRIPT_STARTS))

_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point whether it is a letter or mark (1 letter, 2 mark), and its script."""
    if not _TABLES:
        kind = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            if not 0xD800 <= i < 0xE000 and (c := unicodedata.category(chr(i)))[0] in "LM":
                kind[i] = 1 if c[0] == "L" else 2
        _TABLES["kind"] = kind
        _TABLES["starts"] = np.array([s for s, _ in SCRIPT_STARTS])
        _TABLES["names"] = np.array([SCRIPTS.index(n) for _, n in SCRIPT_STARTS], np.uint8)
    return _TABLES["kind"], _TABLES["starts"]


def letter_runs(off: np.ndarray, data: np.ndarray) -> tuple[tb.Words, np.ndarray]:
    """(words of letters and marks with a letter each, their scripts) of a slice of valid UTF-8."""
    kind, starts = _tables()
    at, point = tb.code_points(data)
    sort = kind[np.minimum(point, 0x10FFFF)]
    per = np.zeros(len(data), np.uint8)
    per[:] = np.repeat(sort, np.diff(np.append(at, len(data)))) if len(at) else 0
    inside = per > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    if not len(data):
        none = np.zeros(0, np.int64)
        return tb.Words(none, none, np.zeros(len(off), np.int64), np.zeros(0, np.uint64)), none
    first = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1]))
    last = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1
    letters = np.concatenate(([0], np.cumsum(per == 1)))
    real = letters[last] > letters[first]
    first, last = first[real], last[real]
    # a word's script is that of its first letter
    nth = np.searchsorted(np.flatnonzero(per == 1), first)
    where = np.flatnonzero(per == 1)[nth] if len(first) else first
    script = _TABLES["names"][np.searchsorted(starts, point[np.searchsorted(at, where, side="right") - 1], side="right") - 1] if len(first) else np.zeros(0, np.uint8)
    w = tb.Words(first, last, np.searchsorted(first, off), np.zeros(0, np.uint64))
    return w, script


def word_grams(w: tb.Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram cells, one for each byte of each word plus 1; start of each word's cells)."""
    n = (w.ends - w.starts) + 1
    head = np.cumsum(n) - n
    pos = np.repeat(w.starts - head, n) + np.arange(int(n.sum()))  # the byte that a gram is centred before
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    pad = np.concatenate(([32], low, [32, 32])).astype(np.uint32)
    a, b, c = pad[pos], pad[pos + 1], pad[pos + 2]
    a[head] = 32
    ends = head + n - 1
    b[ends] = 32
    c[ends] = 10
    two = ends - 1
    c[two] = 32
    key = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (c * np.uint32(0xC2B2AE35))
    key ^= key >> np.uint32(15)
    return ((key * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64), head


@dataclass
class Model:
    """langs in order; log frequency [cells, langs]; which languages write in a script [scripts, langs]."""

    langs: list[str]
    table: np.ndarray
    allowed: np.ndarray
    penalty: float = PENALTY


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> of each language its counts of cells and scripts, one row for each task."""
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for i, j, off, data in tb.slices(batch.column(1)):
            w, script = letter_runs(off, data)
            if not len(w.starts):
                continue
            cell, head = word_grams(w, data)
            doc = w.doc()
            owner = np.repeat(doc, np.diff(np.append(head, len(cell))))
            names = sorted(set(langs[i:j]))
            number = np.array([names.index(x) for x in langs[i:j]])
            grams = np.bincount(number[owner] * (1 << GRAM_BITS) + cell, minlength=len(names) << GRAM_BITS).reshape(len(names), -1)
            kinds = np.bincount(number[doc] * len(SCRIPTS) + script, weights=w.ends - w.starts, minlength=len(names) * len(SCRIPTS)).reshape(len(names), -1)
            for x, g, s in zip(names, grams, kinds):
                total = np.concatenate([g, s.astype(np.int64)])
                seen[x] = seen[x] + total if x in seen else total
    for x, total in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())], names=["lang", "counts"])


def _sum(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        for x in batch.column(1):
            total = total + np.frombuffer(zlib.decompress(x.as_py()), "<i8")
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["lang", "counts"])


def learn(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", penalty: float = PENALTY) -> Model:
    """A model of all rows with a language.  The driver gets one table of fixed size for each language."""
    bounded(rows.sparkSession)
    own = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    got = own.mapInArrow(_count, "lang string, counts binary").groupBy("lang").applyInArrow(_sum, "lang string, counts binary").collect()
    got = sorted((r.lang, np.frombuffer(zlib.decompress(r.counts), "<i8")) for r in got)
    langs = [x for x, _ in got]
    if not langs:
        return Model([], np.zeros((1 << GRAM_BITS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool), penalty)
    counts = np.stack([c for _, c in got])
    grams, scripts = counts[:, : 1 << GRAM_BITS] + 0.5, counts[:, 1 << GRAM_BITS :]
    allowed = (scripts >= 0.001 * np.maximum(scripts.sum(axis=1, keepdims=True), 1)).T
    allowed |= ~allowed.any(axis=1, keepdims=True)
    return Model(langs, np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32), allowed, penalty)


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word.  score [words, labels]; words of document d are first[d] .. first[d+1] - 1.

    Documents are cut into chunks of CHUNK words.  What a chunk makes of each state that may enter it is
    computed for all chunks at once; then states run through the chunks of each document, all documents at
    once; then labels come back within all chunks at once.  The steps are CHUNK plus the chunks of the
    longest document.
    """
    n, labels = score.shape
    out = np.zeros(n, np.int64)
    if labels < 2 or not n:
        return out
    length = np.diff(first)
    chunks = -(-length // CHUNK)
    chunk_first = np.concatenate(([0], np.cumsum(chunks)))
    total = int(chunk_first[-1])
    base = np.repeat(first[:-1] - CHUNK * chunk_first[:-1], chunks) + CHUNK * np.arange(total)
    size = np.minimum(CHUNK, np.repeat(first[1:], chunks) - base)
    state = np.full((total, labels, labels), -np.inf, np.float32)
    state[:, np.arange(labels), np.arange(labels)] = 0
    for t in range(int(size.max())):
        on = np.flatnonzero(size > t)
        s = state[on]
        state[on] = np.maximum(s, s.max(axis=2, keepdims=True) - penalty) + score[base[on] + t][:, None, :]
    enter = np.zeros((total, labels), np.float32)
    now, order = np.zeros((len(length), labels), np.float32), np.flatnonzero(chunks)
    step = 0
    while len(order):
        c = chunk_first[order] + step
        enter[c] = now[order]
        moved = (now[order][:, :, None] + state[c]).max(axis=1)
        now[order] = moved - moved.max(axis=1, keepdims=True)
        step += 1
        order = order[chunks[order] > step]
    back = np.zeros((total, CHUNK, labels), np.int8 if labels <= 127 else np.int32)
    v = enter
    for t in range(int(size.max())):
        on = np.flatnonzero(size > t)
        s = v[on]
        best = s.argmax(axis=1)
        top = np.take_along_axis(s, best[:, None], 1) - penalty
        back[on, t] = np.where(s >= top, np.arange(labels), best[:, None])
        v[on] = np.maximum(s, top) + score[base[on] + t]
    # labels, last chunk first
    label = np.zeros(total, np.int64)
    entry = np.zeros(total, np.int64)
    # what each end state of a chunk was at its start
    path = np.tile(np.arange(labels), (total, 1))
    for t in range(int(size.max()) - 1, -1, -1):
        on = np.flatnonzero(size > t)
        path[on] = np.take_along_axis(back[on, t], path[on], 1)
    order, step = np.flatnonzero(chunks), 1
    last = chunk_first[1:] - 1
    label[last[order]] = v[last[order]].argmax(axis=1)
    while len(order):
        c = chunk_first[order + 1] - step
        entry[c] = path[c, label[c]]
        order = order[chunks[order] > step]
        c = chunk_first[order + 1] - step
        label[c - 1] = entry[c]
        step += 1
    for t in range(int(size.max()) - 1, -1, -1):
        on = np.flatnonzero(size > t)
        out[base[on] + t] = label[on]
        label[on] = back[on, t, label[on]]
    return out


def label_words(model: Model, off: np.ndarray, data: np.ndarray) -> tuple[tb.Words, np.ndarray]:
    """(words of letters, label of each) of a slice."""
    w, script = letter_runs(off, data)
    if not len(w.starts) or not model.langs:
        return w, np.zeros(len(w.starts), np.int64)
    cell, head = word_grams(w, data)
    score = np.add.reduceat(model.table[cell], head, axis=0)
    score -= score.max(axis=1, keepdims=True)
    score[~model.allowed[script]] = -1e4
    return w, viterbi(score, w.first, model.penalty)


def _verdicts(model: Model, w: tb.Words, label: np.ndarray, docs: int) -> tuple[list[str], np.ndarray]:
    if not model.langs:
        return ["und"] * docs, np.zeros(docs)
    size = np.bincount(w.doc() * len(model.langs) + label, weights=w.ends - w.starts, minlength=docs * len(model.langs)).reshape(docs, -1)
    best, total = size.argmax(axis=1), size.sum(axis=1)
    share = np.take_along_axis(size, best[:, None], 1)[:, 0] / np.maximum(total, 1)
    return [model.langs[b] if t else "und" for b, t in zip(best.tolist(), total.tolist())], share


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [], []
            for i, j, off, data in tb.slices(batch.column(batch.num_columns - 1)):
                w, label = label_words(model, off, data)
                x, y = _verdicts(model, w, label, j - i)
                names += x
                scores.append(y)
            cols = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, keep: dict, text_col: str = "text") -> DataFrame:
    """The columns of ``keep`` (name -> (column, type)) with lang_pred and score."""
    shared = bounded(docs.sparkSession).sparkContext.broadcast(model)
    own = docs.select(*(c.alias(n) for n, (c, _) in keep.items()), F.col(text_col).cast("string").alias("_text"))
    return own.mapInArrow(_predict(shared), ", ".join(f"`{n}` {t}" for n, (_, t) in keep.items()) + ", lang_pred string, score double")


def _keep_rows(shared, text: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, j, off, data in tb.slices(batch.column(text)):
                names, scores = _verdicts(shared.value, *label_words(shared.value, off, data), j - i)
                keep += [n != "und" and s >= least for n, s in zip(names, scores.tolist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, with their own columns, in which one language has at least ``least`` of the letters."""
    return docs.mapInArrow(_keep_rows(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), least), docs.schema)


def _spans(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j, off, data in tb.slices(batch.column(1)):
                w, label = label_words(model, off, data)
                doc = w.doc()
                new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])))) if len(doc) else doc
                end = np.append(new[1:], len(doc)) - 1 if len(doc) else doc
                rows = pa.array(i + doc[new])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(w.starts[new] - off[doc[new]]), pa.array(w.ends[end] - off[doc[new]]), pa.array([model.langs[x] if model.langs else "und" for x in label[new]], pa.string())], names=["doc_id", "start", "stop", "lang"])

    return run


def language_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, stop, lang): spans of one language, by UTF-8 bytes from the first to past the last word."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_spans(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, start long, stop long, lang string")
