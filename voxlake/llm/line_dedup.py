"""Line dedup with an edit bound of one character: a deletion-neighbourhood join.

Lines are what stands between line feeds.  A line is dropped when an equal line stands earlier, or, for
lines of ``min_chars`` or more, a line at edit distance 1.  Earlier is by (document id, text hash, line
number); a null id comes first.

A line's neighbourhood is itself and all its variants of one character less, as hashed keys.  Two lines
differ by one insertion where one equals a variant of the other, and by one substitution where both
have the same variant from the same place.  Members of a key need no pairs: each asks only for the
earliest other of its key.  What a key joins is verified as an edit distance on the characters.

Only lines that can have a neighbour are expanded.  One edit leaves the first or the second half of a
line as it is, so both lines share a hash of their beginning or of their end: halves are met first.  Of
the lines left, one edit leaves all but one of eight parts as they are, so both share a hash of what
stands before and after some part: these are met next.  What still has a partner is expanded.

Lines are known by 64-bit hashes of their bytes.  Defined cases: null text has no lines; empty and blank
lines are always kept; rows of equal id and text are one document, and each such row loses the same
lines; rows of one id and other text, and of no id, are documents of their own; an empty table gives no
rows; a very long text is a slice of its own; columns of any name stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .bitmaps import filter_of, marked
from .scratch import Scratch

MIN_CHARS = 16
PARTS = 8
#: Filters of fixed size, of shared halves and of lines to fetch: 4 MB and 1 MB.  A full one only costs time.
HALF_BITS, LINE_BITS = 25, 23
_NULL_ID = -(2**63)
_rng = np.random.default_rng(90_217)
_SALT = _rng.integers(1, 2**63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Chars:
    """Hashes of runs of bytes, and the bytes at which characters start."""

    def __init__(self, data: np.ndarray):
        self.sums, self.down = tb.running(data.astype(np.uint64) + np.uint64(1))
        lead = (data & 0xC0) != 0x80
        self.count = np.zeros(len(data) + 1, np.int32)  # characters before a byte
        np.cumsum(lead, out=self.count[1:])
        self.at = np.append(np.flatnonzero(lead), len(data))

    def part(self, a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        """Hash of the bytes a .. b - 1."""
        return tb.mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * _SALT[salt])


class _Lines(_Chars):
    """Lines of a slice, by bytes; numbered from 0 in each document."""

    def __init__(self, off: np.ndarray, data: np.ndarray):
        super().__init__(data)
        docs = len(off) - 1
        feed = np.flatnonzero(data == 10)
        # a line starts at each document's start and after each line feed
        self.doc = np.concatenate([np.arange(docs), np.searchsorted(off, feed, side="right") - 1])
        self.start = np.concatenate([off[:-1], feed + 1])
        order = np.lexsort((self.start, self.doc))
        self.start, self.doc = self.start[order], self.doc[order]
        last = np.concatenate([self.doc[1:] != self.doc[:-1], [True]]) if docs else np.zeros(0, bool)
        self.stop = np.where(last, off[1:][self.doc], np.concatenate([self.start[1:], [0]]) - 1) if docs else self.start
        first = np.searchsorted(self.doc, np.arange(docs + 1))
        self.number = np.arange(len(self.doc)) - first[self.doc]
        self.per_doc = np.diff(first)
        solid = np.zeros(len(data) + 1, np.int32)
        np.cumsum(np.frombuffer(data.tobytes().translate(tb.NOT_SPACE.tobytes()), bool), out=solid[1:])
        self.blank = solid[self.stop] == solid[self.start]

    def hashes(self, rows: np.ndarray) -> np.ndarray:
        return self.part(self.start[rows], self.stop[rows], 0)

    def halves(self, rows: np.ndarray) -> np.ndarray:
        """Four keys a line, from its two ends at half its length and at half of one less; some are equal."""
        a, b = self.start[rows], self.stop[rows]
        i, j = self.count[a], self.count[b]
        n, out = j - i, []
        for p in (n // 2, np.maximum(n - 1, 0) // 2):
            out += [self.part(a, self.at[i + p], 1), self.part(self.at[j - p], b, 2)]
        return np.stack(out, axis=1)


def _occurrences(min_chars: int):
    """(id, k, text) -> (h, id, k, line, halves) of the lines that aren't blank, halves of long lines only; and a row of each
    document, where h is null and ``line`` counts its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "id", "k", "line", "halves"]
        for batch in batches:
            for i, j, off, data in tb.slices(batch.column(2)):
                x = _Lines(off, data)
                keep = np.flatnonzero(~x.blank)
                keys = np.sort(x.halves(keep).view(np.int64), axis=1)
                new = np.concatenate([np.ones((len(keep), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
                new &= (x.count[x.stop[keep]] - x.count[x.start[keep]] >= min_chars)[:, None]
                at = np.concatenate(([0], np.cumsum(new.sum(axis=1)))).astype(np.int32)
                own = pa.array(i + x.doc[keep])
                yield pa.RecordBatch.from_arrays([pa.array(x.hashes(keep).view(np.int64)), batch.column(0).take(own), batch.column(1).take(own), pa.array(x.number[keep].astype(np.int32)), pa.ListArray.from_arrays(pa.array(at), pa.array(keys[new]))], names=names)
                none = batch.column(2).slice(i, j - i).is_null().to_numpy(zero_copy_only=False)
                lines = np.where(none, 0, x.per_doc).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.nulls(j - i, pa.int64()), batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(lines), pa.nulls(j - i, pa.list_(pa.int64()))], names=names)

    return run


def _open(marks):
    """(h, halves) -> the h of lines of which a half may stand in another line too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = batch.column(1)
            hit = np.concatenate(([0], np.cumsum(marked(marks.value, halves.flatten().to_numpy()))))
            cut = np.concatenate(([0], np.cumsum(halves.value_lengths().to_numpy(zero_copy_only=False))))
            h = tb.distinct(batch.column(0).to_numpy()[hit[cut[1:]] > hit[cut[:-1]]])
            yield pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])

    return run


def _texts(marks):
    """(text) -> (h, line text) of the lines whose hash may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, off, data in tb.slices(batch.column(0)):
                x = _Lines(off, data)
                keep = np.flatnonzero(~x.blank)
                h = x.hashes(keep).view(np.int64)
                want = np.flatnonzero(marked(marks.value, h))
                want = want[np.unique(h[want], return_index=True)[1]]
                said = [data[a:b].tobytes().decode() for a, b in zip(x.start[keep[want]].tolist(), x.stop[keep[want]].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h[want]), pa.array(said, pa.string())], names=["h", "said"])

    return run


def _outsides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, said) -> (h, keys): hashes of what stands before and after each of the parts, of the line's length and of one less."""
    for batch in batches:
        for i, j, off, data in tb.slices(batch.column(1)):
            x = _Chars(data)
            a, b = off[:-1, None], off[1:, None]
            first, stop = x.count[a].astype(np.int64), x.count[b].astype(np.int64)
            part, keys = np.arange(PARTS)[None, :], []
            for less in (0, 1):
                m = np.maximum(stop - first - less, 0)
                head, tail = m * part // PARTS, m - m * (part + 1) // PARTS
                before = x.part(np.broadcast_to(a, head.shape), x.at[first + head], 1)
                after = x.part(x.at[stop - tail], np.broadcast_to(b, head.shape), 2)
                keys.append(tb.mix(before ^ (after * _SALT[3]) ^ tb.mix((m * PARTS + part).astype(np.uint64) + _SALT[4])))
            keys = np.concatenate(keys, axis=1).view(np.int64)
            at = np.arange(j - i + 1, dtype=np.int32) * keys.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel()))], names=["h", "keys"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, said) -> (key, kind, h): kind 0 the line, 1 without a character, 2 the same with its place."""
    for batch in batches:
        for i, j, off, data in tb.slices(batch.column(1), tb.SLICE_BYTES // 4):
            x = _Chars(data)
            first = x.count[off]
            row = np.repeat(np.arange(j - i), np.diff(first))
            c, d = x.at[:-1], x.at[1:]  # the bytes of each character
            a, b = off[:-1][row], off[1:][row]
            raw = (x.sums[c] - x.sums[a]) + (x.sums[b] - x.sums[d]) * x.down[d - c]
            less = tb.mix(raw * x.down[a] + (b - a - (d - c)).astype(np.uint64) * _SALT[0])
            full = x.part(off[:-1], off[1:], 0)
            place = np.arange(len(c)) - first[row]
            placed = tb.mix(less ^ tb.mix(place.astype(np.uint64) + _SALT[3]))
            # of a run of equal characters the deletions are one variant
            same = x.part(c, d, 0)
            once = np.concatenate(([True], (same[1:] != same[:-1]) | (row[1:] != row[:-1]))) if len(c) else np.zeros(0, bool)
            key = np.concatenate([full, less[once], placed])
            kind = np.repeat(np.array([0, 1, 2], np.int32), [len(full), int(once.sum()), len(placed)])
            own = pa.array(i + np.concatenate([np.arange(j - i), row[once], row]))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind), batch.column(0).take(own)], names=["key", "kind", "h"])


def _decide(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((id, k, n_lines) of every row of ``docs``, (i, k, dropped) of the documents with lines to drop)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("k"), text.alias("text"))
    every = scratch.write(texts.mapInArrow(_occurrences(min_chars), "h long, id long, k long, line int, halves array<long>"), "lines")
    place = F.struct(F.coalesce("id", F.lit(_NULL_ID)).alias("id"), "k", "line")
    said_at = every.filter("h is not null")
    firsts = said_at.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = scratch.write(firsts.select("h", "first", (F.col("first") != F.col("last")).alias("again")), "firsts")
    halves = said_at.select("h", F.explode("halves").alias("half")).groupBy("half").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("half")
    marks = spark.sparkContext.broadcast(filter_of(halves, HALF_BITS))
    open_ = scratch.write(said_at.select("h", "halves").mapInArrow(_open(marks), "h long").distinct(), "open")
    wanted = spark.sparkContext.broadcast(filter_of(open_, LINE_BITS))
    said = texts.select("text").mapInArrow(_texts(wanted), "h long, said string").groupBy("h").agg(F.first("said").alias("said"))
    said = scratch.write(said.join(open_, "h", "left_semi"), "said")
    outsides = said.mapInArrow(_outsides, "h long, keys array<long>").select("h", F.explode("keys").alias("key"))
    shared = outsides.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("key")
    near = outsides.join(shared, "key", "left_semi").select("h").distinct()
    near = scratch.write(said.join(near, "h").join(firsts, "h").select("h", "said", "first"), "near")
    scratch.drop("open", "said")
    variants = near.select("h", "said").mapInArrow(_variants, "key long, kind int, h long")
    # of the variants few have a partner
    shared = scratch.write(variants.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("key"), "shared")
    variants = scratch.write(variants.join(shared, "key", "left_semi").join(near.select("h", "first"), "h"), "variants")
    at = F.struct("first", "h")
    keys = variants.groupBy("key").agg(*(F.min(F.when(F.col("kind") == k, at)).alias(f"f{k}") for k in (0, 1, 2)))
    met = variants.join(keys, "key")
    other = F.when(F.col("kind") == 0, F.col("f1")).when(F.col("kind") == 1, F.col("f0")).otherwise(F.col("f2"))
    pairs = met.withColumn("o", other).filter("o.h <> h and o.first < first").select("h", F.col("o.h").alias("g")).distinct()
    pairs = pairs.join(near.select("h", "said"), "h").join(near.select(F.col("h").alias("g"), F.col("said").alias("other")), "g")
    close = pairs.filter(F.levenshtein("said", "other", 1) >= 0).select("h").distinct().withColumn("close", F.lit(True))
    # occurrences to drop: of lines near an earlier one all, of repeated lines all but the first
    again = firsts.join(close, "h", "left").filter("again or close").select("h", "first", F.coalesce("close", F.lit(False)).alias("close"))
    again = scratch.write(again, "again")
    scratch.drop("variants", "shared", "near", "firsts")
    gone = said_at.select("h", place.alias("at")).join(again, "h").filter("close or at > first").select("at.*")
    gone = scratch.write(gone.groupBy(F.col("id").alias("i"), "k").agg(F.array_sort(F.collect_set("line")).alias("dropped")), "gone")
    scratch.drop("again")
    return every.filter("h is null").select("id", "k", F.col("line").cast("long").alias("n_lines")), gone


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped): of each document the numbers of the lines to drop, in order."""
    rows, gone = _decide(docs, min_chars, id_col, text_col)
    gone = gone.withColumnRenamed("k", "j")
    out = rows.join(gone, (F.coalesce("id", F.lit(_NULL_ID)) == F.col("i")) & (F.col("k") == F.col("j")), "left")
    return out.select(F.col("id").alias("doc_id"), "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their own columns, their texts without the dropped lines."""
    _, gone = _decide(docs, min_chars, id_col, text_col)
    own, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    out = docs.join(gone, (F.coalesce(own, F.lit(_NULL_ID)) == gone.i) & (F.xxhash64(text) == gone.k), "left")
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone.dropped)
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    new = F.when(gone.dropped.isNull(), text).otherwise(kept)
    return out.select(*(new.alias(c) if c == text_col else docs[c] for c in docs.columns))
