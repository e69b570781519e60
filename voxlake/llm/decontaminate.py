"""Benchmark decontamination by winnowing.

Words are lower-cased (A-Z only) runs of ASCII letters, digits and non-ASCII bytes.  A window is 13
consecutive words of an item; an item of fewer words, but not none, is one window of its own length.

Of every text the hashes of its 5-word grams are taken, and of each sliding window of 9 such hashes
the smallest is kept (winnowing).  A shared span of 13 words holds the same 9 grams on both sides, so
both keep the same smallest one: every shared window has a common fingerprint.  Windows of fewer words
fingerprint as their own single gram.

Both sides become rows.  Of documents, one scan keeps what passes a filter of fixed size of the
benchmark's fingerprints, extended to the windows around it; these meet the benchmark's windows in a
join by hash.  What meets is merged to spans and items of each text by aggregates.  Nothing of either
side is collected, and the benchmark may be of any size.

Defined cases: null or wordless text has no words and is clean; wordless items have no windows; null
item ids and repeated items count as one item for each distinct id, a null id as the empty string;
empty tables give no rows or no hits; repeated documents are judged each for itself; a very long text is
a slice of its own.  Columns of other names, and of any clashing name, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .bitmaps import filter_of, marked
from .scratch import Scratch, small

WINDOW = 13
GRAM = 5
#: The filter of fingerprints and windows: 8 MB whatever the benchmark.  A full one only costs time.
FILTER_BITS = 26
#: Hits are broadcast up to so many rows, of about 100 bytes each.
MOST_HITS = 200_000


def winnow(g: np.ndarray, span: int) -> np.ndarray:
    """Positions of the fingerprints: in each run of ``span`` hashes the smallest, the rightmost of equals."""
    if len(g) < span:
        return np.zeros(0, np.int64)
    best, at = g[: len(g) - span + 1].copy(), np.arange(len(g) - span + 1)
    for i in range(1, span):
        other = g[i : len(g) - span + 1 + i]
        take = other <= best
        best[take] = other[take]
        at[take] = np.flatnonzero(take) + i
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) -> (m, h, item): the windows of m words of each item, and its fingerprints as m = 0."""
    for batch in batches:
        for i, _, off, data in tb.slices(batch.column(1)):
            w = tb.words(off, data, tb.ALNUM)
            for d, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                if a == b:
                    continue
                m = min(WINDOW, b - a)
                h, prints = tb.distinct(tb.grams(w.hashes[a:b], m)), np.zeros(0, np.uint64)
                if m == WINDOW:
                    g = tb.grams(w.hashes[a:b], GRAM)
                    prints = tb.distinct(g[winnow(g, WINDOW - GRAM + 1)])
                kind = np.repeat(np.array([m, 0], np.int32), [len(h), len(prints)])
                own = batch.column(0).take(pa.array(np.full(len(kind), i + d)))
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([h, prints]).view(np.int64)), own], names=["m", "h", "item"])


def candidate_windows(w: tb.Words, lengths: list[int], packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, hash) of the windows of a slice that the filter lets pass, none across documents."""
    at, size, hashes, n_words = [], [], [], len(w.hashes)
    end_of = np.repeat(w.first[1:], np.diff(w.first))
    for m in lengths:
        if n_words < m:
            continue
        if m == WINDOW:
            g = tb.grams(w.hashes, GRAM)
            prints = winnow(g, WINDOW - GRAM + 1)
            prints = prints[marked(packed, g[prints].view(np.int64))]
            near = tb.distinct((prints[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
            near = near[(near >= 0) & (near + WINDOW <= n_words)]
            if not len(near):
                continue
            h = tb.grams(w.hashes, WINDOW)[near] if len(near) * 4 > n_words else tb.grams(w.hashes[near[:, None] + np.arange(WINDOW)].T.copy(), WINDOW)[0]
        else:
            h = tb.grams(w.hashes, m)
            near = np.arange(len(h))
        keep = np.flatnonzero(marked(packed, h.view(np.int64)))
        keep = keep[near[keep] + m <= end_of[near[keep]]]
        at.append(near[keep])
        size.append(np.full(len(keep), m, np.int32))
        hashes.append(h[keep])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    at, size, hashes = np.concatenate(at), np.concatenate(size), np.concatenate(hashes)
    order = np.argsort(at, kind="stable")
    return at[order], size[order], hashes[order]


_WINDOW_TYPE = pa.struct([("at", pa.int64()), ("m", pa.int32()), ("h", pa.int64())])


def _scan(bloom, lengths: list[int], every: bool):
    """(id, k1, k2, text) -> (id, k1, k2, n_words, windows) of every text, or of those with windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, off, data in tb.slices(batch.column(3)):
                w = tb.words(off, data, tb.ALNUM)
                at, m, h = candidate_windows(w, lengths, bloom.value)
                cut = np.searchsorted(at, w.first)
                at = at - np.repeat(w.first[:-1], np.diff(cut))
                windows = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.StructArray.from_arrays([pa.array(at), pa.array(m), pa.array(h.view(np.int64))], fields=list(_WINDOW_TYPE)))
                cols = [*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array(np.diff(w.first).astype(np.int64)), windows]
                out = pa.RecordBatch.from_arrays(cols, names=["id", "k1", "k2", "n_words", "windows"])
                yield out if every else out.filter(pa.array(np.diff(cut) > 0))

    return run


def _hits(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, every: bool, id_col: str | None, text_col: str, item_col: str) -> tuple[DataFrame, DataFrame]:
    """(scanned texts, (k1, k2, n_hit, n_full, n_items, items_sha256) of each text with a hit); n_full counts windows of 13 words."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).filter("text is not null")
    bench = scratch.write(items.mapInArrow(_item_rows, "m int, h long, item string").distinct(), "bench")
    lengths = sorted(r.m for r in bench.filter("m > 0").select("m").distinct().collect())  # 13 numbers at most
    bloom = spark.sparkContext.broadcast(filter_of(bench.select("h"), FILTER_BITS))
    own = docs.select((F.col(id_col) if id_col else F.lit(None)).cast("long").alias("id"), *text_key(text_col), F.col(text_col).cast("string").alias("text"))
    scanned = scratch.write(own.mapInArrow(_scan(bloom, lengths, every), "id long, k1 long, k2 int, n_words long, windows array<struct<at:long,m:int,h:long>>"), "scanned")
    # equal texts have equal hits, so one of them is enough
    texts = scanned.filter("size(windows) > 0").select("k1", "k2", F.explode("windows").alias("w")).select("k1", "k2", "w.*").distinct()
    # each hash of the benchmark once, so that no window of a document is multiplied by items
    known = scratch.write(bench.filter("m > 0").select("m", "h").distinct(), "known")
    met = scratch.write(texts.join(small(known, known.count(), MOST_HITS), ["m", "h"]), "met")
    # the union of a text's windows, from left to right
    step = lambda s, x: F.struct(F.greatest(s.stop, x.at + x.m).alias("stop"), (s.n + F.greatest(F.lit(0), x.at + x.m - F.greatest(s.stop, x.at))).alias("n"))
    start = F.struct(F.lit(0).cast("long").alias("stop"), F.lit(0).cast("long").alias("n"))
    spans = met.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("w"), F.count(F.when(F.col("m") == WINDOW, 1)).alias("n_full"))
    spans = spans.select("k1", "k2", "n_full", F.aggregate("w", start, step, lambda s: s.n).alias("n_hit"))
    names = bench.filter("m > 0")
    found = met.select("k1", "k2", "m", "h").distinct().join(small(names, names.count(), MOST_HITS), ["m", "h"])
    found = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = found.select("k1", "k2", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    hits = scratch.write(spans.join(found, ["k1", "k2"]), "hits")
    scratch.drop("met", "bench", "known")
    return scanned, hits


def text_key(text_col: str) -> tuple:
    """Two hashes by which equal texts meet."""
    text = F.col(text_col).cast("string")
    return F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document: words, words hit, items with occurring windows and their digest, and the verdict.

    A document is contaminated when it has hits and ``20 * n_hit >= n_words``.
    """
    scratch = Scratch(docs.sparkSession, "benchmark")
    scanned, hits = _hits(docs, benchmark, scratch, True, id_col, text_col, item_col)
    out = scanned.select(F.col("id").alias("doc_id"), "n_words", "k1", "k2").join(small(hits, hits.count(), MOST_HITS), ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.05, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents that hold no benchmark passage, with all their own columns.

    A whole window of 13 words is a passage.  Items of fewer words may stand in a text by chance: their
    hits count where they are ``share`` of its words.
    """
    scratch = Scratch(docs.sparkSession, "benchmark")
    scanned, hits = _hits(docs, benchmark, scratch, False, None, text_col, item_col)
    sizes = scanned.groupBy("k1", "k2").agg(F.max("n_words").alias("n_words"))
    bad = hits.join(sizes, ["k1", "k2"]).filter((F.col("n_full") > 0) | (F.col("n_hit") >= share * F.col("n_words"))).select(F.col("k1").alias("a"), F.col("k2").alias("b"))
    bad = scratch.write(bad, "bad")
    scratch.drop("scanned", "hits")
    bad = small(bad, bad.count())
    k1, k2 = (F.xxhash64(docs[text_col].cast("string")), F.hash(docs[text_col].cast("string")))
    return docs.join(bad, (k1 == bad.a) & (k2 == bad.b), "left_anti")
