"""N-gram Jaccard join, exact, by set relations.

A document's set holds its distinct k-word shingles.  Two sets link when
``den * |A n B| >= num * |A u B|``.  The result is one row per document with its component.

How the pairs stay few, without losing a link between different sets:

1. Equal sets collapse: everything after works on one row per distinct set.
2. Shingles are ordered rare-first.  The order comes from a counting sketch of all shingles of bounded
   size; any order common to all sets is exact, a rough one only costs time.  Linked sets share
   a shingle among the first ``n - ceil(t n) + 1`` of both (their prefixes).
3. Each prefix shingle has an index list.  Every set is first compared with up to three leaders of
   the lists it stands in.  A list's leader stands earliest in it, so has the fewest shingles of its
   own and is nearest to its group's centre.  The answers also give distances to leaders.  A second round takes other leaders and only lists
   that still hold several components, so that a group joins up in a few linear steps.
4. Index-list skipping.  A list is cut into blocks, one for each leader.  Blocks of one component
   need no comparison.  Two blocks are skipped by position and size, where too little can follow
   their earliest positions to reach the overlap, and by count, where they meet in too few lists: of
   two linked sets, prefixes share ``num * (m + n) / (num + den) - num * max(m, n) / den`` or more.
5. Answers from a similar set's answers.  For the blocks that remain, the leaders' own distance D is
   computed once.  A member at distance d of its leader can reach a member at distance e of the
   other only if ``D - d - e`` is within the bound, so most members follow from their leaders.
6. What is left is compared exactly, and links become components.

Defined cases: null or empty text, or text without words, has an empty set and links with nothing;
fewer than k words make one shingle of the whole sequence; equal texts share a component; rows with
a null id take part and get the smallest non-null id of their component, if any; no rows give none.
Shingles and sets are known by 64-bit and 128-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .bitmaps import filter_of, marked
from .components import components
from .scratch import Scratch, small

#: Cells of the counting sketch: about one for 16 shingles, as powers of two within these.
SKETCH_BITS = (20, 24)
CHUNKS = 64
#: Filters of fixed size: 8 MB for shingles that stand in two prefixes, 1 MB for sets to fetch.  A full one only costs time.
TOKEN_BITS = 26
SET_BITS = 23


def shingle_sets(offsets: np.ndarray, data: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    w = tb.words(offsets, data, tb.NOT_SPACE)
    g = tb.grams(w.hashes, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(tb.grams(w.hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in sets], np.int64)
    a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    if n.sum():
        flat = np.concatenate(sets)
        full = np.flatnonzero(n)
        at = np.concatenate(([0], np.cumsum(n[full])[:-1]))
        a[full] = tb.mix(np.add.reduceat(tb.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at) + n[full].astype(np.uint64))
        b[full] = tb.mix(np.add.reduceat(tb.mix(flat + np.uint64(0x14057B7EF767814F)), at))
    return n, a.view(np.int64), b.view(np.int64)


def _summary(k: int, bits: int):
    """(id, text, h) -> per document (id, n, sid, check, h); at the end of a task its share of the sketch, in packed pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            ids = batch.column(0)
            for i, j, off, data in tb.slices(batch.column(1)):
                sets = shingle_sets(off, data, k)
                n, sid, check = _fingerprints(sets)
                np.add.at(sketch, (np.concatenate(sets) & np.uint64(len(sketch) - 1)).astype(np.intp), np.uint32(1))
                none = pa.nulls(j - i, pa.int32())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n), pa.array(sid), pa.array(check), batch.column(2).slice(i, j - i), none, pa.nulls(j - i, pa.binary())], names=["id", "n", "sid", "chk", "h", "chunk", "counts"])
        if sketch.any():
            parts = [zlib.compress(np.minimum(p, 255).astype(np.uint8).tobytes(), 1) for p in np.split(sketch, CHUNKS)]  # over 255 in a task is common anyhow
            none = pa.nulls(CHUNKS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=["id", "n", "sid", "chk", "h", "chunk", "counts"])

    return run


def _rank_cells(bits: int, mean: float):
    """Of each sketch cell a rank: 0 for loads that chance explains, then one more for each doubling."""
    usual = mean + 4 * mean**0.5 + 4

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = np.zeros((1 << bits) // CHUNKS, np.uint64)
        for batch in batches:
            for x in batch.column(1):
                load += np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
        rank = np.clip(np.ceil(np.log2(np.maximum(load / usual, 1))), 0, 60).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(rank.tobytes(), 1)], pa.binary())], names=["chunk", "ranks"])

    return run


def _ranks(summary: DataFrame, bits: int) -> np.ndarray:
    """The rank of each cell: a byte each."""
    mean = (summary.agg(F.sum("n").alias("n")).first().n or 0) / (1 << bits)
    rows = summary.filter("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(_rank_cells(bits, mean), "chunk int, ranks binary").collect()
    out = np.zeros(1 << bits, np.uint8)
    width = len(out) // CHUNKS
    for r in rows:
        out[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(zlib.decompress(r.ranks), np.uint8)
    return out


def _prefixes(k: int, num: int, den: int, ranks_of):
    """Per document with shingles: sid, n and its prefix, rare-first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of.value
        mask = np.uint64(len(ranks) - 1)
        for batch in batches:
            for _, _, off, data in tb.slices(batch.column(1)):
                sets = [s for s in shingle_sets(off, data, k) if len(s)]
                n, sid, _ = _fingerprints(sets)
                once = _first_of_each(sid)
                sets, n, sid = [sets[i] for i in once], n[once], sid[once]
                heads = []
                for s in sets:
                    m = len(s) - -(-num * len(s) // den) + 1
                    heads.append(s[np.argsort(ranks[(s & mask).astype(np.int64)], kind="stable")[:m]])
                at = np.concatenate(([0], np.cumsum([len(h) for h in heads]))).astype(np.int32)
                flat = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(n), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], names=["sid", "n", "head"])

    return run


def _shared_lists(bloom):
    """(sid, n, head) -> (token, sid, n, pos) of the tokens that may stand in another prefix too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = batch.column(2)
            token = head.flatten().to_numpy()
            count = np.diff(head.offsets.to_numpy())
            pos = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)
            keep = np.flatnonzero(marked(bloom.value, token))
            row = np.repeat(np.arange(len(count)), count)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(pos[keep].astype(np.int64))], names=["token", "sid", "n", "pos"])

    return run


def _first_of_each(sid: np.ndarray) -> np.ndarray:
    return np.sort(np.unique(sid, return_index=True)[1])


def _chosen_sets(k: int, bloom):
    """(sid, set) of the documents whose sid may be wanted; the set as little-endian 64-bit hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, off, data in tb.slices(batch.column(1)):
                sets = [s for s in shingle_sets(off, data, k) if len(s)]
                _, sid, _ = _fingerprints(sets)
                keep = _first_of_each(sid)
                keep = keep[marked(bloom.value, sid[keep])]
                yield pa.RecordBatch.from_arrays([pa.array(sid[keep]), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["sid", "items"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, items of a, items of b) -> (a, b, na, nb, inter)."""
    for batch in batches:
        out, seen, last = [], None, None
        left, right = batch.column(2), batch.column(3)
        for i, b in enumerate(batch.column(1).to_pylist()):
            if b != seen:
                seen, last = b, np.frombuffer(right[i].as_buffer(), np.uint64)
            x = np.frombuffer(left[i].as_buffer(), np.uint64)
            small, big = (x, last) if len(x) <= len(last) else (last, x)
            at = np.minimum(np.searchsorted(big, small), len(big) - 1)
            out.append((len(x), len(last), int((big[at] == small).sum())))
        cols = np.array(out, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(cols[:, c]) for c in range(3))], names=["a", "b", "na", "nb", "inter"])


class _Sets:
    """Sets of the wanted documents.  Those not met before are fetched by one pass over the texts behind a filter of fixed size."""

    def __init__(self, texts: DataFrame, k: int, scratch: Scratch):
        self.texts, self.k, self.scratch, self.n = texts, k, scratch, 0
        self.known: list[DataFrame] = []

    def _all(self) -> DataFrame:
        out = self.known[0]
        for x in self.known[1:]:
            out = out.unionByName(x)
        return out

    def compare(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) -> the same with sizes and overlap, exact."""
        self.n += 1
        sc, tag = self.scratch, self.n
        pairs = sc.write(pairs.select("a", "b").distinct(), f"pairs{tag}")
        if pairs.isEmpty():
            return self.texts.sparkSession.createDataFrame([], "a long, b long, na long, nb long, inter long")
        want = pairs.select(F.col("a").alias("sid")).distinct().union(pairs.select("b").distinct()).distinct()
        if self.known:
            want = want.join(self._all().select("sid"), "sid", "left_anti")
        want = sc.write(want, f"want{tag}")
        if not want.isEmpty():
            bloom = self.texts.sparkSession.sparkContext.broadcast(filter_of(want, SET_BITS))
            found = self.texts.mapInArrow(_chosen_sets(self.k, bloom), "sid long, items binary").groupBy("sid").agg(F.first("items").alias("items"))
            self.known.append(sc.write(found.join(want, "sid", "left_semi"), f"sets{tag}", compression="none"))
        left = pairs.join(self._all().select(F.col("sid").alias("a"), F.col("items").alias("x")), "a")
        both = left.join(self._all().select(F.col("sid").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")
        out = sc.write(both.mapInArrow(_overlaps, "a long, b long, na long, nb long, inter long"), f"overlap{tag}")
        sc.drop(f"pairs{tag}", f"want{tag}")
        return out

    def drop(self) -> None:
        self.scratch.drop(*(f"{x}{i}" for x in ("sets", "overlap") for i in range(1, self.n + 1)))


def ngram_jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``docs``.

    ``component_id`` is the smallest id reachable by links.  With ``count_links`` also ``n_links``, the
    number of other rows that the row links with, equal sets and members of its component included.
    Components need few comparisons; counting compares all pairs of sets that prefixes leave open.
    """
    rows, classes = _classes(docs, k, num, den, id_col, text_col, count_links)
    out = rows.join(classes, (rows.sid == classes.sid) & (rows.n > 0), "left")
    more = [F.coalesce("links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), *more)


def _classes(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str, count_links: bool) -> tuple[DataFrame, DataFrame]:
    """((id, n, sid, h) of each row, (sid, root, least) of each set with more than one row or with links)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    hashed = texts.withColumn("h", F.xxhash64("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    bits = min(max(int(np.ceil(np.log2(size / 6 / 16 + 1))), SKETCH_BITS[0]), SKETCH_BITS[1])
    summary = scratch.write(hashed.mapInArrow(_summary(k, bits), "id long, n long, sid long, chk long, h long, chunk int, counts binary"), "summary")
    ranks = spark.sparkContext.broadcast(_ranks(summary, bits))  # a byte a cell, 16 MB at most whatever the input
    rows = summary.filter("chunk is null").select("id", "n", "sid", "h")
    heads = texts.mapInArrow(_prefixes(k, num, den, ranks), "sid long, n long, head array<long>")
    heads = scratch.write(heads.groupBy("sid").agg(F.first("n").alias("n"), F.first("head").alias("head")), "heads")
    twice = heads.select(F.explode("head").alias("token")).groupBy("token").count().filter("count > 1").select("token")
    bloom = spark.sparkContext.broadcast(filter_of(twice, TOKEN_BITS))
    lists = scratch.write(heads.mapInArrow(_shared_lists(bloom), "token long, sid long, n long, pos long"), "lists_all")
    lists = scratch.write(lists.join(lists.groupBy("token").count().filter("count > 1"), "token").select("token", "sid", "n", "pos"), "lists")
    # lists that two linked sets share at least, from their sizes
    need = lambda m, n, low, high: f"({num} * ({m} + {n}) / {num + den}.0D - {num} * greatest({low}, {high}) / {den}.0D)"
    scratch.drop("lists_all", "heads")
    sets = _Sets(texts, k, scratch)
    enough = f"inter * {num + den} >= {num} * (na + nb)"  # den * inter >= num * (na + nb - inter)

    if count_links:
        of = lambda s: lists.select("token", *(F.col(c).alias(f"{c}{s}") for c in ("sid", "n", "pos")))
        pairs = of("x").join(of("y"), "token").filter(f"sidx < sidy and {num} * nx <= {den} * ny and {num} * ny <= {den} * nx")
        room = F.max(F.expr(f"least(nx - posx, ny - posy) * {num + den} >= {num} * (nx + ny)"))
        pairs = pairs.groupBy("sidx", "sidy").agg(room.alias("room")).filter("room").select(F.col("sidx").alias("a"), F.col("sidy").alias("b"))
        every = sets.compare(pairs).filter(enough).select("a", "b")
        every = scratch.write(every.unionByName(every.select(F.col("b").alias("a"), F.col("a").alias("b"))), "every")

    def star(members: DataFrame, seeds: tuple[int, ...]) -> DataFrame:
        """Pairs of a set and up to three leaders of other components, those it shares most lists with."""
        lead = members.groupBy("token").agg(*(F.min(F.struct("pos", F.xxhash64("sid", F.lit(x)).alias("h"), "sid", "n", "root")).alias(f"l{x}") for x in seeds))
        lead = lead.select("token", F.array_distinct(F.array(*(F.struct(f"l{x}.sid", f"l{x}.n", f"l{x}.root") for x in seeds))).alias("lead"))
        met = members.join(lead, "token").select("sid", "n", "root", F.explode("lead").alias("l"))
        met = met.filter(f"root <> l.root and {num} * n <= {den} * l.n and {num} * l.n <= {den} * n")
        met = met.groupBy("sid", F.col("l.sid").alias("b")).agg(F.count("*").alias("c"), F.max("n").alias("n"), F.max("l.n").alias("ln"))
        # half of the lists is enough, where some may have another leader
        met = met.filter(f"2 * c >= {need('n', 'ln', 'n', 'ln')}").groupBy("sid").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "b")), False), 1, 3).alias("m"))
        return met.select(F.col("sid").alias("a"), F.explode("m.b").alias("b"))

    links = sets.compare(star(lists.withColumn("root", F.col("sid")), (1, 2, 3))).filter(enough)
    root = scratch.write(components(links.select("a", "b"), scratch, "cc0"), "root0")
    rooted = lists.join(root.withColumnRenamed("v", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    mixed = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("token")
    rooted = scratch.write(rooted.join(mixed, "token", "left_semi"), "rooted")
    links = links.unionByName(sets.compare(star(rooted, (4, 5, 6))).filter(enough))
    root = scratch.write(components(links.select("a", "b"), scratch, "cc1"), "root1")

    # blocks of a list: by the leader that a member is near to, with its distance
    own = links.select("a", "b", "na", "nb", "inter").unionByName(links.select(F.col("b").alias("a"), F.col("b"), "nb", F.col("nb").alias("na"), F.col("nb").alias("inter")))
    own = own.groupBy("a").agg(F.min(F.struct(F.expr("na + nb - 2 * inter").alias("far"), "b")).alias("p"))
    own = own.select(F.col("a").alias("sid"), F.col("p.b").alias("pivot"), F.col("p.far").alias("far"))
    known = root.select(F.col("v").alias("sid"), "root").join(own, "sid", "left")
    members = rooted.select("token", "sid", "n", "pos").join(known, "sid", "left").select(
        "token", "sid", "n", "pos", F.coalesce("root", "sid").alias("root"), F.coalesce("pivot", "sid").alias("pivot"), F.coalesce("far", F.lit(0)).alias("far"))
    mixed = members.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("token")
    members = scratch.write(members.join(mixed, "token", "left_semi"), "members")
    scratch.drop("lists", "rooted", "root0")
    blocks = scratch.write(members.groupBy("token", "pivot").agg(F.min("root").alias("root"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("pos").alias("p0"), F.max(F.expr("n - pos")).alias("rest"), F.max("far").alias("far")), "blocks")
    side = lambda s: blocks.select("token", *(F.col(c).alias(f"{c}{s}") for c in ("pivot", "root", "n0", "n1", "p0", "rest", "far")))
    # the least overlap that the smallest sizes ask for, against the most that can follow the earliest positions
    room = F.expr(f"least(restx, resty) * {num + den} >= {num} * (n0x + n0y)")
    pairs = side("x").join(side("y"), "token").filter(f"rootx <> rooty and pivotx < pivoty and {num} * n0x <= {den} * n1y and {num} * n0y <= {den} * n1x")
    pairs = pairs.groupBy("pivotx", "pivoty").agg(F.count("*").alias("c"), F.max(room).alias("room"), F.max("rootx").alias("rootx"), F.max("rooty").alias("rooty"), *(F.min(f"n0{x}").alias(f"n0{x}") for x in "xy"), *(F.max(f"{c}{x}").alias(f"{c}{x}") for c in ("n1", "far") for x in "xy"))
    pairs = pairs.filter(f"room and c >= {need('n0x', 'n0y', 'n1x', 'n1y')}").select("pivotx", "pivoty", "rootx", "rooty", "n1x", "n1y", "farx", "fary")
    pairs = scratch.write(pairs, "blockpairs")
    apart = sets.compare(pairs.select(F.col("pivotx").alias("a"), F.col("pivoty").alias("b")))
    gap = apart.select(F.col("a").alias("pivotx"), F.col("b").alias("pivoty"), F.expr("na + nb - 2 * inter").alias("gap"), F.expr(enough).alias("hit"))
    direct = apart.filter(enough).select("a", "b")

    # members of two blocks whose leaders' distance leaves room: |x ^ y| <= (den - num) * (|x| + |y|) / (den + num).
    # First each side alone, against the farthest and largest member of the other; then both.
    reach = lambda m, n, size: f"(gap - {m} - {n}) * {num + den} <= {den - num} * ({size})"
    open_ = pairs.join(gap.filter("not hit"), ["pivotx", "pivoty"]).filter(reach("farx", "fary", "n1x + n1y"))
    # blocks of components that another pair of leaders has linked need nothing more
    ends = (F.least("rootx", "rooty"), F.greatest("rootx", "rooty"))
    met = pairs.join(gap.filter("hit"), ["pivotx", "pivoty"]).select(ends[0].alias("r1"), ends[1].alias("r2")).distinct()
    open_ = open_.join(met, (ends[0] == F.col("r1")) & (ends[1] == F.col("r2")), "left_anti")
    own = members.select("pivot", "sid", "n", "far").distinct()
    alone = lambda s, t: open_.join(own.select(*(F.col(c).alias(f"{c}{s}_") for c in ("pivot", "sid", "n", "far"))), F.expr(f"pivot{s} = pivot{s}_ and " + reach(f"far{s}_", f"far{t}", f"n{s}_ + n1{t}"))).select(
        "pivotx", "pivoty", "gap", f"sid{s}_", f"n{s}_", f"far{s}_")
    both = alone("x", "y").join(alone("y", "x").drop("gap"), ["pivotx", "pivoty"]).filter(
        f"{num} * nx_ <= {den} * ny_ and {num} * ny_ <= {den} * nx_ and (sidx_ <> pivotx or sidy_ <> pivoty) and " + reach("farx_", "fary_", "nx_ + ny_"))
    meet = both.select(F.least("sidx_", "sidy_").alias("a"), F.greatest("sidx_", "sidy_").alias("b"))
    more = sets.compare(meet)
    all_links = links.select("a", "b").unionByName(direct).unionByName(more.filter(enough).select("a", "b"))
    all_links = scratch.write(all_links.distinct(), "links")
    root = scratch.write(components(all_links, scratch, "cc2"), "root2")
    scratch.drop("members", "blocks", "blockpairs", "root1")
    sets.drop()

    sids = rows.filter("n > 0").groupBy("sid").agg(F.min("id").alias("id"))
    linked = root.withColumnRenamed("v", "sid").join(sids, "sid")
    lowest = linked.groupBy("root").agg(F.min("id").alias("least"))
    # a class for each set with more than one row or with links; other rows are their own
    multi = rows.filter("n > 0").groupBy("sid").agg(F.min("id").alias("id"), F.count("*").alias("c"))
    classes = multi.join(root.withColumnRenamed("v", "sid").join(lowest, "root", "left").select("sid", "root", "least"), "sid", "left")
    if count_links:
        others = every.join(multi.select(F.col("sid").alias("b"), "c"), "b").groupBy(F.col("a").alias("sid")).agg(F.sum("c").alias("links"))
        classes = classes.join(others, "sid", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("c") - 1)
    classes = classes.filter("c > 1 or root is not null").select("sid", F.coalesce("root", "sid").alias("root"), F.coalesce("least", "id").alias("least"), *(["links"] if count_links else []))
    return rows, scratch.write(classes, "classes")


def keep_one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their own columns, one of each component: that of the smallest id, a null id last.

    Documents are known by id and text: of rows equal in both one is kept, rows of one id and other texts
    are judged each for itself, and where a component's smallest id has several texts, that of the
    smallest text hash is kept.  Documents without words are in no component: all their rows are kept.
    """
    scratch = Scratch(docs.sparkSession, "distinct")  # winners and losers as pairs of numbers
    rows, classes = _classes(docs, k, num, den, id_col, text_col, False)
    in_class = rows.filter("n > 0").join(classes.select("sid", "root"), "sid").select("root", "id", "h")
    first = in_class.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("f"))
    first = scratch.write(first, "first")
    own = in_class.join(small(first, first.count()), "root").select("id", "h", ((F.col("id").eqNullSafe(F.col("f.id"))) & (F.col("h") == F.col("f.h"))).alias("stays"))
    own = scratch.write(own.groupBy("id", "h").agg(F.max("stays").alias("stays"), F.count("*").alias("c")).filter("not stays or c > 1"), "own")
    drop = own.filter("not stays").select(F.coalesce("id", F.lit(0)).alias("_i"), F.col("id").isNull().alias("_n"), F.col("h").alias("_h"))
    again = own.filter("stays").select(F.coalesce("id", F.lit(0)).alias("_i"), F.col("id").isNull().alias("_n"), F.col("h").alias("_h"))
    i, h = docs[id_col].cast("long"), F.xxhash64(docs[text_col].cast("string"))
    is_ = lambda d: (F.coalesce(i, F.lit(0)) == d._i) & (i.isNull() == d._n) & (h == d._h)
    kept = docs.join(small(drop, drop.count()), is_(drop), "left_anti")
    n = again.count()
    if not n:
        return kept
    return kept.join(small(again, n), is_(again), "left_anti").unionByName(kept.join(small(again, n), is_(again), "left_semi").dropDuplicates([id_col, text_col]))
