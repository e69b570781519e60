"""Mixing sources to target weights by temperature.

Source token shares p become weights proportional to ``p ** exponent``.  The exponent, in [0, 1], is
bisected to the flattest mix within a repetition limit (tokens drawn from a source over its tokens), or
to a target entropy.  A token budget then gives each source a number of epochs.

Draws: every document gets the whole epochs of its source; for the fraction left, documents are taken
in the order of a keyed hash until the tokens are spent.  The cut in that order is found by digits: 
sums of 1024 hash ranges, then of the range that holds the cut, and so on.  These are aggregates that
combine before the shuffle, so a source of any size is never in one task.

The draws are dealt to blocks of about ``block_tokens`` by another keyed hash of document, copy and
seed, so every block holds all sources in proportion and a copy stands apart from the next; the order
of the hash within a block is a permutation (``slot``).

Tokens are words.  Defined cases: null text has no tokens; documents of no tokens come with the whole
epochs, once at least; a null source is a source; equal ids of equal text are drawn alike; one source keeps all; an
empty table gives no rows; a very long text is a slice of its own; columns of any name stay as they are.
A limit that no exponent meets, and no limit at all, raise ``ValueError``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbatch as tb
from .scratch import Scratch, fresh, small

DIGIT = 10
LEVELS = 6


def weights_at(shares: np.ndarray, exponent: float) -> np.ndarray:
    w = np.where(shares > 0, np.maximum(shares, 1e-300) ** exponent, 0.0)
    return w / w.sum()


def entropy(w: np.ndarray) -> float:
    return float(-(w[w > 0] * np.log(w[w > 0])).sum())


def find_exponent(tokens: np.ndarray, budget: float | None = None, max_repeats: float | None = None, target_entropy: float | None = None) -> float:
    """The exponent in [0, 1].  Smaller is flatter: entropy falls and the largest repetition falls as it grows.

    target_entropy: the exponent whose weights have it (0 or 1 where it is out of reach).
    max_repeats: the smallest exponent with at most so many repetitions; the budget defaults to the
    smallest that uses every source once.
    """
    if target_entropy is None and max_repeats is None:
        raise ValueError("give max_repeats or target_entropy")
    shares = tokens / tokens.sum()

    def fits(x: float) -> bool:
        w = weights_at(shares, x)
        if target_entropy is not None:
            return entropy(w) <= target_entropy
        total = budget if budget is not None else full_budget(tokens, w)
        used = tokens > 0
        return bool((w[used] * total / tokens[used]).max() <= max_repeats * (1 + 1e-12))

    if fits(0.0):
        return 0.0
    if target_entropy is None and not fits(1.0):
        raise ValueError("no exponent up to 1 keeps to max_repeats at this budget")
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def full_budget(tokens: np.ndarray, weights: np.ndarray) -> float:
    """The smallest budget in which no source loses a token."""
    used = tokens > 0
    return float((tokens[used] / weights[used]).max())


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [np.diff(tb.words(off, data, tb.NOT_SPACE, None).first) for _, _, off, data in tb.slices(batch.column(3))]
        n = np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n)], names=["doc_id", "source", "h", "tokens"])


def _cuts(rows: DataFrame, want: dict) -> dict:
    """For each source the largest hash bound such that rows below it hold at most the wanted tokens.

    rows: (source, h as 60 bits, tokens).  want: source -> tokens.
    """
    spark = rows.sparkSession
    low, left = {s: 0 for s in want}, dict(want)
    for level in range(LEVELS):
        shift = DIGIT * (LEVELS - 1 - level)
        at = spark.createDataFrame([(s, b) for s, b in low.items()], "source string, low long")
        own = rows.join(small(at, len(low)), rows.source.eqNullSafe(at.source)).select(rows.source, "h", "tokens", "low")
        own = own.filter(F.expr(f"shiftright(h, {shift + DIGIT}) = shiftright(low, {shift + DIGIT})"))
        sums = own.groupBy("source", F.expr(f"shiftright(h, {shift}) & {(1 << DIGIT) - 1}").alias("d")).agg(F.sum("tokens").alias("t")).collect()  # 1024 for each source at most
        by: dict = {}
        for r in sums:
            by.setdefault(r.source, {})[r.d] = r.t
        for s in low:
            digit = 0
            for d in range(1 << DIGIT):
                t = by.get(s, {}).get(d, 0)
                digit = d
                if t > left[s]:
                    break
                left[s] -= t
            else:
                digit = 1 << DIGIT  # all of it fits
            low[s] += digit << shift
            if digit == 1 << DIGIT:
                left[s] = -1  # the bound is past this range: lower digits are 0
    return low


def mix_sources(docs: DataFrame, budget: float | None = None, max_repeats: float | None = 4.0, target_entropy: float | None = None, block_tokens: int = 1 << 20, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, text_hash, source, tokens, copy, weight, block, slot): one row for each draw of a document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sizes = _token_table(docs, scratch, seed, id_col, text_col, source_col)
    plan = plan_mix(sizes, budget, max_repeats, target_entropy)
    drawn = _draws(sizes, plan, spark)
    total = sum(p["tokens"] * p["epochs"] for p in plan.values())
    blocks = max(1, round(total / block_tokens))
    u = F.pmod(F.xxhash64("doc_id", "h", "copy", F.lit(seed + 1)), F.lit(1 << 52))
    drawn = drawn.withColumn("u", u).withColumn("block", F.floor(F.col("u") / (1 << 52) * blocks).cast("int"))
    order = Window.partitionBy("block").orderBy("u", "doc_id", "copy")
    return drawn.withColumn("slot", F.row_number().over(order).cast("long") - 1).select("doc_id", F.col("h").alias("text_hash"), "source", "tokens", "copy", "weight", "block", "slot")


def _token_table(docs: DataFrame, scratch: Scratch, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), draw_hash(id_col, text_col, seed).alias("h"), F.col(text_col).cast("string").alias("text"))
    return scratch.write(own.mapInArrow(_sizes, "doc_id long, source string, h long, tokens long"), "sizes")


def draw_hash(id_col: str, text_col: str, seed: int):
    """60 bits that order a source's documents; equal ids of equal text are equal."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.lit(seed)), F.lit(1 << (DIGIT * LEVELS)))


def plan_mix(sizes: DataFrame, budget: float | None, max_repeats: float | None, target_entropy: float | None) -> dict:
    """source -> its tokens, weight, epochs and the hash bound of the part epoch."""
    rows = sizes.groupBy("source").agg(F.sum("tokens").alias("t")).collect()
    names, tokens = [r.source for r in rows], np.array([float(r.t) for r in rows])
    if not tokens.sum():
        return {s: {"tokens": 0.0, "weight": 1.0 / len(names), "epochs": 1.0, "whole": 1, "bound": 0} for s in names}
    exponent = find_exponent(tokens, budget, max_repeats, target_entropy)
    w = weights_at(tokens / tokens.sum(), exponent)
    total = budget if budget is not None else full_budget(tokens, w)
    out, want = {}, {}
    for s, t, x in zip(names, tokens.tolist(), w.tolist()):
        epochs = x * total / t if t else 1.0
        whole = math.floor(epochs + 1e-9)
        out[s] = {"tokens": t, "weight": x, "epochs": epochs, "whole": whole, "bound": 0}
        want[s] = math.floor((epochs - whole) * t + 1e-6) if t else 0
    for s, bound in _cuts(sizes, {s: n for s, n in want.items() if n > 0}).items():
        out[s]["bound"] = bound
    return out


def _draws(sizes: DataFrame, plan: dict, spark) -> DataFrame:
    """sizes with ``weight`` and one row for each ``copy``."""
    at = spark.createDataFrame([(s, p["weight"], p["whole"], p["bound"]) for s, p in plan.items()], "s string, weight double, whole long, bound long")
    own = sizes.join(small(at, len(plan)), sizes.source.eqNullSafe(at.s))
    n = F.greatest(F.col("whole"), (F.col("tokens") == 0).cast("long")) + ((F.col("h") < F.col("bound")) & (F.col("tokens") > 0)).cast("long")
    own = own.withColumn("copies", n).filter("copies > 0")
    return own.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1))).drop("s", "whole", "bound", "copies")


def mixed_documents(docs: DataFrame, budget: float | None = None, max_repeats: float | None = 2.0, target_entropy: float | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents themselves, each as often as it is drawn, with their own columns."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    plan = plan_mix(_token_table(docs, scratch, seed, id_col, text_col, source_col), budget, max_repeats, target_entropy)
    scratch.drop("sizes")
    if not plan:
        return docs
    name, whole, part, copy = fresh(docs, "_s", "_whole", "_bound", "_copy")
    at = spark.createDataFrame([(s, p["whole"], p["bound"]) for s, p in plan.items()], f"{name} string, {whole} long, {part} long")
    own = docs.join(small(at, len(plan)), docs[source_col].cast("string").eqNullSafe(at[name]))
    blank = ~F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    n = F.greatest(F.col(whole), blank.cast("long")) + ((draw_hash(id_col, text_col, seed) < F.col(part)) & ~blank).cast("long")
    own = own.withColumn(copy, F.explode(F.array_repeat(F.lit(0), n.cast("int"))))
    return own.select(*(F.col(f"`{c}`") for c in docs.columns))
