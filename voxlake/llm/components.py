"""Connected components of an undirected edge table, distributed.

Alternates the two star steps (every vertex hooks its larger, then its smaller neighbours to its
smallest neighbour).  The edge count never grows, a hot vertex is met by aggregates that combine
before the shuffle and by joins that AQE can split, and the number of rounds is logarithmic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    """A count and two 64-bit digests of the edges."""
    return tuple(edges.agg(F.count("*"), *(F.bit_xor(F.xxhash64("u", "v", F.lit(x))) for x in (1, 2))).first())


def components(edges: DataFrame, scratch: Scratch, tag: str, max_rounds: int = 200) -> DataFrame:
    """edges (a long, b long) -> (v long, root long): each vertex with an edge and the smallest vertex it reaches.

    Self-edges and repeated edges add nothing.  No edges: no rows.
    """
    now = scratch.write(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct(), f"{tag}_0")
    size = _state(now)
    for i in range(1, max_rounds):
        both = now.select("v", "u").unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.filter("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*").filter("v <> u").distinct()
        now = scratch.write(small, f"{tag}_{i}")
        scratch.drop(f"{tag}_{i - 1}")
        last, size = size, _state(now)
        if last == size:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.groupBy("v").agg(F.min("u").alias("root")).unionByName(now.select(F.col("u").alias("v"), F.col("u").alias("root")).distinct())
