"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.functions.shared import cut


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
    return row["n"], row["h"] or 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node with an edge except the roots themselves; root is the smallest node of its component.

    edges: columns u, v (long). Null ends and loops are ignored, repeated edges count once, an empty table gives an
    empty result. Each round is two joins of the edge table with its per-node minimum (a map-side combined
    aggregate, so a hub's edges collapse before the shuffle; a hub's join rows are split by AQE), then a reliable
    checkpoint. The rounds needed grow with the logarithm of the longest chain.
    """
    u, v = F.col("u"), F.col("v")
    now = cut(edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(v != F.col("m")).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(after)
        now = after
        if mark == before:
            break
    else:
        raise RuntimeError(f"components still changing after {max_rounds} rounds")
    return now.select(u.alias("node"), v.alias("root"))
