"""Connected components of an edge table, as alternating star contractions.

Each round is two aggregates and joins over the remaining edges and is written to the
shared folder, so a lost executor costs one round at most; nothing goes to the driver but
a row of counts. Hubs are met by partial ``min`` aggregates and by plain equi-joins,
which Spark splits when one key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link every larger neighbour to the smallest one. Small star: the same
    for the smaller neighbours and the node itself."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where(F.col("v") <= F.col("u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        out = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (both.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionAll(low.select("u", F.col("m").alias("v"))))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(u, v)`` edges of any comparable key -> ``(node, root)``, root the smallest key of
    the component; nodes without an edge, self links and null ends do not appear."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = stored(e.where("u is not null and v is not null and u != v").distinct())
    last = None
    for _ in range(max_rounds):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or (now[0], now[1]) == last:
            break
        last = (now[0], now[1])
        e = stored(_star(_star(e, large=True), large=False))
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
