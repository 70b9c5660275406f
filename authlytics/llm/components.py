"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations by node (combined on the map side) and two joins that
adaptive execution can split, so a node with very many links is no hot task. A round's
links are written to the shared checkpoint folder. Rounds end when the links no longer
change; their number grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """``edges``: columns a, b (long). Returns (node, root): the smallest node reachable
    from every node that reaches a smaller one (a root has no row of its own). Null ends
    and loops are no links; no links give no rows."""
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
               .where("a > b").distinct(), f"{name}-0", small=True)
    state, k = _state(e), 0
    while True:
        k += 1
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(e.distinct(), f"{name}-{k}l", small=True)
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = (e.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
             .unionByName(low.select("a", F.col("m").alias("b"))))
        e = stored(e.distinct(), f"{name}-{k}s", small=True)
        now = _state(e)
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
