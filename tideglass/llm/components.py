"""Connected components of a link table by alternating large-star and small-star steps.

Nothing is collected but two sums per round.  Each round is cut by a written
table, so a lost executor costs one round.  A node's neighbours are reduced by
a map-side-combined minimum and joined back, never gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b): a > b.  One step; again a > b, distinct."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:  # neighbours above the node hang on the least of its neighbourhood
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # the node and its neighbours below hang on the least of them
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of any ids -> (node, component): one row per linked node; component is its least reachable id."""
    at = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = state(at)
    while before[0]:
        after = written(_star(_star(at, True), False))
        forget(at)
        at, now = after, state(after)
        if now == before:
            break
        before = now
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
