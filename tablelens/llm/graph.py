"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """u and the smallest of u and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (u, root): every vertex but the root of each component, once.

    The root is the smallest vertex.  A round ties each vertex's larger
    neighbours to its smallest one, then its smaller neighbours; the number of
    rounds grows with the logarithm of the longest path.  Only sums over the
    table come to the driver, to see that a round changed nothing.  Links to
    itself and NULLs are ignored; an empty table gives an empty result.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
              .filter(F.col("u") > F.col("v")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_least_neighbour(both), "u").filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = large.join(_least_neighbour(large), "u")
        now = cut(small.filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                  .unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        was, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == state:
            return now.select("u", F.col("v").alias("root"))
