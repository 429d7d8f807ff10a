"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregations and two joins over edges; the number of rounds grows with the logarithm of
the longest path. A hub's edges are only ever aggregated with map-side minima or joined to its one row, which
the planner's skew join splits. Rounds are written to the shared work folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("hub")).agg(F.least(F.min("v"), F.col("hub")).alias("m"))
    return both.join(least, F.col("u") == F.col("hub")).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("u").alias("hub")).agg(F.min("v").alias("m"))
    moved = edges.join(least, F.col("u") == F.col("hub")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("hub").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node that edges link to another, but for the least of its component, with that least node v.

    edges: (u, v) with u > v, not null, free of repeats; both columns of one orderable type.
    """
    current, last = materialize(edges, "cc"), None
    while True:
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == last or state[0] == 0:
            return current
        following = materialize(_small_star(_large_star(current)), "cc")
        discard(current)
        current, last = following, state
