"""Connected components by alternating large-star and small-star rounds.

Every round is one aggregation and one join in each half, over tables in the shared folder:
nothing but a count and a checksum of the links reaches the driver. A node that has a large
part of all links is only ever the key of a pre-aggregated minimum and of a join of two
stored tables, whose partitions Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.storage import materialize

MOST_ROUNDS = 60


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct links with a > b."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long; order, loops and repeats do not matter). Returns node, root for each
    node that has a link and is not the smallest of its component; root is the smallest."""
    e = materialize(_oriented(edges.where("a is not null and b is not null")), "links")
    seen = None
    for _ in range(MOST_ROUNDS):
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        # large star: neighbours above a node link to the smallest of its neighbourhood
        both = e.select(F.col("b").alias("u"), F.col("b").alias("v")).union(e.select("b", "a")).union(e.select("a", "b"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")), "large-minima")
        e = materialize(_oriented(e.join(least, e.b == least.u).select("a", F.col("m").alias("b"))), "large-star")
        # small star: a node and its neighbours below it link to the smallest of them
        least = materialize(e.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "small-minima")
        below = e.join(least, e.a == least.u).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(_oriented(below.union(least.select("u", "m"))), "small-star")
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
