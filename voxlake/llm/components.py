"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.shared import stored
from voxlake.operators.skew import lookup_join


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("sum")).first()
    return row["n"], row["sum"]


def star_components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b), except the roots themselves.

    A component's root is its smallest node. Each round writes its edges to the
    shared folder, so lineage stays short; the number of rounds is logarithmic.
    """
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # a star's centre meets its leaves in as many tasks as they need
        large = stored(lookup_join(both.where(F.col("b") > F.col("a")), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = lookup_join(large, least, ["a"])
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        last, now = now, stored(small, "edges")
        before, state = state, _state(now)
        if state == before and now.exceptAll(last).isEmpty():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
