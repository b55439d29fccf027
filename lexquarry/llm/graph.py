"""Connected components by alternating large and small stars, cut after each pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.spark import cut


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for each node of edges (a, b); nodes without an edge have no row."""
    now = cut(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        # no union of a cut frame with itself: Catalyst can't rewrite its constraints
        both = now.select(F.explode(F.array(F.struct("hi", "lo"), F.struct(F.col("lo").alias("hi"), F.col("hi").alias("lo")))).alias("e")).select("e.*")
        least = both.groupBy(F.col("hi").alias("u")).agg(F.least(F.min("lo"), F.first("hi")).alias("m"))
        # large star: every larger neighbour of u goes to u's least neighbour
        large = now.join(least, now.lo == least.u).select(F.col("hi"), F.col("m").alias("lo")).where("hi > lo").distinct()
        # small star: u and its smaller neighbours go to the least of them
        small = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        linked = large.join(small, large.hi == small.u).select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
        now = cut(linked.where("hi > lo").distinct())
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
