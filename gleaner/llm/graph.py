"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): every node's
    larger, then smaller neighbours are tied to its smallest neighbour, until each component
    is a star. Each step is one aggregation, which combines before the shuffle, and one join of
    two written tables, whose hot keys adaptive execution splits. Links to itself and nulls
    are left out; an empty table gives an empty one.
    """
    edges = scratch.save(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"
    )
    state, step = None, 0
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), f"{name}-{step}-low")
        large = scratch.save(
            both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), f"{name}-{step}-large"
        )
        smallest = scratch.save(large.groupBy("a").agg(F.min("b").alias("low")), f"{name}-{step}-small")
        tied = large.join(smallest, "a").select(
            F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")
        )
        old, step = f"{name}-{step}", step + 1
        edges = scratch.save(tied.select("e.a", "e.b").filter("a <> b").distinct(), f"{name}-{step}")
        scratch.drop(old, f"{old}-low", f"{old}-large", f"{old}-small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
