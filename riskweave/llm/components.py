"""Connected components of an edge table, by large-star and small-star steps.

Each step is a grouping with partial aggregation and a join; a step's edges are
stored, so plans stay short and a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import stored


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """(node, root) for every node that has an edge and isn't a root; edges have columns a and b."""
    edges = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), purpose)
    while True:
        # every node hands the least node around it, or itself, to its larger neighbours
        least = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("least"))
        large = edges.select("a", "b").join(least, "b", "left").select(
            "a", F.coalesce("least", "b").alias("b"), F.col("least").isNotNull().alias("moved"))
        # and its smaller neighbours and itself to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("least"), F.max("moved").alias("moved"))
        small = large.select("a", "b").join(least.select("a", "least"), "a").filter("b != least").select(
            F.col("b").alias("a"), F.col("least").alias("b"), F.lit(True).alias("moved"))
        both = small.unionByName(least.select("a", F.col("least").alias("b"), "moved"))
        # a step that moves no edge began with stars; that is read from the stored edges, without a shuffle
        edges = stored(both.groupBy("a", "b").agg(F.max("moved").alias("moved")), purpose)
        if edges.filter("moved").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
