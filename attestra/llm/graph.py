"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum (pre-aggregated before the shuffle) and a join back, which adaptive execution splits if
one node holds a large share of the edges. Every round is a written table; only a yes or no a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """From undirected edges (u, v), a row (node, root) for each node of an edge; root is the component's least node.

    Self-loops, repeated and reversed edges change nothing. No edges, no rows.
    """
    now = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _is_star_forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["c"]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        joined = large.join(least, large["u"] == least["c"])
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        before, now = now, stored(small)
        discard(before)
    out = stored(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
    discard(now)
    return out


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node has either one edge, to a node without, or none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out > 1 or out = 1 and into > 0").isEmpty()


def joined_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, root) once more edges are there, from a stored table of those before.

    The edges are contracted to the roots of their ends, so only what they join is worked on, not all components.
    """
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    ends = edges.join(end("u"), "u", "left").join(end("v"), "v", "left")
    between = ends.select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
    moved = components(between)
    to = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    old = roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    out = stored(old.unionByName(moved.join(roots, "node", "left_anti")))
    discard(moved)
    return out
