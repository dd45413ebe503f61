"""Connected components over an edge table, by large-star and small-star rounds.

Every round is a min-aggregation (combined before the shuffle) and an equi-join
that adaptive execution can split, as both its sides come straight from an
exchange, so a node with a third of all edges is no bottleneck. Rounds grow with the logarithm of the longest path. Each round is
written to the shared folder; nothing but a count and a sum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratavox.llm.common import dealt, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v. Large: a node's larger neighbours are linked to its
    least neighbour. Small: its smaller ones and itself are."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.filter("v > u").join(dealt(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(dealt(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge.

    ``edges`` has two columns of one integer type; order, repeats and loops
    don't matter. No edges give no rows.
    """
    a, b = edges.columns
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        print_of = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not print_of[0] or print_of == seen:
            break
        seen = print_of
        now = written(_star(_star(now, True), False), "edges")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
