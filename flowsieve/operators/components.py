"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): every step is a
grouped minimum and a join, and the number of rounds grows with the logarithm of the
number of nodes. A hub collects many edges: its minimum combines on the map side, and the
join back is left to adaptive execution, which broadcasts small sides and splits skewed ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowsieve.runtime import discard, stage


def _large_star(edges: DataFrame) -> DataFrame:
    near = edges.select(F.explode(F.array(
        F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    low = near.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return (
        near.filter("v > u").join(low, "u")
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
        .filter("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    # A node's neighbours and the node itself all move under its lowest neighbour.
    return (
        down.join(low, "u")
        .select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("low").alias("v")),
            F.struct(F.col("u"), F.col("low").alias("v")))).alias("e"))
        .select("e.*").filter("u <> v").distinct()
    )


def _progress(edges: DataFrame) -> tuple[int, tuple]:
    """Nodes that hang under several roots or are a root under another, and a print of the edges."""
    ends = edges.select(F.xxhash64("u", "v").cast("decimal(38,0)").alias("mark"), F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")),
    )).alias("e")).select("mark", "e.*")
    seen = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"),
                                    F.sum("mark").alias("mark"))
    found = seen.agg(F.count_if(F.col("below") + F.col("above") > 1).alias("open"), F.sum("below"), F.sum("mark")).first()
    return found["open"], tuple(found[1:])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); the root is the smallest node."""
    edges = stage(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    before = None
    while True:
        last, edges = edges, stage(_small_star(_large_star(edges)), "stars")
        discard(last)
        unsettled, mark = _progress(edges)
        if not unsettled:
            break
        if mark == before:
            raise RuntimeError("a round of components changed nothing and left open nodes")
        before = mark
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.withColumn("root", F.col("node")))
