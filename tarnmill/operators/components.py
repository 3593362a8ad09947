"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.runtime import materialise, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node that can be reached), for every node of an edge.

    Alternating large and small stars (Kiveris et al., 2014): each round links a node's larger, then its
    smaller neighbours to the smallest one it knows, until every node hangs on its component's smallest. The
    rounds needed grow as the square of the logarithm of the longest path at most. Edges are written to the
    shared folder after each round, so lineage stays short; only a count and a checksum go to the driver.
    Self loops, repeated and reversed edges are harmless. An edge with a null end is left out.
    """
    kind = edges.schema[src].dataType
    both = edges.select(F.col(src).cast(kind).alias("u"), F.col(dst).cast(kind).alias("v")).where("u is not null and v is not null")
    loops = both.where("u = v").select("u").distinct()
    now = materialise(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, now = now, materialise(small)
        release(before)
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (found[0], found[1]) == state:
            break
        state = (found[0], found[1])
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    hung = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = hung.select(F.col("component").alias("node"), "component").distinct()
    placed = hung.select(F.explode(F.array("node", "component")).alias("_node")).distinct()
    alone = loops.join(placed, loops["u"] == F.col("_node"), "left_anti").select(F.col("u").alias("node"), F.col("u").alias("component"))
    return hung.unionByName(roots).unionByName(alone)
