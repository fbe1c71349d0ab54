"""Connected components of an undirected graph by alternating star contraction.

Edges stay distributed; each round is two shuffles by node with map-side minima
and is written to the shared folder, so lineage does not grow and a lost executor
costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, save


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): each node of an edge with the least node it can reach.

    Null ends and self-loops are ignored; repeated and reversed edges count once;
    no edges give no rows. A node of very many edges is met by joins only (whose
    skewed partitions AQE splits) and by partial minima, never by a list.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    now = save(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    while True:
        # large star: every neighbour above u is linked to the least of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its neighbours below are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        up = large.join(low, "u")
        small = up.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = save(small, "cc")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now)
        now = after
        if state == before:
            break
        before = state
    # now a forest of stars: each u has the single centre v
    centres = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
