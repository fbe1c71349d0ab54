"""Vectors: normalising, dot products, partners per vector, nearest centroid, directions.

Pairs above a threshold and nearest neighbours are in ``angular``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Numbers in all centroids together that may be sent to every task (64 MB).
MOST_CENTROIDS = 8_000_000


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column, epsilon: float = 1e-9) -> Column:
    """The vector over its length plus epsilon."""
    n = norm(a) + epsilon
    return F.transform(a, lambda x: x.cast("double") / n)


def both_ways(pairs: DataFrame) -> DataFrame:
    """Directed (i, j, sim) of undirected (a, b, sim)."""
    return pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), "sim").unionByName(pairs.select(F.col("b").alias("i"), F.col("a").alias("j"), "sim"))


def top_partners(directed: DataFrame, top: int, score: str = "score", label: str = "label_j") -> DataFrame:
    """Each row's best ``top`` partners, one per partner label; equal scores go to the larger partner."""
    by_label = W.partitionBy("i", label).orderBy(F.col(score).desc(), F.col("j").desc())
    best = directed.withColumn("__n", F.row_number().over(by_label)).where("__n = 1")
    rank = W.partitionBy("i").orderBy(F.col(score).desc(), F.col("j").desc())
    return best.withColumn("__n", F.row_number().over(rank)).where(F.col("__n") <= top).drop("__n")


def undirected(directed: DataFrame) -> DataFrame:
    """(a, b, sim) of chosen partners, a < b, best similarity of the two ways."""
    return directed.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max("sim").alias("sim"))


def degree_report(pairs: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """One row: nodes, pairs, with a match, median (truncated), p90 (truncated) and largest degree; unmatched nodes count as 0."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias(key)).groupBy(key).agg(F.count("*").alias("d"))
    d = nodes.select(key).join(ends, key, "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    row = d.agg(F.count("*").alias("nodes"), F.count_if(F.col("d") > 0).alias("matched"), F.percentile("d", F.lit(0.5)).alias("m"), F.percentile("d", F.lit(0.9)).alias("p"), F.max("d").alias("max_degree"), F.sum("d").alias("ends"))
    return row.select("nodes", "matched", F.floor("m").alias("median_degree"), F.floor("p").alias("p90_degree"), "max_degree", (F.col("ends") / 2).cast("long").alias("pairs"))


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, key: str, vector: str, floor: float | None = None) -> DataFrame:
    """(key, cluster, sim): the centroid with the largest dot product (the lesser cluster of equals), null below ``floor``.

    All centroids travel as one array to each vector, which takes the best of them where
    it lies; more than ``MOST_CENTROIDS`` values raise.
    """
    size = centroids.agg(F.sum(F.size("centroid"))).first()[0] or 0
    if size > MOST_CENTROIDS:
        raise ValueError(f"{size} values of centroids are too many to send to every task")
    c = F.broadcast(centroids.agg(F.collect_list(F.struct("cluster", "centroid")).alias("__c")))  # one row, of checked size
    each = F.transform("__c", lambda x: F.struct(dot(F.col(vector), x["centroid"]).alias("sim"), (-x["cluster"]).alias("low")))
    best = vectors.crossJoin(c).select(key, F.array_max(each).alias("s"))
    cluster = (-F.col("s.low")).cast(centroids.schema["cluster"].dataType)
    return best.select(key, (cluster if floor is None else F.when(F.col("s.sim") >= floor, cluster)).alias("cluster"), F.col("s.sim").alias("sim"))


def mean_vectors(vectors: DataFrame, group: str, vector: str, normalised: bool = True) -> DataFrame:
    """(cluster, centroid): mean by position, over its length if ``normalised``."""
    parts = vectors.select(F.col(group).alias("cluster"), F.posexplode(vector).alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = parts.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("m")).select("cluster", F.col("m.x").alias("centroid"))
    return mean.withColumn("centroid", unit(F.col("centroid"))) if normalised else mean


def projection(vector: Column, direction: Column) -> Column:
    """Length of the vector along a direction."""
    return dot(vector, direction) / norm(direction)
