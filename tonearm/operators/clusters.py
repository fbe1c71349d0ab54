"""Cosine k-means, cluster names, tempo leaves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonearm.functions import rules

from . import durable
from .vectors import mean_vectors, nearest_centroid

#: Default number of clusters and of rounds.
K, ROUNDS = 18, 40


def lloyd_step(vectors: DataFrame, centroids: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(assignment, next centroids); a cluster without members keeps its centroid."""
    lab = nearest_centroid(vectors, centroids, key, vector)
    new = mean_vectors(vectors.join(lab.select(key, "cluster"), key), "cluster", vector)
    kept = centroids.join(new.select("cluster"), "cluster", "left_anti").select("cluster", "centroid")
    return lab, new.select("cluster", "centroid").unionByName(kept)


def spherical_kmeans(vectors: DataFrame, centroids: DataFrame, key: str, vector: str, rounds: int = ROUNDS) -> DataFrame:
    """Lloyd rounds from given centroids. k centroids are collected per round, so no lineage grows."""
    spark = vectors.sparkSession
    now = centroids
    for _ in range(rounds):
        _, new = lloyd_step(vectors, now, key, vector)
        rows = sorted(map(tuple, new.select("cluster", "centroid").collect()))
        if rows == sorted(map(tuple, now.select("cluster", "centroid").collect())):
            break
        now = spark.createDataFrame(rows, "cluster int, centroid array<double>")
    return nearest_centroid(vectors, now, key, vector)


def cluster_names(members: DataFrame, least: int = 12, share: float = 0.30) -> DataFrame:
    """(cluster, n, name) of members (cluster, sub, family).

    The commonest sub-genre that is not a general one, if it holds enough members, else the
    commonest family; equal counts go to the lesser name.
    """
    n = members.groupBy("cluster").agg(F.count("*").alias("n"))

    def commonest(column: str, rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("cluster", column).agg(F.count("*").alias("c"))
        w = W.partitionBy("cluster").orderBy(F.col("c").desc(), column)
        return counts.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")

    sub = commonest("sub", members.where((F.col("sub") != "") & ~F.col("sub").isin(*rules.GENERIC)))
    fam = commonest("family", members).drop("c")
    named = n.join(fam, "cluster").join(sub, "cluster", "left")
    own = F.coalesce(F.col("c") >= F.greatest(F.lit(float(least)), share * F.col("n")), F.lit(False))
    return named.select("cluster", "n", F.when(own, F.col("sub")).otherwise(F.col("family")).alias("name"))


def merge_names(names: DataFrame) -> DataFrame:
    """(name, clusters, n): clusters of one name are one folder."""
    return names.groupBy("name").agg(F.count("*").alias("clusters"), F.sum("n").alias("n"))


def band_leaves(bands: DataFrame, least: int = 8) -> DataFrame:
    """(folder, band, leaf) of (folder, position, band, n): neighbouring bands join until they hold ``least``; a remainder joins the last leaf.

    At most a dozen bands per folder, folded as one array.
    """
    rows = bands.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("position", "band", "n"))).alias("b"))
    start = F.struct(F.lit(1).alias("leaf"), F.lit(0).cast("long").alias("held"), F.array().cast("array<struct<band:string,leaf:int>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        held = acc["held"] + b["n"]
        return F.struct(
            F.when(held >= least, acc["leaf"] + 1).otherwise(acc["leaf"]).alias("leaf"),
            F.when(held >= least, F.lit(0).cast("long")).otherwise(held).alias("held"),
            F.concat(acc["out"], F.array(F.struct(b["band"].alias("band"), acc["leaf"].alias("leaf")))).alias("out"),
        )

    # what never reached the size belongs to the leaf before, if there is one
    done = F.aggregate(F.col("b"), start, step)
    last = F.greatest(F.lit(1), F.col("d.leaf") - 1)
    return rows.select("folder", done.alias("d")).select("folder", last.alias("last"), F.explode("d.out").alias("o")).select("folder", "o.band", F.least("o.leaf", "last").alias("leaf"))


def place_in_folder(members: DataFrame) -> DataFrame:
    """(folder, track, bpm, pos, cum), written: place of each member by tempo, and the sum of tempos up to it.

    Members lie in range partitions of (folder, tempo, track); a folder that lies in several
    gets what the earlier ones hold added, so no folder is one task.
    """
    order = [F.col("folder"), F.col("bpm"), F.col("track")]
    placed = durable.written(members.select(*order).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = W.partitionBy("part", "folder").orderBy("bpm", "track").rowsBetween(W.unboundedPreceding, 0)
    held = placed.groupBy("part", "folder").agg(F.count("*").alias("n"), F.sum("bpm").alias("s"))
    earlier = W.partitionBy("folder").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = held.select("part", "folder", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("s"))
    own = placed.select(*order, "part", F.count("*").over(inside).alias("own_n"), F.sum("bpm").over(inside).alias("own_s"))
    out = durable.written(own.join(before, ["part", "folder"]).select(*order, (F.col("own_n") + F.col("n")).alias("pos"), (F.col("own_s") + F.col("s")).alias("cum")))
    durable.drop(placed)
    return out


def tempo_segments(members: DataFrame, tolerance: float = 0.08) -> DataFrame:
    """(folder, track, leaf, name): members in order of tempo, cut where one of a leaf would leave the mean's tolerance.

    A member joins while every member, with it, lies within ``tolerance`` of the new mean.
    With places and running sums, whether a member fails a leaf that starts at a given
    place follows from the member's own row; the first that fails starts the next leaf. So
    a round finds one cut of every folder by a minimum with partial sums, and a folder of
    any size spreads over tasks. A leaf's least tempo exceeds that of the one before by
    more than ``tolerance``, which bounds rounds by the logarithm of the range of tempos.
    """
    kinds = {f.name: f.dataType.simpleString() for f in members.schema.fields}
    placed = place_in_folder(members.where("bpm is not null and bpm <> 0").select("folder", "track", F.col("bpm").cast("double").alias("bpm")))
    now = durable.written(placed.where("pos = 1").select("folder", F.lit(0).alias("leaf"), F.col("pos").alias("start"), F.lit(0.0).alias("before"), F.col("bpm").alias("low")))
    starts = [now]
    while not now.isEmpty():
        mean = (F.col("cum") - F.col("before")) / (F.col("pos") - F.col("start") + 1)
        # sorted members: the ends are the farthest from the mean
        failing = placed.join(now, "folder").where(F.col("pos") > F.col("start")).withColumn("mean", mean).where(((F.col("mean") - F.col("low")) / F.col("mean") > tolerance) | ((F.col("bpm") - F.col("mean")) / F.col("mean") > tolerance))
        cut = F.struct((F.col("leaf") + 1).alias("leaf"), F.col("pos").alias("start"), (F.col("cum") - F.col("bpm")).alias("before"), F.col("bpm").alias("low"))
        now = durable.written(failing.groupBy("folder").agg(F.min_by(cut, "pos").alias("cut")).select("folder", "cut.*"))
        starts.append(now)
    leaves = reduce(DataFrame.unionByName, starts)
    totals = placed.groupBy("folder").agg(F.max("pos").alias("n"), F.max_by("cum", "pos").alias("total"))
    by_leaf = W.partitionBy("folder").orderBy("leaf")
    sizes = leaves.join(totals, "folder").select("folder", "leaf", "start", (F.coalesce(F.lead("before").over(by_leaf), "total") - F.col("before")).alias("s"), (F.coalesce(F.lead("start").over(by_leaf), F.col("n") + 1) - F.col("start")).alias("n"))
    plain = F.concat(F.bround(F.col("s") / F.col("n")).cast("long").cast("string"), F.lit("bpm"))
    seen = F.row_number().over(W.partitionBy("folder", "plain").orderBy("leaf"))
    named = sizes.withColumn("plain", plain).withColumn("seen", seen).withColumn("name", F.when(F.col("seen") == 1, F.col("plain")).otherwise(F.concat_ws("-", "plain", F.col("seen").cast("string"))))
    # the few leaves of a folder as one array, in order
    lists = durable.written(named.groupBy("folder").agg(F.sort_array(F.collect_list(F.struct("start", "name"))).alias("leaves")))
    durable.drop(*starts)
    leaf = F.size(F.filter("leaves", lambda x: x["start"] <= F.col("pos"))) - 1
    found = placed.join(lists, "folder").select("folder", "track", leaf.alias("leaf"), F.col("leaves")[leaf]["name"].alias("name"))
    rest = members.where("bpm is null or bpm = 0").select("folder", "track", F.lit(None).cast("int").alias("leaf"), F.lit("unknown-bpm").alias("name"))
    return found.unionByName(rest).select(*[F.col(c).cast(kinds[c]).alias(c) for c in ("folder", "track")], "leaf", "name")
