"""Density clusters: mutual reachability over nearest neighbours, spanning forest, leaves of the condensed tree, vote for noise.

The distance of a vector's k-th neighbour is its core distance; an edge of the neighbour
graph weighs the largest of its ends' core distances and its own length. Boruvka rounds
give the minimum spanning forest: every component takes its lightest edge, and the
components of the taken edges are the next ones.

Single linkage joins the forest's edges from the lightest to the heaviest. A join of two
sides that both have ``least`` members is a split; a side with ``least`` members without
a split in it, below a split, is a leaf, and leaves are the clusters. Joins are done in
levels. A level takes the lightest edges left, as many as make components of at most
``MOST`` edges; each component is joined in a task, and becomes one node, with its size
and whether it holds a split, of the next level's forest. So no task or driver holds the tree.

Trees of the forest that no edge joins lie infinitely far apart: two of them with
``least`` members are a split too. A table that never splits has no cluster.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import angular, durable, store

#: Neighbours of the core distance, members of a cluster, neighbours that vote for noise.
SAMPLES, LEAST, VOTES = 10, 60, 10
#: Edges of one component of a level.
MOST = 100_000


def components(links: DataFrame) -> DataFrame:
    """(node, component), written: the least node that each end of links (u, v) reaches, by alternating stars."""
    now, before = durable.written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = durable.written(small.distinct())
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        durable.drop(now)
        now = after
        if state == before:
            break
        before = state
    out = durable.written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    durable.drop(now)
    return out


def relabelled(edges: DataFrame, labels: DataFrame, *ends: str) -> DataFrame:
    """``edges`` with the components of their ends in place of the ends; ends without label stay."""
    for e in ends:
        edges = edges.join(labels.select(F.col("node").alias(e), F.col("component").alias("__to")), e, "left").withColumn(e, F.coalesce("__to", e)).drop("__to")
    return edges


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, w), written: the minimum spanning forest of edges (a, b, w); equal weights go by a, then b."""
    left = durable.written(edges.select("a", "b", "w", F.col("a").alias("u"), F.col("b").alias("v")))
    taken = []
    while not left.isEmpty():
        edge = F.struct("w", "a", "b", "u", "v")
        sides = left.select(F.col("u").alias("c"), edge.alias("e")).unionByName(left.select(F.col("v").alias("c"), edge.alias("e")))
        best = durable.written(sides.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        taken.append(best)
        labels = components(best)
        met = relabelled(left, labels, "u", "v").where("u <> v")
        # of all edges between two components only the lightest can be taken
        pair = met.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(F.struct("w", "a", "b")).alias("e"))
        after = durable.written(pair.select("e.a", "e.b", "e.w", "u", "v"))
        durable.drop(left, labels)
        left = after
    if not taken:
        return left.select("a", "b", "w")
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    out = durable.written(out.select("a", "b", "w"))
    durable.drop(left, *taken)
    return out


def _join_up(least: int):
    """Joins one component's edges in order; says each node's cluster, and the component's size and whether it holds a split."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("r")
        size, split, held, up = {}, {}, {}, {}
        for x, n, s in (("a", "na", "sa"), ("b", "nb", "sb")):
            for k, m, f in zip(group[x].tolist(), group[n].tolist(), group[s].tolist()):
                size[k], split[k], held[k], up[k] = m, f, [k], k
        cluster: dict = {}

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in zip(group["a"].tolist(), group["b"].tolist()):
            a, b = top(a), top(b)
            both = size[a] >= least and size[b] >= least
            if both:
                for side in (a, b):
                    if not split[side]:
                        cluster.update(dict.fromkeys(held[side], min(held[side])))
            if len(held[a]) < len(held[b]):
                a, b = b, a
            up[b] = a
            split[a] = split[a] or split[b] or both
            size[a] += size[b]
            held[a] += held.pop(b)
        root = top(a)
        nodes = held[root]
        own = pd.array([cluster.get(k) for k in nodes], dtype="Int64")
        return pd.DataFrame({"component": group["component"].iloc[0], "node": nodes, "n": size[root], "split": split[root], "cluster": own})

    return run


def leaves(forest: DataFrame, points: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(point, cluster), written: each point (long) of a forest's leaf by the least point of it; null for noise."""
    edges = durable.written(store.number_rows(forest, [F.col("w"), F.col("a"), F.col("b")], "r").select("a", "b", "r"))
    nodes = durable.written(points.select(F.col("point").alias("node"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("split")))
    at = durable.written(points.select("point", F.col("point").alias("node")))
    done, level = [], 0
    schema = "component long, node long, n long, split boolean, cluster long"
    while True:
        count, first = edges.agg(F.count("*"), F.min("r")).first()
        if not count:
            break
        # half of the edges, if their components are small enough; else fewer, and never less than what one task may hold
        take = max(most, -(-count // 2))
        while True:
            here = durable.written(edges.where(F.col("r") < first + take) if take < count else edges)
            labels = components(here.select(F.col("a").alias("u"), F.col("b").alias("v")))
            of = durable.written(here.join(labels.select(F.col("node").alias("a"), "component"), "a"))
            if take <= most or (of.groupBy("component").count().agg(F.max("count")).first()[0] or 0) <= most:
                break
            take = max(most, take // 2)
            durable.drop(here, labels, of)
        fact = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("split").alias(f"s{x}"))
        joined = durable.written(of.join(fact("a"), "a").join(fact("b"), "b").groupBy("component").applyInPandas(_join_up(least), schema))
        # clusters found now are final; all other points follow their component
        moved = durable.written(at.join(joined.select("node", "component", F.concat_ws("-", F.lit(level), "component", "cluster").alias("name"), "cluster"), "node", "left").select("point", F.coalesce("component", "node").alias("node"), F.when(F.col("cluster").isNotNull(), F.col("name")).alias("name")))
        done.append(moved.where("name is not null").select("point", "name"))
        rest = durable.written(moved.where("name is null").select("point", "node"))
        after = durable.written(nodes.join(joined, "node", "left_anti").select("node", "n", "split").unionByName(joined.groupBy(F.col("component").alias("node")).agg(F.first("n").alias("n"), F.first("split").alias("split"))))
        left = durable.written(relabelled(edges.join(here, "r", "left_anti"), labels, "a", "b").select("a", "b", "r"))
        durable.drop(edges, nodes, at, here, labels, of, joined)
        edges, nodes, at, level = left, after, rest, level + 1
    # the trees that are left lie infinitely far apart
    big = nodes.where(F.col("n") >= least)
    if big.limit(2).count() == 2:
        done.append(at.join(big.where("not split"), "node").select("point", F.concat_ws("-", F.lit("tree"), "node").alias("name")))
    found = points.select("point").limit(0).withColumn("name", F.lit(None).cast("string"))
    for d in done:
        found = found.unionByName(d)
    named = found.groupBy("name").agg(F.min("point").alias("cluster"))
    out = durable.written(points.select("point").join(found.join(named, "name").select("point", "cluster"), "point", "left"))
    durable.drop(edges, nodes, at)
    return out


def density_clusters(vectors: DataFrame, key: str, vector: str, least: int = LEAST, samples: int = SAMPLES, votes: int = VOTES, most: int = MOST) -> DataFrame:
    """(key, cluster, noise): leaf clusters of unit vectors with long keys, by cosine distance.

    A cluster is named by its least key. Noise gets the commonest cluster of its ``votes``
    nearest clustered vectors (of equally common ones the least); without any cluster all are null.
    """
    near = durable.written(angular.nearest(vectors, vectors, key, vector, samples))
    core = near.where(F.col("rank") == samples).select("q", (1 - F.col("sim")).alias("core"))
    ends = lambda c, n: core.select(F.col("q").alias(c), F.col("core").alias(n))
    edge = near.select(F.least("q", key).alias("a"), F.greatest("q", key).alias("b"), (1 - F.col("sim")).alias("d")).groupBy("a", "b").agg(F.min("d").alias("d"))
    edges = edge.join(ends("a", "ca"), "a").join(ends("b", "cb"), "b").select("a", "b", F.greatest("d", "ca", "cb").alias("w"))
    found = leaves(spanning_forest(edges), vectors.select(F.col(key).alias("point")), least, most)
    held = vectors.join(found.withColumnRenamed("point", key), key)
    clustered = durable.written(held.where("cluster is not null").select(key, vector, "cluster"))
    noise = held.where("cluster is null").select(key, vector)
    if clustered.isEmpty():
        return found.select(F.col("point").alias(key), "cluster", F.lit(True).alias("noise"))
    voters = angular.nearest(noise, clustered, key, vector, votes).join(clustered.select(key, "cluster"), key)
    counts = voters.groupBy("q", "cluster").agg(F.count("*").alias("n"))
    voted = counts.groupBy(F.col("q").alias(key)).agg(F.max_by("cluster", F.struct(F.col("n"), -F.col("cluster"))).alias("vote"))
    return found.withColumnRenamed("point", key).join(voted, key, "left").select(key, F.coalesce("cluster", "vote").alias("cluster"), F.col("cluster").isNull().alias("noise"))
