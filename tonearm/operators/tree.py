"""Trees of folders and playlists: closure, integrity, plans, proofs. A node is (id, parent); roots have a null parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import durable


def tops(nodes: DataFrame) -> DataFrame:
    """(id, parent, known, at, ended, rooted) of each node of a table with unique ids.

    ``known``: the parent is a node. ``at`` is the last node above (the node itself if it
    has none), ``rooted`` tells whether that one's parent is null. ``ended`` is false for
    nodes on or below a cycle, which have no last node.

    Pointer doubling: a step looks up where the node pointed at points, so chains of any
    depth end after log2(depth) written steps. A chain that is still open ends some of its
    nodes in the next step; so what is left when a step ends none is cyclic.
    """
    own = nodes.select("id", "parent")
    above = own.select(F.col("id").alias("__above"))
    known = F.col("__above").isNotNull()
    first = own.join(above, F.col("parent") == F.col("__above"), "left")
    state = durable.written(first.select("id", "parent", known.alias("known"), F.coalesce("__above", "id").alias("at"), (~known).alias("ended"), F.col("parent").isNull().alias("rooted")))
    size, now = None, state.where("not ended").count()
    while now and now != size:
        there = state.select(F.col("id").alias("__id"), F.col("at").alias("__at"), F.col("ended").alias("__ended"), F.col("rooted").alias("__rooted"))
        moved = state.where("not ended").join(there, F.col("at") == F.col("__id"))
        moved = moved.select("id", "parent", "known", F.col("__at").alias("at"), F.col("__ended").alias("ended"), F.col("__rooted").alias("rooted"))
        after = durable.written(state.where("ended").unionByName(moved))
        durable.drop(state)
        state, size, now = after, now, after.where("not ended").count()
    return state


def descendants(nodes: DataFrame) -> DataFrame:
    """(ancestor, node, depth) for every node and all above it, itself included with depth 0.

    Each pair comes once, at its least depth; a node on a cycle has the whole cycle above
    it. Steps double the depth covered: pairs up to 2**k levels apart are extended by the
    links of 2**k levels. Only nodes on or below a cycle need their pairs made distinct.
    """
    state = tops(nodes)
    out = _doubled(state.where("ended"), distinct=False)
    if not state.where("not ended").isEmpty():
        out = out.unionByName(_doubled(state.where("not ended"), distinct=True))
    return out


def _doubled(state: DataFrame, distinct: bool) -> DataFrame:
    pairs = durable.written(state.select(F.col("id").alias("ancestor"), F.col("id").alias("node"), F.lit(0).alias("depth")))
    links = durable.written(state.where("known").select("id", F.col("parent").alias("up")))
    span, size = 1, pairs.count()
    while not links.isEmpty():
        further = pairs.join(links, F.col("ancestor") == F.col("id")).select(F.col("up").alias("ancestor"), "node", (F.col("depth") + span).alias("depth"))
        reached = pairs.unionByName(further)
        if distinct:
            reached = reached.groupBy("ancestor", "node").agg(F.min("depth").alias("depth"))
        more = durable.written(reached)
        durable.drop(pairs)
        pairs, before, size = more, size, more.count()
        if distinct and size == before:
            break
        second = links.select(F.col("id").alias("__id"), F.col("up").alias("__up"))
        longer = durable.written(links.join(second, F.col("up") == F.col("__id")).select("id", F.col("__up").alias("up")))
        durable.drop(links)
        links, span = longer, 2 * span
    durable.drop(links)
    return pairs


def integrity(nodes: DataFrame) -> DataFrame:
    """(id, problem): ``dangling`` when the parent is missing, ``unrooted`` when no root is reached, else ``ok``."""
    dangling = F.col("parent").isNotNull() & ~F.col("known")
    ok = F.col("ended") & F.col("rooted")
    return tops(nodes).select("id", F.when(dangling, "dangling").when(~ok, "unrooted").otherwise("ok").alias("problem"))


def overlay(nodes: DataFrame, adds: DataFrame, renames: DataFrame, moves: DataFrame, deletes: DataFrame) -> DataFrame:
    """Nodes (id, parent, name) after a plan: adds (id, parent, name), renames (id, to_name), moves (id, to_parent), deletes (id)."""
    out = nodes.select("id", "parent", "name").unionByName(adds.select("id", "parent", "name"))
    out = out.join(deletes.select("id"), "id", "left_anti").join(renames, "id", "left").join(moves, "id", "left")
    return out.select("id", F.coalesce("to_parent", "parent").alias("parent"), F.coalesce("to_name", "name").alias("name"))


def plan_errors(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, wanted, problem) of references to ids that are missing or of the wrong kind; nodes have (id, kind)."""
    joined = refs.join(nodes.select("id", "kind"), "id", "left")
    problem = F.when(F.col("kind").isNull(), "missing").when(F.col("kind") != F.col("wanted"), "wrong kind")
    return joined.select("id", "wanted", problem.alias("problem")).where("problem is not null")


def nonempty_deletes(nodes: DataFrame, members: DataFrame, deletes: DataFrame) -> DataFrame:
    """Deleted ids that still have members or children which are not deleted."""
    kids = nodes.join(deletes.select("id"), "id", "left_anti").select(F.col("parent").alias("id"))
    return deletes.select("id").join(members.select("id").unionByName(kids), "id", "left_semi")


def orphans(members: DataFrame, surviving: DataFrame) -> DataFrame:
    """Items that were in some list before and are in no surviving list."""
    after = members.join(surviving.select("id"), "id", "left_semi").select("item")
    return members.select("item").distinct().join(after, "item", "left_anti")


def invariants(before: DataFrame, after: DataFrame, before_members: DataFrame, after_members: DataFrame) -> DataFrame:
    """One row of counts before and after, the items lost, and the verdict."""
    lost = before_members.select("item").distinct().join(after_members.select("item"), "item", "left_anti").agg(F.count("*").alias("lost"))
    bad = integrity(after.select("id", "parent")).where("problem <> 'ok'").agg(F.count("*").alias("bad"))
    a = before.agg(F.count("*").alias("nodes_before"))
    b = after.agg(F.count("*").alias("nodes_after"))
    m = before_members.agg(F.count_distinct("item").alias("items_before"))
    n = after_members.agg(F.count_distinct("item").alias("items_after"))
    row = a.crossJoin(b).crossJoin(m).crossJoin(n).crossJoin(lost).crossJoin(bad)  # one row each
    return row.withColumn("verdict", F.when((F.col("lost") == 0) & (F.col("bad") == 0), "PASS").otherwise("FAIL"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
