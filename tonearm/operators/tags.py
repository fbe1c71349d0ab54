"""Tag banks, links, playlists: fill-only plans, numbering, ordered dedupe, consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fill_only(plan: DataFrame, links: DataFrame, ignored: Column | None = None) -> DataFrame:
    """Planned (bank, tag, track) whose track has no tag of that bank yet; ``ignored`` links don't count."""
    blocking = links if ignored is None else links.where(~ignored)
    return plan.join(blocking.select("bank", "track"), ["bank", "track"], "left_anti").distinct()


def number_links(new: DataFrame, links: DataFrame) -> DataFrame:
    """(tag, track, track_no): new links numbered on after the links that each tag has, by track."""
    fresh = new.select("tag", "track").distinct().join(links.select("tag", "track"), ["tag", "track"], "left_anti")
    had = links.groupBy("tag").agg(F.count("*").alias("had"))
    numbered = fresh.withColumn("n", F.row_number().over(W.partitionBy("tag").orderBy("track"))).join(had, "tag", "left")
    return numbered.select("tag", "track", (F.col("n") + F.coalesce("had", F.lit(0))).cast("long").alias("track_no"))


def first_occurrences(entries: DataFrame, group: str, item: str, position: str) -> DataFrame:
    """(group, item, position, n): each item once, where it first occurs, renumbered from 1."""
    once = entries.groupBy(group, item).agg(F.min(position).alias(position))
    return once.withColumn("n", F.row_number().over(W.partitionBy(group).orderBy(position, item)).cast("long"))


def suffix_repeats(rows: DataFrame, group: list[str], name: str, order: list[str]) -> DataFrame:
    """Repeated names in a group become ``name-2``, ``name-3`` and so on."""
    n = F.row_number().over(W.partitionBy(*group, name).orderBy(*order))
    return rows.withColumn("__n", n).withColumn(name, F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), F.col("__n").cast("string")))).drop("__n")


def consolidate(tags: DataFrame, links: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overlay of a reorganisation on tags (id, parent, name, seq) and links (tag, track).

    ``moves`` (id, to_parent, to_name, to_seq, merge_into) holds nulls for what stays. A
    merged tag's links move to its target unless the track is there already; the tag goes.
    Both results have a 0/1 ``deleted``.
    """
    t = tags.join(moves, "id", "left").select(
        "id", F.coalesce("to_parent", "parent").alias("parent"), F.coalesce("to_name", "name").alias("name"), F.coalesce("to_seq", "seq").alias("seq"), F.col("merge_into").isNotNull().cast("int").alias("deleted")
    )
    into = moves.where("merge_into is not null").select(F.col("id").alias("tag"), "merge_into")
    moved = links.join(into, "tag", "left").withColumn("to", F.coalesce("merge_into", "tag"))
    # of all links that meet in (tag, track) the one that was there stays, else the least source tag's
    keep = moved.groupBy("to", "track").agg(F.min(F.struct((F.col("tag") != F.col("to")).cast("int").alias("moved"), F.col("tag").alias("tag"))).alias("k"))
    out = moved.join(keep, ["to", "track"]).select(F.col("to").alias("tag"), "track", F.col("tag").alias("was"), (F.col("k.tag") != moved["tag"]).cast("int").alias("deleted"))
    return t, out


def equal_sets(members: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b): groups (a < b) that hold the same items, proven by equal sorted sets.

    Sets are met by digest and size; members of a set must fit in one row, as a playlist does.
    """
    sets = members.groupBy(group).agg(F.sort_array(F.collect_set(item)).alias("items")).select(F.col(group).alias("g"), F.sha2(F.to_json("items"), 256).alias("d"), F.size("items").alias("n"))
    return sets.alias("x").join(sets.alias("y"), ["d", "n"]).where("x.g < y.g").select(F.col("x.g").alias("a"), F.col("y.g").alias("b"))
