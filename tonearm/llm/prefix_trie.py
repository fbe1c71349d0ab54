"""Prefix trie of conversations by partition refinement.

All conversations start in one class, the root. A round splits the classes that are
still active by their members' next turns: a member's class key is the digest of its
former key and the turn, so members of one class with equal turns meet in one group and
no class is ever listed. A class of one member is retired: the member leaves the
refinement, and its remaining turns are emitted as a chain of nodes with one child each,
row by row from its own turns. A round takes a block of turns, twice as many as the one
before, so rounds grow with the logarithm of the longest *shared* prefix (up to
``LONGEST_BLOCK`` turns a round).

Folding back needs no walk over levels. A node belongs to its smallest member, and a
member owns all nodes of its path from some depth on. So the bytes and leaves of a
subtree are sums over its members of what each owns, plus the rest of the smallest
member's path; every round's classes get them by one grouping with partial sums.

The conversations that end in a node are hashed in order without a list: sorted ids
are joined to pieces where they lie, and the pieces of a node are hashed one after another.

Defined results: rows without conversation id are left out; turns go by turn number,
null first, then by role and text; null role or text is empty; repeated rows are turns of
their own; a conversation without turns is a member of the root only; no rows give no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop, map_columns, require, save, shuffle_partitions, small_enough

#: Turns that the first round takes, and the most that one takes.
FIRST_BLOCK, LONGEST_BLOCK = 8, 512
#: Bytes of joined ids in one piece.
PIECE = 1 << 16
_EMPTY = hashlib.sha256(b"").hexdigest()


def number_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, digest, bytes): the turns of each conversation, numbered from 1.

    Turns are sorted in range partitions, so a conversation of very many turns spreads
    over tasks; the few that lie in several partitions get an offset for each.
    """
    require(rows, conv, turn, role, text)
    spark = rows.sparkSession
    said = lambda c: F.coalesce(rows[c], F.lit(""))
    turns = rows.select(rows[conv].alias("conv"), rows[turn].alias("turn"), said(role).alias("role"), said(text).alias("text")).where("conv is not null")
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    placed = turns.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    digest = F.unhex(F.sha2(F.concat(F.sha2(F.col("role").cast("binary"), 256).cast("binary"), F.col("text").cast("binary")), 256))
    placed = save(placed.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes")), "turns")
    own = F.row_number().over(Window.partitionBy("conv", "part").orderBy("row"))
    parts = placed.groupBy("conv", "part").agg(F.count("*").alias("n"))
    several = parts.join(small_enough(parts.groupBy("conv").agg(F.count("*").alias("parts")).where("parts > 1").select("conv")), "conv", "left_semi")
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # at most two conversations of a partition lie in another one too
    offsets = save(several.select("conv", "part", F.coalesce(before, F.lit(0)).alias("offset")), "offsets")
    numbered = placed.withColumn("own", own).join(small_enough(offsets), ["conv", "part"], "left")
    out = save(numbered.select("conv", (F.col("own") + F.coalesce("offset", F.lit(0))).cast("long").alias("pos"), "digest", "bytes"), "numbered")
    drop(placed, offsets)
    return out


def rebuild(turns: DataFrame, heads: Column, bases: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as another one does, and (conv, n) with their numbers of turns.

    ``heads`` and ``bases`` are expressions of ``conv``: a conversation takes the first
    ``heads`` (at most ``most``) turns of conversation ``bases``, then its own after as many.
    """
    sizes = save(turns.groupBy("conv").agg(F.count("*").alias("own")), "sizes")
    named = sizes.select("conv", "own", heads.cast("long").alias("head"), bases.alias("base"))
    facts = named.join(sizes.select(F.col("conv").alias("base"), F.col("own").alias("base_own")), "base", "left")
    facts = save(facts.select("conv", "own", "head", "base", F.least("head", F.coalesce("base_own", F.lit(0))).alias("taken")), "facts")
    first = turns.where(F.col("pos") <= most).select(F.col("conv").alias("base"), "pos", "digest", "bytes")
    begun = facts.where("taken > 0").join(first, "base").where("pos <= taken").select("conv", "pos", "digest", "bytes")
    rest = turns.join(facts.select("conv", "head", "taken"), "conv").where("pos > head").select("conv", (F.col("pos") - F.col("head") + F.col("taken")).alias("pos"), "digest", "bytes")
    out = save(begun.unionByName(rest), "rebuilt")
    lengths = save(facts.select("conv", (F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("n")), "lengths")
    drop(sizes, facts)
    return out, lengths


def _root() -> Column:
    return F.unhex(F.lit(_EMPTY))


def _classes(members: DataFrame) -> DataFrame:
    """The classes of ``members``: one row for each key, with its smallest member."""
    first = [F.first(c).alias(c) for c in ("parent", "depth", "bytes", "before")]
    return members.groupBy("key").agg(*first, F.min("conv").alias("conv"), F.count("*").alias("n"))


def _refine(turns: DataFrame, lengths: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Written tables of each round: members (conv, depth, key, parent, bytes, before) of the classes
    that the round made, and the classes (key, parent, depth, conv, n, bytes, before).

    A retired member is followed to the end of its block; deeper classes of one stand for nothing more.
    """
    active = lengths.select("conv", _root().alias("key"), F.lit(0).cast("long").alias("before"))
    members, classes, done, block = [], [], 0, FIRST_BLOCK
    written: list[DataFrame] = []
    while True:
        here = turns.where((F.col("pos") > done) & (F.col("pos") <= done + block))
        own = here.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("turns"))
        step = lambda a, t: F.struct(
            F.unhex(F.sha2(F.concat(a["key"], t["digest"]), 256)).alias("key"), a["key"].alias("parent"), t["pos"].alias("depth"), t["bytes"].alias("bytes"), (a["before"] + a["bytes"]).alias("before")
        )
        # the path so far grows by one struct a turn; its last one holds the key
        begin = F.struct(F.col("key"), F.col("key").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), F.col("before"))
        path = F.aggregate("turns", F.array(begin), lambda acc, t: F.concat(acc, F.array(step(F.element_at(acc, -1), t))))
        seen = active.join(own, "conv").select("conv", F.explode(F.slice(path, 2, block)).alias("at")).select("conv", "at.*")
        seen = save(seen, "members")
        made = save(_classes(seen), "classes")
        members.append(seen)
        classes.append(made)
        done += block
        # a class of one member is retired with its member; others that have turns left go on
        alone = made.where("n = 1").select("conv").distinct()
        last = seen.where(F.col("depth") == done).join(alone, "conv", "left_anti")
        active = save(last.select("conv", "key", (F.col("before") + F.col("bytes")).alias("before")), "active")
        written.append(active)
        if active.isEmpty():
            break
        block = min(2 * block, LONGEST_BLOCK)
    drop(*written)
    return members, classes


def _hash_in_order(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv): hash of the ids of each key in ascending order, comma-joined."""
    spark = ends.sparkSession
    kind = ends.schema["conv"].dataType

    def join(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        now, first, part, size = None, None, [], 0
        for keys, ids in batches:
            out: list[list] = [[], [], []]
            for k, i in zip(keys, ids):
                if k != now or size > PIECE:
                    if part:
                        out[0].append(now), out[1].append(first), out[2].append(",".join(part))
                    now, first, part, size = k, i, [], 0
                part.append(str(i))
                size += len(part[-1]) + 1
            yield out
        if part:
            yield [[now], [first], [",".join(part)]]

    def digest(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        now, state = None, None
        for keys, _, parts in batches:
            out: list[list] = [[], []]
            for k, p in zip(keys, parts):
                if k != now:
                    if state is not None:
                        out[0].append(now), out[1].append(state.hexdigest())
                    now, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(p.encode())
            yield out
        if state is not None:
            yield [[now], [state.hexdigest()]]

    key = T.StructField("key", T.BinaryType())
    placed = ends.repartitionByRange(shuffle_partitions(spark), "key", "conv").sortWithinPartitions("key", "conv")
    pieces = map_columns(placed.select("key", "conv"), join, T.StructType([key, T.StructField("first", kind), T.StructField("part", T.StringType())]))
    lined = pieces.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "first")
    return map_columns(lined, digest, T.StructType([key, T.StructField("ends_sha256", T.StringType())]))


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie over ``turns`` (conv, pos, digest, bytes) of conversations ``lengths`` (conv, n).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256):
    a node goes by its smallest member; ``saved_tokens`` counts the bytes of last texts that
    storing the subtree's shared turns once saves; ``ends_sha256`` is over the members that end here.
    """
    members, classes = _refine(turns, lengths)
    seen, made = members[0], classes[0]
    for m, c in zip(members[1:], classes[1:]):
        seen, made = seen.unionByName(m), made.unionByName(c)
    none = F.lit(0).cast("long")
    top = lengths.select("conv", _root().alias("key"), F.lit(None).cast("binary").alias("parent"), none.alias("depth"), none.alias("bytes"), none.alias("before"))
    seen = seen.unionByName(top)
    children = made.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    shared = made.where("n > 1").unionByName(_classes(top).where("n > 0"))
    shared = save(shared.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", none)), "shared")
    # a conversation is retired where it first is a class of its own; of shared nodes it owns those whose smallest member it is
    alone = made.where("n = 1").groupBy("conv").agg(F.min_by(F.struct("depth", "before", "parent"), "depth").alias("retired"))
    owns = shared.groupBy("conv").agg(F.min_by(F.struct("depth", "before"), "depth").alias("first"))
    leaf = shared.where("n_children = 0").select("conv", F.col("depth").alias("n"), F.lit(True).alias("leaf"))
    totals = turns.groupBy("conv").agg(F.sum("bytes").alias("total"))
    facts = lengths.join(totals, "conv", "left").join(alone, "conv", "left").join(owns, "conv", "left").join(leaf, ["conv", "n"], "left")
    total, start = F.coalesce("total", none), F.coalesce("first.before", "retired.before")
    facts = facts.select("conv", "n", total.alias("total"), "retired", F.when(start.isNotNull(), total - start).otherwise(none).alias("owned"), (F.col("retired").isNotNull() | F.col("leaf").isNotNull()).cast("long").alias("leaf"))
    facts = save(facts, "facts")
    # folded back: every member brings what it owns to all nodes of its shared path
    brought = seen.select("conv", "key").join(facts.select("conv", "owned", "leaf", "total"), "conv")
    brought = brought.groupBy("key").agg(F.sum("owned").alias("owned"), F.sum("leaf").alias("n_leaves"), F.sum("total").alias("all_bytes"), F.min_by(F.struct("owned", "total"), "conv").alias("least"))
    ends = save(facts.join(seen.select("conv", "key", F.col("depth").alias("n")), ["conv", "n"]).select("key", "conv"), "ends")
    counts = ends.groupBy("key").agg(F.count("*").alias("n_ends"), F.min("conv").alias("end"))
    hashes = save(_hash_in_order(ends.join(counts.where("n_ends > 1").select("key"), "key", "left_semi")), "hashes")
    names = shared.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv").cast("long").alias("parent_conv_id"))
    nodes = shared.join(brought, "key").join(counts, "key", "left").join(hashes, "key", "left").join(names, "parent", "left")
    # bytes of all members from here on, less those of the nodes below, each once
    once = F.col("owned") - F.col("least.owned") + F.col("least.total") - F.col("before")
    digest = lambda c: F.sha2(F.col(c).cast("string").cast("binary"), 256)
    nodes = nodes.select(
        *[F.col("conv").cast("long").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves"],
        (F.col("all_bytes") - F.col("n") * F.col("before") - once).alias("saved_tokens"),
        F.when(F.col("n_ends").isNull(), F.lit(_EMPTY)).when(F.col("n_ends") == 1, digest("end")).otherwise(F.col("ends_sha256")).alias("ends_sha256"),
    )
    # the tail of a retired conversation is a chain; its first node hangs on a shared one
    alone = facts.where("retired is not null").select("conv", "n", F.col("retired.depth").alias("from"), F.col("retired.parent").alias("parent"))
    tails = turns.join(alone.join(names, "parent").select("conv", "n", "from", "parent_conv_id"), "conv").where("pos >= from")
    conv, one, last = F.col("conv").cast("long"), F.lit(1).cast("long"), F.col("pos") == F.col("n")
    chains = tails.select(
        *[conv.alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("from"), F.col("parent_conv_id")).otherwise(conv).alias("parent_conv_id"), one.alias("n_convs")],
        *[F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), F.when(last, digest("conv")).otherwise(F.lit(_EMPTY)).alias("ends_sha256")],
    )
    out = save(nodes.unionByName(chains), "trie")
    drop(*members, *classes, shared, facts, ends, hashes)
    return out


def conversation_trie(rows: DataFrame, heads: Column | None = None, bases: Column | None = None, most: int = 0, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of all conversations of ``rows``; with ``heads`` and ``bases`` after ``rebuild``."""
    turns = number_turns(rows, conv, turn, role, text)
    if heads is None:
        lengths = save(turns.groupBy("conv").agg(F.count("*").alias("n")), "lengths")
        out = trie(turns, lengths)
        drop(turns, lengths)
        return out
    built, lengths = rebuild(turns, heads, bases, most)
    out = trie(built, lengths)
    drop(turns, built, lengths)
    return out
