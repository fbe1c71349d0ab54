"""Near-duplicate vectors by random-hyperplane sign hashing.

Equal vectors of one label are one class with a count. Each class is hashed by the
signs of ``bits`` random hyperplanes in each of several tables; vectors that share a
label and a code in a table are compared by exact cosine in double precision, in blocks
of bounded size, by matrix product. A pair that an earlier table has met is left to
that table, so links are counted once without ever writing pairs: a block gives each of
its vectors a count and one edge to the least vector of its part of the block.
Components of these edges are found distributed.

The number of bits follows the number of vectors so that codes hold a few vectors each,
and the number of tables follows from the bits so that a pair right at the threshold is
met with probability ``recall`` at least (nearer pairs more often).

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label, link with nothing and stay; vectors of different
lengths never link; repeated rows are copies that link with each other; a null key never
names a component; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import map_columns, require, save

#: Classes of one code per block.
BLOCK = 1024


def hashing(vectors: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables) for so many vectors."""
    bits = min(30, max(6, round(math.log2(max(vectors, 1) / 128))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def sign_codes(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """One code per vector (row) and table."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ planes >= 0).reshape(len(vectors), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def block_links(left: np.ndarray, right: np.ndarray | None, codes: np.ndarray, counts: np.ndarray, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) per vector of a block or pair of blocks.

    ``codes`` and ``counts`` are those of left, then right. root: the least index that
    the vector reaches inside; pairs that an earlier table has met are left out.
    """
    n = len(codes)
    if right is None:
        p, q = np.nonzero(np.triu(left @ left.T >= threshold, 1))
    else:
        p, q = np.nonzero(left @ right.T >= threshold)
        q = q + len(left)
    if table and len(p):
        new = np.ones(len(p), bool)
        for t in range(table):
            new &= codes[p, t] != codes[q, t]
        p, q = p[new], q[new]
    links = np.bincount(p, counts[q], n) + np.bincount(q, counts[p], n)
    root = np.arange(n)
    while len(p):
        before = root.copy()
        np.minimum.at(root, p, root[q])
        np.minimum.at(root, q, root[p])
        root = root[root]
        if (root == before).all():
            break
    return links.astype(np.int64), root


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, recall: float = 0.99, seed: int = 7) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of ``vectors``."""
    require(vectors, key, vector, label)
    key_type, label_type = vectors.schema[key].dataType, vectors.schema[label].dataType
    # components travel as they are stored; cosines are taken in double precision
    kind = np.dtype("<f4") if isinstance(getattr(vectors.schema[vector].dataType, "elementType", None), T.FloatType) else np.dtype("<f8")
    told_schema = T.StructType([T.StructField("key", key_type), T.StructField("label", label_type), T.StructField("class_id", T.BinaryType()), T.StructField("vec", T.BinaryType())])

    def describe(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, vecs, labels in batches:
            ids, raws = [], []
            for v, lab in zip(vecs, labels):
                raw = None
                if v and lab is not None and None not in v:
                    a = np.array(v, np.float64)
                    size = np.abs(a).max()
                    if np.isfinite(size) and size > 0:
                        raw = a.astype(kind).tobytes()
                ids.append(raw and xxhash.xxh3_128_digest(f"{lab}\0".encode() + raw))
                raws.append(raw)
            yield [keys, labels, ids, raws]

    told = save(map_columns(vectors.select(vectors[key], vectors[vector], vectors[label]), describe, told_schema), "vectors")
    found = told.where("class_id is not null")
    one = found.groupBy("class_id").agg(F.min("key").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    one = one.select(F.monotonically_increasing_id().alias("node"), "class_id", "rep", "copies", "label", "vec")
    bits, tables = hashing(found.count(), threshold, recall)
    class_schema = T.StructType([*one.schema.fields, T.StructField("codes", T.ArrayType(T.IntegerType()))])

    def hash_codes(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for columns in batches:
            codes: list = [None] * len(columns[0])
            rows = [np.frombuffer(v, kind).astype(np.float64) for v in columns[5]]
            for size in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == size]
                unit = np.array([rows[i] / np.abs(rows[i]).max() for i in at])
                for i, c in zip(at, sign_codes(unit, bits, tables, seed).tolist()):
                    codes[i] = c
            yield [*columns, codes]

    classes = save(map_columns(one, hash_codes, class_schema), "vectors")
    # lengths are kept apart with the labels
    filed = classes.select("node", "label", F.octet_length("vec").alias("size"), F.posexplode("codes").alias("table", "code"))
    at = ["table", "label", "size", "code"]
    shared = filed.groupBy(at).agg(F.count("*").alias("n")).where("n > 1").select(*at, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = filed.join(shared, at).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(*at, F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node")
    rows = rows.join(classes.select("node", "copies", "codes", "vec"), "node")
    group = [*at, "i", "j"]
    dealt = rows.select(*group, "block", "node", "copies", "codes", "vec").repartition(*group).sortWithinPartitions(*group)

    def links_of(members: list[tuple]) -> tuple[list, list, list]:
        table, i, j = members[0][0], members[0][4], members[0][5]
        members = sorted(members, key=lambda r: (r[6] != i, r[7]))
        unit = np.array([np.frombuffer(r[10], kind) for r in members]).astype(np.float64)
        unit /= np.abs(unit).max(axis=1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        cut = sum(r[6] == i for r in members)
        codes = np.array([r[9] for r in members], np.int32)
        copies = np.array([r[8] for r in members], np.float64)
        links, root = block_links(unit[:cut], None if i == j else unit[cut:], codes, copies, table, threshold)
        some = np.flatnonzero(links)
        return [members[k][7] for k in some], links[some].tolist(), [members[root[k]][7] for k in some]

    def compare(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        members: list[tuple] = []
        for columns in batches:
            out: tuple[list, list, list] = [], [], []
            for row in zip(*columns):
                if members and row[:6] != members[0][:6]:
                    if len(members) > 1:
                        for to, x in zip(out, links_of(members)):
                            to.extend(x)
                    members = []
                members.append(row)
            yield list(out)
        if len(members) > 1:
            yield list(links_of(members))

    links = save(map_columns(dealt, compare, T.StructType([T.StructField(c, T.LongType()) for c in ("node", "links", "root")])), "links")
    joined = connected_components(links, "node", "root")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "class_id", "rep", "copies").join(counts, "node", "left").join(joined, "node", "left")
    named = named.select("class_id", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component").select("class_id", "n_links", "least")
    out = found.select("key", "class_id").join(named, "class_id").select("key", "n_links", F.col("least").alias("component_id"))
    out = out.unionByName(told.where("class_id is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
