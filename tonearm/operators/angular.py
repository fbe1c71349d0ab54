"""Exact similarity of unit vectors with an index of pivots: pairs above a threshold, nearest neighbours.

Angles obey the triangle inequality. A vector lies with its nearest pivot; vectors in
the order of (pivot, angle to it) are cut into blocks, and some blocks in a row are a
group. A block and a group keep the least and the largest angle of their vectors to
every pivot. Two of them whose intervals lie farther apart at some pivot than the wanted
angle hold no wanted pair and never meet. What is left is a product of two groups in one
task: a group travels to the groups that it meets, not to every block.

Vectors must have length one; ``SLACK`` covers what single precision leaves of that.
Null vectors are in no pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import durable, store

#: Pivots; vectors of a block; blocks of a group.
PIVOTS, ROWS, BLOCKS = 32, 1024, 8
#: Vectors that are looked at for one pivot; groups that give a group of queries its first candidates.
SAMPLE, SEEDS = 16, 3
#: Angle by which a bound may be wrong.
SLACK = 2e-3


def pivots_of(vectors: DataFrame, key: str, vector: str, most: int = PIVOTS) -> np.ndarray:
    """Up to ``most`` vectors that lie far apart, near ones next to each other.

    They are chosen among ``SAMPLE`` vectors a pivot, taken by a hash of their keys; this
    bounded number comes to the driver.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(vector).alias("v")).orderBy("h").limit(most * SAMPLE).collect()
    x = np.array([r.v for r in rows], np.float64)
    if not len(x):
        return x
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(most, len(x)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    line = [chosen.pop(0)]
    while chosen:
        line.append(chosen.pop(int((x[chosen] @ x[line[-1]]).argmax())))
    return x[line]


def index(vectors: DataFrame, key: str, vector: str, pivots: np.ndarray, rows: int = ROWS, blocks: int = BLOCKS) -> DataFrame:
    """(block, group, n, keys, flat, low, high), written: blocks of neighbouring vectors and their angles to the pivots."""
    kind = vectors.schema[key].dataType.simpleString()

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.asarray(b.column(1).flatten(), np.float64)
            a = np.arccos(np.clip(flat.reshape(b.num_rows, -1) @ pivots.T, -1, 1)) if b.num_rows else np.zeros((0, len(pivots)))
            near = a.argmin(axis=1) if b.num_rows else np.zeros(0, int)
            offsets = pa.array(np.arange(b.num_rows + 1) * len(pivots), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int32()), pa.array(a[np.arange(len(near)), near]), pa.ListArray.from_arrays(offsets, pa.array(a.ravel()))], ["k", "v", "near", "angle", "angles"])

    clean = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    placed = clean.mapInArrow(angles, f"k {kind}, v array<double>, near int, angle double, angles array<double>")
    numbered = store.number_rows(placed, [F.col("near"), F.col("angle"), F.col("k")], "rn")
    of = numbered.withColumn("block", F.expr(f"(rn - 1) div {rows}"))
    span = [f([F.col("angles")[p] for p in range(len(pivots))]) for f in (lambda c: [F.min(x) for x in c], lambda c: [F.max(x) for x in c])]
    found = of.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("m"), *[(F.array(*x) if x else F.array().cast("array<double>")).alias(n) for x, n in zip(span, ("low", "high"))])
    return durable.written(found.select("block", F.expr(f"block div {blocks}").alias("group"), F.size("m").alias("n"), F.col("m.k").alias("keys"), F.flatten("m.v").alias("flat"), "low", "high"))


def groups(blocks: DataFrame, *more: Column) -> DataFrame:
    """(group, low, high, ...): what the blocks of a group span together."""
    at = lambda f, c: F.aggregate(F.collect_list(c), F.element_at(F.collect_list(c), 1), lambda a, b: F.zip_with(a, b, lambda x, y: f(x, y)))
    return blocks.groupBy("group").agg(at(F.least, "low").alias("low"), at(F.greatest, "high").alias("high"), *more)


def apart(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """The least angle that vectors of two spans can have."""
    gap = F.zip_with(F.zip_with(low_a, high_b, lambda x, y: x - y), F.zip_with(low_b, high_a, lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    return F.greatest(F.lit(0.0), F.coalesce(F.array_max(gap), F.lit(0.0)))


def _bound(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> float:
    return max(0.0, float(np.maximum(low_a - high_b, low_b - high_a).max(initial=0.0)))


_BLOCK = ["block", "n", "keys", "flat", "low", "high"]


def _meet(met: DataFrame, left: DataFrame, right: DataFrame, product: Callable, schema: str, extra: str | None = None) -> DataFrame:
    """``product`` of the left blocks of a pair of groups (i, j) with each right block.

    A task holds one group's left blocks and meets the right ones as they come.
    """
    more = F.col(extra) if extra else F.lit(0.0)
    of = lambda blocks, side, at, x: met.join(blocks.select(F.col("group").alias(at), *_BLOCK, x.alias("extra")), at).select("i", "j", F.lit(side).alias("side"), *_BLOCK, "extra")
    rows = of(left, 0, "i", more).unionByName(of(right, 1, "j", F.lit(0.0)))
    dealt = rows.repartition("i", "j").sortWithinPartitions("i", "j", "side", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            i, j, side = (b.column(c).to_pylist() for c in range(3))
            for r in range(b.num_rows):
                if (i[r], j[r]) != now:
                    now, held = (i[r], j[r]), []
                block, n, keys, flat, low, high, x = (b.column(c)[r] for c in range(3, 10))
                one = (block.as_py(), keys.values, np.asarray(flat.values, np.float64).reshape(n.as_py(), -1), np.asarray(low.values), np.asarray(high.values), x.as_py())
                if not side[r]:
                    held.append(one)
                    continue
                for other in held:
                    yield from product(now, other, one)

    return dealt.mapInArrow(run, schema)


def similar_pairs(vectors: DataFrame, key: str, vector: str, threshold: float, rows: int = ROWS, blocks: int = BLOCKS, met: list | None = None) -> DataFrame:
    """(a, b, sim) for a < b with dot product >= threshold.

    ``met`` takes the number of group pairs that met and of all there are (for tests and reports).
    """
    kind = vectors.schema[key].dataType.simpleString()
    held = index(vectors, key, vector, pivots_of(vectors, key, vector), rows, blocks)
    span = groups(held)
    far = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    g, h = (span.select(F.col("group").alias(n), F.col("low").alias(f"low_{n}"), F.col("high").alias(f"high_{n}")) for n in "ij")
    cells = durable.written(g.join(h, F.col("i") <= F.col("j")).where(apart(F.col("low_i"), F.col("high_i"), F.col("low_j"), F.col("high_j")) <= far).select("i", "j"))
    if met is not None:
        n = span.count()
        met += [cells.count(), n * (n + 1) // 2]

    def product(now, a, b):
        if (now[0] == now[1] and a[0] > b[0]) or _bound(a[3], a[4], b[3], b[4]) > far:
            return
        s = a[2] @ b[2].T
        p, q = np.nonzero(np.triu(s >= threshold, 1) if a[0] == b[0] else s >= threshold)
        x, y = a[1].take(pa.array(p)), b[1].take(pa.array(q))
        swap = pa.compute.greater(x, y)
        yield pa.RecordBatch.from_arrays([pa.compute.if_else(swap, y, x), pa.compute.if_else(swap, x, y), pa.array(s[p, q])], ["a", "b", "sim"])

    return _meet(cells, held, held, product, f"a {kind}, b {kind}, sim double")


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, rows: int = ROWS, blocks: int = BLOCKS, met: list | None = None) -> DataFrame:
    """(q, key, sim, rank): the k nearest other vectors of each query; equal similarities go to the lesser key.

    Any number of queries. First each group of queries meets the ``SEEDS`` groups of vectors
    that lie nearest by their bounds, which gives every query a k-th similarity; then it
    meets all groups that the worst of these does not rule out. A task keeps k candidates a query.
    """
    kind = vectors.schema[key].dataType.simpleString()
    pivots = pivots_of(vectors, key, vector)
    asked, held = index(queries, key, vector, pivots, rows, blocks), index(vectors, key, vector, pivots, rows, blocks)

    def product(now, a, b):
        if a[5] is not None and _bound(a[3], a[4], b[3], b[4]) > a[5]:
            return
        s = a[2] @ b[2].T
        own, other = np.asarray(a[1]), np.asarray(b[1])
        s[own[:, None] == other[None, :]] = -np.inf
        out = ([], [], [])
        for r in range(len(own)):
            line = s[r]
            at = np.nonzero(line >= np.partition(line, -k)[-k])[0] if len(line) > k else np.arange(len(line))
            at = at[np.isfinite(line[at])]
            at = at[np.lexsort((other[at], -line[at]))][:k]
            out[0].append(np.full(len(at), r)), out[1].append(at), out[2].append(line[at])
        p, q = np.concatenate(out[0]), np.concatenate(out[1])
        yield pa.RecordBatch.from_arrays([a[1].take(pa.array(p)), b[1].take(pa.array(q)), pa.array(np.concatenate(out[2]))], ["q", "k", "sim"])

    schema = f"q {kind}, k {kind}, sim double"
    w = W.partitionBy("q").orderBy(F.col("sim").desc(), "k")
    best = lambda found: found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    a, b = (groups(x).select(F.col("group").alias(n), F.col("low").alias(f"low_{n}"), F.col("high").alias(f"high_{n}")) for x, n in ((asked, "i"), (held, "j")))
    bound = apart(F.col("low_i"), F.col("high_i"), F.col("low_j"), F.col("high_j"))
    middle = F.aggregate(F.zip_with(F.zip_with("low_i", "high_i", lambda x, y: x + y), F.zip_with("low_j", "high_j", lambda x, y: x + y), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    cells = durable.written(a.join(b, F.lit(True)).select("i", "j", bound.alias("bound"), middle.alias("middle")))
    near = F.row_number().over(W.partitionBy("i").orderBy("bound", "middle", "j"))
    first = durable.written(cells.withColumn("near", near).where(F.col("near") <= SEEDS).select("i", "j"))
    free = asked.withColumn("far", F.lit(None).cast("double"))
    seeds = durable.written(best(_meet(first, free, held, product, schema, "far")))
    # the angle of the k-th candidate, of the worst query of each block; a query with fewer has no bound
    reach = seeds.groupBy("q").agg(F.count("*").alias("n"), F.min("sim").alias("sim")).select("q", F.when(F.col("n") >= k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "sim"))) + SLACK).otherwise(F.lit(4.0)).alias("reach"))
    of = asked.select("block", "group", F.explode("keys").alias("q")).join(reach, "q", "left").groupBy("block", "group").agg(F.max(F.coalesce("reach", F.lit(4.0))).alias("far"))
    of = durable.written(of)
    wide = of.groupBy(F.col("group").alias("i")).agg(F.max("far").alias("far"))
    chosen = durable.written(cells.join(wide, "i").where(F.col("bound") <= F.col("far")).join(first, ["i", "j"], "left_anti").select("i", "j"))
    if met is not None:
        met += [chosen.count() + first.count(), cells.count()]
    rest = _meet(chosen, asked.join(of.select("block", "far"), "block"), held, product, schema, "far")
    out = durable.written(best(rest.unionByName(seeds.select("q", "k", "sim"))))
    durable.drop(cells, first, seeds, of, chosen, asked, held)
    return out.select("q", F.col("k").alias(key), "sim", "rank")
