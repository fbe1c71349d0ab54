"""A map of vectors in few dimensions that keeps neighbourhoods: fuzzy neighbour graph, spectral start, sampled forces.

Each vector's nearest neighbours get weights that fall with their distance beyond the
first one, scaled so that a vector's weights sum to the same; the two directions of an
edge are united as fuzzy sets. The start are the graph's smoothest coordinates, found by
power iteration on the edges. Epochs then move all points at once: along every edge
by its weight, and away from a few points drawn by hash. Points and edges stay
distributed; a step is joins on points and sums by point, written so that lineage ends.

Distances are one less the cosine; vectors have length one. A null vector has no place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import angular, durable, store

#: Neighbours, least distance on the map, points that push a point in an epoch.
NEIGHBOURS, MIN_DIST, PUSHES = 15, 0.12, 5
#: Rounds of the start and of the forces; width of the start; largest force along an axis.
POWER_ROUNDS, EPOCHS, WIDTH, MOST_FORCE = 12, 30, 10.0, 4.0


def curve(min_dist: float = MIN_DIST) -> tuple[float, float]:
    """(a, b) for which 1 / (1 + a x^2b) is nearest to one up to ``min_dist`` and an exponential fall from there."""
    x = np.linspace(0.01, 3, 300)
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist)))
    a, b, wide = 1.5, 1.0, 0.9
    for _ in range(12):
        tried = [(a * math.exp(wide * i / 4), b * math.exp(wide * j / 4)) for i in range(-4, 5) for j in range(-4, 5)]
        a, b = min(tried, key=lambda t: float(((1 / (1 + t[0] * x ** (2 * t[1])) - want) ** 2).sum()))
        wide /= 2
    return a, b


def fuzzy_edges(near: DataFrame, key: str, k: int) -> DataFrame:
    """(a, b, w) with a < b of neighbours (q, key, sim, rank): weights of the united directions."""
    kind = near.schema["q"].dataType.simpleString()
    lists = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", F.col(key).alias("k"), (1 - F.col("sim")).alias("d")))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            n, width = batch.num_rows, int(sizes.max(initial=0))
            d = np.full((n, width), np.inf)
            held = np.arange(width)[None, :] < sizes[:, None]
            d[held] = np.maximum(np.asarray(batch.column(2).flatten(), np.float64), 0)
            rho = np.where(np.isfinite(d) & (d > 1e-12), d, np.inf).min(axis=1, initial=np.inf)
            far = np.where(held, np.maximum(d - np.where(np.isfinite(rho), rho, 0)[:, None], 0), np.inf)
            low, high, sigma = np.zeros(n), np.full(n, np.inf), np.ones(n)
            for _ in range(64):
                more = np.exp(-far / sigma[:, None]).sum(axis=1) > math.log2(k)
                high, low = np.where(more, sigma, high), np.where(more, low, sigma)
                sigma = np.where(np.isfinite(high), (low + high) / 2, sigma * 2)
                sigma = np.clip(sigma, 1e-6, 1e6)
            w = np.exp(-far / sigma[:, None])[held]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(n), sizes))), batch.column(1).flatten(), pa.array(w)], ["q", "k", "w"])

    ways = lists.select("q", F.col("m.k").alias("k"), F.col("m.d").alias("d")).mapInArrow(run, f"q {kind}, k {kind}, w double")
    both = F.sum("w") - F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(0.0)
    return ways.groupBy(F.least("q", "k").alias("a"), F.greatest("q", "k").alias("b")).agg(both.alias("w"))


def _noise(node: Column, axis: int, seed: int = 0) -> Column:
    """A number in [-0.5, 0.5) by hash."""
    return F.pmod(F.xxhash64(node, F.lit(axis), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) - 0.5


def spectral_start(links: DataFrame, nodes: DataFrame, dims: int, rounds: int = POWER_ROUNDS) -> DataFrame:
    """(i, degree, c0...), written: the smoothest coordinates of the graph.

    ``links`` (i, j, w) has both directions. Power iteration on the lazy walk; the constant
    coordinate is taken off and coordinates are made orthogonal each round, for which sums of a
    few products come to the driver.
    """
    axes = [f"c{d}" for d in range(dims)]
    degree = links.groupBy("i").agg(F.sum("w").alias("degree"))
    now = durable.written(nodes.join(degree, "i", "left").select("i", F.coalesce("degree", F.lit(0.0)).alias("degree"), *[_noise(F.col("i"), d).alias(c) for d, c in enumerate(axes)]))
    for step in range(rounds + 1):
        # orthogonal to the constant and to each other, in the measure of the degrees
        pairs = [(x, y) for n, x in enumerate(axes) for y in axes[: n + 1]]
        sums = now.agg(F.sum("degree").alias("n"), *[F.sum(F.col("degree") * F.col(c)).alias(c) for c in axes], *[F.sum(F.col("degree") * F.col(x) * F.col(y)).alias(f"{x}{y}") for x, y in pairs]).first()
        if not sums["n"]:
            break
        mean = np.array([sums[c] / sums["n"] for c in axes])
        gram = np.zeros((dims, dims))
        for x, y in pairs:
            i, j = axes.index(x), axes.index(y)
            gram[i, j] = gram[j, i] = sums[f"{x}{y}"] / sums["n"] - mean[i] * mean[j]
        turn = np.linalg.inv(np.linalg.cholesky(gram + 1e-12 * np.eye(dims)))
        # rows of the triangular inverse give the new coordinates
        fresh = [sum((F.lit(float(turn[i, j])) * (F.col(axes[j]) - float(mean[j])) for j in range(i + 1)), F.lit(0.0)).alias(axes[i]) for i in range(dims)]
        straight = now.select("i", "degree", *fresh)
        if step == rounds:
            after = durable.written(straight)
        else:
            came = links.join(straight.select(F.col("i").alias("j"), *axes), "j").groupBy("i").agg(*[F.sum(F.col("w") * F.col(c)).alias(f"s_{c}") for c in axes])
            lazy = [F.when(F.col("degree") > 0, (F.col(c) + F.coalesce(F.col(f"s_{c}"), F.lit(0.0)) / F.col("degree")) / 2).otherwise(F.col(c)).alias(c) for c in axes]
            after = durable.written(straight.join(came, "i", "left").select("i", "degree", *lazy))
        durable.drop(now)
        now = after
    return now


def manifold_map(vectors: DataFrame, key: str, vector: str, dims: int = 2, neighbours: int = NEIGHBOURS, min_dist: float = MIN_DIST, epochs: int = EPOCHS) -> DataFrame:
    """(key, c0, c1, ...): a place on the map for each vector; the same rows give the same map."""
    axes = [f"c{d}" for d in range(dims)]
    near = angular.nearest(vectors, vectors, key, vector, neighbours)
    numbered = durable.written(store.number_rows(vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key")), [F.col("key")], "i"))
    count = numbered.count()
    if not count:
        return numbered.select(F.col("key").alias(key), *[F.lit(0.0).alias(c) for c in axes])
    number = lambda of, to: numbered.select(F.col("key").alias(of), F.col("i").alias(to))
    edges = durable.written(fuzzy_edges(near, key, neighbours).join(number("a", "i"), "a").join(number("b", "j"), "b").select("i", "j", "w"))
    links = durable.written(edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")))
    start = spectral_start(links, numbered.select("i"), dims)
    widest = start.agg(*[F.max(F.abs(c)) for c in axes]).first()
    now = durable.written(start.select("i", "degree", *[(F.col(c) * (WIDTH / max(max(widest), 1e-9)) + _noise(F.col("i"), d, 1) * 0.01).alias(c) for d, c in enumerate(axes)]))
    durable.drop(start)
    a, b = curve(min_dist)
    clip = lambda x: F.greatest(F.lit(-MOST_FORCE), F.least(F.lit(MOST_FORCE), x))
    for epoch in range(epochs):
        rate = 1.0 - epoch / epochs
        other = now.select(F.col("i").alias("j"), *[F.col(c).alias(f"o_{c}") for c in axes])
        pulled = links.join(now.select("i", *axes), "i").join(other, "j")
        draws = F.transform(F.sequence(F.lit(1), F.lit(PUSHES)), lambda r: F.pmod(F.xxhash64("i", r, F.lit(epoch)), F.lit(count)) + 1)
        pushed = now.select("i", *axes, F.col("degree").alias("w"), F.explode(draws).alias("j")).where("i <> j").join(other, "j")
        square = sum(((F.col(c) - F.col(f"o_{c}")) * (F.col(c) - F.col(f"o_{c}")) for c in axes), F.lit(0.0))
        power = F.lit(a) * F.pow("d2", F.lit(b))
        pull = F.when(F.col("d2") > 0, -2.0 * a * b * F.pow("d2", F.lit(b - 1.0)) / (1 + power)).otherwise(0.0)
        push = 2.0 * b / ((0.001 + F.col("d2")) * (1 + power))
        force = lambda rows, by: rows.withColumn("d2", square).select("i", *[(F.col("w") * clip(by * (F.col(c) - F.col(f"o_{c}")))).alias(c) for c in axes])
        total = force(pulled, pull).unionByName(force(pushed, push)).groupBy("i").agg(*[F.sum(c).alias(f"f_{c}") for c in axes])
        after = durable.written(now.join(total, "i", "left").select("i", "degree", *[(F.col(c) + rate * clip(F.coalesce(F.col(f"f_{c}"), F.lit(0.0)))).alias(c) for c in axes]))
        durable.drop(now)
        now = after
    out = durable.written(numbered.join(now, "i").select(F.col("key").alias(key), *axes))
    durable.drop(numbered, edges, links, now)
    return out
