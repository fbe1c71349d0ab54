"""The pivot index, segmentation by rounds, ridge from moments and density clusters against plain programs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.operators import angular, clusters, density, layout, ridge
from tonearm.plans import catalogue, vector_queries
from tonearm.sources.views import vectors


def blobs(rng, centres, n, spread, d=16):
    c = rng.normal(size=(centres, d))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, vec array<double>").repartition(3)


def test_pairs_by_pivots_skip_groups_and_lose_none(spark):
    rng = np.random.default_rng(1)
    x = blobs(rng, 12, 600, 0.02)
    x[100:140] = x[100]
    ids = np.arange(600) * 7 % 601
    df = frame(spark, ids, x).unionByName(spark.createDataFrame([(9999, None)], "id long, vec array<double>"))
    met = []
    got = {(r.a, r.b): r.sim for r in angular.similar_pairs(df, "id", "vec", 0.98, rows=10, blocks=2, met=met).collect()}
    s = x @ x.T
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])): s[i, j] for i in range(600) for j in range(i) if s[i, j] >= 0.98}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert met[0] < met[1] / 2, met
    assert angular.similar_pairs(df.limit(0), "id", "vec", 0.9).collect() == []


@pytest.mark.parametrize("k", [3, 50])
def test_neighbours_by_pivots(spark, k):
    rng = np.random.default_rng(2)
    x = blobs(rng, 20, 500, 0.02)
    ids = np.arange(500)
    df = frame(spark, ids, x)
    met = []
    got = {}
    for r in angular.nearest(df.where("id % 3 = 0"), df, "id", "vec", k, rows=16, blocks=1, met=met).collect():
        got.setdefault(r.q, []).append((r["rank"], r.id))
    s = x @ x.T
    np.fill_diagonal(s, -9)
    assert got == {i: [(n + 1, int(j)) for n, j in enumerate(np.argsort(-s[i], kind="stable")[:k])] for i in range(0, 500, 3)}
    if k == 3:
        assert met[0] < 0.6 * met[1], met
    few = angular.nearest(df.where("id < 2"), df.where("id < 3"), "id", "vec", k).collect()
    assert sorted((r.q, r.id) for r in few) == [(0, 1), (0, 2), (1, 0), (1, 2)]


def plain_leaves(tempos, tolerance=0.08):
    leaves, now = [], []
    for b in sorted(tempos):
        mean = sum(now + [b]) / (len(now) + 1)
        if now and any(abs(x - mean) / mean > tolerance for x in now + [b]):
            leaves.append(now)
            now = []
        now.append(b)
    return leaves + [now] if now else leaves


def test_segments_of_a_hot_folder(spark):
    rng = np.random.default_rng(3)
    folders = {"hot": rng.integers(60, 185, 3000).tolist(), "same": [120.0] * 400, "one": [99.5], "steps": [100.0, 100.0, 109.0, 117.5, 117.5, 117.5, 127.0], "fine": (80 + 100 * rng.random(300)).round(2).tolist(), None: [60.0]}
    rows = [(f, i, float(b)) for f, t in folders.items() for i, b in enumerate(t)] + [("hot", 10**6, None), ("hot", 10**6 + 1, 0.0)]
    df = spark.createDataFrame(rows, "folder string, track long, bpm double").repartition(4)
    got = clusters.tempo_segments(df).join(df, ["folder", "track"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan
    got = got.toPandas()
    assert (got[got.track >= 10**6].name == "unknown-bpm").all() and len(got) == len(rows) - 1
    for f, tempos in folders.items():
        own = got[(got.folder == f) & (got.track < 10**6)]
        if f is None:
            continue
        leaves = plain_leaves([float(t) for t in tempos])
        assert [sorted(g.bpm) for _, g in own.groupby("leaf")] == leaves
        seen, names = {}, []
        for leaf in leaves:
            n = f"{round(sum(leaf) / len(leaf))}bpm"
            seen[n] = seen.get(n, 0) + 1
            names.append(n if seen[n] == 1 else f"{n}-{seen[n]}")
        assert own.groupby("leaf").name.first().tolist() == names
    assert clusters.tempo_segments(df.limit(0)).collect() == []


def test_places_of_a_folder_in_several_partitions(spark):
    df = spark.range(1000).select(F.lit("f").alias("folder"), F.col("id").alias("track"), (60 + F.col("id") % 100).cast("double").alias("bpm"))
    placed = clusters.place_in_folder(df).orderBy("pos").collect()
    assert [r.pos for r in placed] == list(range(1, 1001))
    assert [(r.bpm, r.track) for r in placed] == sorted((r.bpm, r.track) for r in placed)
    assert [r.cum for r in placed] == np.cumsum([r.bpm for r in placed]).tolist()


def plain_ridge(x, y, alpha=1.0):
    mx, my = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return my - mx @ w, w


def target_table(spark, sf_dir):
    rows = sorted((r.vec_id, r.label, r.vec) for r in vectors(spark, sf_dir).collect())
    ids, label, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    return ids, label, x, label + 3 * x[:, 0]


def test_ridge_queries_against_one_fit_each(spark, sf_dir):
    ids, label, x, y = target_table(spark, sf_dir)
    _, w = plain_ridge(x[ids % 5 != 0], y[ids % 5 != 0])
    got = {r.pos: r.weight for r in catalogue.QUERIES["ridge_direction"](spark, sf_dir).collect()}
    assert np.allclose([got[i] for i in range(64)], w / np.linalg.norm(w), atol=1e-9)
    got = {r.label: (r.n, r.error) for r in catalogue.QUERIES["leave_one_group_out"](spark, sf_dir).collect()}
    for g in set(label):
        b, w = plain_ridge(x[label != g], y[label != g])
        assert got[g][0] == (label == g).sum() and abs(got[g][1] - np.abs(b + x[label == g] @ w - y[label == g]).mean()) < 1e-9
    assert len(got) == len(set(label))
    b, w = plain_ridge(x[ids % 4 != 0], y[ids % 4 != 0])
    got = {r.vec_id: r.score for r in catalogue.QUERIES["impute_from_embedding"](spark, sf_dir).collect()}
    assert np.allclose([got[i] for i in ids], np.where(ids % 4 != 0, y, b + x @ w), atol=1e-9)
    b, w = plain_ridge(x[ids % 5 != 0], y[ids % 5 != 0])
    order = lambda a: np.array([(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a])
    rho = catalogue.QUERIES["spearman_heldout"](spark, sf_dir).first().rho
    assert abs(rho - np.corrcoef(order(b + x[ids % 5 == 0] @ w), order(y[ids % 5 == 0]))[0, 1]) < 1e-9


def test_moments_of_many_groups_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ridge, "HELD", 3)
    rng = np.random.default_rng(4)
    x, y, g = rng.normal(size=(200, 3)), rng.normal(size=200), rng.integers(0, 20, 200)
    rows = [(f"g{k}" if k else None, v.tolist(), float(t)) for k, v, t in zip(g, x, y)] + [("g1", None, 1.0), ("g2", [1.0, 2.0, 3.0], None)]
    df = spark.createDataFrame(rows, "g string, v array<double>, y double").repartition(3)
    got = {r.group: r for r in ridge.fits_without(df, "v", "y", F.col("g")).collect()}
    assert len(got) == len(set(g))
    for k in set(g):
        b, w = plain_ridge(x[g != k], y[g != k])
        r = got[f"g{k}" if k else None]
        assert abs(r.offset - b) < 1e-9 and np.allclose(r.direction, w, atol=1e-9)
    lone = ridge.fits_without(df.where("g = 'g1'"), "v", "y", F.col("g")).collect()
    assert [(r.offset, r.direction) for r in lone] == [(0.0, [0.0] * 3)]
    with pytest.raises(ValueError):
        ridge.fit(df.limit(0), "v", "y")


def plain_density(x, least, samples):
    """Leaf clusters top down: the heaviest edge of a component goes first."""
    n = len(x)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    order = np.argsort(-s, axis=1, kind="stable")[:, :samples]
    core = 1 - s[np.arange(n), order[:, -1]]
    edges = {(min(i, j), max(i, j)): max(core[i], core[j], 1 - s[i, j]) for i in range(n) for j in order[i].tolist()}
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    tree = []
    for w, (a, b) in sorted((w, e) for e, w in edges.items()):
        if top(a) != top(b):
            up[top(a)] = top(b)
            tree.append((w, a, b))

    def parts(nodes, kept):
        left, out = set(nodes), []
        links = {}
        for _, a, b in kept:
            links.setdefault(a, []).append(b), links.setdefault(b, []).append(a)
        while left:
            stack, seen = [left.pop()], set()
            while stack:
                i = stack.pop()
                seen.add(i)
                stack += [j for j in links.get(i, []) if j in left and not left.discard(j)]
            out.append(seen)
        return out

    found = []

    def descend(cluster, nodes, kept):
        # ``cluster``: the points at its birth; ``nodes``: those still joined
        kept = sorted(kept)
        while kept:
            kept = kept[:-1]
            big = [p for p in parts(nodes, kept) if len(p) >= least]
            if len(big) > 1:
                for p in big:
                    descend(p, p, [e for e in kept if e[1] in p])
                return
            if not big:
                break
            nodes = big[0]
            kept = [e for e in kept if e[1] in nodes]
        if cluster is not None:
            found.append(cluster)

    roots = [p for p in parts(range(n), tree) if len(p) >= least]
    for p in roots:
        descend(p if len(roots) > 1 else None, p, [e for e in tree if e[1] in p])
    return {i: min(c) for c in found for i in c}


@pytest.mark.parametrize("most", [100_000, 50])
def test_density_clusters_of_blobs_and_noise(spark, most):
    rng = np.random.default_rng(6)
    x = np.vstack([blobs(rng, 4, 90, 0.07, 8), blobs(rng, 20, 20, 0.5, 8)])
    x[10:22] = x[10]
    want = plain_density(x, 8, 4)
    assert len(set(want.values())) >= 3 and len(want) < len(x)
    got = {r.id: r for r in density.density_clusters(frame(spark, range(len(x)), x), "id", "vec", least=8, samples=4, votes=3, most=most).collect()}
    assert {i: r.cluster for i, r in got.items() if not r.noise} == want
    held = sorted(want)
    for i, r in got.items():
        if r.noise:
            near = sorted(held, key=lambda j: (-(x[i] @ x[j]), j))[:3]
            votes = [want[j] for j in near]
            assert r.cluster == min(set(votes), key=lambda c: (-votes.count(c), c))


def test_one_blob_never_splits(spark):
    x = blobs(np.random.default_rng(7), 1, 60, 0.1, 8)
    rows = density.density_clusters(frame(spark, range(60), x), "id", "vec", least=40, samples=3).collect()
    assert len(rows) == 60 and all(r.cluster is None and r.noise for r in rows)
    assert density.density_clusters(frame(spark, range(60), x).limit(0), "id", "vec").collect() == []


def test_density_query_against_a_plain_one(spark, sf_dir):
    ids, _, x, _ = target_table(spark, sf_dir)
    plain = plain_density(x, vector_queries.CLUSTER_LEAST, vector_queries.CLUSTER_SAMPLES)
    got = {r.vec_id: r for r in catalogue.QUERIES["density_clusters"](spark, sf_dir).collect()}
    assert got.keys() == set(ids.tolist())
    assert {i: r.cluster for i, r in got.items() if not r.noise} == {ids[i]: ids[c] for i, c in plain.items()}


def trustworthiness(x, y, k=8):
    n, far, near = len(x), 1 - x @ x.T, ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(far, np.inf), np.fill_diagonal(near, np.inf)
    rank = far.argsort(axis=1).argsort(axis=1)
    missed = sum(max(0, rank[i, j] + 1 - k) for i in range(n) for j in near[i].argsort()[:k])
    return 1 - 2 * missed / (n * k * (2 * n - 3 * k - 1))


def test_map_keeps_neighbours_better_than_principal_components(spark):
    x = blobs(np.random.default_rng(8), 8, 160, 0.12)
    df = frame(spark, range(160), x).unionByName(spark.createDataFrame([(999, None)], "id long, vec array<double>"))
    got = {r.id: (r.c0, r.c1) for r in layout.manifold_map(df, "id", "vec", neighbours=10, epochs=12).collect()}
    assert sorted(got) == list(range(160))
    centred = x - x.mean(axis=0)
    linear = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    assert trustworthiness(x, np.array([got[i] for i in range(160)])) > trustworthiness(x, linear) + 0.01
    assert layout.manifold_map(df.limit(0), "id", "vec").collect() == []


def test_fuzzy_weights_sum_to_the_same(spark):
    a, b = layout.curve(0.1)
    assert abs(a - 1.577) < 0.01 and abs(b - 0.895) < 0.01
    near = [(q, q * 100 + r, 0.9 - 0.01 * r * (q + 1), r) for q in range(1, 4) for r in range(1, 9)] + [(9, 10, 1.0, 1), (10, 9, 1.0, 1)]
    rows = layout.fuzzy_edges(spark.createDataFrame(near, "q long, id long, sim double, rank int"), "id", 8).collect()
    for q in range(1, 4):
        # each of these edges has one direction
        assert abs(sum(r.w for r in rows if r.a == q) - 3) < 1e-6
    assert [r.w for r in rows if (r.a, r.b) == (9, 10)] == [1.0]
