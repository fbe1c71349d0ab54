import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonearm.llm import ngram_join, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    return set(zip(*[w[i:] for i in range(n)])) if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k is None, k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows))


def run(spark, rows, n, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(5)
    got = ngram_join.ngram_jaccard_components(docs, n=n, percent=percent).collect()
    return sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in got)


def near_copies(seed, bases, copies, words):
    rnd = random.Random(seed)
    out = []
    for _ in range(bases):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(1, words))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.randrange(0, 1 + len(own) // 15)):
                own[rnd.randrange(len(own))] = f"v{rnd.randrange(5000)}"
            out.append(" ".join(own[: len(own) - rnd.randrange(0, 1 + len(own) // 30)]))
    return out


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 50)])
def test_components_against_brute_force(spark, n, percent):
    texts = near_copies(percent, 40, 9, 150) + [None, "", " \t\n", "One", "one", "ONE two", "one\x0btwo", "Ünë Ü", "x " * 30000, "x " * 30001, "a b c d e f g h", "a b c d e f g h i"]
    rows = [(2**55 + 7 * i % 401, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "lonely words"), (2**55 + 7, texts[1]), (2**55 + 7, texts[1])]
    assert run(spark, rows, n, percent) == brute(rows, n, percent)


def test_blocks_of_a_large_file(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    texts = near_copies(1, 2, 80, 60) + near_copies(2, 1, 120, 200)
    rows = list(enumerate(texts))
    assert run(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_no_rows(spark):
    assert run(spark, [(1, None)], 3, 90) == [(False, 1, 0, 1)]
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_jaccard_components(docs).collect() == []


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_filing_shingle(percent):
    rng = np.random.default_rng(percent)
    levels = rng.integers(0, 3, 1 << ngram_join.SLOT_BITS).astype(np.uint8)
    for _ in range(400):
        size = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        drop, add = int(rng.integers(0, 1 + len(a) // 9)), int(rng.integers(0, 1 + len(a) // 9))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
        if ngram_join.linked(a, b, percent):
            assert np.intersect1d(ngram_join.prefix(a, levels, percent), ngram_join.prefix(b, levels, percent)).size


@pytest.mark.parametrize("n", [1, 3, 5])
def test_shingles_equal_those_of_words(n):
    texts = [None, "", " \t\n", "One", "one", " a b", "a b ", "A  b\x0bc d e f g a b c d e", "Ünë Ü x\x1fy z", "x " * 3000, *near_copies(5, 10, 3, 40)]
    sets = [s.tolist() for s in ngram_join.shingle_sets(pa.array(texts), n)]
    brutes = [shingles(t, n) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in brutes]
    for i in range(len(texts)):
        for j in range(i):
            assert len(set(sets[i]) & set(sets[j])) == len(brutes[i] & brutes[j])


def test_runs_of_a_batch_give_the_same_sets_and_ids():
    from tonearm.llm.tokens import ChunkEncoder, runs_of_texts

    texts = [None, *near_copies(6, 12, 3, 60), "", "x  y\n\nz é", "q " * 500]
    for batch in (pa.array(texts), pa.array(["left", "out", *texts]).slice(2), pa.array(texts, pa.large_string())):
        for most in (1, 300, 10**6):
            runs = list(runs_of_texts(batch, most))
            assert [a for a, _ in runs] == np.cumsum([0, *[len(r) for _, r in runs]])[:-1].tolist()
            assert [t for _, r in runs for t in r.to_pylist()] == texts
            got = [s.tolist() for _, r in runs for s in ngram_join.shingle_sets(r, 3)]
            assert got == [next(iter(ngram_join.shingle_sets(pa.array([t], pa.string()), 3))).tolist() for t in texts]
            for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
                encoder = ChunkEncoder.of(name)
                whole = encoder.encode(texts, 1)[0].tolist()
                assert np.concatenate([encoder.encode(r, 1)[0] for _, r in runs]).tolist() == whole


def test_a_common_passage_files_last(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rnd = random.Random(4)
    rows = [(i, f"{' '.join(f'w{rnd.randrange(10**6)}' for _ in range(200))} {passage}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    levels = ngram_join.shingle_levels(docs, "text", 5)
    (common,) = ngram_join.shingle_sets(pa.array([passage]), 5)
    assert (levels[common >> np.uint64(64 - ngram_join.SLOT_BITS)] > 0).all() and (levels > 0).mean() < 0.01
    _, classes = ngram_join.ngram_classes(docs, "doc_id", "text", 5, 80)
    filed = ngram_join._filed(classes.withColumn("component", F.col("node")))
    assert ngram_join._open_files(filed).where(F.col("file").isin(common.view(np.int64).tolist())).count() == 0


def test_every_pair_comes_out_of_a_tree():
    """One partner a point joins a group; all partners are all linked pairs across components and few others."""
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[k % 7 :], rng.integers(0, 1 << 63, k % 7).astype(np.uint64)])) for k in range(100)]
    sets += [np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64)) for _ in range(100)]
    points = ngram_join.points_of([ngram_join.point(s) for s in sets])
    alone = np.arange(len(sets))
    p, q = ngram_join.asked(points, alone, 90, head=0)
    assert len(p) <= len(sets) and {*p, *q} >= set(range(100)) and all(0 in (i, j) for i, j in zip(p, q) if max(i, j) < 100)
    p, q = ngram_join.asked(points, alone, 90)
    want = {(i, j) for j in range(len(sets)) for i in range(j) if ngram_join.linked(sets[i], sets[j], 90)}
    assert want <= set(zip(p.tolist(), q.tolist())) and len(p) < len(want) + 20
    one = np.where(alone < 90, 0, alone)
    p, q = ngram_join.asked(points, one, 90, cut=90)
    assert {(i, j) for i, j in want if i < 90 <= j} <= set(zip(p.tolist(), q.tolist()))


def test_long_sets_have_finer_bounds():
    rng = np.random.default_rng(9)
    own = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    base = own(20_000)
    sets = [base, np.unique(np.concatenate([base[900:], own(900)])), *[own(20_000) for _ in range(30)], base[:3000], own(3000), np.unique(np.concatenate([base[100:3000], own(90)]))]
    points = ngram_join.points_of([ngram_join.point(s) for s in sets])
    assert len(points[0]) == 4096 and len(points[-1]) == 512
    for cut in (None, 1):
        p, q = ngram_join.asked(points, np.arange(len(sets)), 80, cut=cut)
        got = set(zip(p.tolist(), q.tolist()))
        want = {(i, j) for j in range(len(sets)) for i in range(j) if ngram_join.linked(sets[i], sets[j], 80)}
        assert want and got == {(i, j) for i, j in want if cut is None or i < cut <= j}
    most = ngram_join.bounds_of_long(points, np.array([0, 0]), np.array([2, 32]), np.array([10**6, 10**6]))
    assert most[0] >= len(np.intersect1d(sets[0], sets[2])) and most[1] >= len(np.intersect1d(sets[0], sets[32]))


def test_very_long_texts_and_a_shingle_of_all_rows(spark):
    rnd = random.Random(6)
    words = [f"w{rnd.randrange(10**7)}" for _ in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-30])), (3, " ".join(words[100_000:]))]
    rows += [(10 + i, f"the very same start x{i} y{i} z{i}" + " the very same start" * (i % 3)) for i in range(300)]
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_tree_bound_loses_nothing():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = np.unique(rng.integers(0, 1 << 63, int(rng.integers(20, 400))).astype(np.uint64))
        sets += [base] + [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)])) for k in (1, 2, 5)]
    points = ngram_join.folded(ngram_join.points_of([ngram_join.point(s) for s in sets]), ngram_join.DIMS)
    tree = ngram_join.RTree(points, points.sum(axis=1))
    half = ngram_join.RTree(points[:7], points[:7].sum(axis=1))
    for other, n in ((tree, len(sets)), (half, 7)):
        p, q, most = tree.join(other, 90)
        got = {(int(i), int(j)) for i, j in zip(p, q)}
        assert all(m >= len(np.intersect1d(sets[i], sets[j])) for i, j, m in zip(p, q, most))
        want = {(i, j) for i in range(len(sets)) for j in range(n) if ngram_join.linked(sets[i], sets[j], 90)}
        assert want <= got and len(got) < len(sets) * n / 4


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in queries.op6_ngram_jaccard(spark, sf_dir).collect())
    assert got == brute([(d.doc_id, d.text) for d in docs], 3, 90)


def test_group_of_near_copies_that_do_not_link():
    """Members of a group that just fail to link are no candidates; all linked pairs are."""
    rnd = np.random.default_rng(5)
    for n, lost in ((100, 14), (400, 56), (1000, 140)):
        base = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
        sets = []
        for k in range(60):
            own = base.copy()
            own[rnd.choice(n, lost if k >= 8 else lost // 3, replace=False)] = rnd.integers(0, 1 << 63, lost if k >= 8 else lost // 3, dtype=np.uint64)
            sets.append(np.unique(own))
        points = ngram_join.points_of([ngram_join.point(s) for s in sets])
        assert all(p.sum(dtype=np.int64) == len(s) for p, s in zip(points, sets))
        linked = {(i, j) for i in range(60) for j in range(i + 1, 60) if ngram_join.linked(sets[i], sets[j], 80)}
        p, q = ngram_join.asked(points, np.arange(60), 80)
        got = {(min(i, j), max(i, j)) for i, j in zip(p.tolist(), q.tolist())}
        assert 28 <= len(linked) <= len(got) <= len(linked) + 10 and linked <= got
    for n in (1, 129, 70_000):
        ids = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        x = ngram_join.points_of([ngram_join.point(ids)])[0]
        assert (x == np.bincount((ids & np.uint64(len(x) - 1)).astype(np.int64), minlength=len(x))).all()
    heavy = np.arange(500, dtype=np.uint64) << np.uint64(20)
    assert ngram_join.points_of([ngram_join.point(heavy)])[0].tolist() == [500] + [0] * 511


def test_sizes_tell_which_files_need_trees():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 1 << 63, n, np.uint64)) for n in (1, 7, 130, 500, 700, 5000)]
    sets += [np.arange(n, dtype=np.uint64) << np.uint64(14) for n in (3, 300, 70_000)]
    assert [ngram_join.size_of(ngram_join.point(x)) for x in sets] == [len(x) for x in sets]
    for _ in range(2000):
        sizes = rnd.integers(1, 60, rnd.integers(1, 6)).tolist()
        for percent in (1, 80, 90, 100):
            pairs = [(a, b) for i, a in enumerate(sizes) for b in sizes[i + 1 :]]
            # the overlap of two sets is the smaller one at most
            assert ngram_join.may_link(sizes, percent) == any((100 + percent) * min(p) >= percent * sum(p) for p in pairs)


def test_rows_that_cannot_link_by_a_file_leave_it(spark):
    """Two equal-sized sets whose first common shingle is late in both meet in a file but in no tree; linked ones stay."""
    file, alone = np.array([5, 5, 6, 6, 7, 7, 7]), np.arange(7)
    size, place = np.full(7, 100), np.array([8, 8, 0, 8, 0, 3, 9])
    # 100 shingles with 90 %: 95 must be shared, so the first of them is among the first six of both
    assert ngram_join.meets(file, alone, size, place, 90).tolist() == [False] * 4 + [True, True, False]
    assert not ngram_join.meets(file, file, size, place, 90).any()
    schema = "file long, node long, component long, size long, place long, n long"
    rows = [(int(f), i, i, 100, int(p), 2 if f < 7 else 3) for i, (f, p) in enumerate(zip(file, place))]
    rows += [(8, 100 + i, i, 100, 9, 1000) for i in range(1000)]
    got = ngram_join._meeting(spark.createDataFrame(rows, schema), 90).collect()
    assert sorted(r.node for r in got) == [4, 5, *range(100, 1100)]
    rng = np.random.default_rng(11)
    levels = rng.integers(0, 3, 1 << ngram_join.SLOT_BITS).astype(np.uint8)
    links = 0
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 400))).astype(np.uint64))
        b = np.unique(np.concatenate([a[int(rng.integers(0, 1 + len(a) // 9)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(a) // 9))).astype(np.uint64)]))
        pa_, pb = (ngram_join.prefix(x, levels, 90) for x in (a, b))
        both = np.intersect1d(pa_, pb)
        at = [(int(np.flatnonzero(pa_ == f)[0]), int(np.flatnonzero(pb == f)[0])) for f in both]
        met = any(ngram_join.meets(np.zeros(2, int), np.arange(2), np.array([len(a), len(b)]), np.array(p), 90).all() for p in at)
        links += ngram_join.linked(a, b, 90)
        assert met or not ngram_join.linked(a, b, 90)
    assert links > 50


def test_word_hashes_tell_words_apart():
    texts = ["ab", "AB c", None, "", "x" * 64, "x" * 65, "x" * 66, "a\x00", "a", "abcdefgh", "abcdefghi abcdefgh\x00", "\x0bq\x1fr "]
    hashes, ends = ngram_join.word_hashes(pa.array(texts))
    words = [WORD.findall((t or "").lower()) for t in texts]
    assert ends.tolist() == np.cumsum([len(w) for w in words]).tolist()
    flat = [w for x in words for w in x]
    assert len(set(hashes.tolist())) == len(set(flat)) == len(set(zip(flat, hashes.tolist())))
