import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonearm.operators import angular, clusters, enrich, scale, signal, store, tags, tree, vectors
from tonearm.plans.runner import Runner, Step
from tonearm.sources import pages, registry
from tonearm.streaming import ingest


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_upsert_keeps_whole_rows_and_latest(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 9, None)], "k string, t int, v string")
    new = spark.createDataFrame([("a", 0, None), ("a", 5, "z"), ("c", 1, "n")], "k string, t int, v string")
    assert rows(store.upsert(old, new, ["k"], ["t"]), "k", "t", "v") == [("a", 5, "z"), ("b", 9, None), ("c", 1, "n")]


def test_change_set_and_second_run_is_empty(spark):
    want = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (2, 3, 0.7)], "a int, b int, sim double")
    have = spark.createDataFrame([(1, 2, 0.5, 0), (1, 3, 0.5, 1), (8, 9, 0.1, 0), (7, 9, 0.1, 1)], "a int, b int, sim double, deleted int")
    plan = store.change_set(want, have, ["a", "b"], "sim")
    assert rows(plan, "a", "b", "op") == [(1, 2, "unchanged"), (1, 3, "resurrect"), (2, 3, "insert"), (8, 9, "remove")]
    after = store.apply_changes(have, plan, ["a", "b"], "sim")
    again = store.change_set(want, after, ["a", "b"], "sim")
    assert again.where("op <> 'unchanged'").count() == 0 and after.count() == 5
    assert rows(store.change_numbers(plan, 10, "sim", ["a", "b"]), "op", "usn") == [("insert", 11), ("remove", 13), ("resurrect", 12)]


def test_number_rows_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(13)
    got = store.number_rows(df, [F.col("x").desc()], "n").collect()
    assert all(r.n == 1000 - r.x for r in got)


def test_enrichment_rules(spark):
    r = spark.createDataFrame(
        [("1", 1, 0.6, "Lab", "Gen", "Sty", 1999, "C1"), ("2", 1, 0.59, "Lab", "Gen", "Sty", 1999, "C1"), ("3", 1, 0.9, "none", "Gen", "", 0, "None")],
        "rb_id string, matched int, confidence double, label string, genre string, style string, year int, catno string",
    )
    s = spark.createDataFrame([("2", 1, '["r&b x"]', "2004-01"), ("3", 1, "[]", "1987"), ("4", 0, '["a"]', "1990")], "rb_id string, matched int, artist_genres string, release_date string")
    t = spark.createDataFrame([(str(i), None, "", 0, " ") for i in range(1, 5)], "rb_id string, genre string, label string, year int, catno string")
    got = {(x.rb_id, x.field): (x.value, x.source, x.confidence) for x in enrich.provenance(t, enrich.resolve(r, s)).collect()}
    assert got == {
        ("1", "genre"): ("Sty", "discogs", 0.6), ("1", "label"): ("Lab", "discogs", 0.6), ("1", "year"): ("1999", "discogs", 0.6), ("1", "catno"): ("C1", "discogs", 0.6),
        ("2", "genre"): ("R&B X", "spotify", None), ("2", "year"): ("2004", "spotify", None), ("3", "genre"): ("Gen", "discogs", 0.9), ("3", "year"): ("1987", "spotify", None),
    }


def test_best_candidate(spark):
    c = spark.createDataFrame([("a", 0.5, 1, "x"), ("a", 0.5, 0, "y"), ("b", 0.0, 0, "z")], "k string, s double, pos int, v string")
    assert rows(enrich.best_candidate(c, ["k"], "s", "pos"), "k", "v") == [("a", "y")]


def test_tree_problems(spark):
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("x", "y"), ("y", "x"), ("d", "gone"), ("e", "d")], "id string, parent string")
    assert rows(tree.integrity(nodes), "id", "problem") == [("a", "ok"), ("d", "dangling"), ("e", "unrooted"), ("r", "ok"), ("x", "unrooted"), ("y", "unrooted")]


def test_tree_of_any_depth(spark):
    chain = [(i, i - 1 if i else None) for i in range(10_000)]
    loop = [(20_000 + i, 20_000 + (i + 1) % 7) for i in range(7)] + [(30_000 + i, 29_999 + i if i else 20_003) for i in range(100)]
    got = dict(tree.integrity(spark.createDataFrame(chain + loop, "id long, parent long")).collect())
    assert sum(p == "ok" for p in got.values()) == 10_000 and all(got[i] == "unrooted" for i, _ in loop)


def test_closure_of_chains_and_cycles(spark):
    edges = {i: i - 1 if i else None for i in range(200)} | {1000 + i: 1000 + (i + 1) % 5 for i in range(5)} | {2000: 1002, 2001: 2000, 3000: 9999, 3001: 3000}
    want = set()
    for node in edges:
        at, depth, seen = node, 0, set()
        while at in edges and at not in seen:
            want.add((at, node, depth))
            seen.add(at)
            at, depth = edges[at], depth + 1
    got = tree.descendants(spark.createDataFrame(list(edges.items()), "id long, parent long")).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert tree.descendants(spark.createDataFrame([], "id long, parent long")).collect() == []


def test_quantiles_and_ranks(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 40, 3001).astype(float), rng.standard_normal(3001)
    data = [(float(a), float(b) if k % 7 else None, None) for k, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "x double, y double, z double").repartition(11)
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = scale.quantiles(df, {"x": shares, "y": shares, "z": (0.5,)})
    kept = [b for _, b, _ in data if b is not None]
    assert got["z"] == {0.5: None}
    assert np.allclose(list(got["x"].values()), np.quantile(x, shares)) and np.allclose(list(got["y"].values()), np.quantile(kept, shares))
    ranked = {r.x: r.r for r in scale.ranks(df.select("x"), "x", "r").collect()}
    assert all(ranked[v] == (x < v).sum() + ((x == v).sum() + 1) / 2 for v in set(x))


def test_consolidation_drops_collisions(spark):
    t = spark.createDataFrame([("1", "root", "a", 1), ("2", "root", "b", 2)], "id string, parent string, name string, seq int")
    links = spark.createDataFrame([("1", "x"), ("2", "x"), ("2", "y")], "tag string, track string")
    moves = spark.createDataFrame([("2", None, None, None, "1")], "id string, to_parent string, to_name string, to_seq int, merge_into string")
    bank, out = tags.consolidate(t, links, moves)
    assert rows(bank, "id", "deleted") == [("1", 0), ("2", 1)]
    assert rows(out, "tag", "track", "was", "deleted") == [("1", "x", "1", 0), ("1", "x", "2", 1), ("1", "y", "2", 0)]


def test_equal_sets(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (2, "a"), (3, "a")], "g int, i string")
    assert rows(tags.equal_sets(m, "g", "i"), "a", "b") == [(1, 2)]


def test_pairs_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((70, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {(r.a, r.b): r.sim for r in angular.similar_pairs(df, "id", "v", 0.5, rows=16).collect()}
    s = x @ x.T
    assert set(got) == {(i, j) for i in range(70) for j in range(i + 1, 70) if s[i, j] >= 0.5}
    assert all(abs(v - s[k]) < 1e-12 for k, v in got.items())


def test_top_partners_ties_and_labels(spark):
    d = spark.createDataFrame([(0, 1, 0.9, "a"), (0, 2, 0.9, "b"), (0, 3, 0.9, "b"), (0, 4, 0.1, "c")], "i int, j int, score double, label_j string")
    assert rows(vectors.top_partners(d, 2), "j") == [(1,), (3,)]


def brute_segments(bpms, tolerance=0.08):
    leaves, cur = [], []
    for b in sorted(bpms):
        trial = cur + [b]
        m = float(np.mean(trial))
        if cur and not all(abs(x - m) / m <= tolerance for x in trial):
            leaves.append(cur)
            cur = [b]
        else:
            cur = trial
    return leaves + [cur] if cur else leaves


def test_segments_against_brute_force(spark):
    rnd = random.Random(4)
    data = {f: [rnd.choice([60, 65, 92, 100, 108, 117, 127.5, 174]) + rnd.random() * 20 for _ in range(rnd.randrange(1, 40))] for f in range(8)}
    df = spark.createDataFrame([(f, i, float(b)) for f, bs in data.items() for i, b in enumerate(bs)] + [(0, 99, None), (0, 98, 0.0)], "folder int, track int, bpm double")
    got = clusters.tempo_segments(df).toPandas()
    for f, bs in data.items():
        mine = got[(got.folder == f) & got.leaf.notna()]
        assert mine.groupby("leaf").size().tolist() == [len(x) for x in brute_segments(bs)]
    assert set(got[got.leaf.isna()].name) == {"unknown-bpm"}
    assert got[got.leaf.notna()].groupby(["folder", "leaf"]).name.nunique().eq(1).all()


def test_band_leaves(spark):
    df = spark.createDataFrame([("f", 1, "a", 5), ("f", 2, "b", 4), ("f", 3, "c", 8), ("f", 4, "d", 3), ("g", 1, "a", 2)], "folder string, position int, band string, n long")
    assert rows(clusters.band_leaves(df), "folder", "band", "leaf") == [("f", "a", 1), ("f", "b", 1), ("f", "c", 2), ("f", "d", 2), ("g", "a", 1)]


def test_calibrated_scores_are_the_calibrations_own(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame(rng.gamma(2.0, 3.0, (157, len(scale.COMPONENTS))), columns=list(scale.COMPONENTS))
    df = spark.createDataFrame(data.assign(id=range(157)))
    c = scale.Calibration.from_json(scale.calibrate(df).to_json())
    plain = {r.id: r.score for r in scale.score(df).collect()}
    frozen = {r.id: r.score for r in scale.score(df, calibration=c).collect()}
    assert all(abs(plain[k] - frozen[k]) < 1e-9 for k in plain)
    assert not c.is_stale(scale.ENERGY) and scale.Calibration({}, {}, ()).is_stale(scale.ENERGY)
    d = scale.relative_deciles(scale.score(df), "id").toPandas().sort_values("score")
    assert (d.decile.values == np.minimum(((np.arange(157) + 0.5) / 157 * 10).astype(int) + 1, 10)).all()


def test_frozen_decile_is_right_open(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.5,)], "x double")
    assert [r.d for r in df.select(scale.frozen_decile(F.col("x"), F.array(F.lit(1.0), F.lit(2.0))).alias("d")).collect()] == [1, 2, 3]


def test_signal_of_a_pulse_train():
    rate, seconds = 11025, 24
    x = np.random.default_rng(2).standard_normal(rate * seconds) * 0.01
    for k in range(0, seconds * 2):
        x[int(k * rate / 2) : int(k * rate / 2) + 400] += np.sin(np.arange(400) * 2 * np.pi * 90 / rate)
    out = signal.summarise(x, rate, 120.0)
    assert out["r_bass"] > 0.01 and out["pump"] > 5 and abs(sum(v for k, v in out.items() if k.startswith("r_")) - 1) < 0.6
    assert signal.summarise(x[: rate * 5], rate) is None


def hand_page(number, after, rows, small, large, masks, flags=0, stride=24):
    """A page put together byte by byte; rows lie ``stride`` bytes apart, last row first."""
    page = bytearray(4096)
    struct.pack_into("<III", page, 4, number, 0, after)
    page[24], page[27] = small, flags
    struct.pack_into("<H", page, 34, large)
    for i, row in enumerate(rows):
        at = stride * (len(rows) - 1 - i)
        struct.pack_into("<6I", page, 40 + at, *row)
        struct.pack_into("<H", page, 4096 - 36 * (i // 16) - 6 - 2 * (i % 16), at)
    for g, mask in enumerate(masks):
        struct.pack_into("<H", page, 4096 - 36 * g - 4, mask)
    return bytes(page)


def hand_image(*pages_, entries):
    header = bytearray(4096)
    struct.pack_into("<I", header, 8, len(entries))
    for t, entry in enumerate(entries):
        struct.pack_into("<4I", header, 28 + 16 * t, *entry)
    return bytes(header) + b"".join(pages_)


def test_pages_put_together_by_hand():
    a = [(i, 1, 2, 3, 4, 5) for i in range(20)]
    b = [(100 + i, 0, 0, 0, 0, 2**32 - 1) for i in range(3)]
    image = hand_image(
        hand_page(1, 3, [], 5, 0, [], flags=0x64),  # index page: no rows, its link counts
        hand_page(2, 9, b, 3, 0x1FFF, [0b111]),  # the small count holds; links past the end
        hand_page(3, 2, a, 7, 20, [0xFFFF ^ 0b101, 0b1110], stride=32),  # the large count holds; rows 0, 2 and 16 are gone
        hand_page(4, 4, b, 3, 3, [0b010]),
        entries=[(7, 5, 4, 4), (0, 5, 1, 2)],
    )
    assert pages.image_rows(image) == [r for r in a if r[0] not in (0, 2, 16)] + b
    assert pages.image_rows(image, 7) == [b[1]] and pages.image_rows(image, 9) == []
    assert [i for i, _ in pages.chain(image)] == [1, 3, 2]


@pytest.mark.parametrize("n", [0, 1, 16, 17, 154, 155, 400])
def test_page_round_trip(n):
    data = [(i, 2**32 - 1 - i, i * 3, 7, i % 5, 0) for i in range(n)]
    image = pages.build_image(data)
    assert pages.image_rows(image) == data and len(image) == 4096 * (2 + -(-n // 154))
    for m in (0, 3, 154, 200, 700):  # other rows in the same file, fewer and more of them
        other = [(i, 1, i, 1, 1, 1) for i in range(m)]
        again = pages.replace_rows(image, other)
        table = pages.tables(again)[0]
        assert pages.image_rows(again) == other and table["past"] == len(again) // 4096 >= len(image) // 4096
        assert struct.unpack_from("<I", again, 12)[0] == table["past"] + 1 and struct.unpack_from("<I", again, 20)[0] == struct.unpack_from("<I", image, 20)[0] + 1
        assert pages.image_rows(pages.replace_rows(again, data)) == data


def test_replacing_leaves_other_tables():
    b = [(100 + i, 0, 0, 0, 0, 1) for i in range(3)]
    image = hand_image(hand_page(1, 2, b, 3, 3, [0b111]), hand_page(2, 3, b, 3, 3, [0b101]), entries=[(0, 3, 1, 1), (7, 3, 2, 2)])
    more = [(i, 0, 0, 0, 0, 0) for i in range(300)]
    again = pages.replace_rows(image, more)
    assert pages.image_rows(again) == more and again[8192:12288] == image[8192:12288] and pages.image_rows(again, 7) == [b[0], b[2]]
    assert pages.image_rows(pages.replace_rows(image, [])) == []


def test_page_accounting_and_loops():
    page = pages.build_page(5, 6, [(1,) * 6] * 20)
    free, used = struct.unpack_from("<2H", page, 28)
    assert used == 480 and free == 4096 - 40 - 480 - 36 - 12 and len(pages.build_page(1, 2, [(1,) * 6] * 154)) == 4096
    b = [(1,) * 6]
    loop = hand_image(hand_page(1, 2, b, 1, 1, [1]), hand_page(2, 1, b, 1, 1, [1]), entries=[(0, 3, 1, 9)])
    assert len(list(pages.chain(loop))) == 2
    with pytest.raises(ValueError):
        pages.build_page(1, 2, b * 155)


def test_page_sources(spark, tmp_path):
    data = [(i, 0, i, 1, 1, 0) for i in range(300)]
    (tmp_path / "t.pages").write_bytes(pages.build_image(data))
    files = spark.read.format("binaryFile").load(str(tmp_path / "t.pages"))
    assert sorted(map(tuple, pages.read_images(files).collect())) == data
    pages.register(spark)
    assert sorted(map(tuple, spark.read.format("pagedtable").load(str(tmp_path / "t.pages")).collect())) == data


def test_retries_and_cache(spark):
    calls, slept = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise registry.Throttled(2)
        return {"ok": 1}

    assert registry.with_retries(call, sleep=slept.append) == {"ok": 1} and slept == [2, 2]
    assert "error" in registry.with_retries(lambda: (_ for _ in ()).throw(OSError("down")), sleep=lambda s: None)
    cache = spark.createDataFrame([("a", "cached")], "k string, v string")
    asked = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    assert rows(registry.cached_lookup(asked, cache, lambda k: {"got": k}), "k", "v") == [("a", "cached"), ("b", '{"got": "b"}')]


def test_runner_orders_and_guards(spark):
    seen = []
    r = Runner(spark)
    for phase in ("score", "repair_tempo"):
        r.add(Step(phase, lambda s: s.range(1), lambda plan, p=phase: seen.append(p)))
    assert [p for p, _ in r.run()] == ["repair_tempo", "score"] and seen == []
    r.run(apply=True)
    assert seen == ["repair_tempo", "score"]
    r.add(Step("export", lambda s: s.range(1), lambda plan: None, lambda plan: "lost rows"))
    with pytest.raises(RuntimeError, match="lost rows"):
        r.run(apply=True)


def test_incremental_ingest(spark, tmp_path):
    schema = "rb_id string, name string, num double, t timestamp"
    make = lambda data: spark.createDataFrame(data, schema).selectExpr("rb_id", "name", "num", "t")
    from datetime import datetime

    landed, out, check = (str(tmp_path / x) for x in ("landed", "out", "check"))
    make([("1", "a", 1.0, datetime(2024, 1, 1)), ("1", "a", 2.0, datetime(2024, 1, 2))]).write.parquet(landed)
    kinds = spark.read.parquet(landed).schema

    def run():
        ingest.upsert_stream(ingest.read_features(spark, landed, kinds, "t", ["rb_id", "name"]), out, check, ["rb_id", "name"], ["t"]).awaitTermination()
        return rows(ingest.snapshot(spark, out, kinds), "rb_id", "num")

    assert run() == [("1", 2.0)]
    make([("2", "a", 5.0, datetime(2024, 1, 2)), ("1", "a", 3.0, datetime(2024, 1, 3))]).write.mode("append").parquet(landed)
    assert run() == [("1", 3.0), ("2", 5.0)]
    assert run() == [("1", 3.0), ("2", 5.0)]
