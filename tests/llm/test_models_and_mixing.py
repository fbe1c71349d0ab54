import math
import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tonearm.llm import embed_dedup, exact_dedup, langid, mixing, oracle, quality, queries

from .test_ngram_join import shingles
from .test_tokens_and_packing import check_packing, whole


def brute_vectors(rows, threshold):
    ok = [v is not None and len(v) > 0 and lab is not None and None not in v and all(map(math.isfinite, v)) and any(v) for _, v, lab in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    near.append((i, j))
                    root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 62)
    for i, r in enumerate(rows):
        least[find(i)] = min(least[find(i)], r[0])
    return {r[0]: (links[i], least[find(i)]) for i, r in enumerate(rows)}, len(near)


def near_vectors(seed, groups, dims=16):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = rng.standard_normal(dims)
        for _ in range(int(rng.integers(1, 9))):
            out.append((len(out), (base + rng.standard_normal(dims) * 0.12).tolist(), int(g % 3)))
        out += [(len(out) + k, out[-1][1], int(g % 3)) for k in range(int(rng.integers(0, 3)))]
    return out


@pytest.mark.parametrize("block", [1024, 4])
def test_near_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = near_vectors(1, 60)
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [1.0] * 16, None), (n + 4, [1.0] * 16, None), (n + 5, rows[0][1][:8], 0), (n + 6, [2 * x for x in rows[0][1]], 0), (n + 7, [None, *rows[0][1][1:]], 0), (n + 8, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("copies", F.lit("clash")).repartition(3)
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df, threshold=0.93, recall=0.9999999).collect()}
    want, _ = brute_vectors(rows, 0.93)
    assert {k: (r.n_links, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (k == r.component_id) for k, r in got.items())
    assert embed_dedup.near_vectors(df.limit(0)).collect() == []


def test_near_vectors_recall_of_the_query(spark):
    rows = near_vectors(2, 150, 64)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embed_dedup.near_vectors(df, threshold=0.93).collect()
    want, _ = brute_vectors([(i, np.float32(v).astype(float).tolist(), lab) for i, v, lab in rows], 0.93)
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    assert sum(r.n_links for r in got) >= 0.97 * sum(w[0] for w in want.values())


def test_near_vectors_query_against_brute_force(spark, sf_dir, tmp_path):
    """The registered query on the table with planted neighbours: counts, components, recall."""
    rng = np.random.default_rng(5)
    schema = spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    for k in range(200):
        base = np.array(rows[k][1])
        for _ in range(k % 4):
            v = base + rng.standard_normal(len(base)) * rng.uniform(0.005, 0.06)
            rows.append((10**6 + len(rows), [float(x) for x in np.float32(v)], rows[k][2]))
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in queries.op8_near_vectors(spark, str(tmp_path)).collect()}
    want, near = brute_vectors(rows, 0.93)
    assert near > 200 and all(r.n_links <= want[k][0] for k, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.98 * 2 * near
    assert np.mean([r.component_id == want[k][1] for k, r in got.items()]) > 0.99


def test_language_id_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    rows = docs.select("doc_id", "lang", "text").collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= got[r.doc_id].score <= 1 for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)


@pytest.mark.parametrize("lang", [0, 1])
def test_language_scores_against_brute_force(spark, sf_dir, lang):
    """Scores of whole texts by plain dictionaries over all learned rows."""
    rows = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()][:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    learned = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    langs = sorted({r.lang for r in learned}, key=lambda x: (-sum(r.lang == x for r in learned), x))
    count, grams = {x: defaultdict(int) for x in langs}, {(x, n): defaultdict(int) for x in langs for n in range(1, 5)}
    for r in learned:
        for w in langid.words_of(r.text):
            count[r.lang][w] += 1
            for n in range(1, 5):
                for g in langid.grams_of(w, n):
                    grams[r.lang, n][g] += 1

    def scores(tables, entry):
        size = [sum(t.values()) + langid.SPARE for t in tables]
        return [math.log((t[entry] if entry in t else 0) / z if entry in t else langid.UNSEEN / max(size)) for t, z in zip(tables, size)]

    for r in rows[lang::2]:
        words, total = langid.words_of(r.text), np.zeros(len(langs))
        for w in words:
            if any(w in count[x] for x in langs):
                total += scores([count[x] for x in langs], w)
                continue
            for n in range(4, 0, -1):
                known = [g for g in langid.grams_of(w, n) if any(g in grams[x, n] for x in langs)]
                if known:
                    total += np.mean([scores([grams[x, n] for x in langs], g) for g in known], axis=0)
                    break
        mean = total / max(1, len(words))
        best = int(np.argmax(mean))
        assert got[r.doc_id].lang_pred == langs[best]
        assert abs(got[r.doc_id].score - 1 / np.exp((mean - mean[best]) * min(len(words), langid.SURE_FROM)).sum()) < 1e-9


def test_language_id_draws_whatever_the_keys(spark):
    own = lambda i: str(i).translate(str.maketrans("0123456789", "abcdefghij"))
    rows = [(None, f"{'the cat and dog' if i % 2 else 'der hund und kater'} x{own(i)}", "en" if i % 2 else "de") for i in range(6000)] + [(None, "the cat", "en")] * 6000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, docs_per_lang=200)
    assert model.langs == ["en", "de"] and 100 < len(model.words.place) < 800
    assert langid.fit(docs, docs_per_lang=200, most_docs=20).predict("der hund")[0] == "de"


def test_language_id_of_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und der kater und der hund", "de"), (3, None, "en"), (4, "123 !?", "en"), (5, "", None), (6, "Кот", "en"), (None, "the the", None), (1, "the cat and the dog", "en"), (7, "x" * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n", F.lit(1)).withColumn("key", F.lit("clash"))
    model = langid.fit(docs)
    got = langid.predict(docs, model).collect()
    by = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == len(rows)
    assert (by[1], by[2], by[3], by[4], by[5], by[None]) == ("en", "de", "und", "und", "und", "en") and by[6] in ("en", "de")
    assert langid.fit(docs.limit(0)).predict("the") == ("und", 0.0)
    assert langid.identify(docs.limit(0)).collect() == []


def test_quality_estimates_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.8
    codes = np.zeros(4000, int)
    for k in range(len(quality.LABELLERS)):
        right = rng.random(4000) < (0.9 if k < 6 else 0.5)
        vote = np.where(rng.random(4000) < 0.3, 0, np.where(right == good, 2, 1))
        codes = codes * 3 + vote
    patterns, counts = np.unique(codes, return_counts=True)
    p = dict(zip(patterns, quality.estimate(patterns, counts)))
    assert np.mean([(p[c] > 0.5) == g for c, g in zip(codes, good)]) > 0.95


def test_quality_query_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op3_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([got[x.doc_id].kept == bool(x.quality) for x in labels]) > 0.96
    assert np.mean([got[x.doc_id].kept for x in labels if x.quality]) > 0.98


@pytest.mark.parametrize("keys", ["null", "same", "own"])
def test_quality_draws_whatever_the_keys(spark, keys):
    good = "The quick brown fox jumps over the lazy dog, as it does every single day of the year in town %d."
    rows = [(None if keys == "null" else 7 if keys == "same" else i, "#$ *% &&& !! " * (10 + i % 9) if i % 10 == 0 else good % i) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.score_rows(docs, quality.fit(docs, sample=500)).collect()
    assert all(r.kept == r.text.startswith("The") for r in got)
    hot = spark.createDataFrame([(None, good)] * 5000 + [(None, "#$ *% &&& !! " * 20)] * 5000, "doc_id long, text string")
    got = quality.classify(hot).groupBy("kept").count().collect()
    assert {r.kept: r["count"] for r in got} == {True: 5000, False: 5000}


def test_quality_of_odd_rows(spark):
    text = "The quick brown fox jumps over the lazy dog, as it does every single day of the year in this town."
    rows = [(1, text), (2, None), (3, ""), (4, " \n "), (5, text), (5, text), (None, text), (6, "word. other " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = quality.classify(docs).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if not r.kept} == {2, 3, 4}
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 5 and kept.where("kept = 'clash'").count() == 5
    assert quality.classify(docs.limit(0)).collect() == [] and quality.keep_good(docs.limit(0)).collect() == []


def test_raking_meets_the_marginals(spark):
    rnd = random.Random(0)
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", rnd.randrange(1, 10**6)) for a in range(6) for b in range(4) for c in range(3)], "source string, lang string, topic string, tokens long")
    out = mixing.rake(cells, rounds=16).toPandas()
    for dim, power in mixing.POWERS.items():
        share = out.groupby(dim).tokens.sum() ** power
        assert np.allclose(out.groupby(dim).weight.sum() / out.weight.sum(), share / share.sum(), atol=1e-4)


def test_mixing_to_given_shares(spark):
    rows = [(i, "word " * (20 + i % 50) + ("| x" if i % 3 else " | x"), "big" if i % 2 else f"s{i % 5}", "en" if i % 7 else "de") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.mix_documents(docs, targets={"lang": {"en": 0.6, "de": 0.3, "fr": 0.1}, "source": {"big": 1.0, "s0": 1.0, "s1": 2.0}}).toPandas()
    out["got"] = out.tokens * out.probability
    shares = {d: (out.groupby(d).got.sum() / out.got.sum()).round(4).to_dict() for d in ("lang", "source")}
    assert shares["lang"] == {"en": 0.6667, "de": 0.3333}
    assert {k: v for k, v in shares["source"].items() if v} == {"big": 0.25, "s0": 0.25, "s1": 0.5}
    kept = out[out.kept].groupby("lang").tokens.sum()
    assert abs(kept["en"] / kept.sum() - 2 / 3) < 0.05
    one = spark.createDataFrame([(i, "w " * 10, f"s{i % 2}", f"l{i % 2}") for i in range(100)], docs.schema)
    with pytest.raises(ValueError, match="no weights meet"):
        mixing.mix_documents(one, targets={"source": {"s0": 0.9, "s1": 0.1}, "lang": {"l0": 0.1, "l1": 0.9}})
    with pytest.raises(ValueError, match="has a target"):
        mixing.mix_documents(one, targets={"source": {"none": 1.0}})


def test_mixing_query_meets_its_targets(spark):
    out = queries.op4_mixing(spark, "/root/testdata/sf0.01").toPandas()
    kept = out[out.kept]
    for dim, power in mixing.POWERS.items():
        target = out.groupby(dim).tokens.sum() ** power
        share = kept.groupby(dim).tokens.sum() / kept.tokens.sum()
        assert (share.reindex(target.index, fill_value=0) - target / target.sum()).abs().max() < 0.05


def test_mixing_of_odd_rows(spark):
    rows = [(i, "some words | here" * (i % 7), f"s{i % 3}", "en") for i in range(300)] + [(None, None, None, None), (1, "", "s0", None), (9000, "x" * 10**6, "long", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("mix", F.lit("clash")).withColumn("tokens", F.lit(-1))
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
    assert {r.doc_id: r.tokens for r in got}[9000] == 250_000
    assert mixing.mix_documents(docs.limit(0)).collect() == []
    assert mixing.keep_mixed(docs).columns == docs.columns and mixing.keep_mixed(docs).count() > 0
    with pytest.raises(ValueError, match="column mix"):
        mixing.mix(docs, mixing.document_dims(docs))


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_oracle_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    cursor = con.execute(oracle.ORACLE[name])
    at = [[d[0] for d in cursor.description].index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {r.doc_id for r in queries.op3_quality(spark, sf_dir).collect() if r.kept}
    last = {}
    for k in sorted(kept):
        last[docs[k].text] = k
    kept = sorted(last.values())
    sets = {k: shingles(docs[k].text, 5) for k in kept}
    root = {k: k for k in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in kept:
        for j in kept:
            if j < i and sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = [k for k in kept if find(k) == k]
    left = spark.createDataFrame([docs[k] for k in kept], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    mixed = sorted(r.doc_id for r in mixing.mix_documents(left).collect() if r.kept)
    ids = whole("byte_bpe_50k.json", [docs[k].text for k in mixed])
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), {k: [*i, 0] for k, i in zip(mixed, ids)})


def test_pipeline_stages_keep_columns_and_survive_no_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), sf_dir)
        assert out.columns == docs.columns and out.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).collect() == []


def test_digest_index_counts_over_batches(spark):
    schema = "doc_id long, text string"
    index = exact_dedup.DigestIndex(spark)
    first, second = spark.createDataFrame([(10, "same"), (9, "own")], schema), spark.createDataFrame([(11, "same"), (12, "same"), (13, "new")], schema)
    exact_dedup.add_batch(index, first)
    exact_dedup.add_batch(index, second)
    rows = exact_dedup.memberships(index, first.unionByName(second)).collect()
    assert {(r.key, r.keep_id, r.group_size) for r in rows} == {(10, 10, 3), (11, 10, 3), (12, 10, 3), (9, 9, 1), (13, 13, 1)}
    path = index.location
    index.drop()
    assert not os.path.exists(path) and not [t for t in spark.catalog.listTables() if t.name.startswith(index.name)]


def test_dedup_in_batches(spark):
    rows = [(i, f"t{i % 37}") for i in range(200)] + [(None, "t1"), (None, "only"), (None, "only"), (5000, None), (5001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {}
    for k, t in rows:
        want.setdefault(t or "", []).append(k)
    for batches in (1, 2, 3):
        got = exact_dedup.dedup_in_batches(docs, batches=batches).collect()
        assert len(got) == len(rows) and sum(r.kept for r in got) == len(want)
        assert sorted(repr((r.key, r.keep_id, r.group_size)) for r in got) == sorted(repr((k, max((x for x in want[t or ""] if x is not None), default=None), len(want[t or ""]))) for k, t in rows)
    assert exact_dedup.dedup_in_batches(docs.limit(0)).collect() == []


def test_dedup_query_meets_its_index(spark, sf_dir, monkeypatch):
    plans = []
    append = exact_dedup.DigestIndex.append
    monkeypatch.setattr(exact_dedup.DigestIndex, "append", lambda self, rows: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), append(self, rows))[1])
    queries.op9_exact_dedup(spark, sf_dir).count()
    assert len(plans) == 2 and "SortMergeJoin" in plans[1] and "LeftAnti" in plans[1]


def test_digest_index_skips_known_texts(spark):
    index = exact_dedup.DigestIndex(spark)
    first = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert exact_dedup.keep_first_copies(first, index=index).count() == 1
    assert exact_dedup.keep_first_copies(first.unionByName(spark.createDataFrame([(2, "b")], "doc_id long, text string")), index=index).select("doc_id").collect() == [(2,)]
    index.drop()
