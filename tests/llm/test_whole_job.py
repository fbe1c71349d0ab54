"""The operators on inputs that the shared test data do not hold."""

from pyspark.sql import functions as F

import corpus_pipeline
from tonearm.llm import langid, mixing, quality, toxicity


def test_language_id_with_a_rare_and_a_wordless_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    # a short text of words no other language has, one of a common language's words, one without letters
    odd = [(-1, "zzyzx qoph vlurb zzyzx qoph", "rare"), (-2, " ".join(docs.where("lang = 'en'").first().text.split()[:12]), "same"), (-3, "12 34 !?", "none")]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    model = langid.fit(rows.where((langid.fold(F.col("doc_id")) != 1) | (F.col("doc_id") < 0)))
    held = {r.doc_id: r.lang for r in docs.where(langid.fold(F.col("doc_id")) == 1).collect()}
    got = {r.doc_id: r.lang_pred for r in langid.predict(rows, model).collect()}
    assert sum(got[k] == lang for k, lang in held.items()) >= 0.97 * len(held)
    assert got[-1] == "rare" and "none" not in got.values() and "none" not in model.langs


def test_expected_shares_of_the_mix_meet_the_targets(spark):
    rows = [(i, "word " * (20 + i % 50) + ("| x" if i % 3 else " | x"), "big" if i % 2 else f"s{i % 5}", "en" if i % 7 else "de") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.mix_documents(docs).toPandas()
    out["got"] = out.tokens * out.probability
    assert out.probability.max() > 0.999
    for dim, power in mixing.POWERS.items():
        target = out.groupby(dim).tokens.sum() ** power
        shares = out.groupby(dim).got.sum() / out.got.sum()
        assert (shares - target / target.sum()).abs().max() < 1e-3
    assert {r.doc_id for r in mixing.keep_mixed(docs).collect()} == set(out.doc_id[out.kept])


def test_quality_looks_at_whole_runs_and_all_words(spark):
    hasher = quality.Hasher()
    junk = quality.PIECE * "#$" * 40
    clean, mixed = hasher(quality.Facts.of("a" * quality.PIECE)), hasher(quality.Facts.of("a" * quality.PIECE + junk))
    both = hasher(quality.Facts.of(" ".join(["a" * quality.PIECE, *[junk[i : i + quality.PIECE] for i in range(0, len(junk), quality.PIECE)]])))
    own = hasher.bucket("a" * quality.PIECE)
    assert clean[own] == 1 and abs(mixed[own] - 1 / 81) < 1e-9
    assert abs(both[own] - mixed[own]) < 1e-9
    words = [f"w{i}" for i in range(200)]
    assert quality.Facts.of(" ".join(words)).distinct == 1
    assert abs(quality.Facts.of(" ".join(words + ["same"] * 199)).distinct - 201 / 399) < 1e-9
    prose = "The quick brown fox jumps over the lazy dog as it does every day of the year in this town. "
    rows = [(i, prose * (1 + i % 4)) for i in range(200)] + [(i, "#$ *% &&& " * 20) for i in range(200, 260)] + [(1000, "quick" * 12 + "#$*%" * 500), (1001, "#$*%" * 15 + "quick" * 500)]
    got = {r.doc_id: r.quality_score for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000] < got[1001]


def test_near_copies_go_by_row(spark, sf_dir):
    text = lambda name, last="": " ".join(f"{name}{i}" for i in range(60)) + last
    rows = [
        *[(1, text("a")), (None, text("a", " x")), (None, text("lone")), (None, "other words of no group at all")],
        *[(None, text("b")), (None, text("b", " x")), (None, text("b", " y"))],
        *[(5, text("c")), (7, text("c", " x")), (7, text("d"))],
        *[(8, text("e")), (8, text("e", " x"))],
        *[(9, text("f")), (9, text("f")), (9, text("f", " x"))],
        *[(None, text("g")), (None, text("g")), (10, None), (10, None), (11, " ")],
    ]
    docs = spark.createDataFrame([(*r, "s", i) for i, r in enumerate(rows)], "doc_id long, text string, source string, n int")
    out = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id or 0), (r.text or "").split(" ")[0]) for r in out.collect())
    assert got == sorted([(1, "a0"), (0, "lone0"), (0, "other"), (0, "b0"), (5, "c0"), (7, "d0"), (8, "e0"), (9, "f0"), (0, "g0"), (10, ""), (10, ""), (11, "")])


def test_the_toxicity_curve_is_fitted_on_all_learning_rows(spark, monkeypatch):
    docs = spark.range(33_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the old house "), F.when(F.col("id") % 10 == 0, F.lit("zorgle")).otherwise(F.lit("water"))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    met: list[list[tuple[float, int, int]]] = []
    for name in ("logistic", "best_cut"):
        monkeypatch.setattr(toxicity, name, lambda points, f=getattr(toxicity, name): met.append(points) or f(points))
    toxicity.fit(docs, labels)
    learned = labels.where(toxicity.fold(F.col("doc_id")) != 1)
    want = (learned.count(), learned.where("toxic = 1").count())
    assert want[0] > 20_000 and len(met) == 2
    assert all((sum(n for _, n, _ in x), sum(t for _, _, t in x)) == want for x in met)
