"""Registered queries on small tables that hold what the shared test data do not."""

import datetime
import difflib
import re
from urllib.parse import unquote

import duckdb
import numpy as np

from tonearm.plans import catalogue
from tonearm.sources.views import vectors


def test_fuzzy_match_scores_long_documents(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    texts = ["Alpha beta, gamma", "alpha " + "beta gamma " * 30, "Alpha " + " ".join(words[i * i % 8] for i in range(9000)), "beta " * 500, "unmatched " * 200, None, ""]
    items = ["alpha beta gamma " * 20, "Beta? " * 60, "alpha", "nothing here"]
    for name, key, rows in (("documents", "doc_id", texts), ("benchmark", "item_id", items)):
        spark.createDataFrame(list(enumerate(rows)), f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    norm = lambda t: re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip(" ")
    want = {}
    for i, t in enumerate(map(norm, texts)):
        for j, q in enumerate(map(norm, items)):
            if t.split(" ")[0] == q.split(" ")[0]:
                ratio = difflib.SequenceMatcher(None, q, t).ratio()
                want[i, j] = min(1.0, ratio + 0.15) if t else ratio
    got = {(r.doc_id, r.item_id): r.confidence for r in catalogue.QUERIES["fuzzy_match_ratio"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and {(1, 0), (2, 0), (2, 2), (3, 1)} <= got.keys()
    assert all(abs(got[k] - want[k]) <= 0.00501 for k in want)


def test_path_labels_of_escaped_urls(spark, tmp_path):
    urls = ["http://a.org/x/plain.html", "http://a.org/x/caf%C3%A9%20au%2Blait+1.html", "http://localhost/m/100%25.mp3", "http://a.org/50%/off%zz%4.txt", "http://a.org/d%2Fe/f%2Eg.h", "http://a.org/" + "%41b" * 40]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.base, r.label) for r in catalogue.QUERIES["path_labels"](spark, str(tmp_path)).collect()}
    name = lambda u: unquote(re.sub("^file://(localhost)?", "", u.replace("http", "file"))).rsplit("/", 1)[-1]
    assert got == {i: (re.sub(r"\.[^.]*$", "", name(u)), f"{name(u)} - x"[:44].strip(" -")) for i, u in enumerate(urls)}


def test_kmeans_runs_18_clusters_and_up_to_40_rounds(spark, sf_dir):
    rows = sorted((r.vec_id, r.vec) for r in vectors(spark, sf_dir).select("vec_id", "vec").collect())
    x = np.array([v for _, v in rows], float)
    c = x[:18] / np.linalg.norm(x[:18], axis=1, keepdims=True)
    for _ in range(40):
        lab, before = (x @ c.T).argmax(axis=1), c.copy()
        for k in set(lab):
            m = x[lab == k].mean(axis=0)
            c[k] = m / np.linalg.norm(m)
        if np.allclose(c, before, atol=1e-12):
            break
    got = {r.vec_id: r.cluster for r in catalogue.QUERIES["kmeans_spherical"](spark, sf_dir).collect()}
    assert got == {i: k for (i, _), k in zip(rows, (x @ c.T).argmax(axis=1).tolist())}


def test_levels_round_as_their_sql(spark, tmp_path):
    # a rise of 24.46 is above its upper quartile, and 89.23 above half its 95th percentile, in the last digit only
    rises = [(0.0, 1.0)] * 15 + [(0.01, 24.47), (0.0, 24.46)] + [(0.0, 30.0 + i) for i in range(15)]
    assert rises[15][1] - rises[15][0] == 24.46 - 2**-48
    series = {1: [x for pair in rises for x in pair], 2: [89.23] * 10 + [1.0] * 45 + [178.28, 180.08, 190.0, 200.0], 3: [None, None], 4: [5.0], 5: [None, 7.0, 7.0, 7.0, 9.0]}
    start = datetime.datetime(2024, 1, 1)
    rows = [(100 * u + i, start + datetime.timedelta(seconds=i), u, "view", x, "{}") for u, xs in series.items() for i, x in enumerate(xs)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for name in ("signal_flux_peaks", "signal_summary"):
        df = catalogue.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(df.columns)} from ({catalogue.ORACLE[name]})").fetchall()
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
        assert len(want) == (16 if name == "signal_flux_peaks" else 5)
