"""Mel patches and model steps with linear stand-in models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.operators import heads


class Linear:
    """Softmax of a fixed product."""

    def __init__(self, weights, classes):
        self.weights, self.classes = weights, classes

    def predict(self, rows):
        z = np.exp(rows @ self.weights)
        return z / z.sum(axis=1, keepdims=True)


class Embedder:
    classes = ["low", "high"]

    def embed(self, rows):
        if rows.max() > 8:
            raise ValueError("too loud")
        vectors = rows.mean(axis=1)
        half = vectors.shape[1] // 2
        return vectors, np.stack([vectors[:, :half].sum(axis=1), vectors[:, half:].sum(axis=1)], axis=1)


def noted(path, model):
    def load():
        with open(path, "a") as f:
            f.write("x")
        return model

    return load


def test_mel_patches_against_plain_loops():
    rng = np.random.default_rng(1)
    x, bank = rng.normal(size=3000), heads.mel_bank(8000, 128, 12)
    mel = heads.mel_frames(x, bank, 128, 64)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(128) / 127)
    mels = [2595 * np.log10(1 + 4000 / 700) * i / 13 for i in range(14)]
    edges = [700 * (10 ** (m / 2595) - 1) for m in mels]
    n = 0
    while n * 64 + 128 <= len(x):
        spectrum = np.abs(np.fft.fft(x[n * 64 : n * 64 + 128] * window)[:65]) ** 2
        for b in range(12):
            total = 0.0
            for k in range(65):
                hz = k * 8000 / 128
                total += spectrum[k] * max(0.0, min((hz - edges[b]) / (edges[b + 1] - edges[b]), (edges[b + 2] - hz) / (edges[b + 2] - edges[b + 1])))
            assert abs(mel[n, b] - np.log10(1 + 10_000 * total)) < 1e-9
        n += 1
    assert len(mel) == n
    assert heads.patches(mel, 10).shape == (n // 10, 10, 12) and (heads.patches(mel, 10)[1] == mel[10:20]).all()
    short = heads.patches(mel[:4], 10)
    assert short.shape == (1, 10, 12) and (short[0, 4:] == 0).all() and heads.patches(mel[:0], 10).shape == (0, 10, 12)
    assert heads.even(np.arange(3), 7).tolist() == [0, 1, 2, 0, 1, 2, 0] and heads.even(np.arange(100), 4).tolist() == [0, 33, 66, 99]
    assert len(heads.mel_frames(x[:100], bank, 128, 64)) == 0


def test_heads_choose_the_positive_class_and_load_once(spark, tmp_path):
    rng = np.random.default_rng(2)
    w = rng.normal(size=(4, 2))
    model = {"mood_happy": Linear(w, ["happy", "non_happy"]), "danceability": Linear(-w, ["not_danceable", "danceable"])}
    path = str(tmp_path / "loads")
    x = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>").repartition(12)
    got = {(r.id, r.name): r.num for r in heads.score_heads(df, "id", "v", "two", noted(path, model)).collect()}
    want = {(i, n): m.predict(x)[i, c] for n, m, c in (("mood_happy", model["mood_happy"], 0), ("danceability_ml", model["danceability"], 1)) for i in range(300)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.0005 + 1e-9 for k in want)
    # twelve tasks, at most one load for each of the session's workers
    assert 1 <= len(open(path).read()) <= 4


def test_signals_are_embedded_row_by_row(spark, tmp_path):
    rng = np.random.default_rng(3)
    wave = lambda hz, n=4000, a=0.01: (a * np.sin(2 * np.pi * hz * np.arange(n) / 8000)).tolist()
    rows = [(1, [wave(200), wave(250)]), (2, [wave(3000)]), (3, None), (4, []), (5, [wave(200, 50), None]), (6, [wave(200, 4000, 1e4)]), (7, [rng.normal(size=600).tolist()])]
    df = spark.createDataFrame(rows, "id long, parts array<array<double>>").repartition(2)
    options = {"rate": 8000, "frame": 128, "hop": 64, "bands": 12, "patch": 10, "batch": 6}
    got = {r.id: r for r in heads.embed_signals(df, "id", "parts", "embedder", noted(str(tmp_path / "loads"), Embedder()), **options).collect()}
    assert [got[i].label for i in (1, 2, 3, 4, 5)] == ["low", "high", None, None, None] and got[3].error is None
    assert got[6].vector is None and got[6].error == "ValueError: too loud"
    bank = heads.mel_bank(8000, 128, 12)
    cut = np.concatenate([heads.patches(heads.mel_frames(np.array(p), bank, 128, 64), 10) for p in rows[0][1]])
    assert np.allclose(got[1].vector, Embedder().embed(heads.even(cut, 6))[0].mean(axis=0))


def test_clamp_and_middle(spark):
    df = spark.createDataFrame([(1.5,), (4.0,), (None,)], "d double")
    assert [r.x for r in df.select(heads.danceability(F.col("d")).alias("x")).collect()] == [0.5, 1.0, None]
    rows = [(1, list(range(131 * 2))), (2, list(range(130 * 2))), (3, None)]
    got = {r.id: r.m for r in spark.createDataFrame(rows, "id int, s array<int>").select("id", heads.middle(F.col("s"), 2).alias("m")).collect()}
    assert got == {1: list(range(60, 240)), 2: list(range(260)), 3: None}


def test_a_head_without_positive_class():
    assert heads.positive(["non_x", "x", "y"]) == 1
    with pytest.raises(StopIteration):
        heads.positive(["not_a", "non_a"])
