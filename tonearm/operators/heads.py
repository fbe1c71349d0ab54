"""Model steps over signals and vectors: mel patches, embedding, classifier heads.

Models are what a ``load`` function returns; nothing here brings one. A worker process
loads a model once, however many tasks and batches it runs, and rows go through it in
the batches in which Spark hands them over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sampling rate, frame, hop, mel bands, frames of a patch, patches of a model batch.
RATE, FRAME, HOP, BANDS, PATCH, BATCH = 16_000, 512, 256, 96, 128, 64
# Prefixes of classes that deny what a head is for; feature names that differ from their head's.
DENIALS = ("non_", "not_")
RENAMED = {"danceability": "danceability_ml"}
# Largest danceability, and start, end and least length in seconds of a signal's middle.
MOST_DANCE, MIDDLE = 3.0, (30, 120, 130)


def mel_bank(rate: float = RATE, frame: int = FRAME, bands: int = BANDS) -> np.ndarray:
    """(bands, frame / 2 + 1) triangles, evenly spaced on the mel scale up to half the rate."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1)
    hz = np.fft.rfftfreq(frame, 1 / rate)
    rise = (hz - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - hz) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall))


def mel_frames(samples: np.ndarray, bank: np.ndarray, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """(frames, bands) of log-compressed mel energies; a signal shorter than a frame has none."""
    if len(samples) < frame:
        return np.zeros((0, len(bank)))
    cut = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop]
    power = np.abs(np.fft.rfft(cut * np.hanning(frame), axis=1)) ** 2
    return np.log10(1 + 10_000 * (power @ bank.T))


def patches(mel: np.ndarray, size: int = PATCH) -> np.ndarray:
    """(n, size, bands): frames in patches that do not overlap; a short signal is filled up with zeros, a rest is left out."""
    if not len(mel):
        return np.zeros((0, size, mel.shape[1]))
    if len(mel) < size:
        mel = np.pad(mel, ((0, size - len(mel)), (0, 0)))
    n = len(mel) // size
    return mel[: n * size].reshape(n, size, -1)


def even(rows: np.ndarray, batch: int = BATCH) -> np.ndarray:
    """Exactly ``batch`` rows: few are repeated in turn, many are thinned evenly."""
    at = np.resize(np.arange(len(rows)), batch) if len(rows) < batch else np.linspace(0, len(rows) - 1, batch).astype(int)
    return rows[at]


_loaded: dict[str, Any] = {}


def loaded(name: str, load: Callable[[], Any]) -> Any:
    """The model of that name in this process, loaded on first use."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def positive(classes: Sequence[str]) -> int:
    """Place of the first class that does not deny."""
    return next(i for i, c in enumerate(classes) if not c.startswith(DENIALS))


def embed_signals(signals: DataFrame, key: str, segments: str, name: str, load: Callable[[], Any], **mel: int) -> DataFrame:
    """(key, vector, label, error) of signals with an array of segments (arrays of samples).

    The model has ``embed(patches) -> (vectors, scores)`` and ``classes``; the vector is the
    mean over a batch of patches, the label the class of the largest mean score. No patch
    gives nulls; what goes wrong in a row is its error and stops no other.
    """
    kind = signals.schema[key].dataType.simpleString()
    rate, frame, hop, bands, size, batch = (mel.get(n, v) for n, v in (("rate", RATE), ("frame", FRAME), ("hop", HOP), ("bands", BANDS), ("patch", PATCH), ("batch", BATCH)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tonearm.operators import heads

        model, bank = heads.loaded(name, load), mel_bank(rate, frame, bands)
        for f in frames:
            out = []
            for k, parts in zip(f["k"], f["x"]):
                try:
                    cut = [patches(mel_frames(np.asarray(p, np.float64), bank, frame, hop), size) for p in (parts if parts is not None else []) if p is not None]
                    rows = np.concatenate(cut) if cut else []
                    if not len(rows):
                        out.append((k, None, None, None))
                        continue
                    vectors, scores = model.embed(even(rows, batch))
                    out.append((k, np.mean(vectors, axis=0).tolist(), model.classes[int(np.mean(scores, axis=0).argmax())], None))
                except Exception as e:  # noqa: BLE001  a model may raise anything
                    out.append((k, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "vector", "label", "error"])

    return signals.select(F.col(key).alias("k"), F.col(segments).alias("x")).mapInPandas(run, f"{key} {kind}, vector array<double>, label string, error string")


def score_heads(vectors: DataFrame, key: str, vector: str, name: str, load: Callable[[], Mapping[str, Any]]) -> DataFrame:
    """(key, name, num): each head's probability of its positive class, to three places, for rows with a vector.

    ``load`` gives heads by name, each with ``predict(rows) -> probabilities`` and ``classes``.
    """
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tonearm.operators import heads

        model = heads.loaded(name, load)
        at = {h: positive(m.classes) for h, m in model.items()}
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
            for h, m in model.items():
                p = np.round(np.asarray(m.predict(rows), np.float64)[:, at[h]], 3)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([RENAMED.get(h, h)] * b.num_rows), pa.array(p)], [key, "name", "num"])

    held = vectors.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
    return held.mapInArrow(run, f"{key} {kind}, name string, num double")


def danceability(raw: Column) -> Column:
    """Danceability from 0 to 1."""
    return F.when(raw.isNotNull(), F.round(F.least(raw / MOST_DANCE, F.lit(1.0)), 3))


def middle(samples: Column, rate: int) -> Column:
    """The samples from 30 to 120 seconds of a signal of more than 130; a shorter one whole."""
    start, end, least = (s * rate for s in MIDDLE)
    return F.when(F.size(samples) > least, F.slice(samples, start + 1, end - start)).otherwise(samples)
