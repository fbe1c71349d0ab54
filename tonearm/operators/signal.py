"""Signal operators: differences and peaks in SQL, spectra and summaries over sample arrays in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Frame and hop, band edges in Hz, shortest signal in seconds and frames.
FRAME, HOP = 2048, 512
BAND_EDGES = {"r_sub": (20, 60), "r_bass": (60, 120), "r_lowmid": (120, 500), "r_mid": (500, 2000), "r_hi": (2000, 6000), "r_air": (6000, 11025)}
SHORTEST_S, SHORTEST_FRAMES = 20, 40


def positive_flux(samples: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``samples`` with ``flux``: the rise against the one before, 0 at the start and for falls."""
    w = W.partitionBy(key).orderBy(*order)
    return samples.withColumn("flux", F.greatest(F.lit(0.0), F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0))))


def levels(samples: DataFrame, key: str, value: str, shares: Mapping[str, float]) -> DataFrame:
    """(key, one column a share): quantiles of each series, null for one without values.

    Between neighbours, at a part d of the way, they are ``lo * (1 - d) + hi * d`` with one
    rounding for the first product and the sum, as DuckDB computes ``quantile_cont``. Rows
    are compared with these levels, so the last digit counts; Spark's ``percentile`` rounds
    both products.
    """
    own = W.partitionBy(key)
    ranked = samples.select(key, F.col(value).cast("double").alias("__v"))
    ranked = ranked.withColumns({"__at": F.row_number().over(own.orderBy(F.col("__v").asc_nulls_last())) - 1, "__n": F.count("__v").over(own)})
    place = {c: (F.col("__n") - 1) * F.lit(float(q)) for c, q in shares.items()}
    at = lambda where: F.max(F.when(F.col("__at") == where, F.col("__v")))
    ends = [x for c, p in place.items() for x in (F.max(p - F.floor(p)).alias(f"__d_{c}"), at(F.floor(p)).alias(f"__lo_{c}"), at(F.ceil(p)).alias(f"__hi_{c}"))]

    def between(c: str) -> Column:
        d, lo, hi = (F.col(f"__{k}_{c}") for k in ("d", "lo", "hi"))
        # a series without values never reaches the method, which takes no nulls
        return F.when(lo.isNotNull() & (d > 0), F.java_method(F.lit("java.lang.Math"), F.lit("fma"), lo, 1 - d, hi * d).cast("double")).otherwise(lo)

    return ranked.groupBy(key).agg(*ends).select(key, *[between(c).alias(c) for c in shares])


def peaks(samples: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows above their series' upper quartile, not below the one before and above the one after."""
    level = levels(samples, key, value, {"__p75": 0.75})
    w = W.partitionBy(key).orderBy(*order)
    marked = samples.withColumns({"__before": F.lag(value).over(w), "__after": F.lead(value).over(w)}).join(level, key)
    v = F.col(value)
    return marked.where((v > F.col("__p75")) & (v >= F.col("__before")) & (v > F.col("__after"))).drop("__before", "__after", "__p75")


def series_summary(samples: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, sustain, crest, dyn_range) per series of levels.

    sustain: share above half the 95th percentile; crest: p99 / p50; dyn_range: log10(p90 / p10).
    """
    p = (10, 50, 90, 95, 99)
    stats = levels(samples, key, value, {f"p{k}": k / 100 for k in p})
    joined = samples.join(stats, key)
    tiny = F.lit(1e-9)
    first = [F.first(f"p{k}").alias(f"p{k}") for k in p]
    out = joined.groupBy(key).agg(F.count("*").alias("n"), F.avg((F.col(value) > 0.5 * F.col("p95")).cast("double")).alias("sustain"), *first)
    return out.select(key, "n", "sustain", (F.col("p99") / (F.col("p50") + tiny)).alias("crest"), F.log10((F.col("p90") + tiny) / (F.col("p10") + tiny)).alias("dyn_range"))


def segment_starts(duration: Column, segments: int = 6, length: float = 15.0) -> Column:
    """Starts of evenly spaced segments from 5 % to 90 % less a segment; short signals have one at 0."""
    first, last = duration * 0.05, duration * 0.90 - length
    spaced = F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda k: first + (last - first) * k / float(segments - 1))
    return F.when(duration < 40, F.array(F.lit(0.0))).otherwise(spaced)


def spectrum(x: np.ndarray, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Magnitudes by frame and bin of Hann-windowed frames, without copying the frames first."""
    frames = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    return np.abs(np.fft.rfft(frames * np.hanning(frame), axis=1))


def summarise(x: np.ndarray, rate: float, bpm: float | None = None, frame: int = FRAME, hop: int = HOP, shortest_s: float = SHORTEST_S, shortest_frames: int = SHORTEST_FRAMES) -> dict[str, float] | None:
    """Features of one signal, or None when it is too short."""
    x = x[np.isfinite(x)] if len(x) >= shortest_s * rate else x[:0]
    if len(x) < frame or (len(x) - frame) // hop + 1 < shortest_frames:
        return None
    s = spectrum(x / (np.sqrt(np.mean(x * x)) + 1e-12), frame, hop)
    power, hz, seconds = s**2, np.fft.rfftfreq(frame, 1 / rate), len(x) / rate
    total = power.sum(axis=1) + 1e-12
    p10, p50, p90, p95, p99 = np.percentile(total, [10, 50, 90, 95, 99])
    flux = np.diff(s, axis=0).clip(min=0).sum(axis=1)
    flux /= np.median(flux) + 1e-12
    out = {n: np.median(power[:, (lo <= hz) & (hz < hi)].sum(axis=1) / total) for n, (lo, hi) in BAND_EDGES.items()}
    out["sustain"], out["crest"] = (total > p95 / 2).mean(), p99 / (p50 + 1e-12)
    out["dyn_range"] = np.log10(p90 / (p10 + 1e-12) + 1e-12)
    out["centroid"] = np.median(power @ hz / total)
    out["flux_p50"], level, out["flux_p90"] = np.percentile(flux, [50, 75, 90])
    before, here, after = flux[:-2], flux[1:-1], flux[2:]
    onsets = np.count_nonzero((here > level) & (here >= before) & (here > after))
    out["onset_rate"], out["dur"] = onsets / seconds, seconds
    if bpm and bpm > 40:
        out["onsets_per_beat"] = onsets / (seconds * bpm / 60)
        out["pump"] = regularity(total, rate / hop, bpm / 60)
    return {k: float(v) for k, v in out.items()}


def regularity(envelope: np.ndarray, per_second: float, beat_hz: float) -> float:
    """Strongest envelope component within 6 % of the beat, over the median from 0.1 to 20 Hz."""
    size = np.abs(np.fft.rfft((envelope - envelope.mean()) * np.hanning(len(envelope))))
    hz = np.fft.rfftfreq(len(envelope), 1 / per_second)
    near = (hz > beat_hz * 0.94) & (hz < beat_hz * 1.06)
    return size[near].max() / (np.median(size[(hz > 0.1) & (hz < 20)]) + 1e-12) if near.any() else 0.0


def signal_features(signals: DataFrame, key: str, samples: str, rate: float, bpm: str | None = None, **options) -> DataFrame:
    """(key, name, num) of every signal in an array column; each is read whole in its own row."""
    columns = [F.col(key).alias("k"), F.col(samples).alias("x"), (F.col(bpm) if bpm else F.lit(None)).cast("double").alias("b")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, x, b in zip(f["k"], f["x"], f["b"]):
                got = summarise(np.asarray(x, np.float64), rate, b if b == b and b else None, **options) if x is not None else None
                rows += [(k, n, v) for n, v in (got or {}).items()]
            yield pd.DataFrame(rows, columns=[key, "name", "num"])

    return signals.select(*columns).mapInPandas(run, f"{key} {signals.schema[key].dataType.simpleString()}, name string, num double")
