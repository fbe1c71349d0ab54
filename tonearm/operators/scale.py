"""The energy scale: robust z, grouped score, deciles, frozen calibration, absolute anchors, validation."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import durable
from .store import number_rows, running_total

# Components (sign, group), group weights, anchors (calm end, hard end).
COMPONENTS = {
    "onsets_per_beat": (+1, "drive"),
    "r_bass": (+1, "weight"),
    "r_sub": (+1, "weight"),
    "r_hi": (+1, "weight"),
    "sustain": (+1, "full"),
    "crest": (-1, "full"),
    "dyn_range": (-1, "full"),
    "ml_aggressive": (+1, "percept"),
    "ml_party": (+1, "percept"),
    "ml_energy": (+1, "percept"),
    "ml_relaxed": (-1, "percept"),
}
GROUP_WEIGHTS = {"drive": 0.40, "weight": 0.25, "full": 0.20, "percept": 0.15}
ANCHORS = {
    "onsets_per_beat": (0.5, 6.0),
    "r_bass": (0.0, 0.40),
    "r_sub": (0.0, 0.50),
    "r_hi": (0.0, 0.15),
    "sustain": (0.0, 1.0),
    "crest": (8.0, 1.0),
    "dyn_range": (3.0, 0.0),
    "ml_aggressive": (0.0, 1.0),
    "ml_party": (0.0, 1.0),
    "ml_energy": (0.0, 1.0),
    "ml_relaxed": (1.0, 0.0),
}


@dataclass(frozen=True)
class Scale:
    """Components by name (sign, group) and the groups' weights."""

    components: Mapping[str, tuple[int, str]]
    weights: Mapping[str, float]

    def members(self, group: str) -> list[str]:
        return [n for n, (_, g) in self.components.items() if g == group]


ENERGY = Scale(COMPONENTS, GROUP_WEIGHTS)


@dataclass(frozen=True)
class Calibration:
    """Frozen medians and IQRs of features and raw group means, and score thresholds."""

    features: Mapping[str, tuple[float, float]]
    groups: Mapping[str, tuple[float, float]]
    thresholds: tuple[float, ...]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "Calibration":
        d = json.loads(text)
        return cls({k: tuple(v) for k, v in d["features"].items()}, {k: tuple(v) for k, v in d["groups"].items()}, tuple(d["thresholds"]))

    def is_stale(self, scale: Scale) -> bool:
        """Calibrated on other components: then the relative scale applies."""
        return set(self.features) != set(scale.components)


def robust_z(x: Column, median: Column, iqr: Column) -> Column:
    return F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (x - median) / (iqr + F.lit(1e-12))))


def quantiles(rows: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, dict[float, float | None]]:
    """Exact quantiles of columns, interpolated between neighbours; nulls do not count, an empty column has None.

    All columns are counted by value and put in one global order of range partitions, so
    no task holds a column's values. The driver sees one row a column and two a quantile.
    """
    names = list(wanted)
    cells = [F.struct(F.lit(i).alias("column"), F.col(n).cast("double").alias("value")) for i, n in enumerate(names)]
    counts = rows.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    placed = running_total(counts, [F.col("column"), F.col("value")], "n", "before")
    spans = {r["column"]: (r["first"], r["total"]) for r in placed.groupBy("column").agg(F.min("before").alias("first"), F.sum("n").alias("total")).collect()}
    place = {(names[i], q): first + q * (total - 1) for i, (first, total) in spans.items() for q in wanted[names[i]]}
    ends = sorted({e for x in place.values() for e in (math.floor(x), math.ceil(x))})
    if not ends:
        return {n: dict.fromkeys(wanted[n]) for n in names}
    held = placed.where(F.exists(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: (e >= F.col("before")) & (e < F.col("before") + F.col("n")))).collect()
    at = {e: r["value"] for r in held for e in ends if r["before"] <= e < r["before"] + r["n"]}

    def value(n: str, q: float) -> float | None:
        x = place.get((n, q))
        if x is None:
            return None
        low, high = at[math.floor(x)], at[math.ceil(x)]
        return low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high

    return {n: {q: value(n, q) for q in wanted[n]} for n in names}


def spreads(rows: DataFrame, names: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """Exact median and IQR of each column."""
    got = quantiles(rows, dict.fromkeys(names, (0.25, 0.5, 0.75)))
    return {n: (q[0.5], None if q[0.5] is None else q[0.75] - q[0.25]) for n, q in got.items()}


def _z(name: str, spread: tuple[float | None, float | None]) -> Column:
    median, iqr = (F.lit(x).cast("double") for x in spread)
    return robust_z(F.col(name), median, iqr)


def _means(rows: DataFrame, scale: Scale, features: Mapping[str, tuple[float, float]]) -> DataFrame:
    """``rows`` with z_<component> and m_<group>."""
    out = rows.withColumns({f"z_{n}": _z(n, features[n]) * float(sign) for n, (sign, _) in scale.components.items()})
    return out.withColumns({f"m_{g}": reduce(lambda a, b: a + b, [F.col(f"z_{n}") for n in scale.members(g)]) / float(len(scale.members(g))) for g in scale.weights})


def _total(means: DataFrame, scale: Scale, groups: Mapping[str, tuple[float, float]]) -> DataFrame:
    """``means`` with g_<group> and score."""
    out = means.withColumns({f"g_{g}": _z(f"m_{g}", groups[g]) for g in scale.weights})
    return out.withColumn("score", reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(f"g_{g}") for g, w in scale.weights.items()]))


def _group_spreads(means: DataFrame, scale: Scale) -> dict[str, tuple[float | None, float | None]]:
    got = spreads(means, [f"m_{g}" for g in scale.weights])
    return {g: got[f"m_{g}"] for g in scale.weights}


def score(rows: DataFrame, scale: Scale = ENERGY, calibration: Calibration | None = None) -> DataFrame:
    """``rows`` with z_<component>, m_<group> (raw mean), g_<group> (standardised again) and score.

    Without a calibration the rows are written once, since statistics and scores read them again.
    """
    if calibration is not None and not calibration.is_stale(scale):
        return _total(_means(rows, scale, calibration.features), scale, calibration.groups)
    rows = durable.written(rows)
    means = _means(rows, scale, spreads(rows, list(scale.components)))
    return _total(means, scale, _group_spreads(means, scale))


def relative_deciles(scored: DataFrame, key: str, by: str = "score") -> DataFrame:
    """``scored`` with pct = (rank + .5) / n and decile 1 to 10; equal scores rank by key.

    Ranks come from range partitions and their counts, not from one global window.
    """
    n = scored.agg(F.count("*").alias("__total"))
    ranked = number_rows(scored, [F.col(by), F.col(key)], "__rank").crossJoin(F.broadcast(n))
    pct = (F.col("__rank") - 0.5) / F.col("__total")
    return ranked.withColumn("pct", pct).withColumn("decile", F.least(F.floor(F.col("pct") * 10.0) + 1, F.lit(10)).cast("int")).drop("__rank", "__total")


def frozen_decile(value: Column, thresholds: Column) -> Column:
    """1 + the number of thresholds at or below the value."""
    return (F.size(F.filter(thresholds, lambda t: t <= value)) + 1).cast("int")


def thresholds(scored: DataFrame, by: str = "score") -> tuple[float | None, ...]:
    """Seven octiles, and two more bands of the last one's width as headroom."""
    octiles = list(quantiles(scored, {by: [k / 8 for k in range(1, 8)]})[by].values())
    if octiles[0] is None:
        return (None,) * 9
    band = octiles[6] - octiles[5]
    return (*octiles, octiles[6] + band, octiles[6] + 2 * band)


def calibrate(rows: DataFrame, scale: Scale = ENERGY) -> Calibration:
    """Statistics of features and raw group means, so that rescoring the same rows gives the same deciles."""
    rows = durable.written(rows)
    features = spreads(rows, list(scale.components))
    means = _means(rows, scale, features)
    groups = _group_spreads(means, scale)
    found = thresholds(_total(means, scale, groups))
    durable.drop(rows)
    return Calibration(features, groups, found)


def absolute_score(scale: Scale, anchors: Mapping[str, tuple[float, float]]) -> Column:
    """0 to 10 against fixed anchors; independent of the other rows."""
    total = F.lit(0.0)
    for g, w in scale.weights.items():
        parts = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(n) - anchors[n][0]) / (anchors[n][1] - anchors[n][0]))) for n in scale.members(g)]
        total = total + F.lit(float(w)) * (reduce(lambda a, b: a + b, parts) / float(len(parts)))
    return total * 10.0


def component_correlations(scored: DataFrame, scale: Scale = ENERGY) -> DataFrame:
    """(name, r): Pearson correlation of every component and group with the score, in one aggregation."""
    names = [f"z_{n}" for n in scale.components] + [f"g_{g}" for g in scale.weights]
    row = scored.agg(*[F.corr(n, "score").alias(n) for n in names])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n[2:]).alias("name"), F.col(n).alias("r")) for n in names])).alias("x")).select("x.name", "x.r")


def pair_consistency(pairs: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """One row: pairs, mean distance of their percentiles, share more than two deciles apart."""
    s = scored.select(F.col(key).alias("k"), "pct", "decile")
    both = pairs.join(s.select(F.col("k").alias("a"), F.col("pct").alias("pa"), F.col("decile").alias("da")), "a").join(s.select(F.col("k").alias("b"), F.col("pct").alias("pb"), F.col("decile").alias("db")), "b")
    return both.agg(F.count("*").alias("pairs"), F.avg(F.abs(F.col("pa") - F.col("pb"))).alias("mean_distance"), F.avg((F.abs(F.col("da") - F.col("db")) > 2).cast("double")).alias("far_share"))


def group_medians(scored: DataFrame, group: str, by: str = "score") -> DataFrame:
    return scored.groupBy(group).agg(F.count("*").alias("n"), F.percentile(by, F.lit(0.5)).alias("median"))


def ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Average ranks for rank correlation: ties share the mean of their places."""
    counts = rows.groupBy(column).agg(F.count("*").alias("__c"))
    before = running_total(counts, [F.col(column)], "__c", "__b")
    mean = before.select(column, (F.col("__b") + (F.col("__c") + 1) / 2.0).alias(name))
    return rows.join(mean, column)
