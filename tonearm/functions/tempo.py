"""Tempo columns: octave folding, bands, compatibility, half-time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half-open tempo bands.
BANDS = [(0, 75, "<75"), (75, 85, "75-85"), (85, 95, "85-95"), (95, 110, "95-110"), (110, 122, "110-122"), (122, 128, "122-128"), (128, 135, "128-135"), (135, 145, "135-145"), (145, 160, "145-160"), (160, 175, "160-175"), (175, 999, "175+")]
#: More octaves than lie between any two doubles.
MOST_OCTAVES = 2200


def _octaves(of: Column) -> Column:
    """The whole numbers from 0 on next to an octave count; doubling is exact, so one of them is the wanted one."""
    first = F.greatest(F.floor(F.least(F.greatest(of, F.lit(0.0)), F.lit(float(MOST_OCTAVES)))) - 1, F.lit(0)).cast("int")
    return F.sequence(first, first + 3)


def _double_below(b: Column, floor: float) -> Column:
    """Doubled until it is at least ``floor``: the least exact power of two that does."""
    steps = F.filter(_octaves(F.log2(F.lit(floor)) - F.log2(b)), lambda k: b * F.pow(F.lit(2.0), k) >= floor)
    return b * F.pow(F.lit(2.0), F.get(steps, F.lit(0)))


def _halve_from(b: Column, ceiling: float) -> Column:
    steps = F.filter(_octaves(F.log2(b) - F.log2(F.lit(ceiling))), lambda k: b / F.pow(F.lit(2.0), k) < ceiling)
    return b / F.pow(F.lit(2.0), F.get(steps, F.lit(0)))


def feel_tempo(family: Column, bpm: Column) -> Column:
    """Tempo as felt: fast hip-hop halves, slow four-to-the-floor and drum'n'bass double; 0 and null give null."""
    b = F.nullif(bpm, F.lit(0.0))
    return (
        F.when(family.isin("hip-hop", "halftime"), _halve_from(b, 118.0))
        .when(family.isin("house", "techno", "trance", "psytrance", "hardcore", "dubstep-bass"), _double_below(b, 95.0))
        .when(family == "dnb-juke", _double_below(b, 120.0))
        .otherwise(b)
    )


def canonical_tempo(bpm: Column) -> Column:
    """Folded into [90, 180); 0 and null give null."""
    return _halve_from(_double_below(F.nullif(bpm, F.lit(0.0)), 90.0), 180.0)


def tempo_band(bpm: Column) -> Column:
    b = F.nullif(bpm, F.lit(0.0))
    out = F.when(b.isNull(), "unknown-bpm")
    for lo, hi, name in BANDS:
        out = out.when((b >= lo) & (b < hi), name)
    return out.otherwise("175+")


def tempo_fits(a: Column, b: Column, tolerance: float) -> Column:
    """``a`` within ``tolerance`` of b, 2b or b/2, relative to the latter; false for null, 0 or NaN."""
    ok = F.lit(False)
    for r in (1.0, 2.0, 0.5):
        ok = ok | F.coalesce(F.abs(a - b * r) / F.nullif(b * r, F.lit(0.0)) <= tolerance, F.lit(False))
    usable = (a > 0) & (b > 0) & ~F.isnan(a) & ~F.isnan(b)
    return F.coalesce(usable, F.lit(False)) & ok


def is_half_time(bpm: Column, second: Column) -> Column:
    """At least 118 and within 5 % of twice the second estimate."""
    return F.coalesce((bpm >= 118) & (F.abs(bpm - 2 * second) / F.nullif(2 * second, F.lit(0.0)) < 0.05), F.lit(False))


def stored_tempo(bpm: Column) -> Column:
    """Hundredths as a whole number, halves to even."""
    return F.bround(bpm * 100, 0).cast("int")
