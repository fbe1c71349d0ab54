"""Ordered rule tables for genres, moods and tags, as one evaluator over columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Family by words of the sub-genre, first match wins.
FAMILY_WORDS = [
    ("halftime", ["halftime"]),
    ("psytrance", ["psy", "goa"]),
    ("trance", ["trance"]),
    ("dnb-juke", ["drum n bass", "jungle", "juke", "footwork"]),
    ("dubstep-bass", ["dubstep", "bassline", "grime", "riddim"]),
    ("hardcore", ["hardcore", "gabber"]),
    ("techno", ["techno", "tribal", "industrial"]),
    ("house", ["house", "electro"]),
    ("ambient-downtempo", ["ambient", "downtempo", "experimental", "chillwave", "vaporwave", "glitch", "idm", "drone", "trip hop", "new age", "leftfield"]),
]
# Tag by words of the sub-genre.
TAG_WORDS = [
    ("disco", ["disco", "funk", "soul", "boogie"]),
    ("psy", ["psy", "goa"]),
    ("trance", ["trance"]),
    ("dnb", ["drum n bass", "jungle", "juke", "footwork"]),
    ("bass", ["dubstep", "bassline", "grime", "riddim", "halftime", "bass music"]),
    ("Techno", ["techno", "tribal", "industrial"]),
    ("house", ["house", "garage", "electro"]),
]
# Sub-genres too general to name a cluster.
GENERIC = ("house", "techno", "trance", "hip-hop", "instrumental", "gangsta", "conscious", "electronic", "pop", "rock", "synth-pop", "alternative-rock", "psychedelic-rock", "hard-rock", "blues-rock", "hands-up", "hip-hop-1")
# Moods that the vibe rules read.
MOODS = ("mood_happy", "mood_relaxed", "mood_sad", "mood_aggressive", "mood_party", "energy")


def has_any(s: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(s, F.lit(w)) for w in words))


def first_match(rules: Sequence[tuple[Column, str | None]], otherwise: str | None = None) -> Column:
    """The value of the first rule whose condition holds."""
    out = None
    for condition, value in rules:
        out = F.when(condition, F.lit(value)) if out is None else out.when(condition, F.lit(value))
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def genre_parts(full: Column) -> tuple[Column, Column]:
    """(parent, lower-cased sub-genre) of ``parent---sub``."""
    full = F.coalesce(full, F.lit("?"))
    return F.substring_index(full, "---", 1), F.lower(F.when(F.contains(full, F.lit("---")), F.substr(full, F.instr(full, "---") + 3)).otherwise(F.lit("")))


def genre_family(full: Column) -> Column:
    parent, sub = genre_parts(full)
    rules = [(parent == "Hip Hop", "hip-hop"), (parent != "Electronic", "other")]
    return first_match([*rules, *[(has_any(sub, w), name) for name, w in FAMILY_WORDS], (sub == "hip hop", "hip-hop")], "other")


def genre_tag(full: Column) -> Column:
    parent, sub = genre_parts(full)
    rules = [((parent == "Hip Hop") | (sub == "hip hop"), "hip-hop"), (parent != "Electronic", None)]
    return first_match([*rules, *[(has_any(sub, w), name) for name, w in TAG_WORDS]])


def display_family(genre: Column) -> Column:
    s = F.lower(F.coalesce(genre, F.lit("none")))
    # Display families, first match wins.
    return first_match(
        [
            (has_any(s, ["trance", "goa"]), "Trance"),
            (has_any(s, ["techno", "schranz"]), "Techno"),
            (has_any(s, ["house"]) | (has_any(s, ["garage"]) & ~has_any(s, ["uk"])), "House"),
            (has_any(s, ["hip hop", "rap", "trap", "r&b"]), "Hip Hop"),
            (has_any(s, ["drum n bass", "jungle", "halftime", "neurofunk", "liquid"]), "DnB"),
            (has_any(s, ["bassline", "dubstep", "grime", "riddim", "uk garage", "breakbeat", "breaks"]) | (s == "bass music"), "Bass"),
            (has_any(s, ["ambient", "downtempo", "chill", "experimental", "idm", "drone", "new age", "trip hop"]), "Ambient"),
            (has_any(s, ["hardcore", "hardstyle", "gabber", "electro", "edm", "dance", "dub"]), "Electro/Hard"),
        ],
        "Other",
    )


# The thresholds and names of intensity, vibes and moods in the three rule lists below.


def intensity(aggressive: Column) -> Column:
    a = F.coalesce(aggressive, F.lit(0.0))
    return first_match([(a > 0.60, "peak"), (a > 0.35, "driving"), (a > 0.15, "groovy")], "warmup")


def vibes(happy: Column, relaxed: Column, sad: Column, aggressive: Column, party: Column, energy: Column, mode: Column) -> Column:
    """Array of vibe tags; a missing mood counts as 0."""
    h, r, s, a, p, e = (F.coalesce(c, F.lit(0.0)) for c in (happy, relaxed, sad, aggressive, party, energy))
    hypnotic = (a > 0.10) & (a < 0.60) & (h < 0.25) & (r < 0.50) & (s < 0.10) & (p > 0.87)
    minor = mode.eqNullSafe(F.lit("minor")) & (r > 0.55) & (h < 0.10) & (a < 0.30)
    rules = [
        ("happy", h > 0.40),
        ("chill", r > 0.60),
        ("dark", (s > 0.12) | ((a > 0.55) & (h < 0.10))),
        ("listening", p < 0.60),
        ("euphoric", (h > 0.50) & (e > 0.45) & (p > 0.90)),
        ("hypnotic", hypnotic),
        ("melancholic", ((s > 0.05) & (r > 0.40) & (h < 0.15)) | minor),
        ("feelgood", (h > 0.15) & (h <= 0.50) & (p > 0.90) & (a < 0.40) & ~hypnotic),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))


def map_mood(happy: Column, relaxed: Column, sad: Column, aggressive: Column, party: Column) -> Column:
    """The map's comma-joined moods, or a dash. There a missing or zero party or happy counts as 1."""
    h, r, s, a = (F.coalesce(c, F.lit(0.0)) for c in (happy, relaxed, sad, aggressive))
    p1, h1 = (F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(1.0)) for c in (party, happy))
    rules = [("happy", h > 0.40), ("chill", r > 0.60), ("dark", (s > 0.12) | ((a > 0.55) & (h1 < 0.10))), ("listening", p1 < 0.60)]
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))
    return F.when(F.size(found) == 0, F.lit("—")).otherwise(F.array_join(found, ","))
