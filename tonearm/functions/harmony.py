"""Keys on the Camelot wheel: from names, by arithmetic, and their compatibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The library's key names in wheel order, minor (A) then major (B) from 1 to 12.
WHEEL = ["Abm", "B", "Ebm", "F#", "Bbm", "Db", "Fm", "Ab", "Cm", "Eb", "Gm", "Bb", "Dm", "F", "Am", "C", "Em", "G", "Bm", "D", "F#m", "A", "Dbm", "E"]
# Pitch classes of note names.
PITCH = {"C": 0, "C#": 1, "Db": 1, "D": 2, "D#": 3, "Eb": 3, "E": 4, "F": 5, "F#": 6, "Gb": 6, "G": 7, "G#": 8, "Ab": 8, "A": 9, "A#": 10, "Bb": 10, "B": 11}


def _lookup(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def wheel_number(name: Column) -> Column:
    """1 to 12, or null for an unknown name."""
    return F.try_element_at(_lookup((k, i // 2 + 1) for i, k in enumerate(WHEEL)), name)


def wheel_letter(name: Column) -> Column:
    return F.try_element_at(_lookup((k, "AB"[i % 2]) for i, k in enumerate(WHEEL)), name)


def wheel_code(note: Column, mode: Column) -> Column:
    """Camelot code of a note and mode: a fifth up is one number up, 8B is C major and 8A is A minor."""
    pc = F.try_element_at(_lookup(PITCH.items()), note)
    number = F.when(mode == "major", F.pmod(pc * 7 + 7, F.lit(12)) + 1).when(mode == "minor", F.pmod((pc - 9) * 7 + 7, F.lit(12)) + 1)
    return F.concat(number.cast("string"), F.when(mode == "major", "B").otherwise("A"))


def keys_fit(n1: Column, l1: Column, n2: Column, l2: Column) -> Column:
    """Same number, or neighbours on the wheel with one letter; false when either is unknown."""
    near = (l1 == l2) & F.pmod(n1 - n2, F.lit(12)).isin(1, 11)
    return F.coalesce((n1 == n2) | near, F.lit(False))
