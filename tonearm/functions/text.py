"""Text columns: normal forms, title cleaning, catalogue numbers, fuzzy ratio, labels."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words whose bracket is dropped from a title, the brackets, and the featuring tail.
NOISE_WORDS = "mix|edit|remix|rmx|version|dub|instrumental|bootleg|rework|vip|extended|original|radio|beatless|acapella"
NOISE_BRACKET = rf"(?i)\s*[\(\[][^)\]]*\b({NOISE_WORDS})\b[^)\]]*[\)\]]"
OTHER_BRACKET = r"[\[\(][^)\]]*[\)\]]"
FEATURING = r"(?i)\s*\b(feat\.?|ft\.?|featuring)\b.*$"
# Pattern of a catalogue number, artists and titles of one-shot samples.
CATALOGUE = r"[\[\(]\s*([A-Za-z]{2,}[A-Za-z0-9]*\d{2,}[A-Za-z0-9]*)\s*[\]\)]"
JUNK_ARTISTS = ("loopmasters", "", "none")
JUNK_TITLE = r"^[A-Z0-9'_ -]{1,14}$"


def _plain(c: Column) -> Column:
    return F.lower(F.coalesce(c.cast("string"), F.lit("")))


def normalise(c: Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one blank; trimmed."""
    return F.trim(F.regexp_replace(_plain(c), "[^a-z0-9]+", " "))


def match_label(c: Column) -> Column:
    """Lower case with nothing but a-z and 0-9 left."""
    return F.regexp_replace(_plain(c), "[^a-z0-9]+", "")


def slug(c: Column) -> Column:
    """Lower case joined by hyphens; ``x`` when nothing is left."""
    bare = F.btrim(F.regexp_replace(_plain(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(bare == "", "x").otherwise(bare)


def clean_title(c: Column) -> Column:
    """Without remix brackets, featuring tails, other brackets and doubled blanks."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), NOISE_BRACKET, "")
    s = F.regexp_replace(s, FEATURING, "")
    s = F.regexp_replace(s, OTHER_BRACKET, "")
    return F.btrim(F.regexp_replace(s, r"\s+", " "), F.lit(" -"))


def catalogue_number(c: Column) -> Column:
    """The catalogue number in brackets, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), CATALOGUE, 1), F.lit(""))


def is_junk(length: Column, artist: Column, title: Column) -> Column:
    """Short rows by junk artists or with sample-like titles; long rows never."""
    sample = F.coalesce(title, F.lit("")).rlike(JUNK_TITLE) & ~F.contains(F.coalesce(title, F.lit("")), F.lit(" "))
    return F.when(F.coalesce(length, F.lit(0)) >= 60, False).otherwise(normalise(artist).isin(*JUNK_ARTISTS) | sample)


def display_label(artist: Column, title: Column, most: int) -> Column:
    """``artist - title`` without loose ends, cut to ``most`` characters."""
    return F.left(F.btrim(F.concat(F.coalesce(artist, F.lit("")), F.lit(" - "), F.coalesce(title, F.lit("?"))), F.lit(" -")), F.lit(most))


def base_name(path: Column) -> Column:
    """File name without folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def file_path(uri: Column) -> Column:
    """Path of a ``file://`` URI with escapes read; plus signs and per cent signs that start no escape stay."""
    bare = F.regexp_replace(uri, r"^file://(localhost)?", "")
    escaped = F.replace(F.regexp_replace(bare, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(F.contains(bare, F.lit("%")), F.try_url_decode(escaped)).otherwise(bare)


def year_prefix(c: Column) -> Column:
    """The first four characters as a number, or null."""
    return F.left(c.cast("string"), F.lit(4)).try_cast("int")


def not_sentinel(c: Column) -> Column:
    """Null for empty and ``none``."""
    return F.when(F.lower(c) != "none", F.nullif(c, F.lit("")))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; no built-in function computes it."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


@F.pandas_udf(T.StringType())
def title_case(s: pd.Series) -> pd.Series:
    """Python's title case, which capitalises after any non-letter."""
    return s.map(lambda x: None if x is None else x.title())


def match_confidence(query: Column, title: Column, same_number: Column, artist: Column) -> Column:
    """Ratio of normal forms, at least .95 for an equal catalogue number, .15 more (1 at most) if the artist is in the title."""
    ratio = sequence_ratio(normalise(query), normalise(title))
    ratio = F.when(same_number, F.greatest(ratio, F.lit(0.95))).otherwise(ratio)
    named = (normalise(artist) != "") & F.contains(normalise(title), normalise(artist))
    return F.when(named, F.least(F.lit(1.0), ratio + 0.15)).otherwise(ratio)


def missing_hashtags(comment: Column, tags: Column) -> Column:
    """Tags (array of text) that are not part of the comment, as sorted hashtags."""
    marked = F.transform(tags, lambda t: F.concat(F.lit("#"), t))
    return F.array_sort(F.filter(marked, lambda t: ~F.contains(F.coalesce(comment, F.lit("")), t)))


def with_hashtags(comment: Column, tags: Column) -> Column:
    """The comment with its missing hashtags appended."""
    own = F.coalesce(comment, F.lit(""))
    new = missing_hashtags(comment, tags)
    return F.when(F.size(new) == 0, own).otherwise(F.trim(F.concat(F.rtrim(own), F.lit(" "), F.array_join(new, " "))))
