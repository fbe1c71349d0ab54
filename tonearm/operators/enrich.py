"""Enrichment: candidates, best match, confidence-gated resolution of two sources, fill-empty apply, provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonearm.functions import text

FIELDS = ("genre", "label", "year", "catno")
#: Default gate of a match.
MIN_CONFIDENCE = 0.6


def is_missing(field: str) -> Column:
    """Empty as the target sees it: null or blank text; zero for the year."""
    return F.coalesce(F.col(field), F.lit(0)) == 0 if field == "year" else F.coalesce(F.trim(F.col(field)), F.lit("")) == ""


def candidates(tracks: DataFrame, fields: Sequence[str], limit: int | None, order: str) -> DataFrame:
    """Tracks that are not junk and lack any of ``fields``, in order; ``limit`` ends the scan early."""
    out = tracks.where(~text.is_junk(F.col("length"), F.col("artist"), F.col("title")))
    if fields:
        lacks = is_missing(fields[0])
        for f in fields[1:]:
            lacks = lacks | is_missing(f)
        out = out.where(lacks)
    return out.orderBy(order).limit(limit) if limit is not None else out


def best_candidate(found: DataFrame, key: Sequence[str], score: str, position: str) -> DataFrame:
    """The best-scored candidate of each key; the first of equals; none when no score is above 0."""
    rest = [c for c in found.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(position))).alias("b")
    return found.where(F.col(score) > 0).groupBy(*key).agg(best).select(*key, *[F.col(f"b.{c}").alias(c) for c in rest])


def resolve(releases: DataFrame, streams: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rb_id, and per field value, source, confidence) from both sources' rows.

    Releases count if matched with enough confidence; style goes before genre; a stream's
    first genre and release year fill in. A year or genre that a stream gave has no confidence.
    """
    r = releases.select("rb_id", "matched", "confidence", *[F.col(c).alias("r_" + c) for c in ("label", "genre", "style", "year", "catno")])
    both = r.join(streams.where("matched = 1").select("rb_id", "artist_genres", "release_date"), "rb_id", "full")
    ok = (F.coalesce(F.col("matched"), F.lit(0)) != 0) & (F.coalesce(F.col("confidence"), F.lit(0.0)) >= min_confidence)
    given = F.coalesce(F.nullif("r_style", F.lit("")), F.nullif("r_genre", F.lit("")))
    first = F.nullif(F.get(F.from_json("artist_genres", "array<string>"), F.lit(0)), F.lit(""))
    stream_genre = text.title_case(first)
    has_genre = ok & given.isNotNull()
    has_year = ok & (F.coalesce("r_year", F.lit(0)) != 0)
    stream_year = text.year_prefix(F.nullif("release_date", F.lit("")))

    def value(name: str, v: Column, source: Column, confidence: Column) -> Column:
        return F.when(v.isNotNull(), F.struct(v.cast("string").alias("value"), source.alias("source"), confidence.alias("confidence"))).alias(name)

    releases_, streams_ = F.lit("discogs"), F.lit("spotify")
    return both.select(
        "rb_id",
        value("genre", F.when(has_genre, given).otherwise(stream_genre), F.when(has_genre, releases_).otherwise(streams_), F.when(has_genre, F.col("confidence"))),
        value("label", F.when(ok, text.not_sentinel(F.col("r_label"))), releases_, F.col("confidence")),
        value("year", F.when(has_year, text.year_prefix(F.col("r_year"))).otherwise(stream_year), F.when(has_year, releases_).otherwise(streams_), F.when(has_year, F.col("confidence"))),
        value("catno", F.when(ok, text.not_sentinel(F.col("r_catno"))), releases_, F.col("confidence")),
    )


def provenance(tracks: DataFrame, resolved: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(rb_id, field, value, source, confidence) for each empty field that gets a value."""
    joined = tracks.select("rb_id", *fields).join(resolved.select("rb_id", *[F.col(f).alias("new_" + f) for f in fields]), "rb_id")
    rows = F.array_compact(F.array(*[F.when(is_missing(f) & F.col("new_" + f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col("new_" + f).alias("new"))) for f in fields]))
    return joined.select("rb_id", F.explode(rows).alias("x")).select("rb_id", "x.field", "x.new.value", "x.new.source", "x.new.confidence")


def apply_fills(tracks: DataFrame, resolved: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """``tracks`` with empty fields filled; every other column and row as it was."""
    new = resolved.select("rb_id", *[F.col(f"{f}.value").alias("new_" + f) for f in fields])
    joined = tracks.join(new, "rb_id", "left")
    kinds = {f.name: f.dataType for f in tracks.schema.fields}
    return joined.select(*[F.when(is_missing(c) & F.col("new_" + c).isNotNull(), F.col("new_" + c).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in tracks.columns])


def fetch_report(found: DataFrame, source: str) -> DataFrame:
    """One row: rows, matched, match rate, mean confidence of the matched."""
    hit = F.col("matched") == 1
    return found.agg(F.count("*").alias("fetched"), F.count_if(hit).alias("matched"), F.try_divide(F.count_if(hit), F.count("*")).alias("rate"), F.avg(F.when(hit, F.col("confidence"))).alias("confidence")).withColumn("source", F.lit(source))


def ranked_report(tracks: DataFrame, found: DataFrame) -> DataFrame:
    """All tracks with their match, best confidence first, unmatched last."""
    return tracks.join(found, "rb_id", "left").orderBy(F.col("confidence").desc_nulls_last(), "rb_id")


def latest_applied(log: DataFrame) -> DataFrame:
    """The last applied value of each track and field."""
    w = W.partitionBy("rb_id", "field").orderBy(F.col("applied_at").desc())
    return log.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
