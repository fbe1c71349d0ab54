"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_S, _D, _I = StringType(), DoubleType(), IntegerType()
TRACK = _struct(rb_id=_S, artist=_S, title=_S, isrc=_S, seen_at=TimestampType())
RELEASES = _struct(rb_id=_S, matched=_I, confidence=_D, release_id=LongType(), label=_S, genre=_S, style=_S, year=_I, catno=_S, fetched_at=TimestampType(), raw=_S)
STREAMS = _struct(rb_id=_S, matched=_I, track_id=_S, isrc=_S, artist_genres=_S, release_date=_S, energy=_D, danceability=_D, valence=_D, tempo=_D, key=_I, mode=_I, fetched_at=TimestampType(), raw=_S)
FEATURE = _struct(rb_id=_S, source=_S, name=_S, num=_D, txt=_S, fetched_at=TimestampType())
SOURCE_RUN = _struct(source=_S, started_at=TimestampType(), finished_at=TimestampType(), fetched=_I, matched=_I)
APPLIED = _struct(rb_id=_S, field=_S, value=_S, source=_S, confidence=_D, applied_at=TimestampType())
HTTP_CACHE = _struct(k=_S, v=_S)
TRACK_FILES = _struct(rb_id=_S, path=_S)
EMBEDDING = _struct(rb_id=_S, model=_S, dim=_I, vec=ArrayType(FloatType()), fetched_at=TimestampType())
