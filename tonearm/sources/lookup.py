"""Lookups at remote services: one rate for all tasks, steps that ask only what is still open, closed endpoints.

A service is a function ``call(key) -> mapping``; nothing here opens a connection. Requests
are dealt to a fixed number of lanes, and each lane has its part of the allowed rate, so
all tasks together keep to it however many run at once. Answers go to a table (k, v)
with JSON texts; what it holds is not asked again. An endpoint that rejects its first
request is closed by a row of that table and never asked again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.functions import text
from tonearm.operators import durable, enrich

from .registry import Throttled

#: Requests a second of all tasks together, lanes that share them, tries of a request.
RATE, LANES, ATTEMPTS = 1.0, 4, 4
#: Seconds that a throttled request waits for each try so far, if the service names none.
PAUSE = 3.0
#: Candidates of a search that are scored.
CANDIDATES = 5
CLOSED = "closed:"


class Rejected(Exception):
    """The service refuses; asking again is of no use."""

    def __init__(self, status: int):
        super().__init__(f"HTTP {status}")
        self.status = status


class Pace:
    """At most ``rate`` starts a second, evenly spaced from the first one on."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.free = 1.0 / rate, clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.free is not None and self.free > now:
            self.sleep(self.free - now)
            now = self.free
        self.free = now + self.gap


def answer(call: Callable[[str], Mapping], key: str, pace: Pace, attempts: int = ATTEMPTS) -> dict:
    """The call's result; what went wrong becomes an answer that says so."""
    for k in range(attempts):
        pace.wait()
        try:
            return dict(call(key))
        except Throttled as e:
            pace.sleep(e.after if e.after is not None else PAUSE * (k + 1))
        except Rejected as e:
            return {"error": str(e), "status": e.status}
        except (OSError, ValueError) as e:
            return {"error": str(e)}
    return {"error": "retries exhausted"}


def ask(requests: DataFrame, cache: DataFrame, call: Callable[[str], Mapping], rate: float = RATE, lanes: int = LANES, attempts: int = ATTEMPTS, pace: Callable[..., Pace] = Pace) -> DataFrame:
    """(k, v), written: an answer for each distinct request key, from the cache or else asked.

    A lane is a task's worth of keys with the pace ``rate / lanes``. A lost task repeats its own calls only.
    """
    wanted = requests.select("k").where("k is not null").distinct()
    missing = wanted.join(cache.select("k"), "k", "left_anti").repartition(lanes, "k")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pace(rate / lanes)
        for f in frames:
            yield f.assign(v=[json.dumps(answer(call, k, own, attempts)) for k in f["k"]])

    fresh = durable.written(missing.mapInPandas(run, "k string, v string"))
    return fresh.unionByName(cache.join(wanted, "k", "left_semi").select("k", "v"))


def known(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with the answers that it lacks."""
    return cache.select("k", "v").unionByName(answers.select("k", "v").join(cache.select("k"), "k", "left_anti").dropDuplicates(["k"]))


def ask_open(endpoint: str, requests: DataFrame, cache: DataFrame, call: Callable[[str], Mapping], **options) -> DataFrame:
    """``ask``, but for an endpoint that may be closed: one key goes first, and a rejection closes it for good.

    The row that closes it is among the answers, so a cache that takes them knows it later.
    """
    latch = CLOSED + endpoint
    shut = cache.where(F.col("k") == latch)
    if not shut.isEmpty():
        return cache.join(requests.select("k").distinct(), "k", "left_semi").select("k", "v").unionByName(shut.select("k", "v"))
    missing = requests.select("k").where("k is not null").join(cache.select("k"), "k", "left_anti")
    first = ask(missing.orderBy("k").limit(1), cache, call, **options)
    status = F.get_json_object("v", "$.status").cast("int")
    closed = first.where(status.between(400, 409)).select(F.lit(latch).alias("k"), "v")
    if not closed.isEmpty():
        seen = cache.join(requests.select("k").distinct(), "k", "left_semi").select("k", "v")
        return seen.unionByName(closed)
    return ask(requests, known(cache, first), call, **options)


RELEASE = "struct<id:long,title:string,catno:string,year:string,label:array<string>,genre:array<string>,style:array<string>>"


def release_steps(number: Column, artist: Column, title: Column) -> list[Column]:
    """Request keys of a release search, the strongest first: catalogue number, artist and title, free words."""
    asked = lambda **parts: F.to_json(F.struct(*[p.alias(n) for n, p in sorted(parts.items())]))
    return [F.when(number.isNotNull(), asked(catno=number)), asked(artist=artist, track=title), asked(q=F.concat_ws(" ", artist, title))]


def find_releases(tracks: DataFrame, cache: DataFrame, call: Callable[[str], Mapping], **options) -> tuple[DataFrame, DataFrame]:
    """(matches, cache) of tracks (rb_id, artist, title).

    A step asks only for tracks that the steps before found nothing for. Matches have rb_id,
    matched, confidence and the best candidate's facts; tracks without one have matched 0.
    """
    artist, title = F.coalesce("artist", F.lit("")), text.clean_title(F.col("title"))
    left = tracks.select("rb_id", artist.alias("artist"), title.alias("title"), text.catalogue_number(F.col("title")).alias("number"))
    found = []
    for key in release_steps(F.col("number"), F.col("artist"), F.col("title")):
        asked = left.withColumn("k", key)
        cache = durable.written(known(cache, ask(asked, cache, call, **options)))
        got = asked.join(cache, "k").select("rb_id", "artist", "title", "number", F.from_json(F.get_json_object("v", "$.results"), f"array<{RELEASE}>").alias("results"))
        got = durable.written(got.where(F.size("results") > 0))
        found.append(got)
        left = durable.written(left.join(got.select("rb_id"), "rb_id", "left_anti"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    one = every.select("rb_id", "artist", "title", "number", F.posexplode(F.slice("results", 1, CANDIDATES)).alias("position", "r"))
    same = F.coalesce((F.col("number").isNotNull()) & (text.normalise(F.col("number")) == text.normalise(F.col("r.catno"))), F.lit(False))
    score = text.match_confidence(F.concat_ws(" ", "artist", "title"), F.col("r.title"), same, F.col("artist"))
    best = enrich.best_candidate(one.select("rb_id", "position", "r", score.alias("score")), ["rb_id"], "score", "position")
    head = lambda c: F.get(F.col(f"r.{c}"), F.lit(0)).alias(c)
    facts = best.select("rb_id", F.round("score", 2).alias("confidence"), F.col("r.id").alias("release_id"), *[head(c) for c in ("label", "genre", "style")], F.col("r.year").alias("year"), F.col("r.catno").alias("catno"))
    out = tracks.select("rb_id").join(facts, "rb_id", "left")
    return out.withColumn("matched", F.col("confidence").isNotNull().cast("int")).withColumn("confidence", F.coalesce("confidence", F.lit(0.0))), cache


def find_recordings(tracks: DataFrame, cache: DataFrame, call: Callable[[str], Mapping], **options) -> tuple[DataFrame, DataFrame]:
    """(matches, cache) of tracks (rb_id, isrc): recording, its artist's genres, and its features while that endpoint is open."""
    keyed = tracks.where(F.coalesce("isrc", F.lit("")) != "").select("rb_id", "isrc", F.concat(F.lit("isrc:"), "isrc").alias("k"))
    cache = durable.written(known(cache, ask(keyed, cache, call, **options)))
    item = F.from_json(F.get_json_object("v", "$.items"), "array<struct<id:string,release_date:string,artist:string>>")
    got = keyed.join(cache, "k", "left").select("rb_id", "isrc", F.get(item, F.lit(0)).alias("t"))
    got = durable.written(got.select("rb_id", "isrc", F.col("t.id").alias("track_id"), F.col("t.release_date").alias("release_date"), F.concat(F.lit("artist:"), "t.artist").alias("a"), F.concat(F.lit("features:"), "t.id").alias("f")))
    cache = durable.written(known(cache, ask(got.select(F.col("a").alias("k")), cache, call, **options)))
    cache = durable.written(known(cache, ask_open("features", got.select(F.col("f").alias("k")), cache, call, **options)))
    genres = cache.select(F.col("k").alias("a"), F.coalesce(F.get_json_object("v", "$.genres"), F.lit("[]")).alias("artist_genres"))
    names = ("energy", "danceability", "valence", "tempo", "key", "mode")
    features = cache.select(F.col("k").alias("f"), *[F.get_json_object("v", f"$.{n}").cast("double").alias(n) for n in names])
    out = got.join(genres, "a", "left").join(features, "f", "left")
    return out.select("rb_id", F.col("track_id").isNotNull().cast("int").alias("matched"), "track_id", "isrc", "artist_genres", "release_date", *names), cache
