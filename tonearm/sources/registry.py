"""Pluggable sources, and a cached, retried fetcher behind them."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from tonearm.operators import durable, store

SOURCES: dict[str, Callable[..., DataFrame]] = {}


def source(name: str):
    """Registers ``fn(spark, tracks, **options) -> DataFrame`` under a name."""

    def add(fn):
        SOURCES[name] = fn
        return fn

    return add


def fetch(name: str, spark: SparkSession, tracks: DataFrame, done: DataFrame | None = None, **options) -> DataFrame:
    """Rows of a source for the tracks that ``done`` lacks."""
    work = tracks if done is None else store.not_done(tracks, done, ["rb_id"])
    return SOURCES[name](spark, work, **options)


class Throttled(Exception):
    def __init__(self, after: float = 1.0):
        super().__init__(f"retry after {after}")
        self.after = after


def with_retries(call: Callable[[], Mapping], attempts: int = 4, sleep=time.sleep) -> Mapping:
    """The call's result; an error after the last attempt becomes a row that says so."""
    last: Exception | None = None
    for k in range(attempts):
        try:
            return call()
        except Throttled as e:
            last = e
            sleep(e.after)
        except (OSError, ValueError) as e:
            last = e
            sleep(2**k)
    return {"error": str(last)}


def cached_lookup(requests: DataFrame, cache: DataFrame, call: Callable[[str], Mapping], attempts: int = 4) -> DataFrame:
    """(k, v) for each distinct request key: from the cache, else called in Arrow batches on the executors.

    Answers are written as they come in, so that reading the result again calls nothing;
    a task that is run again repeats its own calls only.
    """
    missing = store.not_done(requests.select("k").distinct(), cache, ["k"])

    def run(frames: Iterable):
        for f in frames:
            yield f.assign(v=[json.dumps(with_retries(lambda k=k: call(k), attempts)) for k in f["k"]])

    fetched = durable.written(missing.mapInPandas(run, "k string, v string"))
    return fetched.unionByName(cache.join(requests.select("k"), "k", "left_semi").select("k", "v"))
