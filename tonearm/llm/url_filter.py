"""URL allow and block rules by a sort-merge range join.

A host's canonical key is its labels reversed, each ended by ``.`` (``org.example.``),
so a rule's host and all its subdomains are the keys in one interval: those that
begin with the rule's key. Urls and rules are sorted by key; a sweep keeps a stack of
the rule hosts whose intervals are open, which are nested prefixes of each other, and
tests the url's path against the paths of each.

Urls are dealt by ranges of (key, path, id), so one host with a third of all rows
spreads over many tasks. A rule goes to each range that its interval meets. The
range bounds are quantiles of a sample whose size follows from the number of ranges;
the rules themselves are never broadcast.

Defined results: of the rules that fit, the longest ``host + path`` wins; of equally
long ones the longer host, then block before allow. A null url or one without
``://`` has an empty host and path and fits no rule. Repeated rows give repeated
rows; a rule with a null host is ignored and a null path counts as empty; no rules
give the default verdict for all.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_columns, require, shuffle_partitions

#: Keys sampled for each range.
BOUND_KEYS = 32
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url as columns."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def host_key(host: Column) -> Column:
    """Labels reversed, each ended by a dot; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _bounds(keys: DataFrame, parts: int) -> list[tuple]:
    """Range bounds over (key, path, tie): quantiles of about ``BOUND_KEYS`` sampled rows a range, however many partitions are read."""
    total = keys.count()
    drawn = keys.where(F.rand(7) < min(1.0, BOUND_KEYS * parts / max(1, total)))
    got = sorted((r.key, r.path, r.tie) for r in drawn.collect())
    return sorted({got[len(got) * k // parts] for k in range(1, parts)}) if got else []


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for each row of ``pages``.

    ``rules`` has host, path and verdict; the verdict of a url that no rule fits is ``default``.
    """
    require(pages, key, url)
    require(rules, "host", "path", "verdict")
    spark = pages.sparkSession
    parts = shuffle_partitions(spark)
    host, path = url_parts(pages[url])
    urls = pages.select(pages[key].alias("id"), host.alias("host"), path.alias("path"))
    urls = urls.select("*", host_key(F.col("host")).alias("key"), F.xxhash64("id").alias("tie"))
    bounds = _bounds(urls.select("key", "path", "tie"), parts)

    @F.pandas_udf("int")
    def range_of(k: pd.Series, p: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, x) for x in zip(k, p, t)], dtype="int32")

    last = "\U0010ffff"

    @F.pandas_udf("array<int>")
    def ranges_of_rule(k: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect.bisect_left(bounds, (x,)), bisect.bisect_right(bounds, (x + last,)) + 1)) for x in k])

    r = rules.where("host is not null").select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    r = r.select("*", host_key(F.col("host")).alias("key"))
    events = urls.select(range_of("key", "path", "tie").alias("part"), "key", F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("verdict")).unionByName(
        r.select(F.explode(ranges_of_rule("key")).alias("part"), "key", F.lit(0).alias("kind"), F.lit(None).cast(urls.schema["id"].dataType).alias("id"), "host", "path", "verdict")
    )
    events = events.repartitionByRange(parts, "part").sortWithinPartitions("part", "key", "kind")
    schema = T.StructType([T.StructField("id", urls.schema["id"].dataType), *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]])

    def sweep(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        at, stack = None, []  # of (key, rules by path, lengths of these paths), outermost first
        for columns in batches:
            out = [[], [], [], [], []]
            for part, k, kind, i, h, p, v in zip(*columns):
                if part != at:
                    at, stack = part, []
                while stack and not k.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != k:
                        stack.append((k, {}, set()))
                    _, own, lengths = stack[-1]
                    if own.get(p, ("allow",))[0] != "block":
                        own[p] = (v, h + p)
                        lengths.add(len(p))
                    continue
                best, verdict = None, default
                for _, own, lengths in reversed(stack):
                    longest = max((n for n in lengths if p[:n] in own), default=None)
                    if longest is not None and (best is None or len(own[p[:longest]][1]) > len(best)):
                        verdict, best = own[p[:longest]]
                for to, x in zip(out, (i, h, p, best, verdict)):
                    to.append(x)
            yield out

    return map_columns(events, sweep, schema).withColumnRenamed("id", key)
