"""What filters remove in every order: interaction audit by adjacent transpositions.

A document is reduced to the mask of the filters that it fails, and documents to counts
by part and mask (at most 2^k cells a part). Orders of the k filters are visited by
single swaps of neighbours. A swap changes two steps only: what the first of the two
removes and what is left to the second; both are read off the counts of the masks that
meet a set of filters but not another. Shapley values add up along the walk.

The cells of a part are one row, so a part of any size costs one walk; parts are spread
over tasks.

Defined results: a null text is empty; words are maximal runs without ASCII white space;
equal texts fail the copy filter but for the rows of the smallest id (a null id is larger
than all others; rows that repeat the smallest id do not fail); a null part is the empty
string; marks of repeated label rows count once, any mark that is set holds; a document
without label has none; no rows give no rows; columns of other names are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_columns, require, save, small_enough

#: Words that a long text should have; share of distinct words, in per cent; share of capitals, in per cent; characters of noise.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, NOISE = 200, 50, 3, b"#$%&*|"
FILTERS = "ABCDE"
COPY = FILTERS.index("E")
_CAPITALS = bytes(range(65, 91))
#: Bytes that go on with a code point of UTF-8.
_CONTINUED = bytes(range(0x80, 0xC0))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes from which words are met one by one instead of as a list.
LONG = 1 << 22


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that the UTF-8 text fails."""
    if len(text) < LONG:
        words = text.split()  # ASCII white space, as in _WORD
        n, distinct = len(words), len(set(words))
    else:
        n, met = 0, set()
        for m in _WORD.finditer(text):
            n += 1
            met.add(hashlib.blake2b(m[0], digest_size=16).digest())
        distinct = len(met)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUED))
    fails = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * points, any(c in text for c in NOISE))
    return sum(1 << i for i, f in enumerate(fails) if f)


def document_masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(key, part, mask): the filters that each document fails, copies included."""
    require(docs, key, text, part)
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("part", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("mask", T.IntegerType())])

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, parts, texts in batches:
            texts = [t or b"" for t in texts]
            yield [keys, parts, [hashlib.sha256(t).digest() for t in texts], [text_mask(t) for t in texts]]

    facts = save(map_columns(docs.select(docs[key].alias("key"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), docs[text].cast("binary").alias("text")), run, schema), "facts")
    # texts that occur once are no copies; the others' least ids meet the rows by digest, whose hot ones Spark splits
    firsts = facts.groupBy("digest").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null").select("digest", "least")
    met = facts.join(small_enough(save(firsts, "firsts")), "digest", "left")
    copy = F.col("least").isNotNull() & ~F.col("key").eqNullSafe(F.col("least"))
    return met.select("key", "part", F.when(copy, F.col("mask").bitwiseOR(F.lit(1 << COPY))).otherwise(F.col("mask")).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality", bad: str = "toxic") -> DataFrame:
    """(part, mask, n, good, bad): documents of each part by the filters that they fail."""
    require(labels, key, good, bad)
    marks = labels.groupBy(labels[key].alias("key")).agg(F.max((labels[good] == 1).cast("int")).alias("good"), F.max((labels[bad] == 1).cast("int")).alias("bad")).where("key is not null")
    return masks.join(marks, "key", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))


def swaps(k: int) -> Iterator[int]:
    """Positions i such that swapping i and i + 1 in turn visits all orders of k things, each once."""
    order, way = list(range(k)), [-1] * k
    while True:
        movable = [x for x in order if 0 <= (to := order.index(x) + way[x]) < k and order[to] < x]
        if not movable:
            return
        x = max(movable)
        at = order.index(x)
        to = at + way[x]
        yield min(at, to)
        order[at], order[to] = order[to], order[at]
        for y in range(x + 1, k):
            way[y] = -way[y]


def walk(counts: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique, good lost, bad lost, shapley) of all orders and steps.

    ``counts`` has (documents, good, bad) by mask.
    """
    k = len(filters)
    full = (1 << k) - 1
    # documents whose mask lies within a set of filters: those that no filter outside of it removes
    within = [[counts.get(m, (0, 0, 0))[j] for m in range(full + 1)] for j in range(3)]
    for row in within:
        for i in range(k):
            for m in range(full + 1):
                if m >> i & 1:
                    row[m] += row[m ^ 1 << i]
    left = lambda gone, j=0: within[j][full ^ gone]  # noqa: E731  documents that pass all filters of ``gone``
    fails = [left(0) - left(1 << i) for i in range(k)]
    unique = [counts.get(1 << i, (0, 0, 0))[0] for i in range(k)]

    def step(order: list[int], at: int) -> tuple:
        gone = sum(1 << x for x in order[:at])
        now = gone | 1 << order[at]
        removed, good, bad = (left(gone, j) - left(now, j) for j in range(3))
        return left(now), removed, fails[order[at]] - removed, unique[order[at]], good, bad

    order = list(range(k))
    steps = [step(order, at) for at in range(k)]
    shapley = [s[1] for s in steps]
    visited = [(list(order), list(steps))]
    for at in swaps(k):
        order[at], order[at + 1] = order[at + 1], order[at]
        steps[at], steps[at + 1] = step(order, at), step(order, at + 1)
        for x, s in zip(order, steps):
            shapley[x] += s[1]
        visited.append((list(order), list(steps)))
    for o, found in visited:
        name = "".join(filters[x] for x in o)
        for at, s in enumerate(found):
            yield name, at + 1, *s, shapley[o[at]]


def audit(table: DataFrame) -> DataFrame:
    """All orders and steps for each part of ``cells``."""
    lists = table.groupBy("part").agg(*[F.collect_list(c).alias(c) for c in ("mask", "n", "good", "bad")])
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for parts, *columns in batches:
            for part, masks, n, good, bad in zip(parts, *columns):
                rows = list(walk(dict(zip(masks, zip(n, good, bad)))))
                yield [[part] * len(rows), *map(list, zip(*rows))]

    # a row holds the at most 32 cells of a part
    return map_columns(lists, run, schema)


def audit_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of filters A to E over ``docs``, by ``part``."""
    masks = document_masks(docs, key, text, part)
    table = save(cells(masks, labels, key), "cells")
    return audit(table)
