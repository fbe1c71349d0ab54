"""Quality classification from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each text. Expectation
maximisation over the counts of vote patterns (all documents, aggregated to at most
3**labellers rows) estimates each labeller's accuracies and the share of good texts.
The posteriors of a bounded sample then train a linear scorer over hashed word shapes,
which scores every text and decides.

Defined results: a null text or one without words scores 0 and is rejected; when no
labeller ever votes, or all votes agree, nothing is rejected but such texts; repeated
rows score alike; no rows give no rows; other columns are carried as they are.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import map_batches, map_columns, release_memory, require

#: Texts that the scorer is fitted on (about), hash buckets of its features, score from which a text stays.
SAMPLE, BUCKETS, KEEP_FROM = 8000, 4096, 0.5
#: Characters of a run without white space that count as one word of the scorer.
PIECE = 60
#: Texts that are Python strings at once.
ROWS_AT_ONCE = 500
_NONE, _BAD, _GOOD = 0, 1, 2
_MARKS = "*%$#&|~^=<>{}[]\\"
_RUNS = [(re.compile(r"[^\W\d_A-Z]+"), "a"), (re.compile(r"[A-Z]+"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"(\W)\1+"), r"\1+")]


def _vote(value: float, bad_from: float, good_to: float) -> int:
    return _BAD if value >= bad_from else _GOOD if value <= good_to else _NONE


@dataclass
class Facts:
    """What labellers and features look at, computed once per text."""

    words: list[str]
    text: str
    repeats: float
    distinct: float

    @classmethod
    def of(cls, text: str | None) -> "Facts":
        words = (text or "").split()
        n = len(words)
        repeats = sum(map(operator.eq, words, words[1:])) / n if n else 0.0
        distinct = sum(len(set(words[i : i + 200])) for i in range(0, n, 200)) / n if n else 0.0
        return cls(words, text or "", repeats, distinct)


def _marks(f: Facts) -> int:
    return _vote(sum(map(f.text.count, _MARKS)) / len(f.text), 0.04, 0.01)


def _capitals(f: Facts) -> int:
    return _NONE if len(f.words) < 5 else _vote(sum(map(str.isupper, f.words)) / len(f.words), 0.3, 0.1)


def _repetition(f: Facts) -> int:
    return _NONE if len(f.words) < 5 else _vote(f.repeats, 0.2, 0.05)


def _variety(f: Facts) -> int:
    return _NONE if len(f.words) < 20 else _vote(1 - f.distinct, 0.75, 0.6)


def _shouting(f: Facts) -> int:
    return _vote(f.text.count("!!") / len(f.words), 0.2, 0.02)


def _odd_ends(f: Facts) -> int:
    return _vote(sum(w[-1] in _MARKS for w in f.words) / len(f.words), 0.25, 0.05)


def _no_letters(f: Facts) -> int:
    return _vote(sum(not any(map(str.isalnum, w)) for w in f.words) / len(f.words), 0.15, 0.05)


def _word_length(f: Facts) -> int:
    return _vote(abs(len(f.text) / len(f.words) - 8), 25, 6)


LABELLERS = (_marks, _capitals, _repetition, _variety, _shouting, _odd_ends, _no_letters, _word_length)


def votes(facts: Facts) -> int:
    """The votes as one number in base 3."""
    out = 0
    for labeller in LABELLERS:
        out = out * 3 + labeller(facts)
    return out


def unpack_votes(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**k % 3 for k in range(len(LABELLERS) - 1, -1, -1)], axis=1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """P(good) of each vote pattern, by expectation maximisation started at the majority."""
    seen = unpack_votes(patterns)
    lead = (seen == _GOOD).sum(axis=1) - (seen == _BAD).sum(axis=1) * 2.0
    good = 1 / (1 + np.exp(-lead))
    for _ in range(rounds):
        before = good
        weight = np.stack([(1 - good) * counts, good * counts])
        log = np.log(weight.sum(axis=1) + 1.0)[:, None] + np.zeros(len(counts))
        for k in range(seen.shape[1]):
            # a labeller's chances of each vote given bad or good, one text of each kind assumed
            chance = np.stack([[w[seen[:, k] == v].sum() + 1.0 for v in range(3)] for w in weight])
            log += np.log(chance / chance.sum(axis=1, keepdims=True))[:, seen[:, k]]
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(good - before).max() < 1e-9:
            break
    return good


class Hasher:
    """Sparse features of a text: shares of its word shapes, and its repetition in steps. Long words count as pieces."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        shape = word
        for pattern, to in _RUNS:
            shape = pattern.sub(to, shape)
        return zlib.crc32(shape.encode("utf-8", "surrogatepass")) % BUCKETS

    def __call__(self, facts: Facts) -> dict[int, float]:
        memo, counts = self.memo, Counter(facts.words)
        if len(memo) > 300_000:
            memo.clear()
        for word in [w for w in counts if len(w) > PIECE]:
            times = counts.pop(word)
            for at in range(0, len(word), PIECE):
                counts[word[at : at + PIECE]] += times
        n = counts.total()
        out: dict[int, float] = {}
        for word, times in counts.items():
            at = memo.get(word)
            if at is None:
                at = memo[word] = self.bucket(word)
            out[at] = out.get(at, 0.0) + times / n
        for name in (f"repeats {min(9, int(facts.repeats * 10))}", f"distinct {min(9, int(facts.distinct * 10))}", "any"):
            at = zlib.crc32(name.encode()) % BUCKETS
            out[at] = out.get(at, 0.0) + 1.0
        return out


def train(rows: list[dict[int, float]], targets: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic scorer for soft targets, by ridge-damped Newton steps over the buckets in use."""
    used = sorted({k for r in rows for k in r})
    place = {k: i for i, k in enumerate(used)}
    x = np.zeros((len(rows), len(used)))
    for i, r in enumerate(rows):
        for k, v in r.items():
            x[i, place[k]] = v
    w = np.zeros(len(used))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(used)), x.T @ (targets - p) - ridge * w)
        w += step
        if np.abs(step).max(initial=0) < 1e-6:
            break
    out = np.zeros(BUCKETS)
    out[used] = w
    return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """The scorer's weights: vote patterns are counted over all rows, the scorer sees about ``sample`` of them.

    The draw follows from the rows' places in their files, so the same files give the same weights.
    """
    require(docs, key, text)
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
        for b in batches:
            seen: Counter = Counter()
            for at in range(0, len(b), ROWS_AT_ONCE):
                for f in map(Facts.of, b.column(0).slice(at, ROWS_AT_ONCE).to_pylist()):
                    if f.words:
                        seen[votes(f)] += 1
            yield [list(seen), list(seen.values())]

    told = map_batches(rows.select("text"), tell, T.StructType([T.StructField("pattern", T.LongType()), T.StructField("n", T.LongType())]))
    counted = sorted((r.pattern, r.n) for r in told.groupBy("pattern").agg(F.sum("n").alias("n")).collect())
    if not counted:
        return np.zeros(BUCKETS)
    patterns, counts = (np.array(c) for c in zip(*counted))
    good = dict(zip(patterns.tolist(), estimate(patterns, counts).tolist()))
    # each row is drawn on its own, so neither repeated keys nor repeated rows fill or empty the sample
    drawn = rows.where(F.rand(5) < min(1.0, sample / counts.sum())).select("text")

    def describe(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        hasher = Hasher()
        for (texts,) in batches:
            out: list[list] = [[], [], []]
            for f in map(Facts.of, texts):
                if f.words:
                    x = hasher(f)
                    for to, v in zip(out, (votes(f), list(x), list(x.values()))):
                        to.append(v)
            yield out

    schema = T.StructType([T.StructField("pattern", T.LongType()), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("shares", T.ArrayType(T.DoubleType()))])
    got = sorted(map_columns(drawn, describe, schema).collect(), key=lambda r: (r.pattern, r.buckets, r.shares))
    return train([dict(zip(r.buckets, r.shares)) for r in got], np.array([good.get(r.pattern, 0.5) for r in got]))


def score_rows(docs: DataFrame, weights: np.ndarray, text: str = "text", score: str | None = "quality_score", keep: str | None = "kept", keep_from: float = KEEP_FROM, only_kept: bool = False) -> DataFrame:
    """All columns of ``docs``, with a score and a decision if named, in the rows' own partitions."""
    require(docs, text)
    schema = T.StructType(list(docs.schema.fields))
    if score:
        schema = schema.add(score, T.DoubleType())
    if keep:
        schema = schema.add(keep, T.BooleanType())
    arrow, at = to_arrow_schema(schema), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            scores = []
            for f in map(Facts.of, chain.from_iterable(b.column(at).slice(i, ROWS_AT_ONCE).to_pylist() for i in range(0, len(b), ROWS_AT_ONCE))):
                x = hasher(f) if f.words else None
                z = sum(weights[k] * v for k, v in x.items()) if x else 0.0
                scores.append(float(1 / (1 + np.exp(-min(30.0, max(-30.0, z))))) if x else 0.0)
            kept = [s >= keep_from for s in scores]
            columns = [c.cast(f.type) for c, f in zip(b.columns, arrow)]
            out = pa.RecordBatch.from_arrays(columns + [pa.array(scores)] * bool(score) + [pa.array(kept, pa.bool_())] * bool(keep), schema=arrow)
            yield out.filter(pa.array(kept, pa.bool_())) if only_kept else out
        release_memory()

    # by position, since names may hold dots
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, schema)


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, quality_score, kept) for each row of ``docs``."""
    weights = fit(docs, key, text)
    return score_rows(docs.select(docs[key], docs[text]), weights, text).select(key, "quality_score", "kept")


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, columns unchanged."""
    return score_rows(docs, fit(docs, key, text), text, score=None, keep=None, only_kept=True)
