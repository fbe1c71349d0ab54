"""Language identification by word-first backoff.

A known word scores by its log frequency in each language; a word that no language
knows backs off to its character n-grams, from four characters down to one, and takes
the mean of the longest ones known. A text's language has the best mean word score.

The model is fitted on about ``docs_per_lang`` texts of each language at most, and
``most_docs`` in all, drawn row by row from a fixed seed, so that the same files give the
same model. It holds every word and n-gram of these,
as sparse rows of the languages that have it, so its size follows from the sample and not
from the corpus, and it may be broadcast. Every text is predicted whole.

Defined results: ``und`` with score 0 for a null text or one without a letter; rows
with null language are predicted but not learned from; a language whose drawn texts
hold no word is never predicted; an entry that a language lacks scores the same in all
languages, below any entry that a language has; equal scores go to the language
with more texts, then to the lesser name; with nothing learned every text is ``und``; no
rows give no rows; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop, map_columns, require, save

#: Bounds of the labelled rows of the fit.
DOCS_PER_LANG, MOST_DOCS = 1000, 20_000
LONGEST_GRAM = 4
#: Occurrences that an unseen entry counts as in the largest language; occurrences added to every total, so that few do not weigh as many.
UNSEEN, SPARE = 0.5, 1000.0
#: Words from which a text's score counts as sure as it gets.
SURE_FROM = 10
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Entries:
    """Log frequencies of entries by language, kept where a language has the entry; ``unseen`` elsewhere."""

    place: dict[str, int]
    start: np.ndarray
    lang: np.ndarray
    more: np.ndarray
    unseen: float

    @classmethod
    def of(cls, rows: list[tuple], langs: list[str], totals: list[float]) -> "Entries":
        """From (lang, entry, n)."""
        rows = sorted(rows, key=lambda r: r[1])
        at = {lang: i for i, lang in enumerate(langs)}
        sizes = np.array(totals, np.float64) + SPARE
        unseen = float(np.log(UNSEEN / sizes.max()))
        lang = np.array([at[r[0]] for r in rows], np.int32)
        more = np.log(np.array([r[2] for r in rows], np.float64) / sizes[lang]) - unseen
        place: dict[str, int] = {}
        start = []
        for i, (_, entry, _) in enumerate(rows):
            if entry not in place:
                place[entry] = len(start)
                start.append(i)
        return cls(place, np.array([*start, len(rows)], np.int64), lang, more, unseen)

    def total(self, at: list[int], counts: np.ndarray, langs: int) -> np.ndarray:
        """Sum over entries of count times score, by language."""
        first, last = self.start[at], self.start[np.array(at) + 1]
        size = last - first
        rows = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.lang[rows], self.more[rows] * np.repeat(counts, size), langs) + counts.sum() * self.unseen


@dataclass
class Model:
    langs: list[str]
    words: Entries | None = None
    grams: dict[int, Entries] = field(default_factory=dict)
    memo: dict[str, np.ndarray] = field(default_factory=dict)

    def backoff(self, word: str) -> np.ndarray:
        for n in range(LONGEST_GRAM, 0, -1):
            known = self.grams.get(n)
            at = [known.place[g] for g in grams_of(word, n) if g in known.place] if known else []
            if at:
                return known.total(at, np.ones(len(at)), len(self.langs)) / len(at)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = Counter(words_of(text))
        total = sum(words.values())
        if not total or not self.langs or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        known, counts, rest = [], [], np.zeros(len(self.langs))
        if len(self.memo) > 200_000:
            self.memo = {}
        for w, n in words.items():
            at = self.words.place.get(w)
            if at is not None:
                known.append(at)
                counts.append(n)
            else:
                score = self.memo.get(w)
                if score is None:
                    score = self.memo[w] = self.backoff(w)
                rest = rest + n * score
        if known:
            rest = rest + self.words.total(known, np.array(counts, np.float64), len(self.langs))
        mean = rest / total
        best = int(np.argmax(mean))
        odds = np.exp((mean - mean[best]) * min(total, SURE_FROM))
        return self.langs[best], float(1 / odds.sum())


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = DOCS_PER_LANG, most_docs: int = MOST_DOCS) -> Model:
    """A model of the rows' text and language."""
    require(docs, key, text, lang)
    spark = docs.sparkSession
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), docs[lang].alias("lang")).where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not langs:
        return Model([])
    wanted = {x: min(docs_per_lang, sizes[x]) for x in langs}
    part = min(1.0, most_docs / sum(wanted.values()))
    share = F.broadcast(spark.createDataFrame([(x, part * wanted[x] / sizes[x]) for x in langs], "lang string, share double"))
    # each row is drawn on its own, so neither repeated keys nor repeated rows fill or empty the sample
    drawn = rows.withColumn("draw", F.rand(11)).join(share, "lang").where("draw < share")

    def count(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for texts, names in batches:
            seen: dict[str, Counter] = {}
            for t, name in zip(texts, names):
                seen.setdefault(name, Counter()).update(words_of(t))
            rows = [(name, w, n) for name, c in seen.items() for w, n in c.items()]
            yield [list(c) for c in zip(*rows)] or [[], [], []]

    counted = map_columns(drawn.select("text", "lang"), count, T.StructType([T.StructField("lang", T.StringType()), T.StructField("entry", T.StringType()), T.StructField("n", T.LongType())]))
    words = save(counted.groupBy("lang", "entry").agg(F.sum("n").alias("n")), "words")
    total = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = [x for x in langs if x in total]
    if not langs:
        drop(words)
        return Model([])
    # each list that comes to the driver is bounded by the sample
    known = Entries.of([(r.lang, r.entry, r.n) for r in words.collect()], langs, [total[x] for x in langs])
    padded = F.concat(F.lit(" "), "entry", F.lit(" "))
    sizes_of = F.sequence(F.lit(1), F.lit(LONGEST_GRAM))
    cut = F.flatten(F.transform(sizes_of, lambda n: F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substr(padded, i, n))).otherwise(F.array().cast("array<string>"))))
    grams = words.select("lang", F.explode(cut).alias("entry"), "n").groupBy("lang", "entry").agg(F.sum("n").alias("n"))
    grams = save(grams.withColumn("size", F.length("entry")), "grams")
    gram_total = {(r.lang, r.size): r.n for r in grams.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    got: dict[int, list] = {}
    for r in grams.collect():
        got.setdefault(r.size, []).append((r.lang, r.entry, r.n))
    drop(words, grams)
    return Model(langs, known, {n: Entries.of(entries, langs, [gram_total.get((x, n), 0) for x in langs]) for n, entries in got.items()})


_models: dict[int, Model] = {}


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for each row of ``docs``; reads nothing but key and text."""
    require(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.grams))
    name = id(shared)
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        own = _models.get(name)
        if own is None:
            _models.clear()
            own = _models[name] = Model(*shared.value)
        for keys, texts in batches:
            got = [own.predict(t) for t in texts]
            yield [keys, [g[0] for g in got], [min(1.0, max(0.0, g[1])) for g in got]]

    return map_columns(docs.select(docs[key].alias("key"), docs[text].alias("text")), run, schema).withColumnRenamed("key", key)


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 3; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score): learned from all folds but 1, predicted for every row."""
    model = fit(docs.where(fold(docs[key]) != 1), key, text, lang)
    out = predict(docs, model, key, text)
    return out.select(key, (fold(F.col(key)) == 1).alias("held_out"), "lang_pred", "score")
