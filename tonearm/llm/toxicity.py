"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

A word is its lower-cased letters between a start and an end mark; a gram is a letter with
up to ``ORDER - 1`` letters before it in the word. Three sets of counts are kept: of all
documents, of the toxic and of the ordinary labelled ones. The counts of all documents
give an interpolated Kneser-Ney model (absolute discounts from counts of counts, lower
orders from the numbers of distinct extensions). Each class has its own discounted counts
of the longest grams and hands the mass left over to that shared model, so what a class
has seen little of is as likely in both, and rare expressions say nothing by being rare.

A word's log ratio is the toxic less the ordinary log-likelihood. Language and style
shift all words of a document alike, so the document's middle word (``MOST_SHIFT`` at
most) is taken off; what a word then adds is that of a text in which a part ``MIXED`` of the words is drawn from the
toxic model. The sum over the words is divided by their number (and ``SPARE``), and a
logistic curve of its inverse hyperbolic sine is the score; its slope is fitted
across ``PARTS`` parts of the learning rows, each scored by the models of the others, and
it is moved so that the cut with the best F1 there scores ``THRESHOLD``.

Counting covers all documents (shared counts) and all labelled learning rows (classes);
the two numbers of the curve are fitted on all of these rows.
What comes to the driver and is broadcast are grams whose shares in the two classes add up
to ``LEAST_SHARE`` at least, and their contexts, hence at most 2 / ``LEAST_SHARE`` of each;
the mass of rarer ones is handed to the shared model too.

Defined results: labels are read from rows whose fold is not 1; of repeated label rows
any toxic one holds; a null key has no label; a null text, or one without letters, scores
as a text of which nothing is known; letter runs are cut at ``LONGEST`` letters; with no
learning row of either class every score is 0; no rows give no rows; rows repeated give
rows repeated; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import fold
from .shared import BROADCAST_ROWS, drop, map_batches, require, save, small_enough
from .tokens import runs_of_texts

#: Letters of the longest gram; letters of the longest word.
ORDER, LONGEST = 5, 64
#: Share of a toxic text's words that its model is taken to give; words without evidence that every text gets, so that few words decide little.
MIXED, SPARE = 0.02, 8
#: Evidence about which the curve turns from linear to logarithmic, since the evidence of short texts has a long tail.
SCALE = 0.01
#: Grams that are rarer than this in both classes taken together are not kept: at most 2 / LEAST_SHARE are.
LEAST_SHARE = 5e-7
#: Parts of the learning rows that the curve is fitted across; with two, models of half the rows put the cut too high.
PARTS = 4
#: Score from which a document counts as toxic.
THRESHOLD = 0.7
START, END = "^", "$"
_WORD = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)
#: Characters of a text that are met at once; chunks whose words' ratios a worker remembers.
SLICE, REMEMBERED = 1 << 20, 400_000
#: Bytes of texts that are counted, and scored, at once.
COUNTED, SCORED = 16_000_000, 4_000_000
#: Words whose grams are met at once.
WORDS = 50_000
#: Largest log ratio of a word that counts; largest part of it that language and style explain.
MOST_EVIDENCE, MOST_SHIFT = 20.0, 1.0


def slices(text: str | None) -> Iterator[list[str]]:
    """The words of a text, some at a time; no word is cut at the end of a slice."""
    text = text or ""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and text[end - 1].isalpha() and end < at + SLICE + LONGEST:
            end += 1
        yield _WORD.findall(text[at:end].lower())
        at = end


def grams_of(word: str) -> list[str]:
    """The longest gram that ends at each letter of the word and at its end."""
    marked = f"{START}{word}{END}"
    n = len(marked)
    return [marked[:i] for i in range(2, min(ORDER, n + 1))] + [marked[i : i + ORDER] for i in range(n - ORDER + 1)]


def chunks(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct chunks, place in them of each chunk of all texts in order, end of each text in these).

    Chunks are what lies between white space, so no word crosses one and the case of a
    letter does not depend on another chunk. Most of them recur, so a chunk's words are found once.
    """
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    for mark in (", ", ". "):
        texts = pc.replace_substring(texts, mark, " ")
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), ends


def words_in(chunk: str) -> list[str]:
    word = chunk.lower()
    if len(word) <= LONGEST and word.isalpha():
        return [word]
    return list(chain.from_iterable(slices(chunk)))


def grams_in(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct grams, place in them of each gram of the words, the word it is of)."""
    marked = "".join([f"{START}{w}{END}" for w in words])
    letters = np.concatenate([np.frombuffer(marked.encode("utf-32-le"), "<u4"), np.zeros(ORDER, "<u4")]).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.cumsum(size) - size
    full = np.maximum(size - ORDER + 1, 0)
    starts, lengths, word = [np.repeat(begin - np.cumsum(full) + full, full) + np.arange(full.sum())], [np.full(full.sum(), ORDER)], [np.repeat(np.arange(len(words)), full)]
    for n in range(2, ORDER):
        some = np.flatnonzero(size >= n)
        starts.append(begin[some])
        lengths.append(np.full(len(some), n))
        word.append(some)
    at, length = np.concatenate(starts), np.concatenate(lengths)
    letter = lambda k: np.where(length > k, letters[at + k], np.uint64(0))
    # three letters fit into 64 bits, and so do the places of two halves among the distinct ones
    places, parts = None, []
    for first in range(0, ORDER, 3):
        coded = pa.array(sum(letter(k) << np.uint64(21 * (k - first)) for k in range(first, min(first + 3, ORDER)))).dictionary_encode()
        parts.append((coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.uint64)))
    both = pa.array(parts[0][1] << np.uint64(32) | parts[1][1]).dictionary_encode()
    met, places = both.dictionary.to_numpy(), both.indices.to_numpy()
    halves = [parts[0][0][(met >> np.uint64(32)).astype(np.int64)], parts[1][0][(met & np.uint64(0xFFFFFFFF)).astype(np.int64)]]
    table = np.stack([halves[k // 3] >> np.uint64(21 * (k % 3)) & np.uint64(0x1FFFFF) for k in range(ORDER)], axis=1).astype("<u4")
    return np.ascontiguousarray(table).view(f"<U{ORDER}").ravel().tolist(), places, np.concatenate(word)


def count_grams(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., gram, n) over the texts of ``rows`` (text and the columns ``by``)."""
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
        for b in batches:
            groups: dict[tuple, list[int]] = {}
            for at, group in enumerate(zip(*(c.to_pylist() for c in b.columns[1:])) if by else [()] * len(b)):
                groups.setdefault(group, []).append(at)
            of = np.zeros(len(b), np.int64)
            for k, rows_of in enumerate(groups.values()):
                of[rows_of] = k
            ids: dict[str, int] = {}
            counts = [np.zeros(0, np.int64) for _ in groups]
            for at, some in runs_of_texts(b.column(0), COUNTED):
                found, places, ends = chunks(some)
                group_of = np.repeat(of[at : at + len(some)], np.diff(ends, prepend=0))
                own = [[ids.setdefault(w, len(ids)) for w in words_in(c)] for c in found]
                flat = np.fromiter(chain.from_iterable(own), np.int64)
                size = np.fromiter(map(len, own), np.int64, len(own))
                for k in range(len(groups)):
                    times = np.repeat(np.bincount(places[group_of == k], minlength=len(found)), size)
                    new = np.zeros(len(ids), np.int64)
                    new[: len(counts[k])] = counts[k]
                    counts[k] = new + np.bincount(flat, times, len(ids)).astype(np.int64)
            words = list(ids)
            grams: dict[str, int] = {}
            totals = [np.zeros(0, np.int64) for _ in groups]
            for at in range(0, len(words), WORDS):
                met, places, word = grams_in(words[at : at + WORDS])
                to = np.array([grams.setdefault(g, len(grams)) for g in met], np.int64)[places]
                for k in range(len(groups)):
                    new = np.zeros(len(grams), np.int64)
                    new[: len(totals[k])] = totals[k]
                    totals[k] = new + np.bincount(to, counts[k][at + word], len(grams)).astype(np.int64)
            names = pa.array(list(grams), pa.string())
            for group, total in zip(groups, totals):
                some = np.flatnonzero(total)
                yield [*[[x] * len(some) for x in group], names.take(pa.array(some)), total[some]]

    return map_batches(rows.select("text", *by), run, schema).groupBy(*by, "gram").agg(F.sum("n").alias("n"))


def _context() -> Column:
    return F.expr("substr(gram, 1, length(gram) - 1)")


def _discounts(counts: DataFrame, *columns: str) -> list[tuple[int, float]]:
    """(letters, absolute discount) of each column of counts, from the numbers of grams met once and twice."""
    facts = [F.struct(F.coalesce(F.sum(c), F.lit(0)), F.count(F.when(F.col(c) == 1, 1)), F.count(F.when(F.col(c) == 2, 1))).alias(c) for c in columns]
    return [(total, once / (once + 2 * twice) if once else 0.5) for total, once, twice in counts.agg(*facts).first()]


def shared_model(counted: DataFrame) -> DataFrame:
    """(gram, p), written: the Kneser-Ney probability of the last letter of each gram of the counts (gram, n)."""
    levels = [counted.where(F.length("gram") == ORDER).select("gram", "n")]
    for k in range(ORDER - 1, 0, -1):
        # distinct letters before; a gram that starts the word has none and counts as often as it occurs
        ahead = levels[0].select(F.expr("substr(gram, 2)").alias("gram"), F.lit(1).cast("long").alias("n"))
        begun = counted.where(F.length("gram") == k).select("gram", "n")
        levels.insert(0, save(ahead.unionByName(begun).groupBy("gram").agg(F.sum("n").alias("n")), "order"))
    made: list[DataFrame] = []
    for level in levels:
        d = _discounts(level, "n")[0][1]
        of = level.withColumn("context", _context())
        of = of.join(of.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")), "context")
        if made:
            of = of.withColumn("suffix", F.expr("substr(gram, 2)")).join(made[-1].select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
        else:
            of = of.withColumn("lower", F.lit(1.0 / (level.count() + 1)))
        p = (F.greatest(F.col("n") - d, F.lit(0.0)) + F.lit(d) * F.col("kinds") * F.col("lower")) / F.col("total")
        made.append(save(of.select("gram", p.alias("p")), "order"))
    out = made[0]
    for level in made[1:]:
        out = out.unionByName(level)
    out = save(out, "shared")
    drop(*levels, *made)
    return out


class _Grams(dict):
    """Ratios of grams; one that is not kept has that of its context."""

    def __missing__(self, gram: str) -> float:
        return self.contexts.get(gram[:-1], 0.0)


@dataclass
class Model:
    """Toxic less ordinary log-likelihood: of kept grams, and of all other letters after kept contexts."""

    grams: dict[str, float] = field(default_factory=dict)
    contexts: dict[str, float] = field(default_factory=dict)
    #: ratios of the words of chunks
    memo: dict[str, list[float]] = field(default_factory=dict)

    def __post_init__(self):
        self.known = _Grams(self.grams)
        self.known.contexts = self.contexts

    def words(self, words: list[str]) -> np.ndarray:
        """The log ratio of each word."""
        if not words:
            return np.zeros(0)
        met, places, word = grams_in(words)
        ratio = np.fromiter(map(self.known.__getitem__, met), np.float64, len(met))
        return np.bincount(word, ratio[places], len(words))

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """What the words of each text add, by the word."""
        found, places, ends = chunks(texts)
        if len(self.memo) > REMEMBERED:
            self.memo = {}
        memo = self.memo
        new = [c for c in found if c not in memo]
        own = [words_in(c) for c in new]
        ids: dict[str, int] = {}
        for ws in own:
            for w in ws:
                ids.setdefault(w, len(ids))
        of = self.words(list(ids)).tolist()
        memo.update(zip(new, ([of[ids[w]] for w in ws] for ws in own)))
        met = [memo[c] for c in found]
        size = np.fromiter(map(len, met), np.int64, len(met))
        ratios = np.fromiter(chain.from_iterable(met), np.float64, int(size.sum()))
        start, size = (np.cumsum(size) - size)[places], size[places]
        x = ratios[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]
        ends = np.concatenate([[0], np.cumsum(size)])[ends]
        length = np.diff(ends, prepend=0)
        middle = np.array([_middle(x[e - n : e]) for e, n in zip(ends.tolist(), length.tolist())])
        x = np.log1p(MIXED * np.expm1(np.minimum(x - np.repeat(middle, length), MOST_EVIDENCE)))
        some = length > 0
        out = np.zeros(len(length))
        if some.any():
            out[some] = np.add.reduceat(x, (ends - length)[some]) / (length[some] + SPARE)
        return out


def _middle(x: np.ndarray) -> float:
    """The middle of ``x`` and ``SPARE`` zeros, ``MOST_SHIFT`` at most."""
    n = len(x) + SPARE
    y = np.zeros(n)
    y[SPARE:] = x
    low, high = (n - 1) // 2, n // 2
    y.partition((low, high))
    return min(max((y[low] + y[high]) / 2, -MOST_SHIFT), MOST_SHIFT)


def class_model(counted: DataFrame, shared: DataFrame) -> Model:
    """From the classes' counts (toxic, gram, n) of longest grams."""
    count = lambda c: F.coalesce(F.sum(F.when(F.col("toxic") == c, F.col("n"))), F.lit(0))
    own = counted.groupBy("gram").agg(count(0).alias("n0"), count(1).alias("n1")).withColumn("context", _context())
    facts = _discounts(own, "n0", "n1")
    share = sum((F.col(f"n{c}") / F.lit(float(max(total, 1))) for c, (total, _) in enumerate(facts)), F.lit(0.0))
    own = own.withColumn("kept", share >= LEAST_SHARE)
    # the discounts and the grams not kept leave their mass to the shared model
    less = [F.greatest(F.col(f"n{c}") - d, F.lit(0.0)) for c, (_, d) in enumerate(facts)]
    sums = [x for c in (0, 1) for x in (F.sum(f"n{c}").alias(f"total{c}"), F.sum(F.when(F.col("kept"), less[c]).otherwise(0.0)).alias(f"kept{c}"))]
    contexts = own.groupBy("context").agg(*sums, F.max("kept").alias("any")).where("any").drop("any")
    left = [F.when(F.col(f"total{c}") > 0, (F.col(f"total{c}") - F.col(f"kept{c}")) / F.col(f"total{c}")).otherwise(1.0) for c in (0, 1)]
    ratio = [F.log(F.when(F.col(f"total{c}") > 0, less[c] / (F.col(f"total{c}") * F.col("p"))).otherwise(0.0) + left[c]) for c in (0, 1)]
    grams = own.where("kept").join(contexts, "context").join(shared, "gram").select("gram", (ratio[1] - ratio[0]).alias("ratio"))
    # at most 2 / LEAST_SHARE rows each
    listed = lambda rows: dict(zip(*(c.to_pylist() for c in rows.toArrow().columns)))
    return Model(listed(grams), listed(contexts.select("context", F.log(left[1]) - F.log(left[0]))))


_models: dict[str, Model] = {}


def evidence(rows: DataFrame, model: Model, carried: list[str]) -> DataFrame:
    """(carried..., evidence) of the texts of ``rows``."""
    sent = rows.sparkSession.sparkContext.broadcast((model.grams, model.contexts))
    name = uuid.uuid4().hex
    schema = T.StructType([*[rows.schema[c] for c in carried], T.StructField("evidence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        own = _models.get(name)
        if own is None:
            _models.clear()
            own = _models[name] = Model(*sent.value)
        for b in batches:
            for at, some in runs_of_texts(b.column(0), SCORED):
                yield [*(c.slice(at, len(some)) for c in b.columns[1:]), own.evidence(some)]

    return map_batches(rows.select("text", *carried), run, schema)


def best_cut(points: list[tuple[float, int, int]]) -> float:
    """The evidence from which calling a row toxic has the best F1 over (evidence, rows, toxic rows)."""
    right = rows = 0
    total, best, cut = sum(t for _, _, t in points), -1.0, 0.0
    for x, n, t in sorted(points, reverse=True):
        right, rows = right + t, rows + n
        if 2 * right / (rows + total) > best:
            best, cut = 2 * right / (rows + total), x
    return cut


def logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """(slope, offset) of the curve through (evidence, rows, toxic rows), by Newton steps with a slight ridge."""
    x = np.arcsinh(np.array([p[0] for p in points]) / SCALE)
    n = np.array([p[1] for p in points], float)
    y = np.array([p[2] for p in points], float)
    unit = max(float(np.sqrt((n * x * x).sum() / n.sum())), 1e-9)
    a = np.stack([x / unit, np.ones_like(x)], axis=1)
    ridge = np.diag([1e-3, 1e-6])
    w = np.zeros(2)
    loss = lambda w: float((n * np.logaddexp(0, a @ w) - y * (a @ w)).sum() + w @ ridge @ w / 2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - n * p) - ridge @ w)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0] / unit), float(w[1])


@dataclass
class Classifier:
    model: Model
    slope: float
    offset: float

    def score(self, evidence: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.asinh(evidence / SCALE) * self.slope + self.offset)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Classifier | None:
    """Learned from ``labels`` of rows outside fold 1 and the texts of all ``docs``; None without rows of both classes."""
    require(docs, key, text)
    require(labels, key, toxic)
    marks = labels.select(labels[key].alias("key"), labels[toxic].alias("toxic")).where("key is not null and toxic is not null")
    marks = save(marks.where(fold(F.col("key")) != 1).groupBy("key").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "marks")
    texts = docs.select(docs[key].alias("key"), docs[text].alias("text")).where("text is not null")
    facts = ["toxic", F.pmod(F.xxhash64("key"), F.lit(PARTS)).alias("part")]
    known = texts.join(small_enough(marks), "key").select("text", *facts)
    if marks.count() <= BROADCAST_ROWS:
        # one pass counts all texts, labelled ones apart; rows without label have null
        every = save(count_grams(texts.join(F.broadcast(marks), "key", "left").select("text", "toxic", F.when(F.col("toxic").isNotNull(), facts[1]).alias("part")), ["toxic", "part"]), "grams")
        counted = every.where("toxic is not null")
    else:
        # labels that must be shuffled would take all texts with them: labelled texts are met on their own
        every, counted = save(count_grams(texts, []), "grams"), save(count_grams(known, ["toxic", "part"]), "class_grams")
    if counted.select("toxic").distinct().count() < 2:
        drop(marks, every, counted)
        return None
    shared = shared_model(every.groupBy("gram").agg(F.sum("n").alias("n")))
    points: dict[float, list[int]] = {}
    for part in range(PARTS):
        got = evidence(known.where(F.col("part") == part), class_model(counted.where(F.col("part") != part), shared), ["toxic"])
        # evidence lies between log(1 - MIXED) and the largest log ratio, so its tenths of a thousandth are few
        for r in got.groupBy(F.round("evidence", 4).alias("x")).agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).collect():
            met = points.setdefault(r.x, [0, 0])
            met[0] += r.n
            met[1] += r.toxic
    listed = [(x, n, t) for x, (n, t) in sorted(points.items())]
    slope = max(logistic(listed)[0], 1e-6)
    # the curve is moved so that the best cut scores THRESHOLD
    offset = float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * np.arcsinh(best_cut(listed) / SCALE))
    out = Classifier(class_model(counted, shared), slope, offset)
    drop(marks, counted, every, shared)
    return out


def detect(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted, evidence) for each row of ``docs``."""
    found = fit(docs, labels, key, text, toxic)
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    if found is None:
        out = rows.select("key", F.lit(0.0).alias("evidence")).withColumn("score", F.lit(0.0))
    else:
        out = evidence(rows, found.model, ["key"]).withColumn("score", found.score(F.col("evidence")))
    return out.select(F.col("key").alias(key), (fold(F.col("key")) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
