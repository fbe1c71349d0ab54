"""Prefix trie, filter audit and toxicity against plain programs."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonearm.llm import exact_dedup, filter_audit, mixing, prefix_trie, quality, queries, toxicity



def grafted(df):
    """The query's trie: heads by crc32, bases at multiples of five."""
    conv = F.col("conv")
    return prefix_trie.conversation_trie(df, F.crc32(conv.cast("string").cast("binary")) % 9, conv - conv % 5, most=8)


def plain_trie(rows, rebuilt=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuilt else 0
        paths[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:] if rebuilt else turns
    at = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            at[tuple(p[:d])].append(c)
    kids = Counter(k[:-1] for k in at if k)
    leaves, saved = Counter(), Counter()
    for k, members in at.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members) - 1) * (len(k[-1][1].encode()) if k else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(k), min(at[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], digest([c for c in m if len(paths[c]) == len(k)])) for k, m in at.items())


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, conv string"


@pytest.mark.parametrize("rebuilt", [True, False])
def test_trie_against_a_plain_one(spark, rebuilt):
    rng = random.Random(5)
    rows = []
    for c in [*range(60), 2**40, -7, -4, 103]:
        for turn in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([turn, turn, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é" * 9, None, ""])))
    # many equal conversations, equal but for the last turn, one much longer than a block, its copy, and rows without id
    for c in range(1000, 1120):
        rows += [(c, i, "user", "hot") for i in range(4)] + ([(c, 9, "user", str(c))] if c % 3 else [])
    for c in (5000, 5005, 5010):
        rows += [(c, i, "user", f"t{i}") for i in range(30)] + ([(c, 31, "x", "y")] if c == 5010 else [])
    rows += [(None, 0, "user", "none"), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, "k", "c") for r in rows], CONVERSATIONS).repartition(5)
    got = grafted(df) if rebuilt else prefix_trie.conversation_trie(df)
    assert trie_rows(got) == plain_trie(rows, rebuilt)


def test_trie_of_little(spark):
    df = spark.createDataFrame([(None, 1, "a", "b", None, None)], CONVERSATIONS)
    assert prefix_trie.conversation_trie(df).collect() == [] == grafted(df).collect()
    # conversation 1 loses its only turn to an absent one's: a root without children
    rows = [(c, 0, "user", "x") for c in (1,)]
    assert zlib.crc32(b"1") % 9 >= 1
    lone = spark.createDataFrame([(*r, None, None) for r in rows], CONVERSATIONS)
    assert trie_rows(grafted(lone)) == plain_trie(rows) == [(1, 0, -1, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    long = [(3, 0, "user", "w" * 3_000_000), (4, 0, "user", "w" * 3_000_000), (4, 1, None, None)]
    df = spark.createDataFrame([(*r, None, None) for r in long], CONVERSATIONS)
    assert trie_rows(prefix_trie.conversation_trie(df)) == plain_trie(long, False)


def test_ids_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    rows = [(c, 0, "user", "same") for c in range(700, 1300)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], CONVERSATIONS).repartition(6)
    assert trie_rows(prefix_trie.conversation_trie(df)) == plain_trie(rows, False)


def plain_audit(docs, labels):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, bad = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    out = []
    for part in {p or "" for _, _, p in docs}:
        fails = []
        for i, text, p in docs:
            if (p or "") != part:
                continue
            t = text or ""
            words = [w for w in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
            f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
            least = first.get(t)
            fails.append((set(f + "E" * (least is not None and (i is None or i > least))), i))
        shapley, rows = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = fails
            for k, x in enumerate(order):
                gone = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                shapley[x] += len(gone)
                rows.append([part, "".join(order), k + 1, len(left), len(gone), sum(x in f for f, _ in fails) - len(gone), sum(f == {x} for f, _ in fails), sum(i in good for _, i in gone), sum(i in bad for _, i in gone)])
        out += [tuple([*r, shapley[r[1][r[2] - 1]]]) for r in rows]
    return sorted(out)


def test_audit_against_a_plain_one(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words[: rng.choice([5, 400])]) for _ in range(rng.choice([10, 199, 200, 260]))) for _ in range(25)]
    texts += [t + rng.choice([" #", "|", " ABCDEFGHIJKLMNOP" * 4, " é"]) for t in texts[:12]] + [None, "", " \t\n\x0b\x0c\r ", "A" * 3 + "a" * 97, "A" * 4 + "é" * 96, "\x1c\x1d x \x85"]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(None, texts[0], "en"), (None, "only without id", "fr"), (None, "only without id", "fr"), docs[0], docs[0], (200, "x " * 300, "fr"), (-5, None, "fr"), (300, "long words " * 500_000, "es")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None), (999, 1, 1)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, part string, mask int").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.audit_documents(df, marks).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())
    assert got == plain_audit(docs, labels)
    assert filter_audit.audit_documents(df.limit(0), marks).collect() == []
    assert len(filter_audit.audit_documents(df, marks.limit(0)).collect()) == len(got)


def test_swaps_visit_all_orders():
    order, seen = list("ABCDE"), {"ABCDE"}
    for at in filter_audit.swaps(5):
        order[at], order[at + 1] = order[at + 1], order[at]
        assert "".join(order) not in seen
        seen.add("".join(order))
    assert len(seen) == 120
    assert filter_audit.text_mask(b"a b " * (filter_audit.LONG // 2)) == filter_audit.text_mask(b"a b " * 1000)


def plain_models(docs, marked):
    """(gram, toxic less ordinary log-likelihood) by plain dictionaries."""

    def counts(texts):
        out = Counter()
        for t in texts:
            for w in toxicity._WORD.findall(t.lower()):
                out.update(toxicity.grams_of(w))
        return out

    def discount(c):
        once, twice = (sum(v == k for v in c.values()) for k in (1, 2))
        return once / (once + 2 * twice) if once else 0.5

    every = counts(docs)
    levels = [Counter({g: n for g, n in every.items() if len(g) == toxicity.ORDER})]
    for k in range(toxicity.ORDER - 1, 0, -1):
        level = Counter(g[1:] for g in levels[0])
        level.update({g: n for g, n in every.items() if len(g) == k})
        levels.insert(0, level)
    facts = []
    for c in levels:
        total, kinds = Counter(), Counter()
        for g, n in c.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        facts.append((c, discount(c), total, kinds))

    def p(g):
        c, d, total, kinds = facts[len(g) - 1]
        lower = p(g[1:]) if len(g) > 1 else 1 / (len(c) + 1)
        return (max(c[g] - d, 0) + d * kinds[g[:-1]] * lower) / total[g[:-1]]

    own = [counts(t for t, toxic in marked if toxic == c) for c in (0, 1)]
    out = []
    for c in own:
        total, kept, d = Counter(), Counter(), discount(c)
        for g, n in c.items():
            total[g[:-1]] += n
            kept[g[:-1]] += n - d
        out.append((c, d, total, kept))

    def ratio(g):
        logs = []
        for c, d, total, kept in out:
            t = total[g[:-1]]
            logs.append(math.log(max(c[g] - d, 0) / (t * p(g)) + (t - kept[g[:-1]]) / t) if t else 0.0)
        return logs[1] - logs[0]

    return ratio, own


def test_toxicity_models_against_plain_dictionaries(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    marked = [(rows[r.doc_id], r.toxic) for r in labels.collect() if r.doc_id in rows and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    found = toxicity.fit(docs, labels)
    ratio, own = plain_models(rows.values(), marked)
    grams = {g for c in own for g in c}
    assert found.model.grams.keys() == grams and len(grams) > 1000
    assert all(abs(found.model.grams[g] - ratio(g)) < 1e-9 for g in grams)
    got = {r.doc_id: r for r in toxicity.detect(docs, labels).collect()}
    for i, text in rows.items():
        x = np.array([sum(ratio(g) if g in grams else found.model.contexts.get(g[:-1], 0.0) for g in toxicity.grams_of(w)) for w in toxicity._WORD.findall(text.lower())])
        x = x - np.clip(np.median([*x, *[0.0] * toxicity.SPARE]), -toxicity.MOST_SHIFT, toxicity.MOST_SHIFT)
        evidence = np.log1p(toxicity.MIXED * np.expm1(np.minimum(x, toxicity.MOST_EVIDENCE))).sum() / (len(x) + toxicity.SPARE)
        z = found.slope * np.arcsinh(evidence / toxicity.SCALE) + found.offset
        assert abs(got[i].evidence - evidence) < 1e-9 and abs(got[i].score - 1 / (1 + math.exp(-z))) < 1e-6
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == (got[i].score >= 0.7)


def test_held_out_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = queries.op13_toxicity(spark, d).join(labels, "doc_id").where("held_out").toPandas()
    assert docs.count() == 10_000
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit >= 0.8 * got.toxic.sum() and hit >= 0.82 * got.predicted.sum()


def test_toxicity_cases(spark):
    clean = [f"the {a} house stands near {b} water" for a in ("old", "new", "red", "tall") for b in ("deep", "calm", "cold")]
    bad = [t + " you zorgle brax zorgle" for t in clean]
    docs = [(i, t) for i, t in enumerate((clean + bad) * 6)]
    labels = [(i, int("zorgle" in t)) for i, t in docs] + [(None, 1), (10**6, 1), (3, None)]
    odd = [(2000, None), (2001, ""), (2002, "12 34 !?"), (2003, "word " * 400_000 + "x" * 3_000_000), (None, bad[0]), (2004, "zorgle brax " * 30), (2005, clean[0]), (2005, clean[0]), (2006, clean[1] + " " + "the old house near calm water " * 5)]
    df = spark.createDataFrame([(*r, "en", 1.0, "k") for r in docs + odd], "doc_id long, text string, lang string, score double, key string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.detect(df, marks).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in got)
    assert by[2004].predicted == 1 and by[None].predicted == 1
    assert [by[i].predicted for i in (2000, 2001, 2002, 2003, 2005, 2006)] == [0] * 6
    assert by[2000].score == by[2001].score == by[2002].score
    held = [(r.predicted, "zorgle" in t) for (i, t) in docs for r in [by[i]] if r.held_out]
    assert len(held) > 20 and all(p == t for p, t in held)
    assert {r.score for r in toxicity.detect(df, marks.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.detect(df.limit(0), marks).collect() == []
    assert list(itertools.chain(*toxicity.slices("ab1cd " * 400_000))) == ["ab", "cd"] * 400_000


def test_one_odd_document_does_not_bound_the_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, "a b c d", "odd", "odd", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix_documents(docs.unionByName(odd)).toPandas()
    assert out.tokens[out.kept].sum() >= 0.4 * out.tokens.sum()
    got = out.tokens * out.probability
    for dim, power in mixing.POWERS.items():
        target = out.groupby(dim).tokens.sum() ** power
        assert (got.groupby(out[dim]).sum() / got.sum() - target / target.sum()).abs().max() < 0.02


def test_columns_with_dots_and_keys_of_text(spark):
    rows = [(f"k{i}", "The quick brown fox jumps over the lazy dog as it does every day in this town. " * (1 + i % 3), "en", f"s{i % 2}", i, i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, `a.b` int, `c``d` int")
    assert mixing.keep_mixed(docs).columns == docs.columns and mixing.keep_mixed(docs).count() > 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["a.b"] for r in kept.collect()} <= set(range(60))
    got = {r.key: r for r in exact_dedup.dedup_in_batches(docs).collect()}
    for j in range(3):
        own = sorted(f"k{i}" for i in range(60) if i % 3 == j)
        assert all((got[k].keep_id, got[k].group_size, got[k].kept) == (own[-1], 20, k == own[-1]) for k in own)
    assert exact_dedup.dedup_in_batches(docs.limit(0)).collect() == []


def test_toxicity_meets_chunks_and_grams_once(monkeypatch):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcéß日本😀𝒳ñ") for _ in range(rnd.randrange(1, 12))) for _ in range(2000)]
    grams, places, of = toxicity.grams_in(words)
    assert len(set(grams)) == len(grams)
    assert Counter((w, grams[g]) for g, w in zip(places.tolist(), of.tolist())) == Counter((w, g) for w, x in enumerate(words) for g in toxicity.grams_of(x))
    parts = ["word", "İz", "ΟΔΟΣ", "Σ", ". ", ", ", ",", ".", " ", "\n", "\t", "\xa0", "　", "\x1c", "12", "a1b", "x" * 70, "'", "_", "²", "ǅ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(3000)] + [None]
    found, places, ends = toxicity.chunks(pa.array(texts))
    cut = [[w for c in one for w in toxicity.words_in(found[c])] for one in np.split(places, ends)[:-1]]
    assert cut == [toxicity._WORD.findall((t or "").lower()) for t in texts]
    model, seen = toxicity.Model(), []
    monkeypatch.setattr(model, "words", lambda words: seen.extend(words) or np.zeros(len(words)))
    model.evidence(pa.array(["Some words, some text.", None, "", "text. Words"]))
    model.evidence(pa.array(["words some"]))
    assert sorted(seen) == ["some", "text", "words"]
