import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.llm import packing, queries, token_rans
from tonearm.llm.tokens import ChunkEncoder, tokenizer_path

ODD = ["", "a  b\tc \n\n d", "'s <|endoftext|> x<|endoftext|>y", " lead", "trail ", "I'm  we'll don't\r\n a1b2 3.4", "Σίσυφος ΟΔΟΣ e\u0301 é", "\x1c a\x85b\u3000z", "İstanbul ﬁ", "\n", "a\nb\n\nc", "x\x1fy z", "a \x01 b", "\x01\x01 \x01", "a b\n c", "a\x00b \x00", "foo bar\n\n\nqux  end", "é" * 1000 + " x"]


def whole(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_equal_whole_texts(name):
    for texts in (ODD, [t for t in ODD if " " not in t], ["some plain words", "and\nmore of them"], [], [None, ""]):
        ids, ends = ChunkEncoder.of(name).encode(texts)
        assert [x.tolist() for x in np.split(ids, ends)[:-1]] == whole(name, [t or "" for t in texts])
        ids, ends = ChunkEncoder.of(name).encode(texts, 7)
        assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [[*x, 7] for x in whole(name, [t or "" for t in texts])]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_full_memo_is_forgotten(name):
    encoder = ChunkEncoder(tokenizer_path(name), memo_entries=3)
    for k in range(5):
        texts = [f"some words {k} of text {k + i}" for i in range(4)]
        ids, ends = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, ends)[:-1]] == whole(name, texts)


@pytest.mark.parametrize("name, texts", [("byte_bpe_50k.json", ["x some words, some text. words\nand, text,\nwords.\nand", "x words some, text. words, text.\nand, some,\nwords"]), ("word_bpe_49k.json", ["x some words, Some text.\nand", "Words some, AND. text, x, and Text. Some"])])
def test_words_before_commas_and_stops_are_encoded_once(name, texts):
    encoder = ChunkEncoder(tokenizer_path(name))
    encoder.encode(texts[:1])
    known = len(encoder.memo)
    ids, ends = encoder.encode(texts)
    assert len(encoder.memo) == known
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == whole(name, texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cuts_at_marks_equal_whole_texts(name):
    parts = ["word", "Word", "É", "ß", "İ", "J\u030c", "\u030c", "ΟΔΟΣ", "\u212a", "ǅ", "ª", "²", "12", "'s", "'S", "don't", "<|ENDOFTEXT|>", "<|endoftext|>"]
    parts += [" ", " ", "  ", "\n", "\t", "\x1f", "\xa0", "\xad", ", ", ". ", ",\n", ".\n", ",", "...", "!", "&&&"]
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(5000)]
    ids, ends = ChunkEncoder(tokenizer_path(name)).encode(texts)
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == whole(name, texts)


def check_packing(rows, ids_of, length=1024):
    """ids_of: for each key the documents with it; every id in one piece, windows gapless, little padding."""
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids_of)
    for key, ids in ids_of.items():
        at = 0
        for r in sorted(pieces[key], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    used = []
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= length
        used.append(at)
    assert sum(u < length for u in used) <= 1


def test_packing_query_against_tokenizer(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ids = whole("byte_bpe_50k.json", [d.text or "" for d in docs])
    check_packing(queries.op5_packing(spark, sf_dir).collect(), {d.doc_id: [*i, 0] for d, i in zip(docs, ids)})


def test_packing_of_odd_rows_over_many_partitions(spark):
    texts = [None, "", "word " * 5000, *ODD, *[f"number {i} " * (i % 40) for i in range(300)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("length", F.lit("clash")).repartition(40)
    ids = whole("byte_bpe_50k.json", [t or "" for t in texts])
    check_packing(packing.pack(docs, "byte_bpe_50k.json", 0, open_windows=2).collect(), {k: [*i, 0] for k, i in enumerate(ids)})


def test_packing_null_keys_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (2**60 + 1, "c")], "doc_id long, text string")
    rows = packing.pack(docs, "byte_bpe_50k.json", 0, keep_ids=True).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 3), (0, 3), (2**60 + 1, 2)]
    assert packing.pack(docs.limit(0), "byte_bpe_50k.json", 0).collect() == []


def test_rans_query_against_tokenizer(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda d: d.doc_id)
    at, want = 0, {}
    for d, i in zip(docs, whole("word_bpe_49k.json", [d.text or "" for d in docs])):
        i = [*i, 1]
        want[d.doc_id] = (at, len(i), zlib.crc32(np.array(i, "<u4").tobytes()))
        at += len(i)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op10_token_rans(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 100_000, 300_001])
def test_block_round_trip_and_parallel_runs(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49_000).astype(np.uint32)
    seen, counts = np.unique(ids, return_counts=True)
    table = token_rans.Frequencies.scaled(seen, counts)
    assert not n or int(table.freq.sum()) == 1 << token_rans.SCALE_BITS
    words, marks = token_rans.encode_block(ids, table)
    step, cuts = token_rans.LANES * token_rans.CHECKPOINT_ROWS, [m[0] for m in marks[1:]] + [len(words) // 4]
    assert len(marks) == -(-n // step)
    parts = [token_rans.decode_run(words[4 * m[0] : 4 * end], m[1], min(step, n - k * step), table) for k, (m, end) in enumerate(zip(marks, cuts))]
    assert not n or (np.concatenate(parts) == ids).all()


def test_a_block_holds_several_runs(spark):
    step = token_rans.LANES * token_rans.CHECKPOINT_ROWS
    assert token_rans.BLOCK_IDS >= 4 * step
    docs = spark.createDataFrame([("b", "word and more " * (step // 2)), ("a", "x"), ("c", "y " * 10)], "name string, text string").coalesce(1)
    path = token_rans.scratch_path(spark)
    token_rans.write_tokens(docs, path, "word_bpe_49k.json", 1, key="name")
    runs = token_rans.read_runs(spark, path)
    assert max(r["count"] for r in runs.groupBy("part", "block").count().collect()) > 1
    want, at = {}, 0
    for name, ids in zip("abc", whole("word_bpe_49k.json", ["x", "word and more " * (step // 2), "y " * 10])):
        want[name] = (at, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes()))
        at += len(ids) + 1
    for with_ids in (False, True):
        got = token_rans.read_tokens(spark, path, "name", with_ids).collect()
        assert {r.name: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_checksums_combine(n):
    a, b = b"some bytes" * 7, bytes(range(256))[:n] * 3
    assert token_rans.combined_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert token_rans.combined_crc32(0, zlib.crc32(b), len(b)) == zlib.crc32(b)


def test_rans_files_with_odd_rows(spark):
    rows = [(5, None), (None, "x"), (1, ""), (7, "b b"), (7, "a"), (2, "long " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(0)).repartition(3)
    path = token_rans.scratch_path(spark)
    token_rans.write_tokens(docs, path, "word_bpe_49k.json", 1, block_ids=64)
    got = sorted(token_rans.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 5, 7, 7]
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens and r.ids[-4:] == b"\x01\0\0\0"
        at += r.n_tokens
    empty = token_rans.scratch_path(spark)
    token_rans.write_tokens(docs.limit(0), empty, "word_bpe_49k.json", 1)
    assert token_rans.read_tokens(spark, empty).collect() == []


def test_rans_checksum_is_verified(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    path = token_rans.scratch_path(spark)
    token_rans.write_tokens(docs, path, "word_bpe_49k.json", 1)
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("words", F.encode(F.lit("spoiled!"), "utf-8"))
    bad = token_rans.scratch_path(spark)
    spark.read.parquet(f"{path}/table").write.parquet(f"{bad}/table")
    blocks.write.parquet(f"{bad}/blocks")
    with pytest.raises(Exception, match="checksum differs"):
        token_rans.read_tokens(spark, bad).collect()
