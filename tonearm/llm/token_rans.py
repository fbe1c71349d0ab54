"""Token-id files coded with a static range asymmetric numeral system.

One frequency table, counted over all ids and shared by all blocks, is scaled to
``2**SCALE_BITS``. Each block is coded on its own by
``LANES`` interleaved 63-bit states (id ``i`` belongs to lane ``i % LANES``) that
renormalise by 32-bit words, so numpy codes a row of lanes at a time. A block carries a
decoder checkpoint every ``CHECKPOINT_ROWS`` rows (states, stream position, CRC-32
checksums of the words and ids from there to the next), so the runs between checkpoints
are decoded and verified in parallel: ``read_tokens`` makes each run a row of its own.

The file format is a Parquet directory, so blocks are written and read by Spark's own
committers and readers wherever the path lives:

    table/   one row: the frequency table (ids as uint32, frequencies as uint32)
    blocks/  part, block, first_id (ids before it in its part), first_at (ids of its first
             document before it), doc_ids, doc_lengths (of whole documents), n_ids, words,
             checkpoints (position, states, words_crc32, ids_crc32)

Parts are ranges of (document key, hash of its ids), so one key of many documents is
dealt to many parts. Global positions need one small sum per part.

Defined results: keys of any sortable type; a null or empty text is the end id alone;
null keys come first; documents with equal keys are ordered by the hash of their ids,
then their ids; no rows give no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop, map_batches, map_columns, new_path, require, save, shuffle_partitions
from .tokens import ChunkEncoder, runs_of_texts

#: A run between checkpoints is ``LANES * CHECKPOINT_ROWS`` ids; a block holds several runs.
SCALE_BITS, LANES, CHECKPOINT_ROWS, BLOCK_IDS = 20, 1024, 128, 1 << 20
LOW = np.uint64(1 << 31)
_U32 = np.uint64(32)
_R = np.uint64(SCALE_BITS)
_MASK = np.uint64((1 << SCALE_BITS) - 1)


class Frequencies:
    """The shared table: for each id that occurs a frequency >= 1, in all ``2**SCALE_BITS``."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = np.asarray(ids, np.uint32), np.asarray(freq, np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if len(ids) else np.zeros(0, np.uint64)
        self.place = np.full(int(self.ids.max()) + 1 if len(ids) else 1, -1, np.int64)
        self.place[self.ids] = np.arange(len(self.ids))
        self._slots = None

    @classmethod
    def scaled(cls, ids: np.ndarray, counts: np.ndarray) -> "Frequencies":
        """Counts scaled to the total, at least 1 each; what rounding leaves goes to the most frequent ids."""
        ids, counts = np.asarray(ids), np.asarray(counts, np.float64)
        if not len(ids):
            return cls(ids, np.zeros(0))
        total = 1 << SCALE_BITS
        freq = np.maximum(1, np.floor(counts / counts.sum() * (total - len(ids)))).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        rest = total - int(freq.sum())
        k = 0
        while rest:
            i = order[k % len(order)]
            step = rest if rest > 0 else -min(-rest, int(freq[i]) - 1)
            freq[i] += step
            rest -= step
            k += 1
        return cls(ids, freq)

    @property
    def slots(self) -> np.ndarray:
        """Index of the id that owns each of the ``2**SCALE_BITS`` slots."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, table: Frequencies) -> tuple[bytes, list[tuple[int, bytes, int, int]]]:
    """(words, checkpoints) of one block.

    checkpoints: for each run of ``CHECKPOINT_ROWS`` rows, from the first: its position
    in words, the states of all lanes (uint64) before its first row, CRC-32 of the run's
    words, CRC-32 of its ids.
    """
    n = len(ids)
    rows = -(-n // LANES)
    at = table.place[ids]
    freq, start = table.freq[at], table.start[at]
    x = np.full(LANES, LOW, np.uint64)
    out, marks, written = [], [], 0
    for r in range(rows - 1, -1, -1):
        f, c = freq[r * LANES : (r + 1) * LANES], start[r * LANES : (r + 1) * LANES]
        y = x[: len(f)]
        full = y >= (f << np.uint64(63 - SCALE_BITS))
        if full.any():
            low = (y[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
            out.append(low)
            written += len(low)
            y[full] >>= _U32
        q = y // f
        y[:] = (q << _R) + (y - q * f) + c
        if r % CHECKPOINT_ROWS == 0:
            marks.append((written, x.astype("<u8").tobytes()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    marks = [(written - w, states) for w, states in reversed(marks)]
    cuts = [p for p, _ in marks[1:]] + [len(words)]
    step, plain = LANES * CHECKPOINT_ROWS, ids.astype("<u4")
    return words.tobytes(), [(p, s, zlib.crc32(words[p:e].tobytes()), zlib.crc32(plain[k * step : (k + 1) * step].tobytes())) for k, ((p, s), e) in enumerate(zip(marks, cuts))]


def decode_run(words: bytes, states: bytes, n: int, table: Frequencies) -> np.ndarray:
    """The ``n`` ids from a checkpoint on; ``words`` begin at its position."""
    rows = -(-n // LANES)
    w, p = np.frombuffer(words, "<u4"), 0
    x = np.frombuffer(states, "<u8").astype(np.uint64)
    slots, ids, freq, start = table.slots, table.ids, table.freq, table.start
    out = np.empty(n, np.uint32)
    for r in range(rows):
        y = x[: min(LANES, n - r * LANES)]
        slot = y & _MASK
        s = slots[slot]
        out[r * LANES : r * LANES + len(y)] = ids[s]
        y[:] = freq[s] * (y >> _R) + slot - start[s]
        need = y < LOW
        k = int(np.count_nonzero(need))
        if k:
            y[need] = (y[need] << _U32) | w[p : p + k]
            p += k
    return out


def combined_crc32(first: int, second: int, length: int) -> int:
    """CRC-32 of two strings joined, of their own and the length of the second.

    Zero bytes act on a CRC as a linear map over its 32 bits; the map of ``length`` of them
    is built by squaring.
    """

    def apply(rows: list[int], value: int) -> int:
        out = 0
        for bit in range(32):
            if value >> bit & 1:
                out ^= rows[bit]
        return out

    # the map of one zero byte, less that of the empty start
    step = [zlib.crc32(b"\0", 1 << bit) ^ zlib.crc32(b"\0", 0) for bit in range(32)]
    while length:
        if length & 1:
            first = apply(step, first)
        step = [apply(step, row) for row in step]
        length >>= 1
    return first ^ second


def block_schema(key: T.DataType) -> T.StructType:
    long = T.LongType()
    mark = T.StructType([T.StructField("position", long), T.StructField("states", T.BinaryType()), T.StructField("words_crc32", long), T.StructField("ids_crc32", long)])
    kinds = {"part": T.IntegerType(), "block": T.IntegerType(), "first_id": long, "first_at": long, "doc_ids": T.ArrayType(key), "doc_lengths": T.ArrayType(long), "n_ids": long, "words": T.BinaryType(), "checkpoints": T.ArrayType(mark)}
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def _pair(table: DataFrame) -> Frequencies:
    row = table.first()
    return Frequencies(np.frombuffer(row["ids"], "<u4"), np.frombuffer(row["freq"], "<u4")) if row else Frequencies(np.zeros(0, np.uint32), np.zeros(0))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode all texts and write table and blocks below ``path``, in ascending key order.

    Texts are tokenized once; ids (two bytes each for small vocabularies) are written
    to the shared folder, counted there, and dealt by ranges of the key.
    """
    require(docs, key, text)
    spark, key_type = docs.sparkSession, docs.schema[key].dataType

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
        encoder = ChunkEncoder.of(tokenizer)
        for b in batches:
            for at, run in runs_of_texts(b.column(1)):
                ids, ends = encoder.encode(run, end_id)
                raw, ends = memoryview(ids.tobytes()), (ends * encoder.dtype.itemsize).tolist()
                coded = [bytes(raw[a:b]) for a, b in zip([0, *ends], ends)]
                yield [b.column(0).slice(at, len(run)), coded, [zlib.crc32(c) for c in coded], [encoder.dtype.itemsize] * len(run)]

    ids_schema = T.StructType([T.StructField("key", key_type), T.StructField("ids", T.BinaryType()), T.StructField("tie", T.LongType()), T.StructField("width", T.IntegerType())])
    tokens = save(map_batches(docs.select(docs[key].alias("key"), docs[text].alias("text")), tokenize, ids_schema), "tokens")

    def count(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        total = np.zeros(0, np.int64)
        for raws, widths in batches:
            if raws:
                got = np.bincount(np.frombuffer(b"".join(raws), f"<u{widths[0]}"))
                if len(got) > len(total):
                    got[: len(total)] += total
                    total = got
                else:
                    total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield [seen, total[seen]]

    # at most one row per vocabulary entry comes to the driver
    counts = map_columns(tokens.select("ids", "width"), count, T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])).groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = sorted((r.id, r.n) for r in counts)
    table = Frequencies.scaled(np.array([i for i, _ in counts], np.int64), np.array([n for _, n in counts], np.int64))
    spark.createDataFrame([(bytearray(table.ids.astype("<u4").tobytes()), bytearray(table.freq.astype("<u4").tobytes()))], "ids binary, freq binary").write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((table.ids, table.freq))

    def blocks(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        own, part = Frequencies(*shared.value), TaskContext.get().partitionId()
        block, first, first_at, keys, lengths, pieces, size = 0, 0, 0, [], [], [], 0

        def row() -> list[list]:
            ids = np.concatenate(pieces)
            words, marks = encode_block(ids, own)
            names = ("position", "states", "words_crc32", "ids_crc32")
            return [[x] for x in (part, block, first, first_at, keys, lengths, len(ids), words, [dict(zip(names, m)) for m in marks])]

        for doc_keys, raws, widths in batches:
            for k, raw, w in zip(doc_keys, raws, widths):
                ids, at = np.frombuffer(raw, f"<u{w}"), 0
                while at < len(ids):
                    piece = ids[at : at + block_ids - size]
                    if not keys:
                        first_at = at
                    keys.append(k)
                    lengths.append(len(ids))
                    pieces.append(piece)
                    at, size = at + len(piece), size + len(piece)
                    if size == block_ids:
                        yield row()
                        block, first, keys, lengths, pieces, size = block + 1, first + size, [], [], [], 0
        if pieces:
            yield row()

    dealt = tokens.repartitionByRange(shuffle_partitions(spark), "key", "tie").sortWithinPartitions("key", "tie", "ids").select("key", "ids", "width")
    map_columns(dealt, blocks, block_schema(key_type)).write.parquet(f"{path}/blocks")
    drop(tokens)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, run, first_id, first_at, n_ids, doc_ids, doc_lengths, words, states, words_crc32, ids_crc32): the runs of all blocks.

    ``words`` are the run's own; ``first_id`` is the block's place in its part. Any run
    decodes by itself, so rows may be dealt to any tasks.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    step, run = LANES * CHECKPOINT_ROWS, F.col("run")
    marks = blocks.withColumn("last", F.array_append(F.transform("checkpoints", lambda m: m["position"]), F.floor(F.octet_length("words") / 4)))
    marks = marks.select("*", F.posexplode("checkpoints").alias("run", "mark"))
    begin, end = F.element_at("last", run + 1), F.element_at("last", run + 2)
    words = F.substring("words", begin.cast("int") * 4 + 1, (end - begin).cast("int") * 4)
    here = F.least(F.lit(step), F.col("n_ids") - run * step).alias("n_ids")
    return marks.select("part", "block", "run", "first_id", "first_at", here, "doc_ids", "doc_lengths", words.alias("words"), "mark.states", "mark.words_crc32", "mark.ids_crc32")


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) per document, decoded from the files at ``path``.

    Each run between checkpoints is decoded as a row of its own; documents that runs cut
    are put together from their pieces, whose checksums combine without their ids.
    Raises when a checksum of a run differs.
    """
    table = _pair(spark.read.schema("ids binary, freq binary").parquet(f"{path}/table"))
    shared = spark.sparkContext.broadcast((table.ids, table.freq))
    # one sum per part, as many rows as the writer had partitions
    coded = spark.read.parquet(f"{path}/blocks")
    sums = sorted((r.part, r.n) for r in coded.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, total = {}, 0
    for part, n in sums:
        before[part] = total
        total += n
    step = LANES * CHECKPOINT_ROWS
    names = [("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()), ("at", T.LongType()), ("n", T.LongType())]
    schema = T.StructType([T.StructField("key", coded.schema["doc_ids"].dataType.elementType), *[T.StructField(*x) for x in names]])
    if with_ids:
        schema = schema.add("ids", T.BinaryType())

    def decode(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        own = Frequencies(*shared.value)
        for columns in batches:
            for part, block, run, first, first_at, n, keys, lengths, words, states, words_crc, ids_crc in zip(*columns):
                if zlib.crc32(words) != words_crc:
                    raise ValueError(f"part {part}, block {block}, run {run}: the words' checksum differs")
                raw = decode_run(words, states, n, own).astype("<u4").tobytes()
                if zlib.crc32(raw) != ids_crc:
                    raise ValueError(f"part {part}, block {block}, run {run}: the ids' checksum differs")
                ends = np.cumsum(lengths) - first_at
                some = slice(int(np.searchsorted(ends, run * step, "right")), int(np.searchsorted(ends, run * step + n - 1, "right")) + 1)
                starts = ends[some] - lengths[some]
                a, b = np.maximum(starts, run * step), np.minimum(ends[some], run * step + n)
                pieces = [raw[4 * i : 4 * j] for i, j in zip(a - run * step, b - run * step)]
                yield [keys[some], starts + first + before[part], lengths[some], [zlib.crc32(p) for p in pieces], a - starts, b - a] + [pieces] * with_ids

    pieces = map_columns(read_runs(spark, path), decode, schema)
    rest = ["ids"] * with_ids
    pieces = save(pieces, "pieces")

    @F.udf("long")
    def joined(parts: list) -> int:
        crc = 0
        for r in parts:
            crc = combined_crc32(crc, r["crc"], 4 * r["n"])
        return crc

    cut = pieces.where("n < n_tokens").groupBy("key", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("at", "n", F.col("ids_crc32").alias("crc"), *rest))).alias("parts"))
    whole = [F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")] if with_ids else []
    out = pieces.where("n = n_tokens").select("key", "start", "n_tokens", "ids_crc32", *rest)
    out = out.unionByName(cut.select("key", "start", "n_tokens", joined("parts").alias("ids_crc32"), *[F.unhex(w).alias("ids") for w in whole]))
    return out.withColumnRenamed("key", key)


def scratch_path(spark: SparkSession) -> str:
    return new_path(spark, "rans")
