"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's ids fill whole
windows first; what is left goes to the open window that it fits best. When it fits
none and no further window may be opened, the fullest window is topped up with the
head of the piece and emitted, so emitted windows have no padding. The windows still
open at the end of a partition are merged by the same rule, many partitions to one,
until one partition is left.

Every piece names its document, its start there, its sequence and its offset. A
sequence is padded to the window length when it is read.

Defined results: a null or empty text is the end id alone; repeated rows are packed
as often as they occur; null keys are kept; no rows give no pieces; a document longer
than a window is cut, and every id lies in exactly one piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_batches, map_columns, require, save
from .tokens import ChunkEncoder, runs_of_texts

#: Open windows per partition.
OPEN_WINDOWS = 16
#: Partitions whose leftovers meet in one task of the next merge.
MERGE_WIDTH = 32


class Packer:
    """Windows of one partition. ``add`` and ``close`` yield closed windows, each a list of pieces.

    A piece is (key, start, ids as uint32 array, tokens of the document).
    """

    def __init__(self, length: int, open_windows: int):
        self.length, self.most = length, open_windows
        self.open: list[tuple[int, list]] = []  # (tokens, pieces)

    def add(self, key, start: int, ids: np.ndarray, total: int) -> Iterator[list]:
        n, at = len(ids), 0
        while n - at >= self.length:
            yield [(key, start + at, ids[at : at + self.length], total)]
            at += self.length
        while at < n:
            need = n - at
            fit = max((k for k, (used, _) in enumerate(self.open) if used + need <= self.length), key=lambda k: self.open[k][0], default=None)
            if fit is None and len(self.open) < self.most:
                # a copy, so that no open window holds on to the ids of a whole run
                self.open.append((need, [(key, start + at, ids[at:].copy(), total)]))
                return
            k = fit if fit is not None else max(range(len(self.open)), key=lambda k: self.open[k][0])
            used, pieces = self.open[k]
            take = min(need, self.length - used)
            pieces.append((key, start + at, ids[at : at + take].copy(), total))
            at += take
            if used + take == self.length:
                self.open.pop(k)
                yield pieces
            else:
                self.open[k] = (used + take, pieces)

    def close(self) -> Iterator[list]:
        yield from (pieces for _, pieces in self.open)
        self.open = []


def _schema(key_type: T.DataType) -> T.StructType:
    f = [T.StructField("key", key_type)]
    f += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    return T.StructType([*f, T.StructField("ids", T.BinaryType()), T.StructField("part", T.IntegerType())])


class _Rows:
    """Collects pieces as output rows; a sequence id is (round, partition, counter)."""

    def __init__(self, step: int, keep_ids: bool):
        self.part = TaskContext.get().partitionId()
        self.base, self.seq, self.keep, self.rows = (step << 56) | (self.part << 32), 0, keep_ids, []

    def window(self, pieces: list, closed: bool) -> None:
        at = 0
        for key, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((key, start, len(ids), zlib.crc32(raw), total, self.base | self.seq, at, raw if self.keep or not closed else None, None if closed else self.part))
            at += len(ids)
        self.seq += 1

    def take(self) -> list[list]:
        out = [list(c) for c in zip(*self.rows)] or [[] for _ in range(9)]
        self.rows = []
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 1024, key: str = "doc_id", text: str = "text", open_windows: int = OPEN_WINDOWS, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Windows are packed where the rows lie, without a shuffle; only the last
    ``open_windows`` windows of each partition are moved, so the merge reads at most
    ``open_windows * length`` ids per partition and its rounds are a logarithm of their number.
    """
    require(docs, key, text)
    schema = _schema(docs.schema[key].dataType)
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
        encoder, packer, out = ChunkEncoder.of(tokenizer), Packer(length, open_windows), _Rows(0, keep_ids)
        for b in batches:
            keys = b.column(0).to_pylist()
            for at, run in runs_of_texts(b.column(1)):
                ids, ends = encoder.encode(run, end_id)
                ids, begin = ids.astype("<u4"), 0
                for key, end in zip(keys[at : at + len(run)], ends.tolist()):
                    for window in packer.add(key, 0, ids[begin:end], end - begin):
                        out.window(window, True)
                    begin = end
                yield out.take()
        for window in packer.close():
            out.window(window, False)
        yield out.take()

    done = save(map_batches(rows, first, schema), "packed")
    result, left, step = done.where("part is null"), done.where("part is not null"), 1
    top = left.agg(F.max("part")).first()[0]
    parts = 0 if top is None else top + 1
    while parts:
        width = -(-parts // MERGE_WIDTH)
        last = width == 1

        def merge(batches: Iterator[list[list]], step: int = step, last: bool = last) -> Iterator[list[list]]:
            packer, out = Packer(length, 1 if last else open_windows), _Rows(step, keep_ids)
            for columns in batches:
                for key, start, _, _, total, _, _, raw, _ in zip(*columns):
                    for window in packer.add(key, start, np.frombuffer(raw, "<u4"), total):
                        out.window(window, True)
                yield out.take()
            for window in packer.close():
                out.window(window, last)
            yield out.take()

        dealt = left.withColumn("to", F.floor(F.col("part") / MERGE_WIDTH)).repartitionByRange(width, "to") if width > 1 else left.coalesce(1)
        dealt = dealt.sortWithinPartitions("part", "sequence_id", "offset").select(*schema.fieldNames())
        merged = save(map_columns(dealt, merge, schema), "packed")
        result = result.unionByName(merged.where("part is null"))
        left = merged.where("part is not null")
        parts = 0 if last else width
        step += 1
    columns = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    return result.select(F.col("key").alias(key), *columns)
