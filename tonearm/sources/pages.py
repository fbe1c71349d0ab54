"""A paged binary table file: numbered pages of fixed size, tables as linked chains of pages, rows of six little-endian u32.

Page 0 is the file header: u32 number of tables at 8, next unused page at 12, sequence at
20, and from 28 one entry of four u32 per table: type, first page past the end, first and
last page of its chain. Every other page has 40 bytes of header (``_HEAD``), a heap of
rows, and from its end backwards one group of 36 bytes per 16 rows: two unused bytes, a
u16 mask of the rows present, sixteen u16 row offsets into the heap. A page whose flags
hold ``SKIP`` (an index page) has no rows, but its link counts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Sizes of page, header, row and group, rows per group and page, skip flag,
# the large row count that means "not used", columns.
PAGE_BYTES, HEADER_BYTES, ROW_BYTES, GROUP_BYTES, GROUP_ROWS, PAGE_ROWS, SKIP, NO_COUNT = 4096, 40, 24, 36, 16, 154, 0x40, 0x1FFF
COLUMNS = ("created_low", "created_high", "partner_id", "owner_id", "like_rate", "flags")
SCHEMA = ", ".join(f"{c} long" for c in COLUMNS)
#: number, type, next page, stamp; small row count, flags, free and used bytes, large row count
_HEAD = struct.Struct("<4x4I4xB2xB2H2xH4x")
_FILE, _ENTRY = struct.Struct("<8x2I4xI"), struct.Struct("<4I")
_TABLES = 28


def _head(page: bytes) -> dict[str, int]:
    return dict(zip(("number", "kind", "after", "stamp", "small", "flags", "free", "used", "large"), _HEAD.unpack_from(page)))


def build_page(number: int, after: int, rows: Sequence[Sequence[int]], flags: int = 0, kind: int = 0, stamp: int = 0, like: bytes | None = None) -> bytes:
    """One page with at most ``PAGE_ROWS`` rows; bytes of the header without a meaning here are those of the page ``like``."""
    n = len(rows)
    if n > PAGE_ROWS:
        raise ValueError(f"{n} rows do not fit a page")
    heap = np.asarray(rows, "<u4").reshape(n, len(COLUMNS)).tobytes()
    groups = -(-n // GROUP_ROWS)
    index = np.zeros((groups, GROUP_BYTES // 2), "<u2")  # words of a group, counted from its end
    place = np.arange(n)
    index[place // GROUP_ROWS, 2 + place % GROUP_ROWS] = place * ROW_BYTES
    np.bitwise_or.at(index[:, 1], place // GROUP_ROWS, (1 << place % GROUP_ROWS).astype("<u2"))
    # a group that is not full counts its mask and the offsets it uses
    taken = GROUP_BYTES * (n // GROUP_ROWS) + (4 + 2 * (n % GROUP_ROWS) if n % GROUP_ROWS else 0)
    free = PAGE_BYTES - HEADER_BYTES - len(heap) - taken
    page = bytearray(PAGE_BYTES)
    if like is not None:
        page[:HEADER_BYTES] = like[:HEADER_BYTES]
    fields = ((4, "4I", (number, kind, after, stamp)), (24, "B", (n,)), (27, "B", (flags,)), (28, "2H", (free, len(heap))), (34, "H", (n,)))
    for at, layout, values in fields:
        struct.pack_into("<" + layout, page, at, *values)
    page[HEADER_BYTES : HEADER_BYTES + len(heap)] = heap
    if groups:
        page[PAGE_BYTES - GROUP_BYTES * groups :] = index.reshape(-1)[::-1].astype("<u2").tobytes()
    return bytes(page)


def page_rows(page: bytes) -> list[tuple[int, ...]]:
    """Rows that are present, in the order of the index; none of a skipped page."""
    h = _head(page)
    n = h["large"] if h["small"] < h["large"] != NO_COUNT else h["small"]
    if h["flags"] & SKIP or not n:
        return []
    groups = -(-n // GROUP_ROWS)
    words = np.frombuffer(page, "<u2")[::-1][: groups * GROUP_BYTES // 2].reshape(groups, -1)
    present = (words[:, 1:2] >> np.arange(GROUP_ROWS, dtype="<u2") & 1).astype(bool).reshape(-1)[:n]
    starts = HEADER_BYTES + words[:, 2:].reshape(-1)[:n][present].astype(np.int64)
    cells = np.frombuffer(page, np.uint8)[starts[:, None] + np.arange(ROW_BYTES)]
    return [tuple(r) for r in np.ascontiguousarray(cells).view("<u4").tolist()]


def tables(image: bytes) -> list[dict[str, int]]:
    """(type, past, first, last) of each table of the file."""
    count = _FILE.unpack_from(image)[0]
    return [dict(zip(("type", "past", "first", "last"), _ENTRY.unpack_from(image, _TABLES + _ENTRY.size * t))) for t in range(count)]


def chain(image: bytes, kind: int = 0) -> Iterator[tuple[int, bytes]]:
    """(number, page) of a table in the order of its links.

    It ends after the table's last page, at link 0, past the end of the file, and at a page met before.
    """
    table = next((t for t in tables(image) if t["type"] == kind), None)
    at, seen = table["first"] if table else 0, set()
    while at and at not in seen and (at + 1) * PAGE_BYTES <= len(image):
        seen.add(at)
        page = image[at * PAGE_BYTES : (at + 1) * PAGE_BYTES]
        yield at, page
        at = 0 if at == table["last"] else _head(page)["after"]


def image_rows(image: bytes, kind: int = 0) -> list[tuple[int, ...]]:
    """All rows of a table."""
    return [r for _, page in chain(image, kind) for r in page_rows(page)]


def empty_image(kind: int = 0) -> bytes:
    """A file of one table that has an index page and no rows."""
    header = bytearray(PAGE_BYTES)
    _put_header(header, used=2, sequence=1, count=1)
    _ENTRY.pack_into(header, _TABLES, kind, 2, 1, 1)
    return bytes(header) + build_page(1, 2, [], SKIP, kind)


def _put_header(image: bytearray, used: int, sequence: int, count: int) -> None:
    struct.pack_into("<2I", image, 8, count, used + 1)
    struct.pack_into("<I", image, 20, sequence)


def replace_rows(image: bytes, rows: Sequence[Sequence[int]], kind: int = 0) -> bytes:
    """The file with ``rows`` as the table's rows; pages of other tables stay as they are.

    Data pages of the table are used again, further ones are appended; the last one's link
    is the first page past the end. Data pages that are no longer needed stay unlinked.
    """
    place = next((i for i, t in enumerate(tables(image)) if t["type"] == kind), None)
    if place is None:
        raise ValueError(f"no table of type {kind}")
    pages = list(chain(image, kind))
    heads = [(i, p) for i, p in pages if _head(p)["flags"] & SKIP]
    data = [(i, p) for i, p in pages if not _head(p)["flags"] & SKIP]
    count, _, sequence = _FILE.unpack_from(image)
    parts = [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]
    if not parts and not heads:
        parts = [[]]
    old = len(image) // PAGE_BYTES
    numbers = [i for i, _ in data][: len(parts)]
    numbers += range(old, old + len(parts) - len(numbers))
    used = max(old, numbers[-1] + 1 if numbers else 0)
    out = bytearray(image) + bytes(PAGE_BYTES * (used - old))
    for number, after, part in zip(numbers, [*numbers[1:], used], parts):
        out[number * PAGE_BYTES : (number + 1) * PAGE_BYTES] = build_page(number, after, part, 0, kind, sequence + 1, data[0][1] if data else None)
    chained = [i for i, _ in heads] + numbers
    if heads:
        struct.pack_into("<I", out, heads[-1][0] * PAGE_BYTES + 12, numbers[0] if numbers else used)
    _ENTRY.pack_into(out, _TABLES + _ENTRY.size * place, kind, used, chained[0], chained[-1])
    _put_header(out, used, sequence + 1, count)
    return bytes(out)


def build_image(rows: Sequence[Sequence[int]], kind: int = 0) -> bytes:
    return replace_rows(empty_image(kind), rows, kind)


def read_images(files: DataFrame, kind: int = 0) -> DataFrame:
    """Rows of a table of all files in a ``binaryFile`` DataFrame."""

    def run(frames):
        import pandas as pd

        for f in frames:
            for image in f["content"]:
                yield pd.DataFrame(image_rows(bytes(image), kind), columns=list(COLUMNS), dtype="int64")

    return files.select("content").mapInPandas(run, SCHEMA)


def image_pages(rows: DataFrame, order: str, first: int = 2) -> DataFrame:
    """(page, bytes): the data pages of an image, each built where its rows meet; ``rows`` are numbered from 1 in ``order``.

    ``first`` is the number of the first data page, ``page`` counts from 0.
    """

    def build(key, group):
        import pandas as pd

        group = group.sort_values(order)
        number = first + int(key[0])
        page = build_page(number, number + 1, group[list(COLUMNS)].astype("int64").values.tolist())
        return pd.DataFrame({"page": [int(key[0])], "bytes": [page]})

    return rows.withColumn("page", F.floor((F.col(order) - 1) / PAGE_ROWS)).groupBy("page").applyInPandas(build, "page long, bytes binary")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.kind = int(options.get("table", 0))

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            yield from image_rows(f.read(), self.kind)


class PagedTable(DataSource):
    """``spark.read.format("pagedtable").load(path)`` for files on a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "pagedtable"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return PageReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedTable)
