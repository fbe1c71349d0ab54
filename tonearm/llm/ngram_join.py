"""Exact Jaccard join on word n-grams with count-vector R-trees.

A text's shingles are hashed into ``DIMS`` groups; its group counts are a point. The
overlap of two sets (or of any two sets in two boxes) is at most the sum of the
coordinates' minima, which R-trees over the points use to give the candidate pairs. Every
pair that is verified on the texts themselves comes out of a tree. Texts of more shingles
have finer points, of which a tree's are sums; they bound a tree's pairs once more.

The trees are dealt over the cluster by files. Shingles are ordered by how common they
are, then by hash; two linked sets share one at least of the first ``n - ceil(t n) + 1``
shingles of each in that order, whatever the order is. So each set is filed under those
shingles, and each file has trees of its own, of at most ``BLOCK`` points. The order comes
from counts of all shingles of all documents in a table of fixed size; it puts passages
that many documents share last, so they file (almost) nothing.

Equal sets are one class from the start. The trees are asked three times: in the files of
the first shingles for one partner of each point, in all files for one partner, and in
all files for all partners. Pairs within a component that is known by then are left
out, and so are files within one; what in a file can link with nothing by the sizes and
by the file's place in the order of either set comes into no tree. So components are exact, groups of near copies settle
in links proportional to their size, and copies are never expanded into pairs.

Defined results: words are maximal runs without ASCII white space, A-Z lower-cased;
fewer words than n form one shingle; no words or null text: an empty set, linked with
nothing; a null key belongs to its class but never names a component (null if no other
key does); rows repeated are members of one class; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import drop, map_batches, map_columns, require, save, small_enough
from .tokens import runs_of_texts

#: Coordinates of a tree's points; capacity of an R-tree node; points of a tree.
DIMS, FANOUT, BLOCK = 128, 16, 512
#: A text's own point has a coordinate for each shingle up to ``FINE`` coordinates, then for so many shingles, up to
#: ``FINEST``: little of what two texts do not share meets in one, so members of a group of near copies are
#: candidates only where they nearly link.
FINE, PER_DIM, FINEST = 512, 8, 1 << 14
#: Shingles of a set whose files are asked first.
FIRST_FILES = 2
#: Parts in which pairs are verified.
SLICES = 2
#: Parts in which files are dealt and asked, by a bit of the shingle's hash; a power of two.
FILE_SLICES = 2
#: Counters of the table that orders shingles, as bits.
SLOT_BITS = 18
#: Bytes of a word up to which it is hashed together with others.
LONG_WORD = 64
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Which bytes are white space, the bytes with A-Z lower-cased, and masks of the first bytes of eight.
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.where((np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Places of four counts in a byte, and the counts in each byte.
_SHIFTS = np.array([0, 2, 4, 6], np.uint8)
_QUADS = ((np.arange(256)[:, None] >> _SHIFTS) & 3).astype(np.uint8)
_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; one to one."""
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words of all texts in order, end of each text in them).

    A word's bytes go into its hash eight at a time, those of all words at once; the few
    words of more than ``LONG_WORD`` bytes are hashed one by one.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    cuts = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    inside = ~_BLANK[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # texts follow each other without a blank
    some = cuts[:-1][np.diff(cuts) > 0]
    first[some], last[some - 1] = inside[some], inside[some - 1]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = ends - begins
    low = np.zeros(len(raw) + 8, np.uint8)
    low[: len(raw)] = _LOWER[raw]
    eight = np.ndarray(len(raw) + 1, "<u8", low, strides=(1,))
    h = _mix(size.astype(np.uint64) * _MIX1 + (eight[begins] & _FIRST_BYTES[np.minimum(size, 8)]))
    at, more = 8, np.flatnonzero((size > 8) & (size <= LONG_WORD))
    while len(more):
        h[more] = _mix(h[more] + (eight[begins[more] + at] & _FIRST_BYTES[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(low[begins[i] : ends[i]].tobytes())
    return h, np.searchsorted(begins, cuts[1:])


def raw_shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all shingles of all texts in order, end of each text in them)."""
    h, ends = word_hashes(texts)
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)].astype(np.int64)
    size = ends - starts
    full = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for i in range(n):
        full = _mix(full + h[i : i + len(full)])
    # what begins a shingle: all words but the last n - 1 of a text, and the first of a shorter text
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    out = np.zeros(int(count.sum()), np.uint64)
    to = np.cumsum(count)
    long = np.flatnonzero(size >= n)
    take = np.repeat(starts[long] - np.cumsum(count[long]) + count[long], count[long]) + np.arange(count[long].sum())
    put = np.repeat(to[long] - np.cumsum(count[long]), count[long]) + np.arange(count[long].sum())
    out[put] = full[take]
    for w in range(1, n):
        short = np.flatnonzero(size == w)
        x = np.full(len(short), w, np.uint64)
        for i in range(w):
            x = _mix(x + h[starts[short] + i])
        out[to[short] - 1] = x
    return out, to


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, ends = raw_shingles(texts, n)
    begin = 0
    for end in ends.tolist():
        x = np.sort(raw[begin:end])
        yield x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
        begin = end


def prefix(ids: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in the common order, one of which any linked set shares."""
    n = len(ids)
    most = n - (percent * n + 99) // 100 + 1
    return ids[np.argsort(levels[ids >> np.uint64(64 - SLOT_BITS)], kind="stable")[:most]]


def point(ids: np.ndarray) -> bytes:
    """Counts of shingles in groups, ``DIMS`` or a power of two more for long texts.

    Two bytes tell how counts are written and how many there are: as 2 bits each, then the
    places of what is above 3, once for each unit; or as 1, 2 or 4 bytes each.
    """
    dims = DIMS
    while dims < FINEST and dims * (1 if dims < FINE else PER_DIM) < len(ids):
        dims *= 2
    counts = np.bincount((ids & np.uint64(dims - 1)).view(np.int64), minlength=dims)
    most = int(counts.max())
    head = lambda width: bytes([width, dims.bit_length() - 1])
    if most < 1 << 8:
        low = counts.astype(np.uint8)
        above = np.flatnonzero(low > 3)
        if len(above):
            above = np.repeat(above, low[above] - 3)
            low = np.minimum(low, 3)
        if len(above) * 2 < dims // 2:
            # four counts of a byte stand in one 32-bit number
            four = low.view("<u4")
            return head(0) + (four | four >> 6 | four >> 12 | four >> 18).astype(np.uint8).tobytes() + above.astype("<u2").tobytes()
    width = next(w for w in (1, 2, 4) if most < 1 << 8 * w)
    return head(width) + counts.astype(f"<u{width}").tobytes()


def size_of(raw: bytes) -> int:
    """The sum of a point's counts, as it is written."""
    width, dims = raw[0], 1 << raw[1]
    if width:
        return int(np.frombuffer(raw, f"<u{width}", dims, 2).sum())
    end = 2 + dims // 4
    low = int.from_bytes(b"\x55" * (dims // 4))
    twos = int.from_bytes(raw[2:end])
    return (twos & low).bit_count() + 2 * (twos >> 1 & low).bit_count() + (len(raw) - end) // 2


def may_link(sizes: list[int], percent: int) -> bool:
    """Whether sets of any two of these sizes can link; if any can, so can two that are next to each other by size."""
    sizes = sorted(sizes)
    return any(100 * a >= percent * b for a, b in zip(sizes, sizes[1:]))


def points_of(raws: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray] = [None] * len(raws)  # type: ignore[list-item]
    alike: dict[bytes, list[int]] = {}
    for i, r in enumerate(raws):
        alike.setdefault(r[:2], []).append(i)
    for (width, power), own in alike.items():
        end = 2 + ((1 << power) * width or (1 << power) // 4)
        table = np.frombuffer(b"".join([raws[i][2:end] for i in own]), f"<u{width or 1}").reshape(len(own), -1)
        if not width:
            table = _QUADS[table].reshape(len(own), -1)
            above = [raws[i][end:] for i in own]
            np.add.at(table, (np.repeat(np.arange(len(own)), [len(x) // 2 for x in above]), np.frombuffer(b"".join(above), "<u2")), 1)
        for i, x in zip(own, table):
            out[i] = x
    return out


def folded(points: list[np.ndarray], dims: int) -> np.ndarray:
    """The points as rows of ``dims`` coordinates, sums of their finer ones."""
    out = np.zeros((len(points), dims), np.uint32)
    sizes = np.array([len(x) for x in points], np.int64)
    for n in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == n)
        step = max(1, (1 << 22) // n)
        for at in range(0, len(which), step):
            some = which[at : at + step]
            out[some] = np.array([points[i] for i in some]).reshape(len(some), -1, dims).sum(axis=1, dtype=np.uint32)
    return out


def bounds_of_long(points: list[np.ndarray], p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """``most`` with the bounds of pairs that both have finer points, in the coarser of the two."""
    dims = np.array([len(x) for x in points], np.int64)
    common = np.minimum(dims[p], dims[q])
    most = most.copy()
    for d in np.unique(common[common > DIMS]).tolist():
        which = np.flatnonzero(common == d)
        own = np.unique(np.concatenate([p[which], q[which]]))
        table = folded([points[i] for i in own], d)
        step = max(1, (1 << 21) // d)
        for at in range(0, len(which), step):
            some = which[at : at + step]
            most[some] = np.minimum(table[np.searchsorted(own, p[some])], table[np.searchsorted(own, q[some])]).sum(axis=1, dtype=np.int64)
    return most


def shingle_levels(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """How common the shingles of each slot are: 0 up to what chance fills a slot with, then by doublings.

    All shingles of all rows are counted in ``2**SLOT_BITS`` slots of their hash.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for b in batches:
            for _, run in runs_of_texts(b.column(0)):
                raw, _ = raw_shingles(run, n)
                total += np.bincount((raw >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
        some = np.flatnonzero(total)
        yield [some, total[some]]

    told = map_batches(docs.select(docs[text].alias("text")), count, T.StructType([T.StructField("slot", T.LongType()), T.StructField("n", T.LongType())]))
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for r in told.groupBy("slot").agg(F.sum("n").alias("n")).collect():
        total[r.slot] = r.n
    usual = np.median(total)
    return np.ceil(np.log2(np.maximum(1.0, (total - usual) / (6 * np.sqrt(usual) + 6)))).astype(np.uint8)


class RTree:
    """Bulk-loaded over points: leaves and nodes of ``FANOUT`` with the largest counts below them.

    The sum of minima of two boxes' upper corners bounds the overlap of any two sets in them.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # near points stand together: order by size, then by the heaviest coordinates
        rank = np.argsort(-points.sum(axis=0), kind="stable")[:4]
        self.order = np.lexsort((*(points[:, c] for c in rank[::-1]), sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = [(self.points, self.sizes)]
        while len(self.levels[-1][0]) > 1:
            upper, small = self.levels[-1]
            cuts = np.arange(0, len(upper), FANOUT)
            self.levels.append((np.maximum.reduceat(upper, cuts), np.minimum.reduceat(small, cuts)))

    def join(self, other: "RTree", percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices (into the points as given) of pairs whose bound reaches the least overlap of a link, and the bounds."""
        depth = max(len(self.levels), len(other.levels))
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(depth - 1, -1, -1):
            (ua, sa), (ub, sb) = (t.levels[min(level, len(t.levels) - 1)] for t in (self, other))
            most = np.empty(len(a), np.int64)
            for at in range(0, len(a), 4096):
                most[at : at + 4096] = np.minimum(ua[a[at : at + 4096]], ub[b[at : at + 4096]]).sum(axis=1, dtype=np.int64)
            keep = (100 + percent) * most >= percent * (sa[a] + sb[b])
            a, b, most = a[keep], b[keep], most[keep]
            if level == 0:
                break
            for t, which in ((self, 0), (other, 1)):
                if level < len(t.levels):
                    up = (a, b)[which]
                    n = len(t.levels[level - 1][0])
                    kids = (up[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    a, b = np.repeat(a, FANOUT), np.repeat(b, FANOUT)
                    a, b = (kids, b) if which == 0 else (a, kids)
                    real = kids < n
                    a, b = a[real], b[real]
        return self.order[a], other.order[b], most


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def asked(fine: list[np.ndarray], components: np.ndarray, percent: int, head: int | None = None, cut: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs across components that trees over the points ``fine`` give.

    With ``cut``: all pairs of one of the first ``cut`` points and one of the others. Else
    with ``head``: one partner for each point at most: the point ``head`` if it is one,
    else the one with the largest share of its bound. Else all pairs.
    """
    points = folded(fine, DIMS)
    size = points.sum(axis=1, dtype=np.int64)
    if cut is None:
        tree = RTree(points, size)
        p, q, most = tree.join(tree, percent)
        ok = (p < q) & (components[p] != components[q])
    else:
        left, right = RTree(points[:cut], size[:cut]), RTree(points[cut:], size[cut:])
        p, q, most = left.join(right, percent)
        q = q + cut
        ok = components[p] != components[q]
    p, q, most = p[ok], q[ok], most[ok]
    most = bounds_of_long(fine, p, q, most)
    ok = (100 + percent) * most >= percent * (size[p] + size[q])
    p, q, most = p[ok], q[ok], most[ok]
    if head is None or cut is not None or not len(p):
        return p, q
    most = most / (size[p] + size[q])
    most[(p == head) | (q == head)] = 2.0
    one, other, most = np.concatenate([p, q]), np.concatenate([q, p]), np.concatenate([most, most])
    order = np.lexsort((-most, one))
    first = order[np.concatenate([[True], one[order][1:] != one[order][:-1]])]
    best = np.unique(np.stack([np.minimum(one[first], other[first]), np.maximum(one[first], other[first])]), axis=1)
    return best[0], best[1]


def ngram_classes(docs: DataFrame, key: str, text: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(members: key, n_shingles, set_id; classes: node, set_id, rep, size, point, prefix), both saved."""
    require(docs, key, text)
    levels = shingle_levels(docs, text, n)
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("point", T.BinaryType()), T.StructField("prefix", T.BinaryType())])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
        for b in batches:
            for at, run in runs_of_texts(b.column(1)):
                out: list = [b.column(0).slice(at, len(run)), [], [], [], []]
                for ids in shingle_sets(run, n):
                    some = len(ids) > 0
                    for to, x in zip(out[1:], (len(ids), xxhash.xxh3_128_digest(ids.tobytes()) if some else None, point(ids) if some else None, prefix(ids, levels, percent).astype("<i8").tobytes() if some else None)):
                        to.append(x)
                yield out

    told = save(map_batches(docs.select(docs[key].alias("key"), docs[text].alias("text")), describe, schema), "ngrams")
    # copies collapse in map-side partial aggregation; any copy's point and prefix are those of the class
    one = told.where("set_id is not null").groupBy("set_id").agg(F.min("key").alias("rep"), F.first(F.struct("n_shingles", "point", "prefix")).alias("s"))
    classes = save(one.select(F.monotonically_increasing_id().alias("node"), "set_id", "rep", F.col("s.n_shingles").alias("size"), F.col("s.point").alias("point"), F.col("s.prefix").alias("prefix")), "ngrams")
    members = save(told.select("key", "n_shingles", "set_id"), "members")
    drop(told)
    return members, classes


def _filed(classes: DataFrame, first: int | None = None, part: int | None = None) -> DataFrame:
    """(file, node, component, size, place) for all filing shingles of each class, or the ``first`` ones; with ``part`` only its files.

    ``place`` counts the shingles of the class before the file's in the common order.
    """
    columns = ("file", "place", "node", "component", "size")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
        for b in batches:
            raws = [np.frombuffer(r, "<i8")[:first] for r in b.column(3).to_pylist()]
            places = [np.arange(len(x)) for x in raws]
            if part is not None:
                places = [np.flatnonzero(x & (FILE_SLICES - 1) == part) for x in raws]
                raws = [x[at] for x, at in zip(raws, places)]
            sizes = [len(r) for r in raws]
            for at in range(0, len(raws), 2000):
                some = slice(at, at + 2000)
                yield [np.concatenate(raws[some]), np.concatenate(places[some]), *[np.repeat(b.column(c).to_numpy()[some], sizes[some]) for c in range(3)]]

    rows = classes.select("node", "component", "size", "prefix")
    return map_batches(rows, spread, T.StructType([T.StructField(c, T.LongType()) for c in columns]))


def _open_files(rows: DataFrame) -> DataFrame:
    """The rows of ``rows`` (file, node, component, ...) in files that hold several components, with the file's rows ``n``.

    Only minima, maxima and counts are shuffled to find them, after partial aggregation.
    """
    several = rows.groupBy("file").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("n")).where("c <> d").select("file", "n")
    return rows.join(several, "file")


def meets(file: np.ndarray, component: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Which rows, in order of their files, can link with a row of their file in another component.

    Linked sets meet in the file of their first common shingle, and all that they share
    stands from there on in either one. A set of ``size`` shingles with ``place`` of them
    before the file's links by it only with sets of at most ``(100 + percent) / percent *
    (size - place) - size`` shingles.
    """
    most = (100 + percent) * (size - place) // percent - size
    begins = np.flatnonzero(np.concatenate([[True], file[1:] != file[:-1]])) if len(file) else np.zeros(0, np.int64)
    counts = np.diff(np.append(begins, len(file)))
    start, count = np.repeat(begins, counts), np.repeat(counts, counts)
    ends = np.cumsum(count)
    keep = np.zeros(len(file), bool)
    at = 0
    while at < len(file):
        before = int(ends[at] - count[at])
        to = max(at + 1, int(np.searchsorted(ends, before + (1 << 18), "right")))
        one = np.repeat(np.arange(at, to), count[at:to])
        other = start[one] + np.arange(before, int(ends[to - 1])) - (ends - count)[one]
        ok = (size[other] <= most[one]) & (size[one] <= most[other]) & (component[one] != component[other])
        keep[one[ok]] = True
        at = to
    return keep


def _meeting(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of open files that can link with another row of their file, by ``meets``; without ``n``.

    Files of more than ``BLOCK`` rows stay whole; they are dealt over many tasks.
    """
    columns = ["file", "node", "component", "size", "place"]
    large = F.when(F.col("n") > BLOCK, F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK))).otherwise(0)
    dealt = rows.withColumn("deal", large).repartition("file", "deal").sortWithinPartitions("file").select(*columns, "n")

    def chosen(t: pa.Table) -> list:
        file, _, component, size, place, n = (c.to_numpy() for c in t.columns)
        keep = n > BLOCK
        small = np.flatnonzero(~keep)
        keep[small] = meets(file[small], component[small], size[small], place[small], percent)
        return [c.combine_chunks() for c in t.select(columns).filter(pa.array(keep)).columns]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        kept: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            # the last file may go on in the next batch; of a large one nothing needs to wait
            last = b.column(0)[-1].as_py()
            file = b.column(0).to_numpy()
            cut = len(b) if b.column(5)[-1].as_py() > BLOCK else int(np.searchsorted(file, last))
            if cut or (kept and kept[-1].column(0)[-1].as_py() != last):
                yield chosen(pa.Table.from_batches([*kept, b.slice(0, cut)]))
                kept = []
            if cut < len(b):
                kept.append(b.slice(cut))
        if kept:
            yield chosen(pa.Table.from_batches(kept))

    return map_batches(dealt, search, T.StructType([T.StructField(c, T.LongType()) for c in columns]))


def _distinct_files(rows: DataFrame) -> DataFrame:
    """``rows`` without files that hold the same classes as another file."""
    mark = lambda seed: F.expr(f"bit_xor(xxhash64({seed}, node))")
    same = rows.groupBy("file").agg(F.count("*").alias("n"), mark(1).alias("x"), mark(2).alias("y"))
    return rows.join(same.groupBy("n", "x", "y").agg(F.min("file").alias("file")).select("file"), "file", "left_semi")


def _in_trees(rows: DataFrame, group: list[str], percent: int, ask) -> DataFrame:
    """Pairs (a < b) that ``ask`` gives for the rows of each ``group``.

    ``rows``: the group's columns, side, node, component, point; ``ask`` gets the sides, nodes,
    components and points of a group and returns pairs of places. Trees are not built for
    groups without two sets whose sizes allow a link.
    """
    dealt = rows.select(*group, "side", "node", "component", "point").repartition(*group).sortWithinPartitions(*group, "side")
    width = len(group)

    def pairs_of(members: list[tuple]) -> tuple[list, list]:
        if not may_link([size_of(r[-1]) for r in members], percent):
            return [], []
        side, node, component = (np.array([r[width + k] for r in members], np.int64) for k in range(3))
        if (component == component[0]).all():
            return [], []
        p, q = ask(side, node, component, points_of([r[-1] for r in members]))
        return np.minimum(node[p], node[q]).tolist(), np.maximum(node[p], node[q]).tolist()

    def search(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        members: list[tuple] = []
        for columns in batches:
            out: tuple[list, list] = [], []
            for row in zip(*columns):
                if members and row[:width] != members[0][:width]:
                    for to, x in zip(out, pairs_of(members)):
                        to.extend(x)
                    members = []
                members.append(row)
            yield list(out)
        if members:
            yield list(pairs_of(members))

    return map_columns(dealt, search, _PAIR).distinct()


def _one_partner(rows: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """For each class of each file one candidate of another component at most.

    A file of more than ``BLOCK`` classes has a tree for each of its blocks, and each of
    these also holds the file's head, so that blocks meet in it. Rows grow by one a block.
    """
    files = rows.groupBy("file").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min_by(F.struct("node", "component"), F.xxhash64("node")).alias("head"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    body = rows.join(files.select("file", "blocks", F.col("head.node").alias("h")), "file")
    body = body.select("file", block.alias("block"), F.when(F.col("node") == F.col("h"), 0).otherwise(1).alias("side"), "node", "component")
    heads = files.where("blocks > 1").select("file", "blocks", "head.node", "head.component").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    heads = heads.where(F.col("block") != block).select("file", "block", F.lit(0).alias("side"), "node", "component")
    every = body.unionByName(heads).join(points, "node")

    def ask(side, node, component, at):  # noqa: ANN001, ANN202
        return asked(at, component, percent, head=0)

    return _in_trees(every, ["file", "block"], percent, ask)


def _all_partners(rows: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """All candidates across components in each file.

    A file's largest component needs no pairs of its own: the other classes are cut into
    blocks that meet each other and all blocks of the largest component.
    """
    parts = rows.groupBy("file", "component").agg(F.count("*").alias("n"))
    files = parts.groupBy("file").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("largest"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    files = files.select("file", "largest", blocks(F.col("n") - F.col("most")).alias("others"), blocks(F.col("most")).alias("own"))
    rows = rows.join(files, "file").withColumn("in", F.col("component") == F.col("largest"))
    some = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rows = rows.withColumn("at", F.when(F.col("in"), F.col("others") + some(F.col("own"))).otherwise(some(F.col("others"))))
    last = F.when(F.col("in"), F.col("others") - 1).otherwise(F.col("others") + F.col("own") - 1)
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("file", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), F.when(F.col("at") <= F.col("with"), 0).otherwise(1).alias("side"), "node", "component")
    # the block of the least place stands first; a block alone is joined with itself

    def ask(side, node, component, at):  # noqa: ANN001, ANN202
        cut = int((side == 0).sum())
        return asked(at, component, percent, cut=cut if cut < len(side) else None)

    return _in_trees(rows.join(points, "node"), ["file", "i", "j"], percent, ask)


def _texts(docs: DataFrame, key: str, text: str, n: int, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of one member of each class in ``nodes``, saved."""
    need = save(classes.join(nodes, "node", "left_semi").select("node", "set_id", "rep"), "need")
    reps = small_enough(need.select("rep").distinct())
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    rows = rows.join(reps, rows["key"].eqNullSafe(reps["rep"]), "left_semi").select("text")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
        for b in batches:
            for _, run in runs_of_texts(b.column(0)):
                yield [[xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in shingle_sets(run, n)], run]

    got = map_batches(rows, name, T.StructType([T.StructField("set_id", T.BinaryType()), T.StructField("text", T.StringType())]))
    out = save(got.join(need.select("node", "set_id"), "set_id").select("node", "text").dropDuplicates(["node"]), "texts")
    drop(need)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, saved.

    Texts are smaller than their sets, so texts come to the pairs, by shuffled joins
    whose skew AQE splits, and are shingled again there. Pairs are taken in ``SLICES``
    parts, one written after another, so disk holds one part's texts at a time.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
        for b in batches:
            p, q = b.column(0).to_pylist(), b.column(1).to_pylist()
            # a partner of many is shingled once a batch
            first: dict[int, int] = {}
            for at, node in enumerate(q):
                first.setdefault(node, at)
            right = b.column(3).take(pa.array(list(first.values()), pa.int64()))
            sets = dict(zip(first, (s for _, run in runs_of_texts(right) for s in shingle_sets(run, n))))
            left = (s for _, run in runs_of_texts(b.column(2)) for s in shingle_sets(run, n))
            ok = [linked(s, sets[node], percent) for s, node in zip(left, q)]
            yield [[i for i, o in zip(p, ok) if o], [i for i, o in zip(q, ok) if o]]

    out = None
    for k in range(SLICES):
        here = lambda c: F.pmod(F.xxhash64(c), F.lit(SLICES)) == k  # noqa: E731, B023
        part = pairs.where(here("b"))
        left = texts.join(part.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        right = texts.where(here("node")).select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        both = part.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        found = save(map_batches(both, verify, _PAIR), "links")
        out = found if out is None else out.unionByName(found)
    return out


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` with the components that ``links`` (a, b) join made one; saved."""
    side = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    edges = links.join(side("a"), "a").join(side("b"), "b").select("ca", "cb")
    joined = connected_components(edges, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("into"))
    return save(labels.join(joined, "component", "left").select("node", F.coalesce("into", "component").alias("component")), "labels")


def ngram_jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``docs``.

    Two rows link when 100 * |intersection| >= percent * |union| of their sets of word
    n-grams; component_id is the least key reachable by links, the row's own included.
    """
    members, classes = ngram_classes(docs, key, text, n, percent)
    points = classes.select("node", "point")
    labels = save(classes.select("node", F.col("node").alias("component")), "labels")
    tested: list[DataFrame] = []
    filed: list[DataFrame] = []
    for step in range(3):
        # files are taken in parts, one written after another, so disk holds one part's rows and points at a time;
        # the few first ones are one part
        dealt = []
        for part in range(FILE_SLICES if step else 1):
            named = classes.select("node", "size", "prefix").join(labels, "node")
            if step == 0:
                rows = _open_files(_filed(named, FIRST_FILES)).drop("n")
            elif step == 1:
                rows = _meeting(_open_files(_filed(named, part=part)), percent)
            else:
                # what could not meet before cannot now
                rows = _open_files(filed[part].drop("component").join(labels, "node")).drop("n")
            dealt.append(save(rows, "filed"))
        drop(*filed)
        filed = dealt
        found = []
        for rows in filed:
            pairs = (_one_partner if step < 2 else _all_partners)(_distinct_files(rows), points, percent)
            for before in tested:
                pairs = pairs.join(before, ["a", "b"], "left_anti")
            found.append(save(pairs, "pairs"))
        pairs = save(reduce(DataFrame.unionByName, found).distinct(), "pairs")
        drop(*found)
        tested.append(pairs)
        if pairs.isEmpty():
            continue
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        texts = _texts(docs, key, text, n, classes, ends)
        links = _verified(pairs, texts, n, percent)
        now = _relabelled(labels, links)
        drop(texts, links, labels)
        labels = now
    drop(*filed, *tested)
    named = classes.select("node", "set_id", "rep").join(labels, "node")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    component = named.join(least, "component").select("set_id", "least")
    out = members.where("set_id is not null").join(component, "set_id").select("key", "n_shingles", F.col("least").alias("component_id"))
    out = out.unionByName(members.where("set_id is null").select("key", "n_shingles", F.col("key").alias("component_id")))
    return out.withColumnRenamed("key", key)
