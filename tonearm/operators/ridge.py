"""Ridge regression from moments: one pass over the rows for any number of fits.

The moments of some rows are their number, the sums of features and target, X'X, X'y and
y'y. They add up, so the rows without one group have the moments of all less those of the
group, and one pass gives the fits that leave out each group in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of the squared length of the direction.
ALPHA = 1.0
#: Groups whose moments a task holds at once.
HELD = 256


def moments(rows: DataFrame, features: str, target: str, group: Column | None = None) -> DataFrame:
    """(group, pos, x): the moments of each group of rows, as numbers by position.

    Positions are those of the matrix [1 X y]' [1 X y] read by rows. Rows with null
    features or target are left out; a null group is a group. A task gives one partial
    matrix for each group that it meets, so a group of any size is met in parts.
    """
    kind = "int" if group is None else rows.select(group.alias("g")).schema["g"].dataType.simpleString()
    own = rows.select((F.lit(0) if group is None else group).alias("group"), F.col(features).cast("array<double>").alias("v"), F.col(target).cast("double").alias("y")).where("v is not null and y is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out():
            names, parts = list(held), list(held.values())
            size = parts[0].size
            offsets = pa.array(np.arange(len(parts) + 1) * size, pa.int32())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, kinds), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p.ravel() for p in parts])))], ["group", "m"])

        kinds = None
        for b in batches:
            if not b.num_rows:
                continue
            kinds = b.column(0).type
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
            z = np.hstack([np.ones((b.num_rows, 1)), x, np.asarray(b.column(2))[:, None]])
            codes = b.column(0).dictionary_encode(null_encoding="encode")
            at = np.asarray(codes.indices)
            order = np.argsort(at, kind="stable")
            ends = np.flatnonzero(np.diff(at[order])) + 1
            for part in np.split(order, ends):
                name = codes.dictionary[int(at[part[0]])].as_py()
                m = z[part].T @ z[part]
                held[name] = held[name] + m if name in held else m
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    partial = own.mapInArrow(run, f"group {kind}, m array<double>")
    return partial.select("group", F.posexplode("m").alias("pos", "x")).groupBy("group", "pos").agg(F.sum("x").alias("x"))


def solve(m: np.ndarray, alpha: float = ALPHA) -> tuple[float, np.ndarray]:
    """(offset, direction) of the matrix [1 X y]' [1 X y]; nothing known gives zeros."""
    n, d = m[0, 0], len(m) - 2
    if n < 0.5:
        return 0.0, np.zeros(d)
    mean = m[0, 1:] / n
    centred = m[1:, 1:] - n * np.outer(mean, mean)
    w = np.linalg.solve(centred[:d, :d] + alpha * np.eye(d), centred[:d, d])
    return float(mean[d] - mean[:d] @ w), w


def fit(rows: DataFrame, features: str, target: str, alpha: float = ALPHA) -> tuple[float, np.ndarray]:
    """One fit; a matrix of the features' number squared comes to the driver."""
    flat = [r.x for r in moments(rows, features, target).orderBy("pos").collect()]
    if not flat:
        raise ValueError("no row has features and target")
    return solve(np.array(flat).reshape(int(len(flat) ** 0.5), -1), alpha)


def fits_without(rows: DataFrame, features: str, target: str, group: Column, alpha: float = ALPHA) -> DataFrame:
    """(group, offset, direction): for each group the fit to all other rows.

    Groups may be many: each is solved where its moments lie; only the moments of all rows
    travel to every task.
    """
    own = moments(rows, features, target, group)
    kind = own.schema["group"].dataType.simpleString()
    by_group = own.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("m")).select("group", F.col("m.x").alias("m"))
    total = np.array([r.x for r in own.groupBy("pos").agg(F.sum("x").alias("x")).orderBy("pos").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for r in range(b.num_rows):
                rest = total - np.asarray(b.column(1)[r].values)
                found.append(solve(rest.reshape(int(len(rest) ** 0.5), -1), alpha))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1].tolist() for f in found], pa.list_(pa.float64()))], ["group", "offset", "direction"])

    return by_group.mapInArrow(run, f"group {kind}, offset double, direction array<double>")


def predicted(features: Column, offset: Column, direction: Column) -> Column:
    """The fitted value."""
    return offset + F.aggregate(F.zip_with(features, direction, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
