"""Bundles of named arrays: shards that numpy reads, written and read by Spark.

``df.write.format("array_bundle").mode("append" or "overwrite").save(path)`` writes one
``.npz`` shard a task, with an array for each column, and last of all the manifest that names
the shards. Readers go by the manifest only: a job that fails or is cut leaves the former
bundle as it was, and its own shards are deleted. Paths are what ``pyarrow.fs`` opens,
so that all executors reach them.

Columns are numbers, booleans, texts, or arrays of numbers of one length; nulls of floating
columns are NaN, of texts empty, and in other columns an error.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME, MANIFEST = "array_bundle", "manifest.json"
#: Rows of a batch that a shard is read in.
BATCH = 10_000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path)


def manifest(path: str) -> dict | None:
    """What the live bundle holds: (shards, schema), or None where there is none."""
    files, at = _open(path)
    if files.get_file_info(f"{at}/{MANIFEST}").type != fs.FileType.File:
        return None
    with files.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


def to_numpy(column: pa.Array, kind: T.DataType) -> np.ndarray:
    """An array with a row for each value."""
    if isinstance(kind, T.ArrayType):
        if column.null_count or not len(column):
            if column.null_count:
                raise ValueError("a null array has no length")
            return np.zeros((0, 0))
        sizes = column.value_lengths().to_numpy()
        if (sizes != sizes[0]).any():
            raise ValueError("arrays of one column must have one length")
        return to_numpy(column.flatten(), kind.elementType).reshape(len(column), -1)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return column.to_numpy(zero_copy_only=False)
    if isinstance(kind, T.StringType):
        return np.array([x or "" for x in column.to_pylist()], dtype=np.str_)
    if column.null_count:
        raise ValueError("only floating columns and texts may hold nulls")
    return column.to_numpy(zero_copy_only=False)


@dataclass
class Shard(WriterCommitMessage):
    name: str | None
    rows: int


@dataclass
class Part(InputPartition):
    name: str


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Shard:
        held = [b for b in batches if b.num_rows]
        if not held:
            return Shard(None, 0)
        table = pa.Table.from_batches(held)
        body = io.BytesIO()
        np.savez_compressed(body, **{f.name: to_numpy(table.column(i).combine_chunks(), f.dataType) for i, f in enumerate(self.schema.fields)})
        files, at = _open(self.path)
        files.create_dir(at, recursive=True)
        name = f"shard-{uuid.uuid4().hex}.npz"
        with files.open_output_stream(f"{at}/{name}") as out:
            out.write(body.getvalue())
        return Shard(name, table.num_rows)

    def commit(self, messages: Sequence[Shard | None]) -> None:
        files, at = _open(self.path)
        files.create_dir(at, recursive=True)
        before = manifest(self.path)
        kept = [] if before is None or self.overwrite else before["shards"]
        shards = kept + [{"name": m.name, "rows": m.rows} for m in messages if m and m.name]
        fresh = f"{at}/{MANIFEST}.{uuid.uuid4().hex}"
        with files.open_output_stream(fresh) as out:
            out.write(json.dumps({"schema": self.schema.jsonValue(), "shards": shards}).encode())
        files.move(fresh, f"{at}/{MANIFEST}")
        for old in (before or {"shards": []})["shards"] if self.overwrite else []:
            files.delete_file(f"{at}/{old['name']}")

    def abort(self, messages: Sequence[Shard | None]) -> None:
        files, at = _open(self.path)
        for m in messages:
            if m and m.name:
                files.delete_file(f"{at}/{m.name}")


class BundleReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[Part]:
        return [Part(s["name"]) for s in (manifest(self.path) or {"shards": []})["shards"]]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not isinstance(part, Part):
            return  # an empty bundle has no shards, but Spark asks once
        files, at = _open(self.path)
        with files.open_input_file(f"{at}/{part.name}") as f:
            held = np.load(io.BytesIO(f.read()))
        arrow = to_arrow_schema(self.schema)
        columns = [held[f.name] for f in arrow]
        for start in range(0, len(columns[0]) if columns else 0, BATCH):
            cut = [c[start : start + BATCH] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(list(c) if c.ndim > 1 else c.tolist() if c.dtype.kind == "U" else c, f.type) for c, f in zip(cut, arrow)], schema=arrow)


class ArrayBundle(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        held = manifest(self.options["path"])
        if held is None:
            raise ValueError(f"no bundle at {self.options['path']}")
        return T.StructType.fromJson(held["schema"])

    def reader(self, schema: T.StructType) -> BundleReader:
        return BundleReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(ArrayBundle)
