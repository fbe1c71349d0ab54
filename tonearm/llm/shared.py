"""Durable intermediate tables, names that cannot clash, and block helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many rows of fixed, small width may be broadcast.
BROADCAST_ROWS = 200_000
#: Spark's setting that removes an execution's shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs in one process (local tests) a temporary
    folder is set; on a cluster every executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            found = got.get()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tonearm-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/tonearm/{tag}-{uuid.uuid4().hex}"


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor costs no more than the tasks it ran; nothing before this
    table is computed again. The write's own shuffle files go as soon as it is done,
    so disk holds one step at a time. ``drop`` removes the table's files.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tonearm_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete what lies at ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*frames: DataFrame) -> None:
    """Remove tables written by ``save`` that no later result reads."""
    for df in frames:
        path = getattr(df, "_tonearm_path", None)
        if path:
            remove(df.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when a count shows at most ``rows`` rows, else as it is.

    Larger sides are left to a shuffled join, whose skewed partitions AQE splits.
    """
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df


def require(df: DataFrame, *columns: str) -> None:
    """Fail early, naming the columns that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """Arrow-batched ``fn`` over whole partitions.

    ``fn`` takes an iterator of record batches and yields lists of columns of ``schema``.
    Spark bounds a batch by rows and by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``).
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
        release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Give back what the allocators of a Python worker keep; workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_columns(df: DataFrame, fn, schema) -> DataFrame:
    """``map_batches`` for Python values.

    ``fn`` takes an iterator of batches, each a list of Python lists (one per column;
    64-bit keys and nulls stay exact), and yields lists of columns of ``schema``.
    """
    return map_batches(df, lambda batches: fn([c.to_pylist() for c in b.columns] for b in batches), schema)
