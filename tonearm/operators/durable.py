"""Steps of iterative or numbering operators, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only a session in one process that names none gets a temporary folder; on a cluster
    every executor would write to a disk of its own, so a missing setting raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found and context._jsc.sc().getCheckpointDir().isDefined():
        found = context._jsc.sc().getCheckpointDir().get()
    if not found:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tonearm-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: its rows are fixed, and lineage ends here.

    Whatever depends on where a row lay (partition ids, ties of a sort) is the same for all readers.
    """
    path = f"{folder(df.sparkSession)}/tonearm/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._step_path = path
    return out


def drop(*steps: DataFrame) -> None:
    """Remove the files of steps that nothing reads any more."""
    for df in steps:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._step_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
