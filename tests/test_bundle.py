"""Array bundles: numpy reads what Spark wrote, a failed job leaves nothing."""

import json
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tonearm.sources import bundle
from tonearm.sources.views import vectors


def test_numpy_reads_what_spark_wrote(spark, sf_dir, tmp_path):
    bundle.register(spark)
    path = str(tmp_path / "b")
    df = vectors(spark, sf_dir).select("vec_id", "vec", F.when(F.col("vec_id") % 3 > 0, F.col("bpm")).alias("bpm"), "name", (F.col("vec_id") % 2 == 0).alias("even")).repartition(3)
    df.write.format("array_bundle").mode("overwrite").save(path)
    held = json.load(open(f"{path}/manifest.json"))["shards"]
    assert len(held) == 3 and sum(s["rows"] for s in held) == df.count()
    rows = {r.vec_id: r for r in df.collect()}
    met = 0
    for s in held:
        a = np.load(f"{path}/{s['name']}")
        assert a["vec"].shape == (s["rows"], 64) and a["vec"].dtype == np.float64
        for i, v, b, n, e in zip(a["vec_id"], a["vec"], a["bpm"], a["name"], a["even"]):
            r = rows[int(i)]
            assert v.tolist() == r.vec and (np.isnan(b) if r.bpm is None else b == r.bpm) and n == r.name and e == r.even
            met += 1
    assert met == len(rows)
    back = {r.vec_id: r for r in spark.read.format("array_bundle").load(path).collect()}
    assert all(back[i].vec == r.vec and back[i].name == r.name and back[i].even == r.even for i, r in rows.items()) and len(back) == len(rows)
    # appended, then replaced: shards of the former bundle go
    df.limit(5).write.format("array_bundle").mode("append").save(path)
    assert spark.read.format("array_bundle").load(path).count() == len(rows) + 5
    df.limit(7).write.format("array_bundle").mode("overwrite").save(path)
    assert spark.read.format("array_bundle").load(path).count() == 7
    assert sorted(os.listdir(path)) == sorted(["manifest.json", *[s["name"] for s in bundle.manifest(path)["shards"]]])


def test_a_failed_job_leaves_the_former_bundle(spark, tmp_path):
    bundle.register(spark)
    path = str(tmp_path / "b")
    good = spark.range(10).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    good.write.format("array_bundle").mode("overwrite").save(path)
    before = sorted(os.listdir(path))
    # one partition holds arrays of two lengths
    bad = spark.range(100).repartition(4).select("id", F.when(F.col("id") == 77, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("v"))
    with pytest.raises(PySparkException):
        bad.write.format("array_bundle").mode("overwrite").save(path)
    assert spark.read.format("array_bundle").load(path).count() == 10
    left = [f for f in os.listdir(path) if f not in before]
    assert left == []
    good.limit(0).write.format("array_bundle").mode("overwrite").save(path)
    assert spark.read.format("array_bundle").load(path).collect() == []
    with pytest.raises(PySparkException):
        spark.read.format("array_bundle").load(str(tmp_path / "none")).collect()
