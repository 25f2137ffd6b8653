"""Shuffle files go as soon as the step that wrote them has ended."""

import os
import time

import pytest
from pyspark.sql import functions as F

from hindcast.llm import common


def shuffled(spark):
    """Bytes of shuffle files in the session's local folders."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    found = [os.path.join(at, f) for d in folders for at, _, names in os.walk(d) for f in names if f.startswith("shuffle_")]
    return sum(os.path.getsize(f) for f in found if os.path.exists(f))


@pytest.mark.parametrize("kind", ["stored", "cut"])
def test_no_shuffle_files_are_left(spark, kind):
    common.release(spark)
    time.sleep(1)
    before, results = shuffled(spark), []
    for i in range(3):
        rows = spark.range(200_000).select("id", F.xxhash64("id", F.lit(i)).alias("k")).repartition(8, "k")
        made = getattr(common, kind)(rows.groupBy("id").agg(F.max("k").alias("k")))
        del rows
        results.append(made[0] if kind == "stored" else made)
        for _ in range(20):
            if shuffled(spark) <= before + 100_000:
                break
            time.sleep(0.25)
        assert shuffled(spark) <= before + 100_000
    assert all(r.count() == 200_000 for r in results)
    common.sweep(spark)
