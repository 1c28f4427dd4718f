"""Tables between steps leave no shuffle files behind."""

import os

from pyspark.sql import functions as F

from matchlake import scratch


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.util.Utils.getConfiguredLocalDirs(spark.sparkContext._jsc.sc().conf())
    return sorted(name for folder in folders for _, _, names in os.walk(folder) for name in names if name.startswith("shuffle_") and name.endswith(".data"))


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    table = scratch.written(spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert set(shuffle_files(spark)) <= set(before)
    assert spark.conf.get(scratch.CLEANUP) == "false"
    assert sorted(r["count"] for r in table.collect()) == [142, 143, 143, 143, 143, 143, 143]
