"""A checkpoint leaves its rows behind, not its shuffle files."""

import time

from pyspark.sql import functions as F

from quantloom import session


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_shuffle_files_go_with_the_checkpoint(spark):
    switch, before = spark.conf.get(session.CLEANUP), shuffle_files(spark)
    df = spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("s"))
    kept = session.checkpointed(df)
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(session.CLEANUP) == switch
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))      # both can be read, again and again
    assert kept.count() == df.count() == 10
