"""Window stages grow in tasks, not in rows per task."""

from pyspark.sql import functions as F

from quantloom.operators import series
from quantloom.operators.series import Series
from quantloom.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_partitions_follow_the_input(spark, monkeypatch):
    bars = T.daily_bars(spark, SF)
    size = series.input_bytes(bars)
    assert size > 10_000
    monkeypatch.setattr(series, "PART_BYTES", size / 40)
    s = Series(bars)
    wide = s.frame({"p": F.spark_partition_id(), "m": s.running_sum("close")})
    assert wide.rdd.getNumPartitions() == 40
    assert wide.groupBy("symbol").agg(F.count_distinct("p").alias("n")).where("n > 1").isEmpty()
    monkeypatch.setattr(series, "PART_BYTES", 4_000_000)
    s = Series(T.daily_bars(spark, SF))
    small = s.frame({"m": s.running_sum("close")})
    assert sorted(map(tuple, wide.drop("p").collect())) == sorted(map(tuple, small.collect()))


def test_fewer_parts_than_cores_are_not_merged_by_the_session(spark, monkeypatch):
    """A session that merges up to the advisory size would put all of them into one task."""
    first = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(first)
    small = Series(T.daily_bars(spark, SF))
    small = sorted(map(tuple, small.frame({"m": small.running_sum("close")}).collect()))
    monkeypatch.setattr(series, "PART_BYTES", series.input_bytes(T.daily_bars(spark, SF)) / 3)
    assert spark.sparkContext.defaultParallelism > 3
    spark.conf.set(first, "false")
    try:
        s = Series(T.daily_bars(spark, SF))
        wide = s.frame({"p": F.spark_partition_id(), "m": s.running_sum("close")})
        assert wide.rdd.getNumPartitions() >= 3
        assert wide.groupBy("symbol").agg(F.count_distinct("p").alias("n")).where("n > 1").isEmpty()
        assert sorted(map(tuple, wide.drop("p").collect())) == small
    finally:
        spark.conf.set(first, before)


def test_rows_without_files_are_left_to_the_session(spark):
    assert series.input_bytes(spark.range(5)) == 0
