"""Set operations on keys and schemas, and top-k reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def schema_rows(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(name, type) of each column."""
    return spark.createDataFrame(df.dtypes, "name string, type string")


def union_keys(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    return a.select(*keys).union(b.select(*keys)).distinct()


def common_keys(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_semi")


def missing_keys(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Keys of a that b does not hold."""
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")


def schema_difference(spark: SparkSession, a: DataFrame, b: DataFrame) -> DataFrame:
    return schema_rows(spark, a).subtract(schema_rows(spark, b))


def top_per_key(df: DataFrame, keys, order, n: int, rank: str = "rank") -> DataFrame:
    """n first rows per key.  Spark keeps at most n rows per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def top_rows(df: DataFrame, order, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
