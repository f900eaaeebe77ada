"""File sources and sinks: Parquet, CSV and JSON through Spark's readers and writers."""

from __future__ import annotations

import operator
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quantloom.session import shared_base

# Accepted codec names.
CODECS = ("snappy", "gzip", "brotli", "lz4", "zstd", "none")
_OPS = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder of the cluster."""
    return f"{shared_base(spark)}/quantloom-{uuid.uuid4().hex}"


def predicate(filters) -> Column:
    """[(column, op, value), ...] joined by AND."""
    parts = []
    for name, op, value in filters:
        if op not in _OPS:
            raise ValueError(f"unsupported operator {op}")
        parts.append(_OPS[op](F.col(name), F.lit(value)))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def write_parquet(df: DataFrame, path: str, codec: str = "snappy", partition_by=(), mode: str = "error") -> None:
    """One table; an empty input is an error.  Tasks write what they hold: no shuffle, a hot partition value is
    written by many tasks.
    """
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec}")
    if df.isEmpty():
        raise ValueError("nothing to store")
    df.write.mode(mode).option("compression", codec).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, compress: bool = False, mode: str = "error") -> None:
    if df.isEmpty():
        raise ValueError("nothing to store")
    df.write.mode(mode).option("compression", "gzip" if compress else "none").csv(path, header=True)


def read_parquet(spark: SparkSession, path: str, columns=None, filters=()) -> DataFrame:
    """Columns and filters reach the scan (see PushedFilters / ReadSchema in the plan)."""
    df = spark.read.parquet(path).where(predicate(filters))
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema, columns=None, filters=()) -> DataFrame:
    """Typed CSV scan; the filters are honoured."""
    df = spark.read.schema(schema).csv(path, header=True).where(predicate(filters))
    return df.select(*columns) if columns else df


def export_results(df: DataFrame, path: str, fmt: str = "csv", time=None, where=None) -> None:
    """Flat export, newest first inside the files; structs and maps become JSON text in CSV."""
    if where is not None:
        df = df.where(where)
    if fmt == "csv":
        nested = [c for c, t in df.dtypes if t.startswith(("struct", "map", "array"))]
        df = df.withColumns({c: F.to_json(c) for c in nested})
    if time is not None:
        df = df.orderBy(F.desc(time))
    writer = df.write.mode("error")
    {"csv": lambda: writer.csv(path, header=True), "json": lambda: writer.json(path)}[fmt]()


def map_batches(df: DataFrame, f, schema: str) -> DataFrame:
    """User function over Arrow batches; batch size = spark.sql.execution.arrow.maxRecordsPerBatch."""
    def run(batches):
        for pdf in batches:
            yield f(pdf)
    return df.mapInPandas(run, schema)
