"""Ranks and cumulative counts that do not put a whole group into one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F


def value_splits(df: DataFrame, value: str, parts: int) -> list[float]:
    """At most `parts`-1 inner boundaries of the pooled values; a small list whatever the size of the data."""
    inner = df.approxQuantile(value, [i / parts for i in range(1, parts)], 1.0 / (4 * parts)) if parts > 1 else []
    return [float("-inf"), *sorted(set(inner)), float("inf")]


def cumulative_counts(df: DataFrame, keys: list[str], value: str, counts: dict, parts: int | None = None) -> DataFrame:
    """Per distinct (keys, value): the given counts (`c`) and their totals over smaller values of the keys (`c_below`).

    Equal values are first added up with map-side combine, so ties are one row.  The distinct values are cut into
    value ranges that hold about the same number of rows, and the running total inside a range is completed with the
    totals of the lower ranges (a table of at most keys x parts rows).  No key is ever a single task.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = df.groupBy(*keys, value).agg(*[agg.alias(n) for n, agg in counts.items()])
    splits = value_splits(df, value, parts)
    if len(splits) < 3:
        ranged = distinct.withColumn("_part", F.lit(0.0))
    else:
        ranged = Bucketizer(splits=splits, inputCol=value, outputCol="_part").transform(distinct)
    lower = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ranged.groupBy(*keys, "_part").agg(*[F.sum(n).alias(n) for n in counts])
    carry = carry.select(*keys, "_part", *[F.coalesce(F.sum(n).over(lower), F.lit(0)).alias(f"_{n}") for n in counts])
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"{n}_below") for n in counts])
    out = local.join(carry, [*keys, "_part"])
    return out.select(*keys, value, *counts,
                      *[(F.col(f"{n}_below") + F.col(f"_{n}")).alias(f"{n}_below") for n in counts])


def count_below(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each row with `below` (rows of smaller value), `ties` (rows of equal value) and `total` rows of its keys."""
    below = cumulative_counts(df, keys, value, {"ties": F.count(F.lit(1))})
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return (df.join(below, [*keys, value]).withColumnRenamed("ties_below", "below").join(totals, keys))


def average_ranks(df: DataFrame, keys: list[str], value: str, counts: dict, parts: int | None = None) -> DataFrame:
    """Distinct values with `rank` = mean 1-based position of their ties (all counts pooled)."""
    c = cumulative_counts(df, keys, value, counts, parts)
    below = sum((F.col(f"{n}_below") for n in counts), F.lit(0))
    ties = sum((F.col(n) for n in counts), F.lit(0))
    return c.withColumn("rank", below + (ties + 1) / 2)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], parts: int | None = None, weight: str | None = None) -> DataFrame:
    """(keys, q0, q1, ...): linearly interpolated quantiles of groups of any size; a row counts `weight` times.

    Works on running counts of distinct values, so no group is gathered; only the values next to each position are
    picked.
    """
    c = cumulative_counts(df.where(F.col(value).isNotNull()), keys, value, {"_k": F.sum(weight) if weight else F.count(F.lit(1))}, parts)
    n = c.groupBy(*keys).agg(F.sum("_k").alias("_n"))
    j = c.join(n, keys) if keys else c.join(F.broadcast(n), F.lit(True))
    first, last = F.col("_k_below"), F.col("_k_below") + F.col("_k") - 1       # 0-based positions of the ties
    out = []
    for i, p in enumerate(probs):
        pos = (F.col("_n") - 1) * p
        low, high = F.floor(pos), F.ceil(pos)
        at = lambda x: F.max(F.when((first <= x) & (x <= last), F.col(value)))
        out += [at(low).alias(f"_l{i}"), at(high).alias(f"_h{i}"), F.max(pos - low).alias(f"_f{i}")]
    a = j.groupBy(*keys).agg(*out)
    return a.select(*keys, *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(f"q{i}")
                             for i in range(len(probs))])
