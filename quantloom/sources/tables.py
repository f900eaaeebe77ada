"""Finance tables derived from the order and event tables.

Tick rows are reduced to bars by an aggregate on (symbol, bucket) with map-side combine, so one symbol that holds a
third of all ticks costs one partial row per bucket and task, not one huge group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quantloom.functions.scalar import div
from quantloom.operators.series import Series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlcv(ticks: DataFrame, keys: list[str], order: list[str], price: str, volume) -> DataFrame:
    """First, highest, lowest and last price and the volume per key; ties in time break on `order`, then price."""
    seq = F.struct(*order, price)
    return (
        ticks.groupBy(*keys)
        .agg(F.min(seq).alias("_first"), F.max(price).alias("high"), F.min(price).alias("low"),
             F.max(seq).alias("_last"), volume.alias("volume"))
        .select(*keys, F.col(f"_first.{price}").alias("open"), "high", "low",
                F.col(f"_last.{price}").alias("close"), "volume")
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol = supplier, price = extended price per unit, volume = quantity."""
    ticks = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber",
        div("l_extendedprice", "l_quantity").alias("price"), "l_quantity")
    return ohlcv(ticks, ["symbol", "ts"], ["l_orderkey", "l_linenumber"], "price", F.sum("l_quantity"))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol = event type, price = event value, volume = number of events."""
    ticks = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
        F.col("ts").alias("tick_ts"), "event_id", "value")
    bars = ohlcv(ticks, ["symbol", "hour"], ["tick_ts", "event_id"], "value", F.count(F.lit(1)).cast("double"))
    return bars.withColumnRenamed("hour", "ts")


def symbol_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per symbol: sector = nation, geography = region."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(F.col("s_suppkey").alias("symbol"), F.col("n_name").alias("sector"),
                F.col("r_name").alias("geography"))
    )


def simple_returns(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    """(keys, ts, ret) with the first row of each key left out."""
    s = Series(bars.select(*keys, "ts", "close"), keys)
    return s.frame({"ret": s.pct(F.col("close"))}, keep=[*keys, "ts"]).where("ret is not null")


def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple_returns(daily_bars(spark, sf_dir))


def benchmark_returns(returns: DataFrame) -> DataFrame:
    """Equal-weight mean return of all symbols per timestamp: one row per calendar bucket."""
    return returns.groupBy("ts").agg(F.avg("ret").alias("bench"))


def sector_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sector, ts, ret): equal-weight return of the members of each sector."""
    return (daily_returns(spark, sf_dir).join(symbol_metadata(spark, sf_dir), "symbol")
            .groupBy("sector", "ts").agg(F.avg("ret").alias("ret")))


# ---- returns of the trade margin ------------------------------------------------------------------------------
# Discount minus tax of the lines, in whole basis points of 100, so that every mean is a quotient of two integers.

def _margins(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    percent = (F.round(F.col("l_discount") * 100) - F.round(F.col("l_tax") * 100)).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"), percent.alias("_m"), *columns)


def _mean_margin(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum("_m") / (F.count(F.lit(1)) * 100.0)).alias(name))


def asset_returns(spark, sf_dir) -> DataFrame:
    """(symbol, ts, ret)"""
    return _mean_margin(_margins(spark, sf_dir), ["symbol", "ts"], "ret")


def market_returns(spark, sf_dir) -> DataFrame:
    """(ts, bench): one row per day."""
    return _mean_margin(_margins(spark, sf_dir), ["ts"], "bench")


def group_returns(spark, sf_dir, group: str) -> DataFrame:
    """(group, ts, ret) with group = sector or geography."""
    lines = _margins(spark, sf_dir).groupBy("symbol", "ts").agg(F.sum("_m").alias("_m"), F.count(F.lit(1)).alias("_n"))
    joined = lines.join(symbol_metadata(spark, sf_dir).select("symbol", group), "symbol")
    return joined.groupBy(group, "ts").agg((F.sum("_m") / (F.sum("_n") * 100.0)).alias("ret"))


def factor_returns(spark, sf_dir) -> DataFrame:
    """(ts, f0..f4): returns of the five regions, days on which all of them traded."""
    regions = group_returns(spark, sf_dir, "geography")
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    wide = regions.groupBy("ts").agg(*[F.max(F.when(F.col("geography") == n, F.col("ret"))).alias(f"f{i}")
                                       for i, n in enumerate(names)])
    return wide.dropna()


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(portfolio, symbol, value, qty): what each customer bought from each supplier."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("portfolio"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("symbol"), "l_extendedprice", "l_quantity")
    return (lines.join(orders, "o_orderkey").groupBy("portfolio", "symbol")
            .agg(F.sum("l_extendedprice").alias("value"), F.sum("l_quantity").alias("qty")))


def with_total(df: DataFrame, keys: list[str], **totals) -> DataFrame:
    """Group totals beside each row.

    The totals are aggregated with map-side combine and joined back, so a hot key never meets in one window task;
    a skewed join side is split by adaptive execution.
    """
    sums = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in totals.items()])
    return df.join(sums, keys)


def portfolio_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(portfolio, symbol, value, qty, w) with w = share of the portfolio value."""
    h = with_total(holdings(spark, sf_dir), ["portfolio"], _total=F.sum("value"))
    return h.select("portfolio", "symbol", "value", "qty", div("value", "_total").alias("w"))
