"""Indicators against a benchmark column or across all symbols of a timestamp.

The cross-sectional ones group by timestamp.  A timestamp holds at most one bar per symbol; ranks inside it come from
`ranks.count_below`, which splits a timestamp with very many symbols by value.
"""

from pyspark.sql import DataFrame, functions as F

from quantloom.functions.scalar import corr_of, div
from quantloom.operators.indicators import indicator
from quantloom.operators.ranks import count_below
from quantloom.operators.series import Series


@indicator("RelativeStrength", needs=("close", "benchmark"), benchmark_column="benchmark", period=20)
def relative_strength(s, benchmark_column, period):
    return {"relative_strength": s.pct(s.close, period) - s.pct(F.col(benchmark_column), period)}


@indicator("RelativeVolatility", needs=("close", "benchmark"), benchmark_column="benchmark", period=20)
def relative_volatility(s, benchmark_column, period):
    own, other = s.let(s.pct(s.close)), s.let(s.pct(F.col(benchmark_column)))
    return {"relative_volatility": div(s.roll(F.stddev_samp, period, own), s.roll(F.stddev_samp, period, other))}


@indicator("InformationRatio", needs=("close", "benchmark"), benchmark_column="benchmark", period=60)
def information_ratio(s, benchmark_column, period):
    active = s.let(s.pct(s.close) - s.pct(F.col(benchmark_column)))
    return {"information_ratio": div(s.roll(F.avg, period, active), s.roll(F.stddev_samp, period, active))}


def stability(s, measure, benchmark_column, period, sub_period):
    """1/(1+population deviation) of a measure over half-overlapping sub-windows of the previous `period` rows."""
    own, other = s.let(s.pct(s.close)), s.let(s.pct(F.col(benchmark_column)))
    starts = range(0, period - sub_period + 1, sub_period // 2)
    parts = [s.let(measure(s, own, other, j - period, j - period + sub_period - 1)) for j in starts]
    values = s.let(F.array_compact(F.array(*parts)))
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.nullif(n, F.lit(0))
    spread = F.sqrt(F.aggregate(F.transform(values, lambda v: F.pow(v - mean, 2)), F.lit(0.0), lambda a, v: a + v)
                    / F.nullif(n, F.lit(0)))
    return F.when((s.row > period) & (n > 1), 1 / (1 + spread))


def sub_beta(s, own, other, start, end):
    both = F.when(own.isNotNull(), other)
    variance = s.over(F.var_samp(other), start, end)
    return F.when(variance > 0, div(s.over(F.covar_samp(own, both), start, end), variance))


def sub_corr(s, own, other, start, end):
    moving = (s.over(F.var_samp(own), start, end) > 0) & (s.over(F.var_samp(other), start, end) > 0)
    return F.when(moving, corr_of(own, other, s.order.rowsBetween(start, end)))


@indicator("BetaStability", needs=("close", "benchmark"), benchmark_column="benchmark", period=60, sub_period=20)
def beta_stability(s, benchmark_column, period, sub_period):
    return {"beta_stability": stability(s, sub_beta, benchmark_column, period, sub_period)}


@indicator("CorrelationStability", needs=("close", "benchmark"), benchmark_column="benchmark", period=60,
           sub_period=20)
def correlation_stability(s, benchmark_column, period, sub_period):
    return {"correlation_stability": stability(s, sub_corr, benchmark_column, period, sub_period)}


def with_period_return(bars: DataFrame, period: int) -> DataFrame:
    s = Series(bars.select("symbol", "ts", "close"))
    return s.frame({"ret": s.pct(s.close, period)}, keep=["symbol", "ts", "close"])


def relative_strength_index(bars: DataFrame, period: int = 20) -> DataFrame:
    """Percent of the other symbols of the timestamp whose n-row return is below the own one."""
    ranked = count_below(with_period_return(bars, period).where("ret is not null"), ["ts"], "ret")
    return ranked.select("symbol", "ts", (100.0 * div(F.col("below"), F.col("total") - 1)).alias("rs_index"))


def cross_sectional_rank(bars: DataFrame, ascending: bool = True) -> DataFrame:
    """Percent of the symbols of the timestamp whose close is below (or above) the own one, itself counted."""
    ranked = count_below(bars.select("symbol", "ts", "close"), ["ts"], "close")
    beyond = F.col("below") if ascending else F.col("total") - F.col("below") - F.col("ties")
    return ranked.select("symbol", "ts", (100.0 * div(beyond, F.col("total"))).alias("cs_rank"))


def sector_momentum(bars: DataFrame, metadata: DataFrame, period: int = 20) -> DataFrame:
    """Mean n-row return of a sector over the whole sample (it looks ahead), repeated on every row."""
    r = with_period_return(bars, period).join(metadata.select("symbol", "sector"), "symbol")
    means = r.groupBy("sector").agg(F.avg("ret").alias("sector_momentum"))
    return r.join(means, "sector").select("symbol", "ts", "sector", "sector_momentum")


def sector_momentum_to_date(bars: DataFrame, metadata: DataFrame, period: int = 20) -> DataFrame:
    """Point-in-time form: mean over all sector rows up to and including the timestamp."""
    r = with_period_return(bars, period).join(metadata.select("symbol", "sector"), "symbol")
    per_day = r.groupBy("sector", "ts").agg(F.sum("ret").alias("_s"), F.count("ret").alias("_n"))
    s = Series(per_day, ["sector"])
    day = s.frame({"sector_momentum": div(s.running_sum(F.col("_s")), s.running_sum(F.col("_n")))},
                  keep=["sector", "ts"])
    return r.select("symbol", "ts", "sector").join(day, ["sector", "ts"])
