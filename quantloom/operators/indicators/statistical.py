"""Moving averages and rolling statistics."""

import math

from pyspark.sql import functions as F

from quantloom.functions.scalar import div
from quantloom.operators.indicators import indicator


@indicator("SMA", period=20)
def sma(s, period):
    return {"sma": s.roll(F.avg, period, s.close)}


@indicator("EMA", period=20)
def ema(s, period):
    return {"ema": s.ewm(s.close, period)}


@indicator("WMA", period=20)
def wma(s, period):
    # sum of k*x over the window from two plain rolling sums of x and row*x
    weighted = s.roll(F.sum, period, s.let(s.row * s.close))
    plain = s.roll(F.sum, period, s.close)
    return {"wma": (weighted - (s.row - period) * plain) / (period * (period + 1) / 2)}


def ewm_chain(s, span, depth):
    out = [s.ewm(s.close, span)]
    while len(out) < depth:
        out.append(s.ewm(out[-1], span))
    return out


@indicator("TEMA", period=20)
def tema(s, period):
    e = ewm_chain(s, period, 3)
    return {"tema": 3 * e[0] - 3 * e[1] + e[2]}


@indicator("DEMA", period=20)
def dema(s, period):
    e = ewm_chain(s, period, 2)
    return {"dema": 2 * e[0] - e[1]}


@indicator("T3", period=20, volume_factor=0.7)
def t3(s, period, volume_factor):
    v, e = volume_factor, ewm_chain(s, period, 6)
    return {"t3": -v**3 * e[5] + (3 * v**2 + 3 * v**3) * e[4] + (-6 * v**2 - 3 * v - 3 * v**3) * e[3]
                  + (1 + 3 * v + v**3 + 3 * v**2) * e[2]}


@indicator("KAMA", period=10, fast_sc=2, slow_sc=30)
def kama(s, period, fast_sc, slow_sc):
    """Adaptive average k = k' + g (x - k'), with a gain g in [slow^2, fast^2] that depends on the data.

    Unrolled: k is a weighted sum of earlier closes, each weighted with its gain times the product of later (1 - g).
    The product is carried as a sum of logarithms, cut into segments so that it stays in double range.
    """
    fast, slow = 2.0 / (fast_sc + 1), 2.0 / (slow_sc + 1)
    move = F.abs(s.close - s.lag(s.close, period))
    path = s.roll(F.sum, period, s.let(F.abs(s.diff(s.close))))
    er = div(move, path)
    gain = s.let(F.when(s.row > period, F.pow(er * (fast - slow) + slow, 2)))
    return {"kama": s.let(gated_mean(s, s.close, gain, period))}


def gated_mean(s, x, gain, first_row):
    """k(first_row) = x, then k = (1 - gain) k + gain x, for gains below one.

    A row whose gain is null makes the rest of the series null, as a missing value would in the recurrence.
    """
    from pyspark.sql import Window
    from quantloom.operators.series import ROW
    keep = s.let(F.when(s.row == first_row, F.lit(0.0)).when(s.row > first_row, F.log1p(-gain)))
    total = s.let(s.running_sum(keep))                  # log of the product of (1 - gain) so far
    part = s.let(F.floor(-total / 300))                 # segments of at most e^300
    base = s.let(total + part * 300)                    # in (-300, 0]
    push = s.let(F.when(s.row == first_row, x).when(s.row > first_row, gain * x))
    inside = Window.partitionBy(*s.part, part).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*s.part).orderBy(part).rangeBetween(-1, -1)
    near = s.let(F.sum(push * F.exp(-base)).over(inside))
    far = s.let(F.sum(push * F.exp(-base - 300)).over(before))
    broken = s.let(s.running_sum(F.when((s.row > first_row) & gain.isNull(), 1).otherwise(0)))
    value = (near + F.coalesce(far, F.lit(0.0))) * F.exp(base)
    return F.when((s.row >= first_row) & (broken == 0), value)


@indicator("LinearRegression", period=20)
def linear_regression(s, period):
    """Least squares on the row number; line value at the last row of the window, and slope."""
    slope = s.let(s.roll(F.regr_slope, period, s.close, F.col("_row").cast("double")))
    mean = s.roll(F.avg, period, s.close)
    return {"line": mean + slope * ((period - 1) / 2), "slope": slope}


@indicator("Correlation", needs=("close", "volume"), period=20, reference_column="volume")
def correlation(s, period, reference_column):
    return {"correlation": s.roll_corr(period, s.close, reference_column)}


@indicator("Covariance", needs=("close", "volume"), period=20, reference_column="volume")
def covariance(s, period, reference_column):
    return {"covariance": s.roll(F.covar_samp, period, s.close, reference_column)}


@indicator("Beta", needs=("close", "market_return"), period=60, market_column="market_return")
def beta(s, period, market_column):
    r = s.let(s.pct(s.close))
    m = F.col(market_column)
    return {"beta": div(s.roll(F.covar_samp, period, r, m), s.roll(F.var_samp, period, m))}


@indicator("RSquared", needs=("close", "market_return"), period=60, market_column="market_return")
def r_squared(s, period, market_column):
    return {"r_squared": F.pow(s.roll_corr(period, s.let(s.pct(s.close)), F.col(market_column)), 2)}


@indicator("ZScore", period=20)
def z_score(s, period):
    return {"zscore": div(s.close - s.roll(F.avg, period, s.close), s.roll(F.stddev_samp, period, s.close))}


@indicator("PercentRank", period=20)
def percent_rank(s, period):
    """Mean of the strict and the weak rank of the current value among the n-1 values before it."""
    past = s.let(F.when(s.row >= period, F.collect_list(s.close).over(s.order.rowsBetween(-(period - 1), -1))))
    below, upto = F.size(F.filter(past, lambda v: v < s.close)), F.size(F.filter(past, lambda v: v <= s.close))
    tie = F.when(upto > below, 1).otherwise(0)
    return {"percent_rank": F.when(past.isNotNull(), (below + upto + tie) / 2 / (period - 1))}


def unbiased_skew(x, w, n):
    return F.skewness(x).over(w) * (math.sqrt(n * (n - 1)) / (n - 2))


def unbiased_kurt(x, w, n):
    return (F.kurtosis(x).over(w) * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


@indicator("Skewness", period=20)
def skewness(s, period):
    r, w = s.let(s.pct(s.close)), s.last_rows(period)
    return {"skewness": F.when(F.count(r).over(w) == period, unbiased_skew(r, w, period))}


@indicator("Kurtosis", period=20)
def kurtosis(s, period):
    r, w = s.let(s.pct(s.close)), s.last_rows(period)
    return {"kurtosis": F.when(F.count(r).over(w) == period, unbiased_kurt(r, w, period))}


@indicator("Entropy", period=20, bins=10)
def entropy(s, period, bins):
    """Shannon entropy in bits of an equal-width histogram of the returns in the window."""
    r = s.let(s.pct(s.close))
    values = s.let(s.window_array(period, r))
    low, high = s.let(F.array_min(values)), s.let(F.array_max(values))
    bin_of = lambda v: F.least(F.floor(div(v - low, high - low) * bins), F.lit(bins - 1))
    slots = s.let(F.transform(values, bin_of))
    counts = s.let(F.transform(F.array_distinct(slots), lambda b: F.size(F.filter(slots, lambda x: x == b)) / period))
    bits = F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return {"entropy": F.when(high == low, F.lit(0.0)).otherwise(bits)}


@indicator("HurstExponent", period=100)
def hurst_exponent(s, period):
    """log(R/S)/log(n): range of the cumulated deviations of the prices over their population deviation."""
    values = s.let(s.window_array(period, s.close))
    mean = s.let(s.roll(F.avg, period, s.close))
    sd = s.let(s.roll(F.stddev_pop, period, s.close))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("hi"), F.lit(float("inf")).alias("lo"))

    def step(acc, v):
        total = acc["sum"] + v - mean
        return F.struct(total.alias("sum"), F.greatest(acc["hi"], total).alias("hi"),
                        F.least(acc["lo"], total).alias("lo"))
    swing = s.let(F.aggregate(values, start, step, lambda acc: acc["hi"] - acc["lo"]))
    return {"hurst": F.ln(div(swing, sd)) / math.log(period)}
