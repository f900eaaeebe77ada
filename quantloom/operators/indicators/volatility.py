"""Volatility indicators."""

import math

from pyspark.sql import functions as F

from quantloom.functions.scalar import TRADING_DAYS, div, log_ratio
from quantloom.operators.indicators import indicator
from quantloom.operators.indicators.momentum import HLC, HLCV

OHLC = ("open", "high", "low", "close")


@indicator("BollingerBands", period=20, std_dev=2)
def bollinger_bands(s, period, std_dev):
    mean, sd = s.let(s.roll(F.avg, period, s.close)), s.let(s.roll(F.stddev_samp, period, s.close))
    upper, lower = mean + std_dev * sd, mean - std_dev * sd
    return {"upper": upper, "middle": mean, "lower": lower, "width": div(upper - lower, mean),
            "position": div(s.close - lower, upper - lower)}


@indicator("ATR", needs=HLC, period=14)
def atr(s, period):
    return {"atr": s.roll(F.avg, period, s.true_range())}


@indicator("Keltner", needs=HLC, period=20, multiplier=2)
def keltner(s, period, multiplier):
    middle, width = s.ewm((s.high + s.low + s.close) / 3, period), multiplier * s.ewm(s.true_range(), period)
    return {"upper": middle + width, "middle": middle, "lower": middle - width}


@indicator("DonchianChannel", needs=("high", "low"), period=20)
def donchian_channel(s, period):
    upper, lower = s.let(s.roll(F.max, period, "high")), s.let(s.roll(F.min, period, "low"))
    return {"upper": upper, "middle": (upper + lower) / 2, "lower": lower}


@indicator("VWAP", needs=HLCV, period=None)
def vwap(s, period):
    value = s.let((s.high + s.low + s.close) / 3 * s.volume)
    if period is None:
        return {"vwap": div(s.running_sum(value), s.running_sum(s.volume))}
    return {"vwap": div(s.roll(F.sum, period, value), s.roll(F.sum, period, s.volume))}


@indicator("StandardDeviation", period=20)
def standard_deviation(s, period):
    return {"sd": s.roll(F.stddev_samp, period, s.close)}


@indicator("HistoricalVolatility", period=30, trading_days=TRADING_DAYS)
def historical_volatility(s, period, trading_days):
    step = s.let(F.ln(div(s.close, s.lag(s.close))))
    return {"historical_volatility": s.roll(F.stddev_samp, period, step) * math.sqrt(trading_days)}


def range_volatility(s, term, period, trading_days):
    return F.sqrt(s.roll(F.avg, period, s.let(term)) * trading_days)


def open_close_term(s):
    """Infinite where the lowest price is zero: the range of the logarithms has no bound then."""
    return log_ratio(s.high, s.close) * log_ratio(s.high, s.open) + log_ratio(s.low, s.close) * log_ratio(s.low, s.open)


@indicator("GarmanKlass", needs=OHLC, period=30, trading_days=TRADING_DAYS)
def garman_klass(s, period, trading_days):
    """Same estimator as RogersSatchell, kept under this name; `GarmanKlassTextbook` is the published one."""
    return {"garman_klass": range_volatility(s, open_close_term(s), period, trading_days)}


@indicator("GarmanKlassTextbook", needs=OHLC, period=30, trading_days=TRADING_DAYS)
def garman_klass_textbook(s, period, trading_days):
    term = 0.5 * F.pow(log_ratio(s.high, s.low), 2) - (2 * math.log(2) - 1) * F.pow(log_ratio(s.close, s.open), 2)
    mean = s.roll(F.avg, period, s.let(term))
    return {"garman_klass_textbook": F.sqrt(F.greatest(mean, F.when(mean.isNotNull(), 0.0)) * trading_days)}


@indicator("Parkinson", needs=("high", "low"), period=30, trading_days=TRADING_DAYS)
def parkinson(s, period, trading_days):
    term = F.pow(F.ln(div(s.high, s.low)), 2) / (4 * math.log(2))
    return {"parkinson": range_volatility(s, term, period, trading_days)}


@indicator("RogersSatchell", needs=OHLC, period=30, trading_days=TRADING_DAYS)
def rogers_satchell(s, period, trading_days):
    return {"rogers_satchell": range_volatility(s, open_close_term(s), period, trading_days)}
