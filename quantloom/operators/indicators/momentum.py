"""Momentum indicators."""

from pyspark.sql import functions as F

from quantloom.functions.scalar import div, strict_greatest, strict_least
from quantloom.operators.indicators import indicator

HLC = ("high", "low", "close")
HLCV = ("high", "low", "close", "volume")


def strength_index(gain, loss):
    """100 - 100/(1+gain/loss); 100 when there was no loss, null when there was neither."""
    return F.when((loss == 0) & (gain > 0), 100.0).otherwise(100 - div(F.lit(100.0), 1 + div(gain, loss)))


def rsi_of(s, period):
    """Simple-average RSI.  The first row has no change and counts as no gain and no loss."""
    d = s.let(s.diff(s.close))
    gain = s.let(s.roll(F.avg, period, s.let(F.when(d > 0, d).otherwise(F.lit(0.0)))))
    loss = s.let(s.roll(F.avg, period, s.let(F.when(d < 0, -d).otherwise(F.lit(0.0)))))
    return s.let(strength_index(gain, loss))


@indicator("RSI", period=14)
def rsi(s, period):
    return {"rsi": rsi_of(s, period)}


def macd_lines(s, fast, slow, signal):
    line = s.let(s.ewm(s.close, fast) - s.ewm(s.close, slow))
    sig = s.ewm(line, signal)
    return line, sig, line - sig


@indicator("MACD", fast_period=12, slow_period=26, signal_period=9)
def macd(s, fast_period, slow_period, signal_period):
    line, sig, hist = macd_lines(s, fast_period, slow_period, signal_period)
    return {"macd": line, "signal": sig, "histogram": hist}


@indicator("Stochastic", needs=HLC, k_period=14, d_period=3)
def stochastic(s, k_period, d_period):
    low, high = s.roll(F.min, k_period, "low"), s.roll(F.max, k_period, "high")
    k = s.let(100 * div(s.close - low, high - low))
    return {"k": k, "d": s.roll(F.avg, d_period, k)}


@indicator("Williams_R", needs=HLC, period=14)
def williams_r(s, period):
    low, high = s.roll(F.min, period, "low"), s.roll(F.max, period, "high")
    return {"williams_r": -100 * div(high - s.close, high - low)}


def rate_of_change(s, n):
    return 100 * s.pct(s.close, n)


@indicator("ROC", period=12)
def roc(s, period):
    return {"roc": rate_of_change(s, period)}


@indicator("MFI", needs=HLCV, period=14)
def mfi(s, period):
    tp = s.let((s.high + s.low + s.close) / 3)
    flow, before = tp * s.volume, s.let(s.lag(tp))
    up = s.let(F.when(tp > before, flow).otherwise(0.0))
    down = s.let(F.when(tp < before, flow).otherwise(0.0))
    return {"mfi": strength_index(s.let(s.roll(F.sum, period, up)), s.let(s.roll(F.sum, period, down)))}


@indicator("TSI", first_smooth=25, second_smooth=13)
def tsi(s, first_smooth, second_smooth):
    d = s.let(s.diff(s.close))
    top = s.ewm(s.ewm(d, first_smooth), second_smooth)
    bottom = s.ewm(s.ewm(F.abs(d), first_smooth), second_smooth)
    return {"tsi": 100 * div(top, bottom)}


@indicator("UO", needs=HLC, period1=7, period2=14, period3=28)
def ultimate_oscillator(s, period1, period2, period3):
    before = s.let(s.lag(s.close))
    floor = strict_least(s.low, before)
    pressure = s.let(s.close - floor)
    span = s.let(strict_greatest(s.high, before) - floor)
    part = [div(s.roll(F.sum, n, pressure), s.roll(F.sum, n, span)) for n in (period1, period2, period3)]
    return {"uo": 100 * (4 * part[0] + 2 * part[1] + part[2]) / 7}


@indicator("CCI", needs=HLC, period=20)
def cci(s, period):
    tp = s.let((s.high + s.low + s.close) / 3)
    values = s.let(s.window_array(period, tp))
    mean = s.let(s.roll(F.avg, period, tp))
    # deviation of each value of the window from the mean of that window
    mad = s.let(F.aggregate(F.transform(values, lambda v: F.abs(v - mean)), F.lit(0.0), lambda a, v: a + v) / period)
    return {"cci": div(tp - mean, 0.015 * mad)}


@indicator("DPO", period=20)
def dpo(s, period):
    return {"dpo": s.close - s.lag(s.let(s.roll(F.avg, period, s.close)), period // 2 + 1)}


@indicator("CMO", period=14)
def cmo(s, period):
    d = s.let(s.diff(s.close))
    up = s.let(s.roll(F.sum, period, s.let(F.when(d > 0, d).otherwise(0.0))))
    down = s.let(s.roll(F.sum, period, s.let(F.when(d < 0, -d).otherwise(0.0))))
    return {"cmo": 100 * div(up - down, up + down)}


@indicator("TRIX", period=14)
def trix(s, period):
    e = s.ewm(s.ewm(s.ewm(s.close, period), period), period)
    return {"trix": s.pct(e) * 10000}


@indicator("KST", roc1_period=10, roc2_period=15, roc3_period=20, roc4_period=30, sma1_period=10, sma2_period=10,
           sma3_period=10, sma4_period=15)
def kst(s, **p):
    terms = []
    for i in (1, 2, 3, 4):
        change = s.let(rate_of_change(s, p[f"roc{i}_period"]))
        terms.append(i * s.roll(F.avg, p[f"sma{i}_period"], change))
    return {"kst": terms[0] + terms[1] + terms[2] + terms[3]}
