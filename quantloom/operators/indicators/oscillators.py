"""Oscillators."""

from pyspark.sql import functions as F

from quantloom.functions.scalar import div
from quantloom.operators.indicators import indicator
from quantloom.operators.indicators.momentum import HLC, HLCV, macd_lines, rsi_of


@indicator("StochasticRSI", rsi_period=14, stoch_period=14, k_period=3, d_period=3)
def stochastic_rsi(s, rsi_period, stoch_period, k_period, d_period):
    r = rsi_of(s, rsi_period)
    low, high = s.roll(F.min, stoch_period, r), s.roll(F.max, stoch_period, r)
    raw = s.let(100 * div(r - low, high - low))
    k = s.let(s.roll(F.avg, k_period, raw))
    return {"stoch_rsi": raw, "k": k, "d": s.roll(F.avg, d_period, k)}


@indicator("MACD_Histogram", fast_period=12, slow_period=26, signal_period=9)
def macd_histogram(s, fast_period, slow_period, signal_period):
    return {"macd_histogram": macd_lines(s, fast_period, slow_period, signal_period)[2]}


@indicator("PPO", fast_period=12, slow_period=26, signal_period=9)
def ppo(s, fast_period, slow_period, signal_period):
    slow = s.ewm(s.close, slow_period)
    line = s.let(100 * div(s.ewm(s.close, fast_period) - slow, slow))
    sig = s.ewm(line, signal_period)
    return {"ppo": line, "signal": sig, "histogram": line - sig}


@indicator("PriceOscillator", fast_period=10, slow_period=20, ma_type="SMA")
def price_oscillator(s, fast_period, slow_period, ma_type):
    mean = s.ewm if ma_type.upper() == "EMA" else (lambda x, n: s.roll(F.avg, n, x))
    return {"price_oscillator": mean(s.close, fast_period) - mean(s.close, slow_period)}


@indicator("VolumeOscillator", needs=("volume",), fast_period=5, slow_period=10)
def volume_oscillator(s, fast_period, slow_period):
    slow = s.roll(F.avg, slow_period, s.volume)
    return {"volume_oscillator": 100 * div(s.roll(F.avg, fast_period, s.volume) - slow, slow)}


@indicator("DerivativeOscillator", rsi_period=14, ema1_period=5, ema2_period=3, sma_period=9)
def derivative_oscillator(s, rsi_period, ema1_period, ema2_period, sma_period):
    smooth = s.ewm(s.ewm(rsi_of(s, rsi_period), ema1_period), ema2_period)
    return {"derivative_oscillator": smooth - s.roll(F.avg, sma_period, smooth)}


@indicator("RVGI", needs=("open", *HLC), period=10)
def rvgi(s, period):
    def four_tap(x):
        x = s.let(x)
        return s.let((x + 2 * s.lag(x) + 2 * s.lag(x, 2) + s.lag(x, 3)) / 6)
    vigor = s.let(div(s.roll(F.sum, period, four_tap(s.close - s.open)), s.roll(F.sum, period, four_tap(s.high - s.low))))
    return {"rvgi": vigor, "signal": four_tap(vigor)}


@indicator("KeltnerOscillator", needs=HLC, period=20, multiplier=2)
def keltner_oscillator(s, period, multiplier):
    middle = s.ewm((s.high + s.low + s.close) / 3, period)
    width = 2 * multiplier * s.ewm(s.true_range(), period)
    return {"keltner_oscillator": 100 * div(s.close - middle, width)}


def money_flow_volume(s):
    """Close location value times volume; a bar without range counts as zero."""
    return F.coalesce(div((s.close - s.low) - (s.high - s.close), s.high - s.low), F.lit(0.0)) * s.volume


def chaikin_line(s, fast, slow):
    ad = s.let(s.running_sum(s.let(money_flow_volume(s))))
    return s.ewm(ad, fast) - s.ewm(ad, slow)


@indicator("ChaikinOscillator", needs=HLCV, fast_period=3, slow_period=10)
def chaikin_oscillator(s, fast_period, slow_period):
    return {"chaikin_oscillator": chaikin_line(s, fast_period, slow_period)}


def aroon_lines(s, period):
    """Rows since the first extreme of the window, as a share of the period; starts one row after the window fills."""
    w, row = s.last_rows(period), s.row
    up = row + F.max(F.struct(s.high, -row)).over(w)["col2"]
    down = row + F.max(F.struct(-s.low, -row)).over(w)["col2"]
    ready = row > period
    scale = 100.0 / period
    return (s.let(F.when(ready, (period - up) / period * 100)), s.let(F.when(ready, (period - down) / period * 100)))


@indicator("AroonOscillator", needs=("high", "low"), period=25)
def aroon_oscillator(s, period):
    up, down = aroon_lines(s, period)
    return {"aroon_oscillator": up - down}


@indicator("PolarizedFractalEfficiency", period=10)
def polarized_fractal_efficiency(s, period):
    net = s.close - s.lag(s.close, period - 1)
    path = s.roll(F.sum, period - 1, s.let(F.abs(s.diff(s.close))))
    ratio = F.coalesce(div(F.abs(net), path), F.lit(0.0)) * 100
    return {"pfe": F.when(s.row >= period, F.when(net > 0, ratio).otherwise(-ratio))}
