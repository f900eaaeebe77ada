"""Trend indicators.  PSAR and SuperTrend switch state from row to row and run as one grouped pass per symbol."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quantloom.functions.scalar import div, true_or_false
from quantloom.operators.indicators import indicator, require_columns
from quantloom.operators.indicators.momentum import HLC
from quantloom.operators.indicators.oscillators import aroon_lines


@indicator("ADX", needs=HLC, period=14)
def adx(s, period):
    up = s.let(s.high - s.lag(s.high))
    down = s.let(s.lag(s.low) - s.low)
    plus = s.let(F.when(true_or_false((up > down) & (up > 0)), up).otherwise(0.0))
    minus = s.let(F.when(true_or_false((down > up) & (down > 0)), down).otherwise(0.0))
    alpha = 1.0 / period
    tr = s.ewm(s.true_range(), alpha=alpha)
    plus_di = s.let(100 * div(s.ewm(plus, alpha=alpha), tr))
    minus_di = s.let(100 * div(s.ewm(minus, alpha=alpha), tr))
    dx = 100 * div(F.abs(plus_di - minus_di), plus_di + minus_di)
    return {"adx": s.ewm(dx, alpha=alpha), "plus_di": plus_di, "minus_di": minus_di}


@indicator("Aroon", needs=("high", "low"), period=25)
def aroon(s, period):
    up, down = aroon_lines(s, period)
    return {"aroon_up": up, "aroon_down": down, "oscillator": up - down}


@indicator("Ichimoku", needs=HLC, tenkan_period=9, kijun_period=26, senkou_b_period=52, displacement=26)
def ichimoku(s, tenkan_period, kijun_period, senkou_b_period, displacement):
    """The lagging span is the close `displacement` rows ahead: it reads the future and must not feed a signal."""
    def middle(n):
        return s.let((s.roll(F.max, n, "high") + s.roll(F.min, n, "low")) / 2)
    tenkan, kijun, wide = middle(tenkan_period), middle(kijun_period), middle(senkou_b_period)
    return {"tenkan_sen": tenkan, "kijun_sen": kijun,
            "senkou_span_a": s.lag((tenkan + kijun) / 2, displacement), "senkou_span_b": s.lag(wide, displacement),
            "chikou_span": s.lead(s.close, displacement)}


@indicator("VortexIndicator", needs=HLC, period=14)
def vortex(s, period):
    tr = s.let(s.roll(F.sum, period, s.true_range()))
    plus = div(s.roll(F.sum, period, s.let(F.abs(s.high - s.lag(s.low)))), tr)
    minus = div(s.roll(F.sum, period, s.let(F.abs(s.low - s.lag(s.high)))), tr)
    return {"vi_plus": plus, "vi_minus": minus, "vi_diff": plus - minus}


@indicator("MassIndex", needs=("high", "low"), period=25, ema_period=9)
def mass_index(s, period, ema_period):
    once = s.ewm(s.high - s.low, ema_period)
    return {"mass_index": s.roll(F.sum, period, s.let(div(once, s.ewm(once, ema_period))))}


@indicator("TrendIntensity", period=30)
def trend_intensity(s, period):
    above = s.let(F.when(true_or_false(s.close > s.roll(F.avg, period, s.close)), 1.0).otherwise(0.0))
    return {"trend_intensity": s.roll(F.sum, period, above) / period * 100}


# ---- row-to-row state machines ------------------------------------------------------------------------------

FRAME_INDICATORS = {}


def frame_indicator(name, needs, outputs, **params):
    """Register a function of numpy arrays (one symbol, in time order) that returns one array per output."""
    def add(f):
        FRAME_INDICATORS[name] = (f, tuple(needs), tuple(outputs), params)
        return f
    return add


def compute_frame(df: DataFrame, name: str, key="symbol", ts="ts", **params) -> DataFrame:
    """Run a state machine over each symbol.

    One symbol is one group: bars hold at most one row per time bucket, which bounds the group by the calendar.
    """
    f, needs, outputs, defaults = FRAME_INDICATORS[name]
    require_columns(df, [key, ts, *needs])
    settings = {**defaults, **params}
    narrow = df.select(key, ts, *needs)
    types = {c: t for c, t in narrow.dtypes}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        arrays = f(*[pdf[c].to_numpy(dtype=float) for c in needs], **settings)
        out = pdf[[key, ts]].copy()
        for column, values in zip(outputs, arrays):
            out[column] = values
        return out

    schema = ", ".join([f"{key} {types[key]}", f"{ts} {types[ts]}", *[f"{o} double" for o in outputs]])
    out = narrow.groupBy(key).applyInPandas(run, schema)
    return out.select(key, ts, *[F.nanvl(o, F.lit(None).cast("double")).alias(o) for o in outputs])


@frame_indicator("PSAR", needs=HLC, outputs=("psar", "direction"), af_start=0.02, af_increment=0.02, af_maximum=0.2)
def parabolic_stop(high, low, close, af_start, af_increment, af_maximum):
    """Stop-and-reverse line.  `side` is +1 below the price, -1 above it; mirrored prices serve the short side."""
    n = len(high)
    line, direction = np.empty(n), np.empty(n)
    side, stop, speed, extreme = 1, low[0], af_start, high[0]
    line[0], direction[0] = stop, side
    for t in range(1, n):
        ahead, behind = (high, low) if side > 0 else (low, high)     # favourable and adverse extremes of a bar
        stop += speed * (extreme - stop)
        if side * (behind[t] - stop) <= 0:                           # touched: turn around at the old extreme
            stop, speed, extreme, side = extreme, af_start, behind[t], -side
        else:
            if side * (ahead[t] - extreme) > 0:
                extreme, speed = ahead[t], min(speed + af_increment, af_maximum)
            recent = behind[max(t - 2, 0):t]
            stop = min(stop, recent.min()) if side > 0 else max(stop, recent.max())
        line[t], direction[t] = stop, side
    return line, direction


@frame_indicator("SuperTrend", needs=HLC, outputs=("supertrend", "direction", "upper", "lower"), period=10,
                 multiplier=3.0)
def supertrend(high, low, close, period, multiplier):
    """Ratcheting bands around the bar middle; state starts at the first row that has an average true range."""
    n = len(close)
    line, direction, upper, lower = (np.full(n, np.nan) for _ in range(4))
    if n <= period:
        return line, direction, upper, lower
    before = np.concatenate([[np.nan], close[:-1]])
    tr = np.maximum(high - low, np.maximum(abs(high - before), abs(low - before)))
    atr = pd.Series(tr).rolling(period).mean().to_numpy()
    middle = (high + low) / 2
    raw_up, raw_down = middle + multiplier * atr, middle - multiplier * atr
    first = period                                                   # row 0 has no true range
    upper[first], lower[first], on_upper = raw_up[first], raw_down[first], True
    line[first], direction[first] = upper[first], 1
    for t in range(first + 1, n):
        free_up = raw_up[t] < upper[t - 1] or close[t - 1] > upper[t - 1]
        free_down = raw_down[t] > lower[t - 1] or close[t - 1] < lower[t - 1]
        upper[t] = raw_up[t] if free_up else upper[t - 1]
        lower[t] = raw_down[t] if free_down else lower[t - 1]
        on_upper = close[t] <= upper[t] if on_upper else close[t] < lower[t]
        line[t], direction[t] = (upper[t], -1) if on_upper else (lower[t], 1)
    return line, direction, upper, lower
