"""Volume indicators."""

from pyspark.sql import functions as F

from quantloom.functions.scalar import div
from quantloom.operators.indicators import indicator
from quantloom.operators.indicators.momentum import HLCV, strength_index
from quantloom.operators.indicators.oscillators import chaikin_line, money_flow_volume

CV = ("close", "volume")


@indicator("OBV", needs=CV)
def on_balance_volume(s):
    d = s.let(s.diff(s.close))
    return {"obv": s.running_sum(s.let(F.coalesce(F.signum(d) * s.volume, F.lit(0.0))))}


@indicator("AD", needs=HLCV)
def accumulation_distribution(s):
    return {"ad": s.running_sum(s.let(money_flow_volume(s)))}


@indicator("ADOSC", needs=HLCV, fast_period=3, slow_period=10)
def accumulation_oscillator(s, fast_period, slow_period):
    return {"adosc": chaikin_line(s, fast_period, slow_period)}


@indicator("PVT", needs=CV)
def price_volume_trend(s):
    return {"pvt": s.running_sum(s.let(s.pct(s.close) * s.volume))}


def volume_gated_index(s, moved, initial_value):
    step = s.let(F.when(moved, div(s.close, s.lag(s.close))).otherwise(F.lit(1.0)))
    return initial_value * s.running_product(step)


@indicator("NVI", needs=CV, initial_value=1000)
def negative_volume_index(s, initial_value):
    return {"nvi": volume_gated_index(s, s.volume < s.lag(s.volume), initial_value)}


@indicator("PVI", needs=CV, initial_value=1000)
def positive_volume_index(s, initial_value):
    return {"pvi": volume_gated_index(s, s.volume > s.lag(s.volume), initial_value)}


@indicator("EMV", needs=("high", "low", "volume"), period=14, scale=10000)
def ease_of_movement(s, period, scale):
    """A bar without range or volume counts as zero."""
    middle = (s.high + s.low) / 2
    box = div(s.volume, scale * (s.high - s.low))
    raw = s.let(F.coalesce(div(middle - s.lag(middle), box), F.lit(0.0)))
    return {"emv": s.roll(F.avg, period, raw)}


@indicator("FI", needs=CV, period=13)
def force_index(s, period):
    raw = s.let(s.diff(s.close) * s.volume)
    return {"fi": raw if period == 1 else s.ewm(raw, period)}


@indicator("VWMACD", needs=CV, fast_period=12, slow_period=26, signal_period=9)
def volume_weighted_macd(s, fast_period, slow_period, signal_period):
    def mean(n):
        return div(s.ewm(s.close * s.volume, n), s.ewm(s.volume, n))
    line = s.let(mean(fast_period) - mean(slow_period))
    sig = s.ewm(line, signal_period)
    return {"vwmacd": line, "signal": sig, "histogram": line - sig}


@indicator("VolumePriceConfirmation", needs=CV, period=20)
def volume_price_confirmation(s, period):
    return {"vpc": s.roll_corr(period, s.let(s.pct(s.close)), s.let(s.pct(s.volume)))}


@indicator("VolumeWeightedRSI", needs=CV, period=14)
def volume_weighted_rsi(s, period):
    d = s.let(s.diff(s.close))
    total = s.let(s.roll(F.sum, period, s.volume))
    gain = s.let(div(s.roll(F.sum, period, s.let(F.when(d > 0, d * s.volume).otherwise(0.0))), total))
    loss = s.let(div(s.roll(F.sum, period, s.let(F.when(d < 0, -d * s.volume).otherwise(0.0))), total))
    return {"vw_rsi": strength_index(gain, loss)}
