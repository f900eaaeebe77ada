"""A feature request as one lazy plan, and the checks around it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quantloom.functions.scalar import corr_of, div
from quantloom.functions.stats import unbiased_kurtosis, unbiased_skewness
from quantloom.operators.indicators import REGISTRY, require_columns
from quantloom.operators.indicators.momentum import strength_index
from quantloom.operators.rolling import rolling_columns, with_moments
from quantloom.operators.series import Series

CUSTOM: dict = {}


def custom_feature(name: str):
    """Register `f(series, **params) -> Column` to run after the indicators."""
    def add(f):
        CUSTOM[name] = f
        return f
    return add


def params_suffix(params: dict) -> str:
    return "_".join(f"{k}{params[k]}" for k in sorted(params)) if params else "default"


def compute_features(df: DataFrame, request: dict, keys=("symbol",), ts="ts") -> DataFrame:
    """Run a request {rolling: {...}, indicators: {name: params}, custom: {name: params}}.

    All parts share one `Series`, so the whole request is one exchange by key.
    """
    needs = {c for name in request.get("indicators", {}) for c in REGISTRY[name].needs}
    require_columns(df, [*keys, ts, *needs])
    s = Series(df, keys, ts)
    out = {}
    if "rolling" in request:
        out |= rolling_columns(s, **request["rolling"])
    for name, params in request.get("indicators", {}).items():
        for output, column in REGISTRY[name].columns(s, **params).items():
            out[f"{name}_{output}_{params_suffix(params)}"] = column
    for name, params in request.get("custom", {}).items():
        out[f"custom_{name}"] = CUSTOM[name](s, **params)
    return s.frame(out)


def decay_weights(period: int, decay_factor: float) -> list[float]:
    weights = [decay_factor ** i for i in range(period)]
    return [w / sum(weights) for w in weights]


@custom_feature("CustomMomentum")
def decayed_momentum(s, period=20, decay_factor=0.9):
    """Weighted mean of the last returns; the oldest row of the window weighs most."""
    r = s.let(s.pct(s.close))
    values = s.let(s.window_array(period, r))
    pairs = F.zip_with(values, F.array(*[F.lit(w) for w in decay_weights(period, decay_factor)]), lambda a, b: a * b)
    return F.when(values.isNotNull(), F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v))


def dual_volatility(short: Column, long: Column, threshold=0.02):
    return {"short_vol": short, "long_vol": long, "vol_ratio": div(short, long),
            "vol_regime": F.when(short > threshold, 1.0).otherwise(0.0)}


def composite_signal(close: Column, mean: Column, sd: Column, macd: Column, rsi: Column):
    place = div(close - (mean - 2 * sd), 4 * sd)
    return {"composite": ((rsi - 50) / 50 + F.tanh(div(macd, sd)) + (place - 0.5) * 2) / 3}


def plugin_indicators(df: DataFrame, period=20, short=10, long=30, rsi_period=14, decay_factor=0.9) -> DataFrame:
    """Custom momentum, two volatilities, microstructure and a composite signal.  Changes and exponential means are windows; a task takes the rolling moments of all of them at once."""
    s = Series(df)
    d, move = s.let(s.diff(s.close)), s.close - s.open
    base = {"_close": s.close, "_volume": s.volume, "_change": s.pct(s.close), "_impact": div(F.abs(move), s.volume), "_span": div(s.high - s.low, s.close),
            "_moved": move * s.volume, "_value": (s.high + s.low + s.close) / 3 * s.volume, "_macd": s.ewm(s.close, 12) - s.ewm(s.close, 26),
            "_gain": F.when(d > 0, d).otherwise(F.lit(0.0)), "_loss": F.when(d < 0, -d).otherwise(F.lit(0.0))}
    wanted = [("_change", period, "decayed"), ("_change", short, "std"), ("_change", long, "std"), ("_close", period, "mean"), ("_close", period, "std"),
              ("_value", period, "sum"), ("_volume", period, "sum"), *[(c, period, "mean") for c in ("_impact", "_span", "_moved")], *[(c, rsi_period, "mean") for c in ("_gain", "_loss")]]
    m = with_moments(s, {k: c.cast("double") for k, c in base.items()}, wanted, {"decayed": np.array(decay_weights(period, decay_factor))}, ["symbol", "ts"])
    of = lambda c, n, op: F.col(f"_{c}_rolling_{n}_{op}")
    close, fair = F.col("_close"), div(of("value", period, "sum"), of("volume", period, "sum"))
    out = {"custom_momentum": of("change", period, "decayed"), **dual_volatility(of("change", short, "std"), of("change", long, "std")),
           "price_impact": of("impact", period, "mean"), "intraday_range": of("span", period, "mean"), "vw_price_change": of("moved", period, "mean"),
           "market_efficiency": 1 - div(F.abs(close - fair), close),
           **composite_signal(close, of("close", period, "mean"), of("close", period, "std"), F.col("_macd"), strength_index(of("gain", rsi_period, "mean"), of("loss", rsi_period, "mean")))}
    return m.select("symbol", "ts", *[c.alias(k) for k, c in out.items()])


# ---- checks of a feature frame --------------------------------------------------------------------------------------

def validate_features(df: DataFrame, features: list[str], threshold: float = 0.95) -> DataFrame:
    """(check, column, other, value): nulls, infinities, constant columns, highly correlated pairs, from one pass.

    Everything is an algebraic aggregate, so the single result row is combined map-side.
    """
    n = F.count(F.lit(1))
    aggs = [n.alias("_n")]
    for c in features:
        x = F.col(c)
        aggs += [F.count_if(x.isNull() | F.isnan(x)).alias(f"null|{c}|"),
                 F.count_if(F.abs(x) == float("inf")).alias(f"infinite|{c}|"),
                 F.min(x).eqNullSafe(F.max(x)).cast("long").alias(
                     f"constant|{c}|")]
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    aggs += [corr_of(a, b).alias(f"correlated|{a}|{b}") for a, b in pairs]
    row = df.agg(*aggs)
    names = [c for c in row.columns if "|" in c]
    long = row.select(F.explode(F.array(*[
        F.struct(*[F.lit(v).alias(k) for k, v in zip(("check", "column", "other"), c.split("|"))],
                 F.col(f"`{c}`").cast("double").alias("value")) for c in names])).alias("r")).select("r.*")
    hit = F.when(F.col("check") == "correlated", F.abs("value") > threshold).otherwise(F.col("value") > 0)
    return long.where(hit)


def feature_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: nulls, distinct values, mean, deviation, extremes and bias-corrected moments."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")).select("r.*")
    moments = long.groupBy("column").agg(
        F.count_if(F.col("x").isNull()).alias("nulls"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"), unbiased_skewness("x").alias("skew"),
        unbiased_kurtosis("x").alias("kurtosis"))
    # two-step distinct: the values of one column are spread over all tasks
    distinct = long.where("x is not null").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    return moments.join(distinct, "column", "left").fillna(0, ["distinct_values"])


def compact_types(df: DataFrame) -> DataFrame:
    """Smallest integer and float type that holds each column; reads the extremes in one aggregate."""
    sized = {c: t for c, t in df.dtypes if t in ("bigint", "int", "smallint", "double")}
    if not sized:
        return df
    row = df.agg(*[f(c).alias(f"{c}|{n}") for c in sized for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for c in df.columns:
        lo, hi = (row[f"{c}|lo"], row[f"{c}|hi"]) if c in sized else (None, None)
        if lo is None:
            out.append(F.col(c))
        elif sized[c] == "double":
            out.append(F.col(c).cast("float" if -3.4e38 < lo and hi < 3.4e38 else "double").alias(c))
        else:
            fit = next(t for t, b in (("byte", 7), ("short", 15), ("int", 31), ("long", 63))
                       if -2 ** b <= lo and hi < 2 ** b)
            out.append(F.col(c).cast(fit).alias(c))
    return df.select(*out)
