"""plugin_indicators takes its rolling moments by batch."""

import math

from pyspark.sql import functions as F

from quantloom.functions.scalar import div
from quantloom.operators import features as FT
from quantloom.operators.indicators.momentum import rsi_of
from quantloom.operators.series import Series


def test_plugin_indicators_equal_frames_without_using_them(spark, bars_pdf):
    pdf = bars_pdf[["symbol", "ts", "open", "high", "low", "close", "volume"]].copy()
    pdf.loc[40, "close"] = 0.0                                  # the change behind it is null
    pdf.loc[200:225, ["open", "high", "low", "close"]] = 7.0    # a window without deviation
    pdf.loc[60, "volume"] = 0.0
    df = spark.createDataFrame(pdf)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        made = FT.plugin_indicators(df)
        got = {(r.symbol, r.ts): r for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "specifiedwindowframe(RowFrame, -19" not in plan and "specifiedwindowframe(RowFrame, -29" not in plan
    s = Series(df)
    r, mean, sd = s.let(s.pct(s.close)), s.roll(F.avg, 20, s.close), s.roll(F.stddev_samp, 20, s.close)
    short, long = s.let(s.roll(F.stddev_samp, 10, r)), s.let(s.roll(F.stddev_samp, 30, r))
    move = s.close - s.open
    fair = div(s.roll(F.sum, 20, s.let((s.high + s.low + s.close) / 3 * s.volume)), s.roll(F.sum, 20, s.volume))
    macd = s.ewm(s.close, 12) - s.ewm(s.close, 26)
    want = s.frame({"custom_momentum": FT.decayed_momentum(s), "short_vol": short, "long_vol": long, "vol_ratio": div(short, long), "vol_regime": F.when(short > 0.02, 1.0).otherwise(0.0),
                    "price_impact": s.roll(F.avg, 20, s.let(div(F.abs(move), s.volume))), "intraday_range": s.roll(F.avg, 20, s.let(div(s.high - s.low, s.close))),
                    "vw_price_change": s.roll(F.avg, 20, s.let(move * s.volume)), "market_efficiency": 1 - div(F.abs(s.close - fair), s.close),
                    "composite": ((rsi_of(s, 14) - 50) / 50 + F.tanh(div(macd, sd)) + (div(s.close - (mean - 2 * sd), 4 * sd) - 0.5) * 2) / 3}, keep=["symbol", "ts"]).collect()
    assert len(want) == len(got) == len(pdf)
    for row in want:
        for name, v in row.asDict().items():
            g = got[row.symbol, row.ts][name]
            if name not in ("symbol", "ts"):
                assert (v is None) == (g is None), (row.symbol, row.ts, name, v, g)
                assert v is None or math.isclose(v, g, rel_tol=1e-7, abs_tol=1e-7), (row.symbol, row.ts, name, v, g)
