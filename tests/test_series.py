import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import make_bars
from quantloom.operators.indicators import REGISTRY, compute
from quantloom.operators.indicators.trend import compute_frame
from quantloom.operators.series import Series, into_blocks, number_rows


def ordered(df):
    return df.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


@pytest.mark.parametrize("span", [2, 3, 26, 50])
def test_ewm_matches_pandas(spark, span):
    pdf = make_bars(1200, symbols=(1,))
    pdf.loc[[0, 5, 6, 7, 300], "close"] = np.nan
    s = Series(spark.createDataFrame(pdf).withColumn("close", F.nanvl("close", F.lit(None).cast("double"))))
    got = ordered(s.frame({"e": s.ewm(F.col("close"), span)}, keep=["symbol", "ts"]))["e"].to_numpy(float)
    want = pdf["close"].ewm(span=span).mean().to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-11)


@pytest.mark.parametrize("span", [2, 3, 10])
def test_ewm_carries_its_mean_over_a_long_gap(spark, span):
    pdf = make_bars(2500, symbols=(1,))
    pdf.loc[3:1900, "close"] = np.nan
    s = Series(spark.createDataFrame(pdf).withColumn("close", F.nanvl("close", F.lit(None).cast("double"))))
    got = ordered(s.frame({"e": s.ewm(F.col("close"), span)}, keep=["symbol", "ts"]))["e"].to_numpy(float)
    want = pdf["close"].ewm(span=span).mean().ffill().to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-11)


@pytest.mark.parametrize("span", [3, 20])
def test_ewm_of_blocks_carries_its_mean_over_empty_blocks(spark, span):
    """Gaps longer than a block and its margin, at the start, in the middle and at the end; a mean of the mean, and one of a difference of means."""
    pdf = make_bars(3010, symbols=(1, 2))
    gap = pdf.groupby("symbol").cumcount()
    pdf.loc[(pdf.symbol == 1) & (gap > 4) & (gap < 3001), "close"] = np.nan
    pdf.loc[(pdf.symbol == 2) & ((gap < 700) | (gap > 2000)), "close"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("close", F.nanvl("close", F.lit(None).cast("double"))).repartition(3)
    got = []
    for form in ({}, {"block_rows": 256, "lookback": Series.ewm_lookback(span)}):
        s = Series(df, **form)
        e = s.ewm(F.col("close"), span)
        fast = s.ewm(F.col("close"), 2)
        got.append(ordered(s.frame({"e": e, "twice": s.ewm(e, span), "line": s.ewm(s.let(fast - e), span)}, keep=["symbol", "ts"])))
    for k, g in pdf.groupby("symbol"):
        mine = got[1][got[1].symbol == k]
        np.testing.assert_allclose(mine["e"], g["close"].ewm(span=span).mean().ffill(), rtol=1e-9)
        assert mine["e"].isna().sum() == (700 if k == 2 else 0)
    pd.testing.assert_frame_equal(*got, rtol=1e-9, atol=1e-9)


SLOW_DECAY = {"KAMA": 10_000}          # memory of the slowest gain, in rows


@pytest.mark.parametrize("name", sorted(n for n in REGISTRY if n != "Ichimoku" and n != "MidPoint"))
def test_blocks_do_not_change_an_indicator(bars, name):
    """Cutting a series into blocks with a look-back margin gives the plain result."""
    plain = ordered(compute(bars, name))
    cut = ordered(compute(bars, name, block_rows=40, lookback=SLOW_DECAY.get(name, 150)))
    pd.testing.assert_frame_equal(plain, cut, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("name", ["RSI", "ADX", "VWAP", "NVI", "KAMA", "BetaStability", "Entropy"])
def test_no_look_ahead(spark, bars_pdf, name):
    early = bars_pdf[bars_pdf.ts < "2020-04-10"]
    a = ordered(compute(spark.createDataFrame(early), name))
    b = ordered(compute(spark.createDataFrame(bars_pdf), name))
    pd.testing.assert_frame_equal(a, b[b.ts < "2020-04-10"].reset_index(drop=True), rtol=1e-9)


def test_row_numbers_without_a_window_over_the_key(bars):
    n = number_rows(bars, ["symbol"], "ts", F.date_trunc("week", "ts")).toPandas().sort_values(["symbol", "ts"])
    for _, g in n.groupby("symbol"):
        assert list(g["_row"]) == list(range(1, len(g) + 1))


def test_a_hot_symbol_is_spread_over_blocks(spark):
    df = spark.range(5000).select(F.lit(1).alias("symbol"), F.col("id").cast("timestamp").alias("ts"), F.rand(1).alias("close"))
    blocks = into_blocks(number_rows(df, ["symbol"], "ts", F.date_trunc("minute", "ts")), 500, 20)
    sizes = [r["count"] for r in blocks.groupBy("_block").count().collect()]
    assert max(sizes) <= 520 and sum(r["_own"] for r in blocks.select("_own").collect()) == 5000


def test_edge_groups(spark):
    ts = pd.date_range("2020-01-01", periods=40)
    one = pd.DataFrame({"symbol": 1, "ts": ts[:1], "close": 5.0})
    flat = pd.DataFrame({"symbol": 2, "ts": ts, "close": 7.0})
    rise = pd.DataFrame({"symbol": 3, "ts": ts, "close": np.arange(40) + 1.0})
    df = spark.createDataFrame(pd.concat([one, flat, rise]))
    rsi = ordered(compute(df, "RSI"))
    assert rsi[rsi.symbol < 3]["rsi"].isna().all() and (rsi[rsi.symbol == 3]["rsi"].dropna() == 100).all()
    assert compute(df.limit(0), "RSI").count() == 0
    with pytest.raises(ValueError):
        compute(df, "ATR")
    with pytest.raises(ValueError):
        compute(df, "RSI", perid=3)
    for name in ("ZScore", "Skewness", "Entropy", "HurstExponent", "PercentRank"):
        compute(df, name).collect()


def test_kama_is_the_recurrence(bars, bars_pdf):
    got = ordered(compute(bars, "KAMA"))
    for k, g in bars_pdf.groupby("symbol"):
        x = g["close"].to_numpy()
        out = np.full(len(x), np.nan)
        out[9] = x[9]
        for t in range(10, len(x)):
            er = abs(x[t] - x[t - 10]) / np.abs(np.diff(x[t - 10:t + 1])).sum()
            gain = (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2
            out[t] = out[t - 1] + gain * (x[t] - out[t - 1])
        np.testing.assert_allclose(got[got.symbol == k]["kama"].to_numpy(float), out, rtol=1e-10)


def test_parabolic_stop_properties(bars, bars_pdf):
    got = ordered(compute_frame(bars, "PSAR"))
    m = got.merge(bars_pdf, on=["symbol", "ts"])
    first = m.groupby("symbol").head(1)
    assert (first["psar"] == first["low"]).all() and (first["direction"] == 1).all()
    later = m.drop(first.index)
    up = later[later.direction == 1]
    kept = up[up.groupby("symbol")["direction"].shift().eq(1)]
    assert set(m["direction"]) == {1.0, -1.0}
    # a line that is kept stays on its side of the last two bars
    lows = m.groupby("symbol")["low"].shift()
    turned = m["direction"] != m.groupby("symbol")["direction"].shift()
    same = m[(m.direction == 1) & ~turned]
    assert (same["psar"] <= lows[same.index] + 1e-9).all() and len(kept)


def test_supertrend_sides(bars, bars_pdf):
    m = ordered(compute_frame(bars, "SuperTrend")).merge(bars_pdf, on=["symbol", "ts"]).dropna(subset=["supertrend"])
    start = m.groupby("symbol").head(1).index
    rest = m.drop(start)
    assert ((rest.direction == 1) == (rest.supertrend == rest.lower)).all()
    assert ((rest.direction == -1) == (rest.supertrend == rest.upper)).all()
