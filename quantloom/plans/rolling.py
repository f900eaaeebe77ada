"""Rolling features, probes and rolling analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import features as FT, rolling as R
from quantloom.operators.series import Series
from quantloom.plans import query
from quantloom.plans.indicators import GAIN_LOSS, MACD, RET, rsi, strength
from quantloom.plans.kit import (ASSET, DAILY, FACTORS, MARKET, META, B, O, W, dv, ewm, lag, pct, pick, result, rnd,
                                 roll, roll2, rounded, steps, with_)
from quantloom.sources import tables as T

ASSET_MARKET = "am AS (SELECT * FROM asset JOIN market USING (ts))"


def asset_market(spark, sf_dir):
    return T.asset_returns(spark, sf_dir).join(T.market_returns(spark, sf_dir), "ts")


# ---- rolling engine ---------------------------------------------------------------------------------------------
BASIC = ["mean", "std", "min", "max", "sum", "skew", "kurt"]
NAMES = [f"close_rolling_{n}_{op}" for n in (20, 50) for op in BASIC]
FN = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum", "skew": "skewness",
      "kurt": "kurtosis"}


@query("rolling_basic", with_(DAILY, steps("daily", [
    (f"close_rolling_{n}_{op}", roll(FN[op], "close", n)) for n in (20, 50) for op in BASIC]), body=pick(NAMES, 3)))
def rolling_basic(spark, sf_dir):
    return result(R.rolling_features(T.daily_bars(spark, sf_dir), ["close"], (20, 50), BASIC), NAMES, 3)


QN = ["close_rolling_20_median", "close_rolling_20_quantile_25", "close_rolling_20_quantile_75"]


@query("rolling_quantiles", with_(DAILY, steps("daily", [
    (n, f"CASE WHEN rn >= 20 THEN quantile_cont(close, {q}) OVER {W(20)} END")
    for n, q in zip(QN, (0.5, 0.25, 0.75))]), body=pick(QN, 3)))
def rolling_quantiles(spark, sf_dir):
    df = R.rolling_features(T.daily_bars(spark, sf_dir), ["close"], (20,), ["median", "quantile"])
    return result(df, QN, 3)


@query("rolling_rank_zscore", with_(DAILY, steps("daily", [
    ("v", f"list(close) OVER {W(20)}"), ("m", roll("avg", "close", 20)), ("sd", roll("stddev_samp", "close", 20)),
    ("close_rolling_20_rank", "CASE WHEN rn >= 20 THEN (len(list_filter(v, lambda x: x < close)) + len(list_filter(v, lambda x: x <= close)) + 1) / 40.0 END"),
    ("close_rolling_20_zscore", "CASE WHEN sd > 0 THEN (close - m) / sd WHEN sd = 0 THEN 0 END")]),
    body=pick(["close_rolling_20_rank", "close_rolling_20_zscore"])))
def rolling_rank_zscore(spark, sf_dir):
    df = R.rolling_features(T.daily_bars(spark, sf_dir), ["close"], (20,), ["rank", "zscore"])
    return result(df, ["close_rolling_20_rank", "close_rolling_20_zscore"])


FW = B(-18, 0)
GROW = ["rsi", "momentum", "volatility", "sharpe"]


@query("rolling_growing_start", with_(DAILY, steps("daily", GAIN_LOSS + RET + [
    ("ag", roll("avg", "up", 14)), ("al", roll("avg", "dn", 14)), ("m", f"avg(r) OVER {FW}"),
    ("sd", f"stddev_samp(r) OVER {FW}"),
    ("close_rolling_20_rsi", f"CASE WHEN rn >= 15 THEN {strength('ag', 'al')} END"),
    ("close_rolling_20_momentum", f"CASE WHEN rn >= 2 THEN coalesce(close / nullif(first(close) OVER {W(20)}, 0) - 1, 0) END"),
    ("close_rolling_20_volatility", "sd * sqrt(252)"),
    ("close_rolling_20_sharpe", "CASE WHEN rn < 2 THEN NULL WHEN sd > 0 THEN m / sd * sqrt(252) ELSE 0 END")]),
    body=pick([f"close_rolling_20_{g}" for g in GROW], 4)))
def rolling_growing_start(spark, sf_dir):
    df = R.rolling_features(T.daily_bars(spark, sf_dir), ["close"], (20,), GROW)
    return result(df, [f"close_rolling_20_{g}" for g in GROW], 4)


@query("rolling_valid_rows", with_(DAILY, steps("daily", [("mean", roll("avg", "close", 10))]),
                                   body=pick(["mean"], 4) + " WHERE mean IS NOT NULL"))
def rolling_valid_rows(spark, sf_dir):
    return result(R.valid_rolling(T.daily_bars(spark, sf_dir), "close", 10, "mean"), ["mean"], 4)


# ---- feature requests -------------------------------------------------------------------------------------------
REQUEST = {"rolling": {"columns": ["close"], "windows": [20], "operations": ["mean"]},
           "indicators": {"RSI": {"period": 14}, "ATR": {"period": 14}, "MACD": {}, "OBV": {}, "ZScore": {"period": 20}},
           "custom": {"CustomMomentum": {}}}
REQUEST_OUT = {"close_rolling_20_mean": 3, "RSI_rsi_period14": 5, "ATR_atr_period14": 3, "MACD_macd_default": 3,
               "MACD_signal_default": 3, "MACD_histogram_default": 3, "OBV_obv_default": 3, "ZScore_zscore_period20": 5,
               "custom_CustomMomentum": 5}
DECAY = [0.9 ** i for i in range(20)]
MOM = "CASE WHEN rn > 20 THEN " + " + ".join(
    f"{DECAY[i] / sum(DECAY)!r}::DOUBLE * {lag('r', 19 - i) if i < 19 else 'r'}" for i in range(20)) + " END"


@query("feature_request", with_(DAILY, steps("daily", rsi(14, "RSI_rsi_period14") + MACD + RET + [
    ("pc", lag("close")),
    ("tr", "CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END"),
    ("ATR_atr_period14", roll("avg", "tr", 14)), ("close_rolling_20_mean", roll("avg", "close", 20)),
    ("MACD_macd_default", "macd"), ("MACD_signal_default", "signal"), ("MACD_histogram_default", "histogram"),
    ("OBV_obv_default", f"sum(coalesce(sign(d) * volume, 0)) OVER {B(-100000, 0)}"),
    ("ZScore_zscore_period20", dv("close - close_rolling_20_mean", roll("stddev_samp", "close", 20))),
    ("custom_CustomMomentum", MOM)]), body=pick(list(REQUEST_OUT), REQUEST_OUT)))
def feature_request(spark, sf_dir):
    return result(FT.compute_features(T.daily_bars(spark, sf_dir), REQUEST), list(REQUEST_OUT), REQUEST_OUT)


BASE_SET = ["ma_20", "momentum", "rsi", "bb_upper", "bb_lower", "macd", "macd_signal", "volatility", "return_1d",
            "return_5d", "return_10d", "return_20d"]


@query("base_feature_set", with_(DAILY, steps("daily", rsi(14) + MACD + RET + [
    ("ma_20", roll("avg", "close", 20)), ("sd", roll("stddev_samp", "close", 20)), ("momentum", pct("close", 10)),
    ("bb_upper", "ma_20 + 2 * sd"), ("bb_lower", "ma_20 - 2 * sd"), ("macd_signal", "signal"),
    ("volatility", roll("stddev_samp", "r", 20))] + [(f"return_{k}d", pct("close", k)) for k in (1, 5, 10, 20)]),
    body=pick(BASE_SET, 4)))
def base_feature_set(spark, sf_dir):
    return result(R.base_feature_set(T.daily_bars(spark, sf_dir)), BASE_SET, 4)


LEARN_SET = ["price", "returns", "momentum_5", "momentum_20", "sma_5", "sma_20", "volatility", "rsi"]


@query("learning_feature_set", with_(DAILY, steps("daily", GAIN_LOSS + RET + [
    ("ag", roll("avg", "up", 14)), ("al", roll("avg", "dn", 14)), ("price", "close"), ("returns", "r"),
    ("momentum_5", pct("close", 5)), ("momentum_20", pct("close", 20)), ("sma_5", roll("avg", "close", 5)),
    ("sma_20", roll("avg", "close", 20)), ("volatility", roll("stddev_samp", "r", 20)),
    ("rsi", "100 - 100 / (1 + ag / (al + 1e-10))")]),
    body=pick(LEARN_SET, 4) + " WHERE momentum_20 IS NOT NULL AND volatility IS NOT NULL AND rsi IS NOT NULL"))
def learning_feature_set(spark, sf_dir):
    return result(R.learning_feature_set(T.daily_bars(spark, sf_dir)), LEARN_SET, 4)


LAGSET = ["close_lag_1", "close_lag_5", "close_rolling_mean_5", "close_rolling_std_5", "close_diff", "close_pct_change"]


@query("lag_rolling_diff_features", with_(DAILY, steps("daily", [
    ("close_lag_1", lag("close")), ("close_lag_5", lag("close", 5)), ("close_rolling_mean_5", roll("avg", "close", 5)),
    ("close_rolling_std_5", roll("stddev_samp", "close", 5)), ("close_diff", f"close - {lag('close')}"),
    ("close_pct_change", pct("close"))]), body=pick(LAGSET, 4)))
def lag_rolling_diff_features(spark, sf_dir):
    df = R.lag_rolling_diff_features(T.daily_bars(spark, sf_dir), ["close"], (1, 5), (5,))
    return result(df, LAGSET, 4)


@query("sequence_features", with_(DAILY, steps("daily", [
    ("seq", f"list([close, volume]) OVER {B(-60, -1)}")]), body=f"""SELECT symbol, strftime(ts, '%Y-%m-%d') AS day,
  CAST(len(seq) AS BIGINT) AS steps, {rnd('seq[1][1]', 4, 'oldest')}, {rnd('seq[60][1]', 4, 'newest')},
  {rnd('list_sum(list_transform(seq, lambda v: v[2]))', 2, 'volume')}, {rnd('close', 4, 'target')} FROM final WHERE len(seq) = 60"""))
def sequence_features(spark, sf_dir):
    q = R.sequences(T.daily_bars(spark, sf_dir), ["close", "volume"], "close", 60)
    seq = F.col("sequence")
    return q.select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.size(seq).cast("long").alias("steps"),
                    rounded(seq[0][0], 4).alias("oldest"), rounded(seq[59][0], 4).alias("newest"),
                    rounded(F.aggregate(seq, F.lit(0.0), lambda a, v: a + v[1]), 2).alias("volume"),
                    rounded("target", 4).alias("target"))


PLUGIN = {"custom_momentum": 5, "short_vol": 4, "long_vol": 4, "vol_ratio": 5, "vol_regime": 1, "price_impact": 3,
          "intraday_range": 5, "vw_price_change": 1, "market_efficiency": 5, "composite": 5}


@query("plugin_indicators", with_(DAILY, steps("daily", rsi(14) + MACD + RET + [
    ("custom_momentum", MOM), ("short_vol", roll("stddev_samp", "r", 10)), ("long_vol", roll("stddev_samp", "r", 30)),
    ("vol_ratio", dv("short_vol", "long_vol")), ("vol_regime", "CASE WHEN short_vol > 0.02 THEN 1 ELSE 0 END"),
    ("pi", dv("abs(close - open)", "volume")), ("price_impact", roll("avg", "pi", 20)), ("ir", dv("high - low", "close")),
    ("intraday_range", roll("avg", "ir", 20)), ("vpc", "(close - open) * volume"),
    ("vw_price_change", roll("avg", "vpc", 20)), ("pv", "(high + low + close) / 3 * volume"),
    ("fair", dv(roll("sum", "pv", 20), roll("sum", "volume", 20))),
    ("market_efficiency", f"1 - {dv('abs(close - fair)', 'close')}"), ("m", roll("avg", "close", 20)),
    ("sd", roll("stddev_samp", "close", 20)), ("bb", dv("close - (m - 2 * sd)", "4 * sd")),
    ("x", dv("macd", "sd")), ("th", "CASE WHEN x > 20 THEN 1 WHEN x < -20 THEN -1 ELSE (exp(2 * x) - 1) / (exp(2 * x) + 1) END"),
    ("composite", "((rsi - 50) / 50 + th + (bb - 0.5) * 2) / 3")]), body=pick(list(PLUGIN), PLUGIN)))
def plugin_indicators(spark, sf_dir):
    return result(FT.plugin_indicators(T.daily_bars(spark, sf_dir)), list(PLUGIN), PLUGIN)


@query("cross_sectional_strength", with_(DAILY, body=f"""SELECT symbol, strftime(ts, '%Y-%m-%d') AS day,
  {rnd('close / nullif(avg(close) OVER (PARTITION BY ts), 0)', 6, 'relative_strength')} FROM daily"""))
def cross_sectional_strength(spark, sf_dir):
    return result(R.cross_sectional_strength(T.daily_bars(spark, sf_dir)), ["relative_strength"])


@query("sector_rolling_momentum", with_(DAILY, META, steps("daily", [("ch", pct("close"))], prefix="c"),
    "sec AS (SELECT sector, ts, avg(ch) AS ch FROM cfinal JOIN meta USING (symbol) WHERE ch IS NOT NULL GROUP BY 1, 2)",
    steps("sec", [("sector_momentum", roll("avg", "ch", 20, "sector"))], part="sector"),
    body=pick(["sector_momentum"], 4, keys=("sector",))))
def sector_rolling_momentum(spark, sf_dir):
    df = R.sector_rolling_momentum(T.daily_bars(spark, sf_dir), T.symbol_metadata(spark, sf_dir))
    return result(df, ["sector_momentum"], 4, keys=("sector",))


# ---- look-ahead probes --------------------------------------------------------------------------------------------
@query("probe_flat_feature", with_(DAILY, steps("daily", [
    ("turn", "floor(volume / 1000)"), ("sd", f"stddev_samp(turn) OVER {W(21)}"), ("c", f"count(turn) OVER {W(21)}")]),
    body="SELECT symbol, strftime(ts, '%Y-%m-%d') AS day FROM final WHERE sd = 0 AND c > 5"))
def probe_flat_feature(spark, sf_dir):
    bars = T.daily_bars(spark, sf_dir).withColumn("turn", F.floor(F.col("volume") / 1000).cast("double"))
    return result(R.stability_probe(bars, "turn"), [])


@query("probe_correlation", with_(DAILY, steps("daily", [("sma", roll("avg", "close", 5)), ("lc", lag("close")), ("lv", lag("volume"))]),
    body=f"""SELECT symbol, feature, data, kind, {rnd('c', 6, 'corr')}, coalesce(abs(c) > CASE WHEN kind = 'same' THEN 0.99 ELSE 0.95 END, FALSE) AS suspicious
  FROM (SELECT symbol, unnest([{{'data': 'close', 'kind': 'same', 'c': corr(sma, close)}},
    {{'data': 'close', 'kind': 'lagged', 'c': corr(sma, lc)}}, {{'data': 'volume', 'kind': 'same', 'c': corr(sma, volume)}},
    {{'data': 'volume', 'kind': 'lagged', 'c': corr(sma, lv)}}], recursive := true), 'sma' AS feature FROM final GROUP BY symbol)"""))
def probe_correlation(spark, sf_dir):
    s = Series(T.daily_bars(spark, sf_dir))
    df = s.frame({"sma": s.roll(F.avg, 5, s.close)}, keep=["symbol", "ts", "close", "volume"])
    out = R.correlation_probe(df, ["sma"], ["close", "volume"])
    return out.select("symbol", "feature", "data", "kind", rounded("corr").alias("corr"), "suspicious")


@query("probe_extreme_change", with_(DAILY, steps("daily", [("ch", pct("close"))]),
    "b AS (SELECT symbol, quantile_cont(ch, 0.01) AS lo, quantile_cont(ch, 0.99) AS hi FROM final GROUP BY symbol)",
    body=f"""SELECT symbol, n, extreme, {rnd('extreme / n', 6, 'share')}, extreme / n > 0.05 AS suspicious FROM (
  SELECT symbol, count(ch) AS n, count(*) FILTER (ch < lo OR ch > hi) AS extreme FROM final JOIN b USING (symbol)
  GROUP BY symbol) WHERE n >= 10"""))
def probe_extreme_change(spark, sf_dir):
    df = R.extreme_change_probe(T.daily_bars(spark, sf_dir), "close")
    return df.select("symbol", "n", "extreme", rounded("share").alias("share"), "suspicious")


@query("probe_sharpe_consistency", with_(ASSET, steps("asset", [
    ("m", roll("avg", "ret", 252)), ("sd", roll("stddev_samp", "ret", 252)),
    ("sharpe", "CASE WHEN sd = 0 THEN 0 ELSE m / sd * sqrt(252) END")]),
    body=f"""SELECT symbol, {rnd('avg(CASE WHEN sharpe > 3 THEN 1.0 ELSE 0.0 END)', 6, 'share')},
  avg(CASE WHEN sharpe > 3 THEN 1.0 ELSE 0.0 END) > 0.5 AS suspicious FROM final WHERE sharpe IS NOT NULL GROUP BY symbol"""))
def probe_sharpe_consistency(spark, sf_dir):
    df = R.sharpe_consistency_probe(T.asset_returns(spark, sf_dir))
    return df.select("symbol", rounded("share").alias("share"), "suspicious")


@query("probe_target_names", """SELECT name FROM (SELECT DISTINCT p_brand || '_' || lower(p_type) || CASE WHEN p_size % 2 = 0 THEN '_return' ELSE '_lag_return' END AS name FROM part)
  WHERE regexp_matches(lower(name), 'return|target|label|y') AND NOT regexp_matches(lower(name), 'lag|shift|prev|past')""")
def probe_target_names(spark, sf_dir):
    kind = F.when(F.col("p_size") % 2 == 0, "_return").otherwise("_lag_return")
    names = T.table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("_"), F.lower("p_type"), kind).alias("name")).distinct()
    return R.target_name_probe(names)


# ---- rolling analytics ----------------------------------------------------------------------------------------------
PREV = B(-252, -1)
COMPARE = ["portfolio_return", "benchmark_return", "excess_return", "tracking_error", "information_ratio", "hit_ratio",
           "beta", "alpha", "correlation", "r_squared"]


def grown(x):
    return f"pow(product(1 + {x}) OVER {PREV}, 1.0) - 1"


@query("rolling_comparison", with_(ASSET, MARKET, ASSET_MARKET, steps("am", [
    ("ex", "ret - bench"), ("n", "count(*) OVER (PARTITION BY symbol)"), ("portfolio_return", grown("ret")),
    ("benchmark_return", grown("bench")), ("excess_return", grown("ex")), ("sd", f"stddev_samp(ex) OVER {PREV}"),
    ("tracking_error", "sd * sqrt(252)"), ("information_ratio", f"avg(ex) OVER {PREV} / sd * sqrt(252)"),
    ("hit_ratio", f"avg(CASE WHEN ex > 0 THEN 1.0 ELSE 0.0 END) OVER {PREV}"),
    ("beta", f"covar_samp(ret, bench) OVER {PREV} / var_samp(bench) OVER {PREV}"),
    ("alpha", f"(avg(ret) OVER {PREV} - beta * avg(bench) OVER {PREV}) * 252"),
    ("correlation", f"corr(ret, bench) OVER {PREV}"), ("r_squared", "correlation * correlation")]),
    body=pick(COMPARE, 5) + " WHERE n >= 504 AND rn > 252"))
def rolling_comparison(spark, sf_dir):
    return result(R.rolling_comparison(asset_market(spark, sf_dir)), COMPARE, 5)


ATTR = ["alpha", "r_squared", "beta_f0", "beta_f1", "contribution_f0", "contribution_f1"]
P2 = B(-126, -1)


@query("rolling_factor_attribution", with_(ASSET, META, FACTORS, "af AS (SELECT * FROM asset JOIN factors USING (ts))",
    steps("af", [(n, f"covar_pop({a}, {b}) OVER {P2}") for n, a, b in
                 (("s00", "f0", "f0"), ("s01", "f0", "f1"), ("s11", "f1", "f1"), ("y0", "f0", "ret"), ("y1", "f1", "ret"))]
          + [("det", "s00 * s11 - s01 * s01"), ("beta_f0", "(s11 * y0 - s01 * y1) / nullif(det, 0)"),
             ("beta_f1", "(s00 * y1 - s01 * y0) / nullif(det, 0)"), ("m0", f"avg(f0) OVER {P2}"),
             ("m1", f"avg(f1) OVER {P2}"), ("alpha", f"avg(ret) OVER {P2} - beta_f0 * m0 - beta_f1 * m1"),
             ("r_squared", f"(beta_f0 * y0 + beta_f1 * y1) / nullif(var_pop(ret) OVER {P2}, 0)"),
             ("contribution_f0", "beta_f0 * m0"), ("contribution_f1", "beta_f1 * m1")]),
    body=pick(ATTR) + " WHERE rn > 126"))
def rolling_factor_attribution(spark, sf_dir):
    df = T.asset_returns(spark, sf_dir).join(T.factor_returns(spark, sf_dir), "ts")
    return result(R.rolling_factor_attribution(df, ["f0", "f1"], 126), ATTR)


@query("rolling_model_performance", with_(ASSET, steps("asset", [("y_pred", lag("ret"))]),
    steps("f2", [("e", "ret - y_pred"), ("e2", "e * e"), ("ae", "abs(e)"), ("mse", roll("avg", "e2", 100)),
                 ("mae", roll("avg", "ae", 100)), ("corr", roll2("corr", "ret", "y_pred", 100))],
          source="(SELECT symbol, ts, ret, y_pred FROM final WHERE y_pred IS NOT NULL)", prefix="p"),
    body=pick(["mse", "mae", "corr"], source="pfinal") + " WHERE mse IS NOT NULL"))
def rolling_model_performance(spark, sf_dir):
    s = Series(T.asset_returns(spark, sf_dir))
    pred = s.frame({"y_pred": s.lag("ret")}).withColumnRenamed("ret", "y_true").where("y_pred is not null")
    return result(R.rolling_model_performance(pred, keys=("symbol",)), ["mse", "mae", "corr"])
