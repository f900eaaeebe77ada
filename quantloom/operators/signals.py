"""Strategies, signal aggregation and signal checks.

A signal row is (strategy, symbol, ts, signal_type, strength in [-1, 1], confidence in [0, 1]).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.functions.scalar import corr_of, div, true_or_false
from quantloom.operators.indicators.momentum import macd_lines, rsi_of
from quantloom.operators.series import ROW, Series
from quantloom.session import checkpointed

TYPES = ("BUY", "SELL", "HOLD")


def vote_signals(bars: DataFrame) -> DataFrame:
    """0.4 momentum + 0.3 RSI + 0.3 MACD vote, cut at plus and minus one half.

    A missing momentum or MACD counts as a vote against, a missing RSI as no vote.  Votes are added in tenths so that
    the cut is exact.
    """
    s = Series(bars.select("symbol", "ts", "close"))
    line, sig, _ = macd_lines(s, 12, 26, 9)
    rsi = rsi_of(s, 14)
    momentum = F.when(true_or_false(s.pct(s.close, 10) > 0), 4).otherwise(-4)
    strength = F.when(rsi < 30, 3).when(rsi > 70, -3).otherwise(0)
    trend = F.when(true_or_false(line > sig), 3).otherwise(-3)
    total = s.let(momentum + strength + trend)
    return s.frame({"signal": F.when(total > 5, 1).when(total < -5, -1).otherwise(0)})


def lagged_backtest(bars_with_signal: DataFrame) -> DataFrame:
    """(ts, n, ret): mean over symbols of the change times the signal one row before; missing pairs are left out."""
    s = Series(bars_with_signal.select("symbol", "ts", "close", "signal"))
    r = s.frame({"ret": s.pct(s.close) * s.lag("signal")}, keep=["symbol", "ts"])
    return r.groupBy("ts").agg(F.count("ret").alias("n"), F.avg("ret").alias("ret"),
                               (F.coalesce(F.sum("ret"), F.lit(0.0)) / F.count(F.lit(1))).alias("ret_all"))


def _agreement(s: Series, x: Column) -> Column:
    """Share of the last six rows (fewer at the start) with the same sign as the current one."""
    values = s.let(F.collect_list(F.coalesce(x, F.lit(0.0))).over(s.order.rowsBetween(-5, 0)))
    return F.size(F.filter(values, lambda v: v * x > 0)) / F.size(values)


def _graded(x: Column, threshold: float):
    kind = F.when(x > threshold, "BUY").when(x < -threshold, "SELL").otherwise("HOLD")
    size = F.least(F.greatest(x / threshold, F.lit(-1.0)), F.lit(1.0))
    return kind, F.when(F.abs(x) > threshold, size).otherwise(0.0)


def _signal(strategy: str, valid: Column, kind: Column, strength: Column, confidence: Column) -> Column:
    return F.when(valid, F.struct(F.lit(strategy).alias("strategy"), kind.alias("signal_type"),
                                  strength.cast("double").alias("strength"), confidence.cast("double").alias("confidence")))


def moving_average_rule(s: Series, short=10, long=30, threshold=0.02) -> Column:
    slow = s.let(s.roll(F.avg, long, s.close))
    gap = s.let(div(s.roll(F.avg, short, s.close) - slow, slow))
    kind, strength = _graded(gap, threshold)
    return _signal("moving_average", (s.row > long) & gap.isNotNull(), kind, strength, _agreement(s, gap))


def rsi_rule(s: Series, period=14, oversold=30.0, overbought=70.0) -> Column:
    x = rsi_of(s, period)
    low, high = x < oversold, x > overbought
    strength = F.when(low, (oversold - x) / oversold).when(high, -(x - overbought) / (100 - overbought)).otherwise(0.0)
    sure = F.when(low, F.least((oversold - x) / 20, F.lit(1.0))).when(high, F.least((x - overbought) / 20, F.lit(1.0))).otherwise(0.5)
    kind = F.when(low, "BUY").when(high, "SELL").otherwise("HOLD")
    return _signal("rsi", (s.row > period) & x.isNotNull(), kind, strength, sure)


def momentum_rule(s: Series, lookback=20, threshold=0.05) -> Column:
    x = s.let(s.pct(s.close, lookback))
    kind, strength = _graded(x, threshold)
    return _signal("momentum", (s.row > lookback) & x.isNotNull(), kind, strength, _agreement(s, x))


def strategy_signals(bars: DataFrame, rules=(moving_average_rule, rsi_rule, momentum_rule)) -> DataFrame:
    """All rules (functions of a series) over one pass of the bars: one exchange, one row per valid signal."""
    s = Series(bars.select("symbol", "ts", "close"))
    out = s.frame({f"_r{i}": rule(s) for i, rule in enumerate(rules)}, keep=["symbol", "ts"])
    each = F.inline(F.array_compact(F.array(*[F.col(f"_r{i}") for i in range(len(rules))])))
    return out.select("symbol", "ts", each).select("strategy", "symbol", "ts", "signal_type", "strength", "confidence")


def long_flat_signals(bars: DataFrame, predictions: DataFrame | None = None, window=20) -> DataFrame:
    """1 above the moving average, else 0; with predictions both must agree."""
    s = Series(bars.select("symbol", "ts", "close"))
    out = s.frame({"signal": F.when(true_or_false(s.close > s.roll(F.avg, window, s.close)), 1).otherwise(0)})
    if predictions is None:
        return out
    j = out.join(predictions.select("symbol", "ts", F.col("signal").alias("_p")), ["symbol", "ts"], "left")
    return j.withColumn("signal", F.when(F.coalesce("_p", F.lit(0)) > 0, F.col("signal")).otherwise(0)).drop("_p")


def prediction_signals(predictions: DataFrame, threshold=0.02) -> DataFrame:
    """BUY or SELL where the predicted price is away from the price by more than the threshold."""
    x = div(F.col("y_pred") - F.col("price"), F.col("price"))
    return predictions.withColumns({"expected": x, "signal_type": F.when(x > threshold, "BUY").when(x < -threshold, "SELL").otherwise("HOLD")})


# ---- aggregation over strategies --------------------------------------------------------------------------------------
def _cut(x: Column) -> Column:
    return F.when(x > 0.1, "BUY").when(x < -0.1, "SELL").otherwise("HOLD")


def with_weights(signals: DataFrame, weights: dict[str, float]) -> DataFrame:
    table = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
    return signals.withColumn("w", F.coalesce(table[F.col("strategy")], F.lit(0.0)))


def _combined(signals, strength, confidence, extra=(), where="_w > 0"):
    a = signals.groupBy("symbol", "ts").agg(F.sum("w").alias("_w"), strength.alias("strength"), confidence.alias("confidence"), *extra)
    return a.where(where).withColumn("signal_type", _cut(F.col("strength"))).select("symbol", "ts", "signal_type", "strength", "confidence")


def weighted_average(signals: DataFrame) -> DataFrame:
    w = F.col("w")
    return _combined(signals, F.sum(w * F.col("strength")), F.sum(w * F.col("confidence")))


def confidence_weighted(signals: DataFrame) -> DataFrame:
    cw = F.col("w") * F.col("confidence")
    return _combined(signals, div(F.sum(F.col("strength") * cw), F.sum(cw)), F.sum(cw) / F.count(F.lit(1)),
                     [F.sum(cw).alias("_cw")], "_cw > 0")


def rank_based(signals: DataFrame) -> DataFrame:
    """Weights fall with the rank of |strength| among the strategies of a (symbol, ts), a handful of rows."""
    order = Window.partitionBy("symbol", "ts").orderBy(F.desc(F.abs("strength")), "strategy")
    r = signals.withColumn("w", F.col("w") / F.row_number().over(order))
    w = F.col("w")
    return _combined(r, div(F.sum(w * F.col("strength")), F.sum(w)), div(F.sum(w * F.col("confidence")), F.sum(w)))


def majority_vote(signals: DataFrame) -> DataFrame:
    """Type with the largest weight (BUY before SELL before HOLD on ties); strength is the lead over the second."""
    vote = lambda t: F.coalesce(F.sum(F.when(F.col("signal_type") == t, F.col("w"))), F.lit(0.0))
    a = signals.groupBy("symbol", "ts").agg(*[vote(t).alias(t) for t in TYPES],
                                            (F.sum(F.col("w") * F.col("confidence")) / F.count(F.lit(1))).alias("confidence"))
    buy, sell, hold = (F.col(t) for t in TYPES)
    top = F.greatest(buy, sell, hold)
    second = F.element_at(F.sort_array(F.array(buy, sell, hold), asc=False), 2)
    kind = F.when(buy == top, "BUY").when(sell == top, "SELL").otherwise("HOLD")
    return a.select("symbol", "ts", kind.alias("signal_type"), (top - second).alias("strength"), "confidence")


def ensemble(signals: DataFrame) -> DataFrame:
    """Mean of weighted average, majority vote and confidence weighting per (symbol, ts), from one aggregate."""
    w, c, x = F.col("w"), F.col("confidence"), F.col("strength")
    vote = lambda t: F.coalesce(F.sum(F.when(F.col("signal_type") == t, w)), F.lit(0.0)).alias(f"_{t}")
    a = signals.groupBy("symbol", "ts").agg(
        F.sum(w).alias("_w"), F.sum(w * x).alias("_wx"), F.sum(w * c).alias("_wc"), F.sum(w * c * x).alias("_wcx"),
        F.count(F.lit(1)).alias("_n"), *[vote(t) for t in TYPES])
    votes = F.sort_array(F.array(*[F.col(f"_{t}") for t in TYPES]), asc=False)
    mean_confidence = F.col("_wc") / F.col("_n")
    pair = lambda strength, confidence: F.struct(strength.alias("s"), confidence.alias("c"))
    parts = F.array_compact(F.array(
        F.when(F.col("_w") > 0, pair(F.col("_wx"), F.col("_wc"))), pair(votes[0] - votes[1], mean_confidence),
        F.when(F.col("_wc") > 0, pair(div("_wcx", "_wc"), mean_confidence))))
    a = a.withColumn("_p", parts)
    mean = lambda f: F.aggregate("_p", F.lit(0.0), lambda acc, v: acc + v[f]) / F.size("_p")
    a = a.withColumns({"strength": mean("s"), "confidence": mean("c")})
    return a.select("symbol", "ts", _cut(F.col("strength")).alias("signal_type"), "strength", "confidence")


def strategy_weights(stats: DataFrame, scheme: str = "equal") -> DataFrame:
    """(strategy, w) from one row per strategy; a handful of rows.

    equal; volatility: inverse of `deviation` (at least .01); performance: positive `ret`; sharpe: positive `sharpe`;
    adaptive: mean of the last three.
    """
    raw = {"equal": F.lit(1.0), "volatility": 1 / F.greatest("deviation", F.lit(0.01)),
           "performance": F.greatest("ret", F.lit(0.0)), "sharpe": F.greatest("sharpe", F.lit(0.0))}

    def share(x: Column) -> Column:
        whole = Window.partitionBy(F.lit(0))
        return F.coalesce(div(x, F.sum(x).over(whole)), 1 / F.count(F.lit(1)).over(whole))
    if scheme == "adaptive":
        return stats.select("strategy", ((share(raw["volatility"]) + share(raw["performance"]) + share(raw["sharpe"])) / 3).alias("w"))
    return stats.select("strategy", share(raw[scheme]).alias("w"))


# ---- checks of a signal table -------------------------------------------------------------------------------------------
def check(name: str, value: Column, passed: Column, threshold: float, weight: str) -> Column:
    return F.struct(F.lit(name).alias("rule"), value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"),
                    F.lit(weight).alias("weight"), F.coalesce(passed, F.lit(False)).alias("passed"))


def validate_signals(signals: DataFrame, data_end: DataFrame) -> DataFrame:
    """(strategy, rule, value, threshold, weight, passed): one aggregate per strategy, then one pass of the series for all that needs their order or that aggregate.

    Outliers and the correlation of |strength| with confidence are judged from ten signals on; a correlation that does not exist fails.
    Stability is the mean over the symbols that have forty signals or more; without such a symbol it passes.
    """
    k = ["strategy"]
    last = data_end.agg(F.max("ts").alias("_last"))
    missing = F.col("symbol").isNull() | F.col("ts").isNull() | F.col("strength").isNull() | F.col("confidence").isNull()
    d = signals.join(F.broadcast(last), F.lit(True))
    base = d.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("incomplete"), F.count_if(~F.col("signal_type").isin(*TYPES)).alias("bad_type"),
        F.count_if(F.abs("strength") > 1).alias("bad_strength"), F.count_if((F.col("confidence") < 0) | (F.col("confidence") > 1)).alias("bad_confidence"),
        *[F.count_if(F.col("signal_type") == t).alias(f"_{t}") for t in TYPES], F.count_if(F.col("ts") > F.col("_last")).alias("future"),
        F.avg("strength").alias("_m"), F.stddev_pop("strength").alias("_s"), corr_of(F.abs("strength"), F.col("confidence")).alias("_corr"))
    base = checkpointed(base)        # a row per strategy, read here and below
    s = Series(signals, ["strategy", "symbol"])
    again = Window.partitionBy(*s.keys, "ts", "signal_type").orderBy(ROW)
    rows = s.frame({"_gap": F.datediff("ts", s.lag("ts")), "_again": F.row_number().over(again) > 1, "_past": F.avg(F.abs("strength")).over(s.order.rowsBetween(-10, -1)),
                    "_at": s.row}, keep=[*s.keys, "strength"])
    rows = rows.join(F.broadcast(base.select(*k, "_m", "_s")), k)
    past = F.when(F.col("_at") > 10, F.col("_past"))
    each = rows.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("_c"), F.count_if(F.col("_gap") > 7).alias("gaps"), F.count_if("_again").alias("duplicates"),
        F.count_if(F.abs(div(F.col("strength") - F.col("_m"), F.col("_s"))) > 3).alias("outliers"), (1 - div(F.stddev_pop(past), F.avg(past))).alias("stability"))
    steady = F.when(F.col("symbol").isNotNull() & (F.col("_c") >= 40), F.col("stability"))
    a = base.join(each.groupBy(*k).agg(*[F.sum(c).alias(c) for c in ("gaps", "duplicates", "outliers")], F.avg(steady).alias("stability")), k)
    zero = lambda c: check(c, F.col(c), F.col(c) == 0, 0, "critical")
    few = F.col("n") < 10
    balance = F.greatest(*[F.col(f"_{t}") for t in TYPES]) / F.col("n")
    rows = [zero(c) for c in ("incomplete", "bad_type", "bad_strength", "bad_confidence", "future")]
    rows += [check("gaps", F.col("gaps"), F.col("gaps") == 0, 7, "warning"), check("balance", balance, balance <= 0.8, 0.8, "warning"),
             check("duplicates", F.col("duplicates"), F.col("duplicates") == 0, 0, "warning"),
             check("outliers", F.col("outliers"), few | (F.col("outliers") == 0), 3, "warning"),
             check("confidence_correlation", F.when(~few, F.col("_corr")), few | (F.col("_corr") >= 0.3), 0.3, "warning"),
             check("signal_stability", F.col("stability"), F.coalesce(F.col("stability") >= 0.7, F.lit(True)), 0.7, "warning")]
    return a.select(*k, F.inline(F.array(*rows)))


def validation_score(checks: DataFrame) -> DataFrame:
    """Share of passed rules; a critical one counts twice, a failed warning still counts half."""
    critical = F.col("weight") == "critical"
    w = F.when(critical, 2.0).otherwise(1.0)
    got = F.when(F.col("passed"), w).when(~critical, 0.5).otherwise(0.0)
    return checks.groupBy("strategy").agg((F.sum(got) / F.sum(w)).alias("score"), F.count_if(~F.col("passed")).alias("failed"))


# ---- bias rules over one row of backtest facts per strategy ---------------------------------------------------------------
# Fixed values: (bias, severity, fact, comparison, limit, penalty).
BIAS_RULES = (
    ("data_snooping", "high", "configurations", ">", 50, 3), ("short_sample", "medium", "days", "<", 365, 2),
    ("benign_market", "medium", "market_drawdown", ">", -0.10, 2), ("high_sharpe", "high", "sharpe", ">", 3.0, 3),
    ("overfitting", "high", "parameter_ratio", ">", 0.01, 3), ("win_rate", "high", "win_rate", ">", 0.95, 3),
    ("instability", "medium", "return_cv", ">", 2.0, 2), ("insignificant", "medium", "p_value", ">", 0.05, 2),
    ("few_trades", "medium", "trades", "<", 30, 2),
)


# Round parameter values.
ROUND_VALUES = (5, 10, 15, 20, 25, 30, 50, 100, 200)


def round_parameters(parameters: DataFrame, key="strategy") -> DataFrame:
    """Findings for parameters (key, parameter, value) that are round numbers, perhaps picked by hand."""
    return parameters.where(F.col("value").isin(*[float(v) for v in ROUND_VALUES])).select(
        key, F.concat(F.lit("round_"), "parameter").alias("bias"), F.lit("low").alias("severity"), "value", F.lit(None).cast("double").alias("limit"), F.lit(1).alias("penalty"))


def bias_findings(facts: DataFrame, key="strategy", rules=BIAS_RULES) -> DataFrame:
    hits = []
    for bias, severity, fact, op, limit, penalty in rules:
        v = F.col(fact).cast("double")
        hits.append(F.when((v > limit) if op == ">" else (v < limit), F.struct(
            F.lit(bias).alias("bias"), F.lit(severity).alias("severity"), v.alias("value"), F.lit(float(limit)).alias("limit"),
            F.lit(penalty).alias("penalty"))))
    return facts.select(key, F.inline(F.array_compact(F.array(*hits))))


def bias_score(findings: DataFrame, key="strategy") -> DataFrame:
    return findings.groupBy(key).agg(F.sum("penalty").alias("risk_score"), F.count(F.lit(1)).alias("findings"))
