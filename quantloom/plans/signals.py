"""Signals, aggregation, backtests, orders and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.stats import student_tail
from quantloom.operators import backtest as BT, metrics as M, signals as S
from quantloom.plans import query
from quantloom.plans.indicators import MACD, rsi
from quantloom.plans.joins import TRADES, ASOF_B, ASOF_F, NEAR
from quantloom.plans.kit import (ASSET, DAILY, MARKET, META, B, O, U, W, dv, lag, pct, pick, result, rnd, roll, rounded, steps, with_)
from quantloom.plans.metrics import student
from quantloom.plans.tables import FILLS, FW, costed_fills
from quantloom.sources import tables as T

VOTE = rsi(14) + MACD + [("mom", pct("close", 10)), ("tot", "CASE WHEN coalesce(mom > 0, FALSE) THEN 4 ELSE -4 END + CASE WHEN rsi < 30 THEN 3 WHEN rsi > 70 THEN -3 ELSE 0 END + CASE WHEN coalesce(macd > signal, FALSE) THEN 3 ELSE -3 END"),
                         ("sig", "CASE WHEN tot > 5 THEN 1 WHEN tot < -5 THEN -1 ELSE 0 END")]


@query("vote_signals", with_(DAILY, steps("daily", VOTE), body="SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, CAST(sig AS DOUBLE) AS signal FROM final"))
def vote_signals(spark, sf_dir):
    return result(S.vote_signals(T.daily_bars(spark, sf_dir)), ["signal"], 1)


@query("lagged_backtest", with_(DAILY, steps("daily", VOTE + [("pr", f"({pct('close')}) * {lag('sig')}")]), body=f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(pr) AS n, {rnd('avg(pr)', 5, 'ret')},
  {rnd('coalesce(sum(pr), 0) / count(*)', 5, 'ret_all')} FROM final GROUP BY ts"""))
def lagged_backtest(spark, sf_dir):
    return result(S.lagged_backtest(S.vote_signals(T.daily_bars(spark, sf_dir))), ["ret", "ret_all"], 5, keys=("n",))


AGREE = "len(list_filter(v, lambda y: y * x > 0)) / len(v)"
MA = steps("daily", [("sh", roll("avg", "close", 10)), ("lo", roll("avg", "close", 30)), ("x", dv("sh - lo", "lo")), ("v", f"list(coalesce(x, 0)) OVER {B(-5, 0)}"),
    ("signal_type", "CASE WHEN x > 0.02 THEN 'BUY' WHEN x < -0.02 THEN 'SELL' ELSE 'HOLD' END"), ("strength", "CASE WHEN abs(x) > 0.02 THEN greatest(least(x / 0.02, 1), -1) ELSE 0 END"), ("confidence", AGREE)], prefix="a")
RS = steps("daily", rsi(14) + [("signal_type", "CASE WHEN rsi < 30 THEN 'BUY' WHEN rsi > 70 THEN 'SELL' ELSE 'HOLD' END"),
    ("strength", "CASE WHEN rsi < 30 THEN (30 - rsi) / 30 WHEN rsi > 70 THEN -(rsi - 70) / 30 ELSE 0 END"), ("confidence", "CASE WHEN rsi < 30 THEN least((30 - rsi) / 20, 1) WHEN rsi > 70 THEN least((rsi - 70) / 20, 1) ELSE 0.5 END")], prefix="b")
MO = steps("daily", [("x", pct("close", 20)), ("v", f"list(coalesce(x, 0)) OVER {B(-5, 0)}"), ("signal_type", "CASE WHEN x > 0.05 THEN 'BUY' WHEN x < -0.05 THEN 'SELL' ELSE 'HOLD' END"),
    ("strength", "CASE WHEN abs(x) > 0.05 THEN greatest(least(x / 0.05, 1), -1) ELSE 0 END"), ("confidence", AGREE)], prefix="c")
SIG = """sig AS (SELECT 'moving_average' AS strategy, symbol, ts, signal_type, strength, confidence FROM afinal WHERE rn > 30 AND x IS NOT NULL UNION ALL SELECT 'rsi', symbol, ts, signal_type, strength, confidence FROM bfinal WHERE rn > 14 AND rsi IS NOT NULL
  UNION ALL SELECT 'momentum', symbol, ts, signal_type, strength, confidence FROM cfinal WHERE rn > 20 AND x IS NOT NULL)"""
STRAT = (DAILY, MA, RS, MO, SIG)
WTS = {"moving_average": 0.5, "rsi": 0.3, "momentum": 0.2}
SW = "sgw AS (SELECT *, CASE strategy WHEN 'moving_average' THEN 0.5 WHEN 'rsi' THEN 0.3 ELSE 0.2 END::DOUBLE AS w FROM sig)"
SK, SVV = ("symbol", "signal_type"), ["strength", "confidence"]


def all_signals(spark, sf_dir):
    return S.strategy_signals(T.daily_bars(spark, sf_dir))


@query("strategy_signals", with_(*STRAT, body=pick(SVV, 5, keys=("strategy", *SK), source="sig")))
def strategy_signals(spark, sf_dir):
    return result(all_signals(spark, sf_dir), SVV, 5, keys=("strategy", *SK))


@query("long_flat_signals", with_(DAILY, steps("daily", [("m", roll("avg", "close", 20))]), body="SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN coalesce(close > m, FALSE) AND volume % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS signal FROM final"))
def long_flat_signals(spark, sf_dir):
    bars = T.daily_bars(spark, sf_dir)
    pred = bars.select("symbol", "ts", F.when(F.col("volume") % 2 == 0, 1).otherwise(0).alias("signal"))
    return result(S.long_flat_signals(bars, pred), ["signal"], 1)


@query("prediction_signals", with_(DAILY, steps("daily", [("y", f"avg(close) OVER {W(5)}"), ("e", dv("y - close", "close"))]), body=f"SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN e > 0.02 THEN 'BUY' WHEN e < -0.02 THEN 'SELL' ELSE 'HOLD' END AS signal_type, {rnd('e', 5, 'expected')} FROM final"))
def prediction_signals(spark, sf_dir):
    from quantloom.operators.series import Series
    s = Series(T.daily_bars(spark, sf_dir).select("symbol", "ts", "close"))
    pred = s.frame({"y_pred": F.avg("close").over(s.last_rows(5))}).withColumnRenamed("close", "price")
    return result(S.prediction_signals(pred), ["expected"], 5, keys=SK)


CUT = "CASE WHEN strength > 0.1 THEN 'BUY' WHEN strength < -0.1 THEN 'SELL' ELSE 'HOLD' END"
AGG = {
    "weighted_average": "SELECT symbol, ts, sum(w * strength) AS strength, sum(w * confidence) AS confidence FROM sgw GROUP BY 1, 2 HAVING sum(w) > 0",
    "confidence_weighted": "SELECT symbol, ts, sum(w * confidence * strength) / sum(w * confidence) AS strength, sum(w * confidence) / count(*) AS confidence FROM sgw GROUP BY 1, 2 HAVING sum(w * confidence) > 0",
    "rank_based": "SELECT symbol, ts, sum(rw * strength) / sum(rw) AS strength, sum(rw * confidence) / sum(rw) AS confidence FROM (SELECT *, w / row_number() OVER (PARTITION BY symbol, ts ORDER BY abs(strength) DESC, strategy) AS rw FROM sgw) GROUP BY 1, 2 HAVING sum(rw) > 0",
}
VOTES = """vt AS (SELECT symbol, ts, coalesce(sum(w) FILTER (signal_type = 'BUY'), 0) AS b, coalesce(sum(w) FILTER (signal_type = 'SELL'), 0) AS s, coalesce(sum(w) FILTER (signal_type = 'HOLD'), 0) AS h, sum(w * confidence) / count(*) AS confidence FROM sgw GROUP BY 1, 2),
mv AS (SELECT symbol, ts, CASE WHEN b = greatest(b, s, h) THEN 'BUY' WHEN s = greatest(b, s, h) THEN 'SELL' ELSE 'HOLD' END AS signal_type, greatest(b, s, h) - list_sort([b, s, h])[2] AS strength, confidence FROM vt)"""
for _name in AGG:
    def _agg(spark, sf_dir, name=_name):
        return result(getattr(S, name)(S.with_weights(all_signals(spark, sf_dir), WTS)), SVV, 5, keys=SK)
    query(f"aggregate_{_name}", with_(*STRAT, SW, f"g AS (SELECT *, {CUT} AS signal_type FROM ({AGG[_name]}))", body=pick(SVV, 5, keys=SK, source="g")))(_agg)


@query("aggregate_majority_vote", with_(*STRAT, SW, VOTES, body=pick(SVV, 5, keys=SK, source="mv")))
def aggregate_majority_vote(spark, sf_dir):
    return result(S.majority_vote(S.with_weights(all_signals(spark, sf_dir), WTS)), SVV, 5, keys=SK)


@query("aggregate_ensemble", with_(*STRAT, SW, VOTES, f"""en AS (SELECT symbol, ts, avg(strength) AS strength, avg(confidence) AS confidence FROM (SELECT symbol, ts, strength, confidence FROM ({AGG['weighted_average']})
  UNION ALL SELECT symbol, ts, strength, confidence FROM mv UNION ALL SELECT symbol, ts, strength, confidence FROM ({AGG['confidence_weighted']})) GROUP BY 1, 2)""", f"g AS (SELECT *, {CUT} AS signal_type FROM en)", body=pick(SVV, 5, keys=SK, source="g")))
def aggregate_ensemble(spark, sf_dir):
    return result(S.ensemble(S.with_weights(all_signals(spark, sf_dir), WTS)), SVV, 5, keys=SK)


def stats(spark, sf_dir):
    """Deviation of the strength, mean and Sharpe of the pay-off strength x next change per strategy."""
    return all_signals(spark, sf_dir).groupBy("strategy").agg(
        F.stddev_pop("strength").alias("deviation"), F.avg("strength").alias("ret"), (F.avg("strength") / F.stddev_samp("strength")).alias("sharpe"))


STATS = "stt AS (SELECT strategy, stddev_pop(strength) AS deviation, avg(strength) AS ret, avg(strength) / stddev_samp(strength) AS sharpe FROM sig GROUP BY 1)"


def share(x):
    return f"coalesce({x} / nullif(sum({x}) OVER (), 0), 1.0 / count(*) OVER ())"


RAW = {"equal": "1.0", "volatility": "1 / greatest(deviation, 0.01)", "performance": "greatest(ret, 0)", "sharpe": "greatest(sharpe, 0)"}
SCHEMES = [*RAW, "adaptive"]


@query("strategy_weights", with_(*STRAT, STATS, "g AS (" + " UNION ALL ".join(f"SELECT '{k}' AS scheme, strategy, {share(v)} AS w FROM stt" for k, v in RAW.items())
    + f" UNION ALL SELECT 'adaptive', strategy, ({share(RAW['volatility'])} + {share(RAW['performance'])} + {share(RAW['sharpe'])}) / 3 FROM stt)", body=pick(["w"], 5, keys=("scheme", "strategy"), ts=None, source="g")))
def strategy_weights(spark, sf_dir):
    st = stats(spark, sf_dir)
    out = [S.strategy_weights(st, k).withColumn("scheme", F.lit(k)) for k in SCHEMES]
    df = out[0]
    for o in out[1:]:
        df = df.unionByName(o)
    return result(df, ["w"], 5, keys=("scheme", "strategy"), ts=None)


@query("signal_stability", with_(*STRAT, "m AS (SELECT strategy, symbol, avg(abs(strength)) OVER (PARTITION BY strategy, symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS m, row_number() OVER (PARTITION BY strategy, symbol ORDER BY ts) AS rn FROM sig)",
    body=f"SELECT strategy, symbol, {rnd('1 - stddev_pop(m) / nullif(avg(m), 0)', 5, 'stability')} FROM m WHERE rn > 10 GROUP BY 1, 2"))
def signal_stability(spark, sf_dir):
    from quantloom.operators.rolling import signal_stability as stab
    return result(stab(all_signals(spark, sf_dir), keys=("strategy", "symbol")), ["stability"], 5, keys=("strategy", "symbol"), ts=None)


RULES = [("incomplete", "incomplete", 0, "critical", "incomplete = 0"), ("bad_type", "0", 0, "critical", "TRUE"), ("bad_strength", "bs", 0, "critical", "bs = 0"), ("bad_confidence", "bc", 0, "critical", "bc = 0"),
         ("future", "fu", 0, "critical", "fu = 0"), ("gaps", "gaps", 7, "warning", "gaps = 0"), ("balance", "bal", 0.8, "warning", "bal <= 0.8"), ("duplicates", "0", 0, "warning", "TRUE"), ("outliers", "outl", 3, "warning", "n < 10 OR outl = 0"),
         ("confidence_correlation", "CASE WHEN n >= 10 THEN conf END", 0.3, "warning", "coalesce(n < 10 OR conf >= 0.3, FALSE)"),
         ("signal_stability", "stab", 0.7, "warning", "coalesce(stab >= 0.7, TRUE)")]
VAL = ("""sm AS (SELECT *, avg(strength) OVER (PARTITION BY strategy) AS m, stddev_pop(strength) OVER (PARTITION BY strategy) AS sd, date_diff('day', lag(ts) OVER (PARTITION BY strategy, symbol ORDER BY ts), ts) AS gap FROM sig)""",
    """fx0 AS (SELECT a.strategy, count(*) FILTER (a.strength IS NULL OR a.confidence IS NULL) AS incomplete, count(*) FILTER (abs(a.strength) > 1) AS bs, count(*) FILTER (a.confidence < 0 OR a.confidence > 1) AS bc,
  count(*) FILTER (a.ts > (SELECT max(o_orderdate) FROM orders)) AS fu, count(*) FILTER (gap > 7) AS gaps, greatest(count(*) FILTER (a.signal_type = 'BUY'), count(*) FILTER (a.signal_type = 'SELL'), count(*) FILTER (a.signal_type = 'HOLD')) / count(*) AS bal,
  count(*) FILTER (abs((a.strength - m) / nullif(sd, 0)) > 3) AS outl, count(*) AS n,
  covar_pop(abs(a.strength), a.confidence) / nullif(stddev_pop(abs(a.strength)) * stddev_pop(a.confidence), 0) AS conf FROM sm a GROUP BY 1)""",
    """sb0 AS (SELECT strategy, symbol, avg(abs(strength)) OVER (PARTITION BY strategy, symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS m, row_number() OVER (PARTITION BY strategy, symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY strategy, symbol) AS c FROM sig)""",
    "sb AS (SELECT strategy, avg(stability) AS stab FROM (SELECT strategy, symbol, 1 - stddev_pop(m) / nullif(avg(m), 0) AS stability FROM sb0 WHERE rn > 10 AND c >= 40 GROUP BY 1, 2) GROUP BY 1)",
    "fx AS (SELECT fx0.*, stab FROM fx0 LEFT JOIN sb USING (strategy))",
    "ck AS (" + " UNION ALL ".join(f"SELECT strategy, '{n}' AS rule, {v}::DOUBLE AS value, {t}::DOUBLE AS threshold, '{w}' AS weight, {p} AS passed FROM fx" for n, v, t, w, p in RULES) + ")")


def checks(spark, sf_dir):
    sig = all_signals(spark, sf_dir)
    data_end = T.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"))
    return S.validate_signals(sig, data_end)


@query("signal_validation", with_(*STRAT, *VAL, body=pick(["value"], 5, keys=("strategy", "rule", "threshold", "weight", "passed"), ts=None, source="ck")))
def signal_validation(spark, sf_dir):
    return result(checks(spark, sf_dir), ["value"], 5, keys=("strategy", "rule", "threshold", "weight", "passed"), ts=None)


@query("signal_validation_score", with_(*STRAT, *VAL, body=f"""SELECT strategy, {rnd("sum(CASE WHEN passed THEN CASE weight WHEN 'critical' THEN 2 ELSE 1 END WHEN weight = 'critical' THEN 0 ELSE 0.5 END) / sum(CASE weight WHEN 'critical' THEN 2 ELSE 1 END)", 6, 'score')}, count(*) FILTER (NOT passed) AS failed FROM ck GROUP BY 1"""))
def signal_validation_score(spark, sf_dir):
    return result(S.validation_score(checks(spark, sf_dir)), ["score"], keys=("strategy", "failed"), ts=None)


MDD = """mp AS (SELECT ts, product(1 + bench) OVER (ORDER BY ts) AS g FROM market), mdd AS (SELECT g / max(g) OVER (ORDER BY ts) - 1 AS dd FROM mp),
pm AS (SELECT s_suppkey AS strategy, 'period' AS parameter, (s_suppkey % 50 + 5)::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 'holding', (s_suppkey % 13 + 5)::DOUBLE FROM supplier)"""
FACTS = MDD + """, fc0 AS (SELECT symbol AS strategy, symbol % 90 AS configurations, date_diff('day', min(ts), max(ts)) AS days, (SELECT min(dd) FROM mdd) AS market_drawdown, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, 5.0 / count(*) AS parameter_ratio,
  avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, abs(stddev_samp(ret) / nullif(avg(ret), 0)) AS return_cv, count(*) FILTER (ret <> 0) AS trades, count(*) - 1 AS dof, avg(ret) / nullif(stddev_samp(ret) / sqrt(count(*)), 0) AS t FROM asset GROUP BY symbol),
fc AS (SELECT *, CASE WHEN dof >= 30 THEN """ + student("t", "dof") + """ END AS p_value FROM fc0)"""
BF = "bf AS (" + " UNION ALL ".join(f"SELECT strategy, '{b}' AS bias, '{s}' AS severity, {f}::DOUBLE AS value, {l}::DOUBLE AS lim, {p} AS penalty FROM fc WHERE {f} {op} {l}" for b, s, f, op, l, p in S.BIAS_RULES) + " UNION ALL SELECT strategy, 'round_' || parameter, 'low', value, NULL, 1 FROM pm WHERE value IN (5, 10, 15, 20, 25, 30, 50, 100, 200))"


def bias(spark, sf_dir):
    r = T.asset_returns(spark, sf_dir)
    facts = r.groupBy(F.col("symbol").alias("strategy")).agg(
        (F.max("symbol") % 90).alias("configurations"), F.datediff(F.max("ts"), F.min("ts")).alias("days"), 
        (F.avg("ret") / F.stddev_samp("ret") * 252 ** 0.5).alias("sharpe"), (5.0 / F.count(F.lit(1))).alias("parameter_ratio"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.abs(F.try_divide(F.stddev_samp("ret"), F.avg("ret"))).alias("return_cv"), F.count_if(F.col("ret") != 0).alias("trades"),
        (F.count(F.lit(1)) - 1).alias("_dof"), F.try_divide(F.avg("ret"), F.stddev_samp("ret") / F.sqrt(F.count(F.lit(1)))).alias("_t"))
    market = M.with_drawdown(T.market_returns(spark, sf_dir).select(F.lit("market").alias("symbol"), "ts", F.col("bench").alias("ret")), ["symbol"])
    facts = facts.join(F.broadcast(market.agg(F.min("drawdown").alias("market_drawdown"))), F.lit(True))
    facts = facts.withColumn("p_value", F.when(F.col("_dof") >= 30, student_tail("_t", F.col("_dof"))))
    symbols = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("strategy"))
    parameters = symbols.select("strategy", F.inline(F.array(*[F.struct(F.lit(n).alias("parameter"), (F.col("strategy") % m + 5).cast("double").alias("value")) for n, m in (("period", 50), ("holding", 13))])))
    return S.bias_findings(facts).unionByName(S.round_parameters(parameters))


@query("bias_findings", with_(ASSET, MARKET, FACTS, BF, body=pick(["value"], 5, keys=("strategy", "bias", "severity"), ts=None, source="bf")))
def bias_findings(spark, sf_dir):
    return result(bias(spark, sf_dir), ["value"], 5, keys=("strategy", "bias", "severity"), ts=None)


@query("bias_score", with_(ASSET, MARKET, FACTS, BF, body="SELECT strategy, CAST(sum(penalty) AS BIGINT) AS risk_score, count(*) AS findings FROM bf GROUP BY 1"))
def bias_score(spark, sf_dir):
    return S.bias_score(bias(spark, sf_dir))


@query("signal_log_value", with_(*STRAT, body=f"SELECT strategy, symbol, strftime(ts, '%Y-%m-%d') AS day, {rnd('product(1 + 0.01 * strength) OVER (PARTITION BY strategy, symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)', 5, 'value')} FROM sig"))
def signal_log_value(spark, sf_dir):
    return result(BT.signal_log_value(all_signals(spark, sf_dir)), ["value"], 5, keys=("strategy", "symbol"))


# ---- orders and costs: every line is an order placed on its order date -------------------------------------------------------
ORD = """ord AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS symbol, o_orderdate AS ts, CASE l_linenumber % 4 WHEN 0 THEN 'MARKET' WHEN 1 THEN 'LIMIT' WHEN 2 THEN 'STOP' ELSE 'STOP_LIMIT' END AS order_type, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
  l_quantity * 2000 AS qty, l_extendedprice / 20 AS price, l_extendedprice / 20 * CASE WHEN l_returnflag = 'R' THEN 1.2 ELSE 0.8 END AS stop_price
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
OK3 = ("k", "n", "p", "symbol")


def order_rows(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("ts"))
    x = F.col("l_extendedprice") / 20
    sell = F.col("l_returnflag") == "R"
    kinds = F.array(*[F.lit(t) for t in ("MARKET", "LIMIT", "STOP", "STOP_LIMIT")])
    return T.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("symbol"),
        F.get(kinds, F.col("l_linenumber") % 4).alias("order_type"), F.when(sell, "SELL").otherwise("BUY").alias("side"), (F.col("l_quantity") * 2000).alias("qty"),
        x.alias("price"), (x * F.when(sell, 1.2).otherwise(0.8)).alias("stop_price")).join(o, "k")


BAND = """(order_type = 'MARKET' OR (order_type = 'LIMIT' AND side = 'BUY' AND close <= price) OR (order_type = 'LIMIT' AND side = 'SELL' AND close >= price) OR (order_type = 'STOP' AND side = 'BUY' AND close >= stop_price)
  OR (order_type = 'STOP' AND side = 'SELL' AND close <= stop_price) OR (order_type = 'STOP_LIMIT' AND side = 'BUY' AND close >= stop_price AND close <= price) OR (order_type = 'STOP_LIMIT' AND side = 'SELL' AND close <= stop_price AND close >= price))"""


@query("order_triggers", with_(DAILY, TRADES, ORD, f"h AS (SELECT o.k, o.n, o.p, o.symbol, o.qty, o.price, any_value(order_type) AS order_type, any_value(side) AS side, min(d.ts) AS fts, arg_min(close, d.ts) AS c FROM ord o JOIN daily d ON d.symbol = o.symbol AND d.ts > o.ts AND {BAND} GROUP BY ALL)",
    body=f"SELECT k, n, p, symbol, strftime(fts, '%Y-%m-%d') AS day, {rnd('''CASE WHEN order_type IN ('LIMIT', 'STOP_LIMIT') THEN CASE WHEN side = 'BUY' THEN least(c, price) ELSE greatest(c, price) END ELSE c END''', 4, 'fill_price')} FROM h"))
def order_triggers(spark, sf_dir):
    return result(BT.first_executions(order_rows(spark, sf_dir), T.daily_bars(spark, sf_dir), (*OK3, "qty", "price")), ["fill_price"], 4, keys=OK3, ts="fill_ts")


@query("order_fill_steps", """WITH RECURSIVE q AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS symbol, l_quantity * 2000 AS rest, 0 AS step FROM lineitem
  UNION ALL SELECT k, n, p, symbol, rest / 2, step + 1 FROM q WHERE rest > 10000)
SELECT k, n, p, symbol, CAST(step AS BIGINT) AS step, CASE WHEN rest > 10000 THEN rest / 2 ELSE rest END AS fill_qty FROM q""")
def order_fill_steps(spark, sf_dir):
    return BT.fill_steps(order_rows(spark, sf_dir)).select(*OK3, "step", "fill_qty")


VOLS = steps("daily", [("r", pct("close")), ("vol", f"stddev_samp(r) OVER {W(20)} * sqrt(252)")], prefix="v")
CB = ASOF_B.replace("daily", "vfinal").replace("d.close AS bc", "d.vol AS bc")
CF = ASOF_F.replace("daily", "vfinal").replace("d.close AS fc", "d.vol AS fc")
CC = ["commission", "spread_cost", "impact_cost", "slippage", "total_cost"]


@query("fill_costs", with_(DAILY, TRADES, ORD, VOLS, CB, CF, f"nv AS (SELECT *, {NEAR.format(f='fc', b='bc')} AS near_vol FROM f)", f"j AS (SELECT o.k, o.n, o.p, o.symbol, o.side, o.qty / 2000 AS q, o.price * 20 / (o.qty / 2000) AS px, coalesce(near_vol, 0.2) AS v FROM ord o JOIN (SELECT DISTINCT k, n, p, symbol, near_vol FROM nv) f ON f.k = o.k AND f.n = o.n AND f.p = o.p AND f.symbol = o.symbol)",
    """c AS (SELECT *, least(greatest(q * 0.005, q * px * 0.001, 1), 50) AS commission, q * px * floor(5 * (1 + v)) / 10000 * 0.5 AS spread_cost,
  q * px * 0.1 * pow(q / 1e6, 0.6) * (1 + 0.5 * v) * CASE WHEN side = 'SELL' THEN 1.1 ELSE 1 END / 100 AS impact_cost, q * px * 2 * (1 + v) / 10000 AS slippage FROM j)""",
    "e AS (SELECT *, commission + spread_cost + impact_cost + slippage AS total_cost FROM c)", body=pick(CC, 3, keys=OK3, ts=None, source="e")))
def fill_costs(spark, sf_dir):
    fills = order_rows(spark, sf_dir).withColumn("qty", F.col("qty") / 2000).withColumn("price", F.col("price") * 20 / F.col("qty"))
    return result(BT.fill_costs(fills, T.daily_bars(spark, sf_dir)), CC, 3, keys=OK3, ts=None)


@query("position_sizes", with_(*STRAT, f"""j AS (SELECT s.*, close, CASE signal_type WHEN 'BUY' THEN least(least(1e6 * abs(strength) * confidence, 1e5) / close, 5e4 / close) WHEN 'SELL' THEN least(least(1e6 * abs(strength) * confidence, 1e5) / close, volume) ELSE least(1e6 * abs(strength) * confidence, 1e5) / close END AS shares
  FROM sig s JOIN daily USING (symbol, ts))""", body=pick(["shares"], 4, keys=("strategy", "symbol"), source="j")))
def position_sizes(spark, sf_dir):
    bars = T.daily_bars(spark, sf_dir)
    j = S.strategy_signals(bars).join(bars.select("symbol", "ts", "close", "volume"), ["symbol", "ts"])
    size = BT.position_size(F.lit(1e6), F.col("close"), F.col("strength"), F.col("confidence"), F.lit(5e4), F.col("volume"), F.col("signal_type"))
    return result(j.withColumn("shares", size), ["shares"], 4, keys=("strategy", "symbol"))


# ---- positions and values: the lines of a sector are the fills of its portfolio, returned lines are sales --------------------
SFILL = """sf AS (SELECT sector AS portfolio, symbol, l_shipdate AS ts, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS qty, l_extendedprice / l_quantity AS price FROM lineitem JOIN meta ON symbol = l_suppkey),
nt AS (SELECT portfolio, symbol, ts, sum(qty) AS q, sum(qty * price + 1) AS f FROM sf GROUP BY 1, 2, 3),
dy AS (SELECT portfolio, symbol, unnest(generate_series(f, t, INTERVAL 1 DAY)) AS ts FROM (SELECT portfolio, symbol, min(ts) AS f FROM nt GROUP BY 1, 2) JOIN (SELECT portfolio, max(ts) AS t FROM nt GROUP BY 1) USING (portfolio)),
gd AS (SELECT dy.portfolio, dy.symbol, dy.ts, sum(coalesce(q, 0)) OVER w AS held, last_value(close IGNORE NULLS) OVER w AS px, coalesce(f, 0) AS f FROM dy LEFT JOIN nt USING (portfolio, symbol, ts) LEFT JOIN daily ON daily.symbol = dy.symbol AND daily.ts = dy.ts WINDOW w AS (PARTITION BY dy.portfolio, dy.symbol ORDER BY dy.ts ROWS UNBOUNDED PRECEDING)),
vl AS (SELECT portfolio, ts, h AS holdings, 1e9 - sum(f) OVER (PARTITION BY portfolio ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cash FROM (SELECT portfolio, ts, sum(coalesce(held * px, 0)) AS h, sum(f) AS f FROM gd GROUP BY 1, 2)),
vv AS (SELECT *, cash + holdings AS total FROM vl)"""


def sector_fills(spark, sf_dir):
    q = F.col("l_quantity")
    lines = T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"), F.when(F.col("l_returnflag") == "R", -q).otherwise(q).alias("qty"), (F.col("l_extendedprice") / q).alias("price"))
    return lines.join(T.symbol_metadata(spark, sf_dir).select("symbol", F.col("sector").alias("portfolio")), "symbol").withColumn("cost", F.lit(1.0))


DV = ["holdings", "cash", "total"]


@query("daily_values", with_(DAILY, META, SFILL, body=pick(DV, 0, keys=("portfolio",), source="vv")))
def daily_values(spark, sf_dir):
    return result(BT.daily_values(sector_fills(spark, sf_dir), T.daily_bars(spark, sf_dir), 1e9), DV, 0, keys=("portfolio",))


PNL = ("fx AS (SELECT * FROM fills)", f"a AS (SELECT *, sum(qty) {FW} AS held, row_number() {FW} AS rn FROM fills)",
       "b AS (SELECT *, coalesce(sum(CASE WHEN held = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio, symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS leg FROM a)",
       "c AS (SELECT *, CASE WHEN held <> 0 THEN sum(qty * price) OVER (PARTITION BY portfolio, symbol, leg ORDER BY rn) / held END AS cost FROM b)",
       "d AS (SELECT *, CASE WHEN qty < 0 THEN -qty * (price - lag(cost) OVER (PARTITION BY portfolio, symbol ORDER BY rn)) END AS pnl FROM c)")


def pnl_rows(spark, sf_dir):
    return costed_fills(spark, sf_dir)


PM = ["win_rate", "profit_factor", "average_win", "average_loss", "largest_win", "largest_loss"]


@query("realized_trades", with_(FILLS, *PNL, body=f"""SELECT portfolio, count(*) AS trades, count(*) FILTER (pnl > 0) AS winning, count(*) FILTER (pnl < 0) AS losing, {rnd('sum(pnl)', 1, 'pnl')} FROM d GROUP BY 1"""))
def realized_trades(spark, sf_dir):
    return pnl_rows(spark, sf_dir).groupBy("portfolio").agg(F.count(F.lit(1)).alias("trades"), F.count_if(F.col("pnl") > 0).alias("winning"), F.count_if(F.col("pnl") < 0).alias("losing"), rounded(F.sum("pnl"), 1).alias("pnl"))


@query("backtest_result", with_(DAILY, META, SFILL, "en AS (SELECT portfolio, arg_max(total, ts) AS final_capital FROM vv GROUP BY 1)", "tr AS (SELECT portfolio, count(*) AS trades, count(*) FILTER (qty * price > 0) AS winning, count(*) FILTER (qty * price < 0) AS losing FROM sf GROUP BY 1)",
    body=f"SELECT portfolio, trades, winning, losing, {rnd('final_capital', 0)}, {rnd('final_capital / 1e9 - 1', 6, 'total_return')} FROM en JOIN tr USING (portfolio)"))
def backtest_result(spark, sf_dir):
    f = sector_fills(spark, sf_dir)
    v = BT.daily_values(f, T.daily_bars(spark, sf_dir), 1e9)
    out = BT.result_summary(v, f.withColumn("pnl", F.col("qty") * F.col("price")), 1e9)
    return out.select("portfolio", "trades", "winning", "losing", rounded("final_capital", 0).alias("final_capital"), rounded("total_return").alias("total_return"))
