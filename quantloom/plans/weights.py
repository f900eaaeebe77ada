"""Weights, risk decomposition, constraints and rebalancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import weights as W
from quantloom.plans import query
from quantloom.plans.joins import yw, year_weights
from quantloom.plans.kit import (ASSET, FACTORS, HOLDINGS, MARKET, META, pick, result, rnd, rounded, steps, with_)
from quantloom.plans.metrics import FC
from quantloom.plans.risk import ATTR, FIT, NM, POS, loadings, positions, simple
from quantloom.plans.rolling import ASSET_MARKET
from quantloom.sources import tables as T

PFK = ("portfolio",)
MEM = "mem AS (SELECT DISTINCT portfolio, symbol FROM holdings)"
simple("equal_weights", with_(HOLDINGS, "f AS (SELECT portfolio, symbol, 1.0 / count(*) OVER (PARTITION BY portfolio) AS w FROM holdings)", body=pick(["w"], 6, keys=("portfolio", "symbol"), ts=None, source="f")), ["w"], 6,
    lambda s, d: W.equal_weights(T.holdings(s, d).select("portfolio", "symbol")), ("portfolio", "symbol"))
simple("inverse_volatility_weights", with_(ASSET, HOLDINGS, "v AS (SELECT symbol, stddev_samp(ret) AS s FROM asset GROUP BY 1)", "f AS (SELECT portfolio, symbol, (1 / s) / sum(1 / s) OVER (PARTITION BY portfolio) AS w FROM holdings JOIN v USING (symbol))",
    body=pick(["w"], 6, keys=("portfolio", "symbol"), ts=None, source="f")), ["w"], 6, lambda s, d: W.inverse_volatility_weights(T.asset_returns(s, d), T.holdings(s, d).select("portfolio", "symbol")), ("portfolio", "symbol"))


# one problem per calendar year over the five regions
def problems(spark, sf_dir):
    f = T.factor_returns(spark, sf_dir).withColumn("problem", F.year("ts"))
    pairs = [(a, b) for a in FC for b in FC]
    g = f.groupBy("problem").agg(*[F.covar_samp(a, b).alias(f"c_{a}_{b}") for a, b in pairs], *[F.avg(a).alias(f"m_{a}") for a in FC])
    return g.select("problem", F.inline(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"c_{a}_{b}").alias("cov"), F.col(f"m_{a}").alias("mean"), F.lit(0.2).alias("w")) for a, b in pairs])))


def tilt(spark, sf_dir):
    p = problems(spark, sf_dir)
    return p.where("i = j").select("problem", F.col("i").alias("symbol"), (F.lit(0.1) + 0.05 * F.substring("i", 2, 1).cast("int")).alias("w"))


PR = "pr AS (" + " UNION ALL ".join(f"SELECT year(ts) AS problem, '{a}' AS i, '{b}' AS j, covar_samp({a}, {b}) AS cov FROM factors GROUP BY 1" for a in FC for b in FC) + ")"
RC = """tw AS (SELECT DISTINCT problem, i AS symbol, 0.1 + 0.05 * CAST(substr(i, 2, 1) AS INTEGER) AS w FROM pr), m AS (SELECT problem, i, sum(cov * w) AS m FROM pr JOIN tw USING (problem) WHERE j = symbol GROUP BY 1, 2),
rc AS (SELECT tw.problem, symbol, w, w * m / sum(w * m) OVER (PARTITION BY tw.problem) AS contribution, m / sqrt(sum(w * m) OVER (PARTITION BY tw.problem)) AS marginal, sqrt(sum(w * m) OVER (PARTITION BY tw.problem)) AS volatility FROM tw JOIN m ON m.problem = tw.problem AND i = symbol)"""
RV = ["w", "contribution", "marginal", "volatility"]
simple("risk_contributions", with_(META, FACTORS, PR, RC, body=pick(RV, 6, keys=("problem", "symbol"), ts=None, source="rc")), RV, 6, lambda s, d: W.risk_contributions(tilt(s, d), problems(s, d).select("problem", "i", "j", "cov")), ("problem", "symbol"))
RB = ["total_risk", "risk_concentration", "effective_bets", "largest", "smallest"]
simple("risk_budget", with_(META, FACTORS, PR, RC, "f AS (SELECT problem, max(volatility) AS total_risk, sum(contribution * contribution) AS risk_concentration, 1 / sum(contribution * contribution) AS effective_bets, max(contribution) AS largest, min(contribution) AS smallest FROM rc GROUP BY 1)",
    body=pick(RB, 5, keys=("problem",), ts=None, source="f")), RB, 5, lambda s, d: W.risk_budget(W.risk_contributions(tilt(s, d), problems(s, d).select("problem", "i", "j", "cov"))), ("problem",))
simple("optimal_weights", None, ["w"], 5, lambda s, d: W.optimal_weights(problems(s, d), risk_aversion=5.0), ("problem", "objective", "symbol"))
simple("efficient_frontier", None, ["target", "expected_return", "risk"], 6, lambda s, d: W.efficient_frontier(problems(s, d)), ("problem", "point"))
VIEWS = [{"asset": "f0", "expected_return": 0.02}, {"asset_a": "f1", "asset_b": "f2", "expected_outperformance": 0.001}, {"weights": {"f3": 0.5, "f4": 0.5}, "expected_return": 0.01}]
simple("black_litterman", None, ["prior", "posterior"], 8, lambda s, d: W.black_litterman(problems(s, d), VIEWS), ("problem", "symbol"))


def long_loadings(spark, sf_dir):
    return loadings(spark, sf_dir).select("symbol", F.inline(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"beta_{f}").alias("b")) for f in ("f0", "f1")])))


LOAD = "ld AS (SELECT symbol, 'f0' AS factor, beta_f0 AS b FROM ft UNION ALL SELECT symbol, 'f1', beta_f1 FROM ft)"
EX = "xp AS (SELECT portfolio, factor, sum(w * b) AS exposure FROM weights JOIN ld USING (symbol) GROUP BY 1, 2)"
simple("weight_factor_exposures", with_(META, ASSET, FACTORS, *FIT, HOLDINGS, LOAD, EX, body=pick(["exposure"], 6, keys=("portfolio", "factor"), ts=None, source="xp")), ["exposure"], 6,
    lambda s, d: W.factor_exposures(T.portfolio_weights(s, d), long_loadings(s, d), PFK), ("portfolio", "factor"))


def factor_shares(spark, sf_dir):
    ex = W.factor_exposures(T.portfolio_weights(spark, sf_dir), long_loadings(spark, sf_dir), PFK)
    from quantloom.operators.metrics import column_moments
    cov = column_moments(T.factor_returns(spark, sf_dir), ["f0", "f1"])[1]
    var = T.portfolio_weights(spark, sf_dir).groupBy("portfolio").agg((F.sum(F.col("w") * F.col("w")) * 0.001).alias("variance"))
    return W.factor_decomposition(ex, cov, var, PFK)


simple("weight_factor_decomposition", with_(META, ASSET, FACTORS, *FIT, HOLDINGS, LOAD, EX, "vr AS (SELECT portfolio, sum(w * w) * 0.001 AS variance FROM weights GROUP BY 1)", "fv AS (SELECT 'f0' AS factor, var_samp(f0) AS v FROM factors UNION ALL SELECT 'f1', var_samp(f1) FROM factors)",
    "sh AS (SELECT portfolio, factor, exposure * exposure * v / variance AS share FROM xp JOIN fv USING (factor) JOIN vr USING (portfolio))", "f AS (SELECT * FROM sh UNION ALL SELECT portfolio, 'specific', 1 - sum(share) FROM sh GROUP BY 1)",
    body=pick(["share"], 6, keys=("portfolio", "factor"), ts=None, source="f")), ["share"], 6, factor_shares, ("portfolio", "factor"))

# ---- constraints ------------------------------------------------------------------------------------------------------------
VV, VK = ["value", "limit", "excess"], ("portfolio", "constraint", "kind")
LIM = "greatest(1 - volatility * 0.1, 0.1) * 0.06"
simple("position_violations", with_(*POS, f"""f AS (SELECT portfolio, CAST(symbol AS VARCHAR) AS "constraint", 'position_min' AS kind, w AS value, 0.005 AS "limit", 0.005 - w AS excess FROM pos WHERE w < 0.005
  UNION ALL SELECT portfolio, CAST(symbol AS VARCHAR), 'position_max', w, {LIM}, w - {LIM} FROM pos WHERE w > {LIM})""", body=pick(VV, 6, keys=('portfolio', '"constraint"', 'kind'), ts=None, source="f").replace(" AS limit", ' AS "limit"').replace("CAST(limit", 'CAST("limit"')), VV, 6,
    lambda s, d: W.position_violations(positions(s, d), 0.005, 0.06, volatility_factor=0.1), VK)
simple("sector_violations", with_(*POS, """lm AS (SELECT * FROM (VALUES ('Technology', 0.05, 0.12, 0.8), ('Energy', 0.02, 0.10, 0.5), ('Utilities', 0.0, 0.08, 0.9)) t(sector, lo, hi, cr))""",
    """sx AS (SELECT p.portfolio, lm.sector, coalesce(sum(pos.w), 0) AS w, lo, hi * CASE WHEN cr > 0.7 THEN 1 - (cr - 0.7) * 0.5 ELSE 1 END AS hi FROM (SELECT DISTINCT portfolio FROM pos) p CROSS JOIN lm LEFT JOIN pos ON pos.portfolio = p.portfolio AND pos.sector = lm.sector GROUP BY ALL)""",
    """f AS (SELECT portfolio, sector AS "constraint", 'sector_min' AS kind, w AS value, lo AS "limit", lo - w AS excess FROM sx WHERE w < lo UNION ALL SELECT portfolio, sector, 'sector_max', w, hi, w - hi FROM sx WHERE w > hi)""",
    body=pick(VV, 6, keys=('portfolio', '"constraint"', 'kind'), ts=None, source="f").replace(" AS limit", ' AS "limit"').replace("CAST(limit", 'CAST("limit"')), VV, 6,
    lambda s, d: W.group_violations(positions(s, d), {"Technology": (0.05, 0.12), "Energy": (0.02, 0.10), "Utilities": (0.0, 0.08)}, correlations={"Technology": 0.8, "Energy": 0.5, "Utilities": 0.9}), VK)


def weight_pairs(spark, sf_dir):
    a, b = year_weights(spark, sf_dir, 1996, "current"), year_weights(spark, sf_dir, 1997, "target")
    return a.join(b, ["portfolio", "symbol"], "full_outer").fillna(0.0)


WP = (yw(1996, "current"), yw(1997, "target"), "wp AS (SELECT portfolio, symbol, coalesce(current, 0) AS current, coalesce(target, 0) AS target, coalesce(target, 0) - coalesce(current, 0) AS t FROM current FULL JOIN target USING (portfolio, symbol))")
TM = ["total_turnover", "one_way_turnover", "sell_turnover", "net_turnover", "largest_trade"]
TMQ = "tm AS (SELECT portfolio, sum(abs(t)) AS total_turnover, sum(greatest(t, 0)) AS one_way_turnover, sum(greatest(-t, 0)) AS sell_turnover, sum(t) AS net_turnover, max(abs(t)) AS largest_trade, count(*) FILTER (abs(t) > 1e-6) AS trades FROM wp GROUP BY 1)"
simple("turnover_metrics", with_(*WP, TMQ, body=pick(TM, 6, keys=("portfolio", "trades"), ts=None, source="tm")), TM, 6, lambda s, d: W.turnover_metrics(weight_pairs(s, d)), ("portfolio", "trades"))
simple("turnover_violations", with_(*WP, TMQ, """f AS (SELECT portfolio, 'turnover' AS "constraint", 'one_way_turnover' AS kind, one_way_turnover AS value, 0.8 AS "limit", one_way_turnover - 0.8 AS excess FROM tm WHERE one_way_turnover > 0.8)""",
    body=pick(VV, 6, keys=('portfolio', '"constraint"', 'kind'), ts=None, source="f").replace(" AS limit", ' AS "limit"').replace("CAST(limit", 'CAST("limit"')), VV, 6, lambda s, d: W.turnover_violations(weight_pairs(s, d), 0.8, one_way=True), VK)
# scores follow from the supplier key and balance
ESG = """es AS (SELECT s_suppkey AS symbol, (s_suppkey * 7 % 101)::DOUBLE AS esg, (s_suppkey * 11 % 101)::DOUBLE AS environmental, (s_suppkey * 13 % 101)::DOUBLE AS social, (s_suppkey * 17 % 101)::DOUBLE AS governance, s_acctbal AS carbon, (s_suppkey % 6)::DOUBLE AS controversy,
  s_suppkey % 3 = 0 AS green, s_suppkey % 50 = 1 AS excluded FROM supplier), em AS (SELECT portfolio, """ + ", ".join(f"sum(w * {c}) AS {c}" for c in W.ESG_SCORES) + ", sum(CASE WHEN green THEN w ELSE 0 END) AS green, sum(CASE WHEN excluded THEN w ELSE 0 END) AS excluded FROM weights JOIN es USING (symbol) GROUP BY 1)"
EV = [*W.ESG_SCORES, "green", "excluded"]


def esg_rows(spark, sf_dir):
    k = F.col("s_suppkey")
    e = T.table(spark, sf_dir, "supplier").select(k.alias("symbol"), *[(k * m % 101).cast("double").alias(n) for n, m in (("esg", 7), ("environmental", 11), ("social", 13), ("governance", 17))], F.col("s_acctbal").alias("carbon"),
                                                  (k % 6).cast("double").alias("controversy"), (k % 3 == 0).alias("green"), (k % 50 == 1).alias("excluded"))
    return T.portfolio_weights(spark, sf_dir).join(e, "symbol")


simple("esg_metrics", with_(HOLDINGS, ESG, body=pick(EV, 4, keys=PFK, ts=None, source="em")), EV, 4, lambda s, d: W.esg_metrics(esg_rows(s, d)), PFK)
simple("esg_violations", with_(HOLDINGS, ESG, """f AS (SELECT portfolio, 'esg' AS "constraint", 'esg_score' AS kind, esg AS value, 48.0 AS "limit", 48 - esg AS excess FROM em WHERE esg < 48 UNION ALL SELECT portfolio, 'esg', 'exclusions', excluded, 0, excluded FROM em WHERE excluded > 0
  UNION ALL SELECT portfolio, 'esg', 'carbon', carbon, 5000, carbon - 5000 FROM em WHERE carbon > 5000)""", body=pick(VV, 4, keys=('portfolio', '"constraint"', 'kind'), ts=None, source="f").replace(" AS limit", ' AS "limit"').replace("CAST(limit", 'CAST("limit"')), VV, 4,
    lambda s, d: W.esg_violations(W.esg_metrics(esg_rows(s, d)), 48.0, 5000.0), VK)
simple("leverage_and_top_violations", with_(HOLDINGS, "lw AS (SELECT portfolio, symbol, CASE WHEN symbol % 29 = 3 THEN -w ELSE w * 1.05 END AS w FROM weights)", "a AS (SELECT portfolio, sum(abs(w)) AS l, min(w) AS mn FROM lw GROUP BY 1)",
    "t AS (SELECT portfolio, sum(w) AS t FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY w DESC, symbol) AS k FROM lw) WHERE k <= 5 GROUP BY 1)",
    """f AS (SELECT portfolio, 'leverage' AS "constraint", 'leverage' AS kind, l AS value, 1.04 AS "limit", l - 1.04 AS excess FROM a WHERE l > 1.04 + 1e-6 UNION ALL SELECT portfolio, 'leverage', 'short', mn, 0, -mn FROM a WHERE mn < -1e-6
  UNION ALL SELECT portfolio, 'concentration', 'top_n', t, 0.4, t - 0.4 FROM t WHERE t > 0.4 + 1e-6)""", body=pick(VV, 6, keys=('portfolio', '"constraint"', 'kind'), ts=None, source="f").replace(" AS limit", ' AS "limit"').replace("CAST(limit", 'CAST("limit"')), VV, 6,
    lambda s, d: W.whole_violations(T.portfolio_weights(s, d).withColumn("w", F.when(F.col("symbol") % 29 == 3, -F.col("w")).otherwise(F.col("w") * 1.05)), 1.04, 5, 0.4), VK)

# market conditions: one row per day of the factor table
COND = """cd AS (SELECT strftime(ts, '%Y-%m-%d') AS day, abs(f0) * 10 AS volatility, abs(f1) * 10 AS stress, 1 - abs(f2) * 10 AS liquidity, CASE WHEN f3 > f4 THEN 'high' ELSE 'low' END AS correlation_regime FROM factors),
lt AS (SELECT * FROM (VALUES ('position', 0.1, 0.5), ('sector', 0.3, 0.5), ('turnover', 0.5, 0.5)) t(kind, lim, s))"""
simple("adjusted_limits", with_(META, FACTORS, COND, """f AS (SELECT day, kind, lim * CASE kind WHEN 'position' THEN greatest(0.5, 1 - stress * s) * CASE WHEN volatility > 0.3 THEN greatest(0.7, 1 - volatility * s * 0.5) ELSE 1 END
  WHEN 'sector' THEN CASE WHEN stress > 0.5 THEN greatest(0.7, 1 - stress * s * 0.3) ELSE 1 END * CASE WHEN correlation_regime = 'high' THEN 1 - s * 0.2 ELSE 1 END ELSE greatest(0.3, least(1 - volatility * s * 0.5, liquidity, 1 - stress * s * 0.3)) END AS adjusted FROM cd CROSS JOIN lt)""",
    body=pick(["adjusted"], 6, keys=("day", "kind"), ts=None, source="f")), ["adjusted"], 6, lambda s, d: W.adjusted_limits(
        s.createDataFrame([("position", 0.1, 0.5), ("sector", 0.3, 0.5), ("turnover", 0.5, 0.5)], "kind string, limit double, sensitivity double"),
        T.factor_returns(s, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.abs("f0") * 10).alias("volatility"), (F.abs("f1") * 10).alias("stress"), (1 - F.abs("f2") * 10).alias("liquidity"), F.when(F.col("f3") > F.col("f4"), "high").otherwise("low").alias("correlation_regime"))), ("day", "kind"))
RCV = ["turnover", "traded_value", "cost", "distance", "temporary_impact", "permanent_impact", "timing_risk", "opportunity_cost", "shortfall"]
RCD = {**dict.fromkeys(RCV, 6), "traded_value": 1}
simple("rebalance_costs", with_(*WP, """g AS (SELECT portfolio, sum(abs(t)) AS turnover, sum(t * t) AS sq FROM wp GROUP BY 1)""", """f AS (SELECT portfolio, turnover, turnover * 1e6 AS traded_value, 0.001 * turnover + 0.0001 * sq AS cost, sqrt(sq) AS distance, 0.0001 * turnover AS temporary_impact, 0.00005 * turnover AS permanent_impact,
  0.001 * turnover AS timing_risk, 0.001 * turnover AS opportunity_cost, 0.00215 * turnover AS shortfall FROM g)""", body=pick(RCV, RCD, keys=PFK, ts=None, source="f")), RCV, RCD, lambda s, d: W.rebalance_costs(weight_pairs(s, d), 1e6), PFK)
simple("rebalance_trades", with_(*WP, "f AS (SELECT portfolio, symbol, t AS trade, t * 1e6 AS trade_value, CASE WHEN t > 0 THEN 'BUY' WHEN t < 0 THEN 'SELL' ELSE 'HOLD' END AS side FROM wp)", body=pick(["trade", "trade_value"], {"trade": 6, "trade_value": 2}, keys=("portfolio", "symbol", "side"), ts=None, source="f")),
    ["trade", "trade_value"], {"trade": 6, "trade_value": 2}, lambda s, d: W.rebalance_trades(weight_pairs(s, d), 1e6), ("portfolio", "symbol", "side"))
VWV = ["total", "largest", "smallest"]
simple("validate_weights", with_(HOLDINGS, "x AS (SELECT portfolio, CASE WHEN symbol % 23 = 5 THEN w * 1.5 ELSE w END AS w FROM weights)", """f AS (SELECT portfolio, sum(w) AS total, count(*) FILTER (abs(w) > 1e-6) AS positions, max(w) AS largest, min(w) AS smallest, abs(sum(w) - 1) <= 0.01 AS is_valid, min(w) < 0 AS negative, max(w) > 0.5 AS concentrated,
  count(*) FILTER (abs(w) > 0 AND abs(w) < 0.01) > 0.3 * count(*) AS many_tiny FROM x GROUP BY 1)""", body=pick(VWV, 6, keys=("portfolio", "positions", "is_valid", "negative", "concentrated", "many_tiny"), ts=None, source="f")), VWV, 6,
    lambda s, d: W.validate_weights(T.portfolio_weights(s, d).withColumn("w", F.when(F.col("symbol") % 23 == 5, F.col("w") * 1.5).otherwise(F.col("w")))), ("portfolio", "positions", "is_valid", "negative", "concentrated", "many_tiny"))
