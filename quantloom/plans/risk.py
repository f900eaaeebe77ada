"""Value at risk, stress, liquidity, concentration and factor risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.stats import normal_density
from quantloom.operators import concentration as C, factor_risk as FR, joins as J, liquidity as L, metrics as M, risk as R, stress as S
from quantloom.operators.student import student_fit
from quantloom.plans import query
from quantloom.plans.joins import NAMES
from quantloom.plans.kit import (ASSET, DAILY, FACTORS, HOLDINGS, MARKET, META, B, W, dv, lag, pct, pick, result, rnd, roll, rounded, steps, with_)
from quantloom.plans.metrics import DRAW, FC, SECTOR_W, sector_portfolios
from quantloom.plans.rolling import ASSET_MARKET, asset_market
from quantloom.session import checkpointed
from quantloom.sources import tables as T

VALUE = 1_000_000.0
TAIL = "tl AS (SELECT symbol, ts, ret FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM asset) WHERE k <= 252 AND n >= 30)"
VC = ["var_95", "cvar_95", "var_99", "cvar_99"]


def simple(name, sql, values, digits, make, keys=("symbol",)):
    @query(name, sql)
    def run(spark, sf_dir):
        return result(make(spark, sf_dir), values, digits, keys=keys, ts=None)


simple("historical_var", with_(ASSET, TAIL, "q AS (SELECT symbol, quantile_cont(ret, 1 - 0.95) AS a, quantile_cont(ret, 1 - 0.99) AS b FROM tl GROUP BY symbol)",
    "f AS (SELECT symbol, -any_value(a) * 1e6 AS var_95, -avg(ret) FILTER (ret <= a) * 1e6 AS cvar_95, -any_value(b) * 1e6 AS var_99, -avg(ret) FILTER (ret <= b) * 1e6 AS cvar_99 FROM tl JOIN q USING (symbol) GROUP BY symbol)",
    body=pick(VC, 3, ts=None, source="f")), VC, 3, lambda s, d: R.historical_var(T.asset_returns(s, d), VALUE))
Z95, Z99 = 1.6448536269514722, 2.3263478740408408
simple("normal_var", with_(ASSET, TAIL, "m AS (SELECT symbol, avg(ret) AS m, stddev_samp(ret) AS s FROM tl GROUP BY symbol)",
    f"f AS (SELECT symbol, -(m - {Z95} * s) * 1e6 AS var_95, -(m - s * {normal_density(Z95)!r} / 0.05) * 1e6 AS cvar_95, -(m - {Z99} * s) * 1e6 AS var_99, -(m - s * {normal_density(Z99)!r} / 0.01) * 1e6 AS cvar_99 FROM m)",
    body=pick(VC, 3, ts=None, source="f")), VC, 3, lambda s, d: R.normal_var(T.asset_returns(s, d), VALUE))
simple("student_fit", None, ["dof", "location", "scale", "log_likelihood"], 5, lambda s, d: student_fit(T.asset_returns(s, d)), ("symbol", "n"))
simple("student_var", None, ["dof", *VC], 3, lambda s, d: R.student_var(T.asset_returns(s, d), VALUE))
simple("bootstrap_var", None, ["low", "high"], 4, lambda s, d: R.bootstrap_var(T.asset_returns(s, d), value=VALUE))

simple("component_var", with_(META, ASSET, SECTOR_W, "pr AS (SELECT portfolio, ts, sum(w * ret) AS r FROM asset JOIN sw USING (symbol) GROUP BY 1, 2)",
    "pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY ts DESC) AS k FROM pr) WHERE k <= 252)",
    "base AS (SELECT portfolio, -quantile_cont(r, 1 - 0.95) AS portfolio_var FROM pl GROUP BY portfolio)",
    "mv AS (SELECT pl.portfolio, sw.symbol, sw.w, -quantile_cont((pl.r + 0.001 * coalesce(asset.ret, 0)) / ((SELECT sum(w) FROM sw s2 WHERE s2.portfolio = pl.portfolio) + 0.001), 1 - 0.95) AS v FROM pl JOIN sw USING (portfolio) LEFT JOIN asset ON asset.symbol = sw.symbol AND asset.ts = pl.ts GROUP BY ALL)".replace(
        "(SELECT sum(w) FROM sw s2 WHERE s2.portfolio = pl.portfolio)", "1.0"),
    "f AS (SELECT portfolio, symbol, w, portfolio_var, (v - portfolio_var) / 0.001 * w AS component_var FROM mv JOIN base USING (portfolio))",
    body=pick(["w", "portfolio_var", "component_var"], 5, keys=("portfolio", "symbol"), ts=None, source="f")), ["w", "portfolio_var", "component_var"], 5,
    lambda s, d: R.component_var(checkpointed(T.asset_returns(s, d)), checkpointed(sector_portfolios(s, d))), ("portfolio", "symbol"))

PW = B(-60, -1)
NORMAL_TAIL = """1 - 2 * (z / 400) / 3 * list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(i * z / 400, 2) / 2) / sqrt(2 * pi())))"""
VB = ["violation_rate", "kupiec", "kupiec_p", "average_violation"]
simple("var_backtest", with_(ASSET, steps("asset", [("v", f"CASE WHEN rn > 60 THEN -(avg(ret) OVER {PW} - {Z95} * stddev_samp(ret) OVER {PW}) END"),
        ("hit", "CASE WHEN ret < -v THEN 1 ELSE 0 END"), ("st", f"CASE WHEN hit = 1 AND coalesce(CASE WHEN rn > 61 THEN {lag('hit')} END, 0) = 0 THEN 1 ELSE 0 END")]),
    "g AS (SELECT symbol, count(*)::DOUBLE AS n, sum(hit)::DOUBLE AS x, CAST(sum(st) AS BIGINT) AS clusters, coalesce(avg(ret) FILTER (hit = 1), 0) AS average_violation FROM final WHERE v IS NOT NULL GROUP BY symbol)",
    "h AS (SELECT *, x / n AS violation_rate, 2 * (x * ln(CASE WHEN x > 0 THEN x / n END / (1 - 0.95)) + (n - x) * ln(CASE WHEN x < n THEN 1 - x / n END / 0.95)) AS kupiec FROM g)",
    f"f AS (SELECT *, {NORMAL_TAIL} AS kupiec_p FROM (SELECT *, sqrt(greatest(kupiec, 0)) AS z FROM h))",
    body=pick(VB, 4, keys=("symbol", "clusters"), ts=None, source="f")), VB, 4,
    lambda s, d: R.var_backtest(T.asset_returns(s, d), R.rolling_normal_var(T.asset_returns(s, d))), ("symbol", "clusters"))

# ---- positions with attributes --------------------------------------------------------------------------------------
NM = "nm AS (SELECT unnest(range(0, 10)) AS i, unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) AS n)"
ATTR = """sym AS (SELECT symbol, covar_samp(ret, bench) / nullif(var_samp(bench), 0) AS beta, stddev_samp(ret) * sqrt(252) AS volatility FROM am GROUP BY symbol),
attr AS (SELECT s_suppkey AS symbol, n AS sector, r_name AS geography, CASE s_nationkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'JPY' END AS currency, beta, volatility, (s_nationkey % 7 + 1)::DOUBLE AS duration
  FROM supplier JOIN nm ON i = s_nationkey % 10 JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN sym ON symbol = s_suppkey),
pos AS (SELECT portfolio, symbol, value, qty, w, sector, geography, currency, beta, volatility, duration FROM weights JOIN attr USING (symbol))"""
POS = (ASSET, MARKET, ASSET_MARKET, HOLDINGS, NM, ATTR)


def attributes(spark, sf_dir, returns=None):
    n = F.col("s_nationkey")
    am = asset_market(spark, sf_dir) if returns is None else returns.join(T.market_returns(spark, sf_dir), "ts")
    sym = am.groupBy("symbol").agg((F.covar_samp("ret", "bench") / F.nullif(F.var_samp("bench"), F.lit(0.0))).alias("beta"), (F.stddev_samp("ret") * 252 ** 0.5).alias("volatility"))
    base = T.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("symbol"), F.get(F.array(*[F.lit(x) for x in NAMES]), n % 10).alias("sector"),
        F.get(F.array(F.lit("USD"), F.lit("EUR"), F.lit("JPY")), n % 3).alias("currency"), (n % 7 + 1).cast("double").alias("duration"))
    geo = T.symbol_metadata(spark, sf_dir).select("symbol", "geography")
    return base.join(geo, "symbol").join(sym, "symbol", "left")


def positions(spark, sf_dir):
    return T.portfolio_weights(spark, sf_dir).join(attributes(spark, sf_dir), "symbol")


def stored_positions(spark, sf_dir):
    """Positions written once to the shared folder, for operators that look at them from several sides."""
    return checkpointed(positions(spark, sf_dir).select("portfolio", "symbol", "w", "sector", "geography", "currency"))


# ---- stress --------------------------------------------------------------------------------------------------------
SCEN = [{"name": "crash", "market_shock": -0.4, "vol_mult": 3.0, "liquidity": 0.03}, {"name": "dip", "market_shock": -0.1, "vol_mult": 1.2, "liquidity": 0.01}]
SCEN_SQL = "sc AS (SELECT * FROM (VALUES ('crash', -0.4::DOUBLE, 3.0::DOUBLE, 0.03::DOUBLE), ('dip', -0.1, 1.2, 0.01)) t(scenario, market_shock, vol_mult, liquidity))"
SV = ["base_value", "stressed_value", "pnl", "pnl_percent"]


def pnl_sql(expr):
    return with_(*POS, SCEN_SQL, f"f0 AS (SELECT portfolio, scenario, sum(value) AS base_value, sum({expr}) AS pnl FROM pos CROSS JOIN sc GROUP BY 1, 2)",
                 "f AS (SELECT *, base_value + pnl AS stressed_value, 100 * pnl / base_value AS pnl_percent FROM f0)", body=pick(SV, 2, keys=("portfolio", "scenario"), ts=None, source="f"))


PS = ("portfolio", "scenario")
simple("stress_historical", pnl_sql("value * coalesce(beta, 1) * market_shock"), SV, 2, lambda s, d: S.historical_shock(positions(s, d), SCEN), PS)
simple("stress_custom", pnl_sql("value * market_shock - value * liquidity * w * 10 - value * volatility * (vol_mult - 1)"), SV, 2, lambda s, d: S.custom_shock(positions(s, d), SCEN), PS)
MULT = "CASE sector " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.SECTOR_MULTIPLIER.items()) + " ELSE 1.0 END"
simple("stress_sector_impacts", with_(*POS, SCEN_SQL, f"f AS (SELECT portfolio, sector, scenario, sum(value) * any_value(market_shock) * any_value(vol_mult) * any_value({MULT}) AS impact FROM pos CROSS JOIN sc GROUP BY 1, 2, 3)",
    body=pick(["impact"], 2, keys=("portfolio", "sector", "scenario"), ts=None, source="f")), ["impact"], 2,
    lambda s, d: S.sector_impacts(S.sector_exposures(positions(s, d)), SCEN), ("portfolio", "sector", "scenario"))
FS = ["pnl", "pnl_percent", "var_95", "var_99"]
simple("stress_factor_shock", with_(*POS, """f0 AS (SELECT portfolio, 'factor_shock' AS scenario, sum(value) AS b, sum(value * duration) * 0.02 * -0.05 + coalesce(sum(value * CASE sector WHEN 'Technology' THEN -0.15 WHEN 'Energy' THEN 0.05 END), 0) AS pnl FROM pos GROUP BY 1)""",
    "f AS (SELECT portfolio, scenario, pnl, 100 * pnl / b AS pnl_percent, pnl * 1.2 AS var_95, pnl * 1.5 AS var_99 FROM f0)", body=pick(FS, 2, keys=PS, ts=None, source="f")), FS, 2,
    lambda s, d: (lambda p: S.factor_shock(p, S.sector_exposures(p), 0.02, sector_shocks={"Technology": -0.15, "Energy": 0.05}))(checkpointed(positions(s, d))), PS)
SD = ["mean", "sd", "worst", "var_95", "var_99"]
simple("scenario_distribution", with_(META, ASSET, SECTOR_W, "pr AS (SELECT portfolio, ts, sum(w * ret) / sum(w) AS ret FROM asset JOIN sw USING (symbol) GROUP BY 1, 2)",
    steps("pr", [("h", "CASE WHEN rn >= 10 THEN sum(ret) OVER " + W(10, "portfolio") + " END")], part="portfolio"),
    "f AS (SELECT portfolio, count(h) AS n, avg(h) AS mean, stddev_pop(h) AS sd, min(h) AS worst, quantile_cont(h, 0.05) AS var_95, quantile_cont(h, 0.01) AS var_99 FROM final WHERE h IS NOT NULL GROUP BY 1)",
    body=pick(SD, 5, keys=("portfolio", "n"), ts=None, source="f")), SD, 5, lambda s, d: scenario_distribution(s, d), ("portfolio", "n"))


def scenario_distribution(spark, sf_dir):
    """Ten-row sums of the portfolio returns are the scenarios."""
    from quantloom.operators.series import Series
    s = Series(M.weighted_portfolio_returns(T.asset_returns(spark, sf_dir), sector_portfolios(spark, sf_dir)), ["portfolio"])
    return S.scenario_distribution(s.frame({"h": s.roll(F.sum, 10, "ret")}, keep=["portfolio"]).where("h is not null").withColumnRenamed("h", "ret"))


simple("simulated_scenarios", None, SD, 6, lambda s, d: S.scenario_distribution(S.one_factor_scenarios(
    sector_portfolios(s, d).join(attributes(s, d).select("symbol", "volatility"), "symbol"), 1000, 10, 0.2)), ("portfolio", "n"))


@query("stress_history", f"SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice AS pnl FROM orders WHERE o_custkey = 7 AND o_orderdate >= TIMESTAMP '1996-01-01'")
def stress_history(spark, sf_dir):
    res = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("portfolio"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("pnl"))
    return S.result_history(res, 7, "1996-01-01").select("k", F.date_format("ts", "yyyy-MM-dd").alias("day"), "pnl")


# ---- liquidity ------------------------------------------------------------------------------------------------------
LIQ = (DAILY, steps("daily", [("r", pct("close")), ("r1", lag("r")), ("sp", "(high - low) / close * 0.5"), ("dv", "volume * close")]),
       """lq0 AS (SELECT symbol, avg(sp) AS spread, avg(dv) AS adv, sum(sp * volume) / sum(volume) AS vw_spread, coalesce(avg(abs(r) / dv) * 1e6, 0.001) AS amihud, corr(r, r1) AS au, stddev_samp(r) AS volatility FROM final GROUP BY symbol),
lq AS (SELECT *, least(CASE WHEN au < 0 THEN 2 * sqrt(-au) ELSE 0.005 END, 0.05) AS roll FROM lq0)""")
LV = {"spread": 6, "adv": 2, "vw_spread": 6, "amihud": 4, "roll": 6, "volatility": 4}
simple("symbol_liquidity", with_(*LIQ, body=pick(list(LV), LV, ts=None, source="lq")), list(LV), LV, lambda s, d: L.symbol_liquidity(T.daily_bars(s, d)))
PLQ = """pl0 AS (SELECT portfolio, symbol, value, w, spread, least(0.1 * sqrt(least(value / adv, 1)) * volatility, 0.1) AS impact, least(value / (adv * 0.2), 90) AS days,
  greatest(CASE WHEN adv >= 1e8 THEN 1 WHEN adv >= 1e7 THEN 2 WHEN adv >= 1e6 THEN 3 ELSE 4 END, CASE WHEN spread <= 0.001 THEN 1 WHEN spread <= 0.005 THEN 2 WHEN spread <= 0.02 THEN 3 ELSE 4 END) AS tier FROM weights JOIN lq USING (symbol)),
pl AS (SELECT *, CASE WHEN sc <= 3 THEN 'low' WHEN sc <= 6 THEN 'medium' WHEN sc <= 15 THEN 'high' ELSE 'critical' END AS risk FROM (SELECT *, least(spread * 1000, 10) + least(days / 10, 10) + least(impact * 100, 10) AS sc FROM pl0))"""


def pos_liq(spark, sf_dir):
    return L.position_liquidity(T.portfolio_weights(spark, sf_dir), L.symbol_liquidity(T.daily_bars(spark, sf_dir)))


simple("position_liquidity", with_(*LIQ, HOLDINGS, PLQ, body=pick(["impact", "days", "tier"], 5, keys=("portfolio", "symbol", "risk"), ts=None, source="pl")), ["impact", "days", "tier"], 5, pos_liq, ("portfolio", "symbol", "risk"))
PROF = """pf AS (SELECT portfolio, sum(spread * w) / greatest(sum(w), 0.01) AS spread, sum(days * w) / greatest(sum(w), 0.01) AS days, sum(pow(w / (1 + days), 2)) / pow(sum(w / (1 + days)), 2) AS concentration,
  coalesce(sum(w) FILTER (tier <= 2), 0) AS liquid_share, """ + ", ".join(f"coalesce(sum(w) FILTER (tier = {k}), 0) AS tier_{k}" for k in (1, 2, 3, 4)) + """, 2 * sum(impact * w) AS stress_cost, first(days ORDER BY w DESC, symbol) AS largest_days FROM pl GROUP BY portfolio),
pf2 AS (SELECT *, greatest(0, 100 - spread * 10000) * 0.4 + greatest(0, 100 - days * 10) * 0.4 + greatest(0, 100 - concentration * 100) * 0.2 AS liquidity_score FROM pf)"""
PFV = ["spread", "days", "concentration", "liquid_share", "tier_1", "tier_2", "tier_3", "tier_4", "stress_cost", "largest_days", "liquidity_score"]
PFK = ("portfolio",)
simple("portfolio_liquidity", with_(*LIQ, HOLDINGS, PLQ, PROF, body=pick(PFV, 5, keys=PFK, ts=None, source="pf2")), PFV, 5, lambda s, d: L.portfolio_liquidity(pos_liq(s, d)), PFK)
LS = ["cost_increase", "time_increase", "spread_increase", "stress_impact"]
simple("liquidity_stress", with_(*LIQ, HOLDINGS, PLQ, PROF, "f AS (SELECT portfolio, stress_cost AS cost_increase, days AS time_increase, spread * 2 AS spread_increase, stress_cost + days * 0.01 + spread * 2 AS stress_impact FROM pf2)",
    body=pick(LS, 5, keys=PFK, ts=None, source="f")), LS, 5, lambda s, d: L.liquidity_stress(L.portfolio_liquidity(pos_liq(s, d))), PFK)


def advice_sql(rules, source):
    return " UNION ALL ".join(f"SELECT portfolio, '{n}' AS rule, {rnd(f'abs({m})' if m in R.ABSOLUTE else m, 5, 'value')} FROM {source} WHERE {f'abs({m})' if m in R.ABSOLUTE else m} {op} {lim}" for n, m, op, lim, _ in rules)


simple("liquidity_advice", with_(*LIQ, HOLDINGS, PLQ, PROF, body=advice_sql(L.ADVICE, "pf2")), ["value"], 5, lambda s, d: R.recommendations(L.portfolio_liquidity(pos_liq(s, d)), rules=L.ADVICE), ("portfolio", "rule"))

# ---- concentration ----------------------------------------------------------------------------------------------------
CON = """gs AS (SELECT portfolio, 'sector' AS kind, sector AS entity, sum(w) AS share FROM pos GROUP BY 1, 3 UNION ALL SELECT portfolio, 'geography', geography, sum(w) FROM pos GROUP BY 1, 3 UNION ALL SELECT portfolio, 'currency', currency, sum(w) FROM pos GROUP BY 1, 3),
rk AS (SELECT portfolio, w, row_number() OVER (PARTITION BY portfolio ORDER BY w DESC, symbol) AS k FROM pos),
cm0 AS (SELECT portfolio, sum(w * w) AS hhi, max(w) AS max_position, sum(w) FILTER (k <= 5) AS top_5, sum(w) FILTER (k <= 10) AS top_10 FROM rk GROUP BY 1),
cm1 AS (SELECT portfolio, max(share) FILTER (kind = 'sector') AS max_sector, max(share) FILTER (kind = 'geography') AS max_geography, max(share) FILTER (kind = 'currency') AS max_currency,
  sum(share * share) FILTER (kind = 'sector') AS sector_hhi, sum(share * share) FILTER (kind = 'geography') AS geography_hhi FROM gs GROUP BY 1),
cm AS (SELECT *, 1 / hhi AS effective_positions, least(hhi * 200, 40) + least(max_position * 300, 30) + least(max_sector * 150, 30) AS concentration_score FROM cm0 JOIN cm1 USING (portfolio))"""
CV = ["hhi", "effective_positions", "top_5", "top_10", "max_position", "max_sector", "max_geography", "max_currency", "concentration_score"]
simple("concentration_metrics", with_(*POS, CON, body=pick(CV, 5, keys=PFK, ts=None, source="cm")), CV, 5, lambda s, d: C.concentration_metrics(stored_positions(s, d)), PFK)
AL = """al0 AS (SELECT portfolio, 'position' AS kind, CAST(symbol AS VARCHAR) AS entity, w AS exposure, 0.05 AS lim FROM pos UNION ALL SELECT portfolio, kind, entity, share, CASE kind WHEN 'sector' THEN 0.25 WHEN 'geography' THEN 0.4 ELSE 0.6 END FROM gs
  UNION ALL SELECT portfolio, 'top_5', 'portfolio', top_5, 0.2 FROM cm UNION ALL SELECT portfolio, 'top_10', 'portfolio', top_10, 0.3 FROM cm UNION ALL SELECT portfolio, 'hhi', 'portfolio', hhi, 0.15 FROM cm),
al AS (SELECT *, exposure - lim AS excess, CASE WHEN 100 * (exposure - lim) / lim <= 10 THEN 'low' WHEN 100 * (exposure - lim) / lim <= 25 THEN 'medium' WHEN 100 * (exposure - lim) / lim <= 50 THEN 'high' ELSE 'critical' END AS severity,
  lim * 0.9 AS target, exposure - lim * 0.9 AS reduction FROM al0 WHERE exposure > lim)"""
AK = ("portfolio", "kind", "entity", "severity")
simple("concentration_alerts", with_(*POS, CON, AL, body=pick(["exposure", "excess"], 6, keys=AK, ts=None, source="al")), ["exposure", "excess"], 6, lambda s, d: C.limit_alerts(stored_positions(s, d)), AK)
simple("rebalance_suggestions", with_(*POS, CON, AL, body=pick(["exposure", "target", "reduction"], 6, keys=AK, ts=None, source="al") + " WHERE kind IN ('position', 'sector')"), ["exposure", "target", "reduction"], 6,
       lambda s, d: C.rebalance_suggestions(C.limit_alerts(stored_positions(s, d))), AK)
simple("sector_cut_members", with_(*POS, CON, AL, "f AS (SELECT pos.portfolio, pos.sector, symbol, w, reduction FROM pos JOIN al ON al.portfolio = pos.portfolio AND kind = 'sector' AND entity = sector)",
    body=pick(["w", "reduction"], 6, keys=("portfolio", "sector", "symbol"), ts=None, source="f")), ["w", "reduction"], 6,
    lambda s, d: (lambda p: C.sector_members(C.rebalance_suggestions(C.limit_alerts(p)), p))(stored_positions(s, d)), ("portfolio", "sector", "symbol"))
simple("diversification_flags", with_(*POS, CON, "f AS (SELECT *, sector_hhi > 0.25 AS more_sectors, geography_hhi > 0.5 AS more_regions, effective_positions < 10 AS more_positions FROM cm)",
    body=pick(["sector_hhi", "geography_hhi"], 6, keys=("portfolio", "more_sectors", "more_regions", "more_positions"), ts=None, source="f")), ["sector_hhi", "geography_hhi"], 6,
    lambda s, d: C.diversification_flags(stored_positions(s, d)), ("portfolio", "more_sectors", "more_regions", "more_positions"))
RE = ["hhi", "new_hhi", "hhi_improvement", "score_improvement"]
simple("rebalance_effect", with_(*POS, CON, AL, "ct AS (SELECT portfolio, sum(reduction) AS r FROM al WHERE kind = 'position' GROUP BY 1)",
    "f AS (SELECT portfolio, hhi, new_hhi, hhi - new_hhi AS hhi_improvement, concentration_score * (1 - new_hhi / hhi) AS score_improvement FROM (SELECT *, greatest(0.02, hhi - 0.5 * coalesce(r, 0)) AS new_hhi FROM cm LEFT JOIN ct USING (portfolio)))",
    body=pick(RE, 5, keys=PFK, ts=None, source="f")), RE, 5, lambda s, d: (lambda p: C.rebalance_effect(C.rebalance_suggestions(C.limit_alerts(p)), C.concentration_metrics(p)))(stored_positions(s, d)), PFK)
LU = ["max_position_used", "top_5_used", "top_10_used", "hhi_used", "max_sector_used"]
simple("limit_utilization", with_(*POS, CON, "f AS (SELECT portfolio, 100 * max_position / 0.05 AS max_position_used, 100 * top_5 / 0.2 AS top_5_used, 100 * top_10 / 0.3 AS top_10_used, 100 * hhi / 0.15 AS hhi_used, 100 * max_sector / 0.25 AS max_sector_used FROM cm)",
    body=pick(LU, 4, keys=PFK, ts=None, source="f")), LU, 4, lambda s, d: C.limit_utilization(C.concentration_metrics(stored_positions(s, d))), PFK)

# ---- factor risk -------------------------------------------------------------------------------------------------------
FIT = ("afj AS (SELECT * FROM asset JOIN factors USING (ts))", """ft0 AS (SELECT symbol, count(*) AS n, var_pop(f0) + 0.1 / count(*) AS a, covar_pop(f0, f1) AS b, var_pop(f1) + 0.1 / count(*) AS c, covar_pop(f0, ret) AS p, covar_pop(f1, ret) AS q, var_pop(ret) AS v, var_pop(f0) AS a0, var_pop(f1) AS c0 FROM afj GROUP BY symbol),
ft1 AS (SELECT *, (c * p - b * q) / (a * c - b * b) AS x, (a * q - b * p) / (a * c - b * b) AS y FROM ft0),
ft AS (SELECT symbol, CASE WHEN n >= 60 THEN x ELSE 0 END AS beta_f0, CASE WHEN n >= 60 THEN y ELSE 0 END AS beta_f1, CASE WHEN n >= 60 THEN sqrt(greatest(v - 2 * (x * p + y * q) + x * x * a0 + 2 * x * y * b + y * y * c0, 0)) * sqrt(252) ELSE 0.1 END AS specific_risk FROM ft1)""")


def loadings(spark, sf_dir):
    return FR.fit_assets(T.asset_returns(spark, sf_dir).join(T.factor_returns(spark, sf_dir), "ts"), ["f0", "f1"])


simple("factor_model_fit", with_(META, ASSET, FACTORS, *FIT, body=pick(["beta_f0", "beta_f1", "specific_risk"], 5, ts=None, source="ft")), ["beta_f0", "beta_f1", "specific_risk"], 5, loadings)
EXPO = "ex AS (SELECT portfolio, sum(w * beta_f0) AS b_f0, sum(w * beta_f1) AS b_f1, sum(pow(w * specific_risk, 2)) AS sv FROM weights JOIN ft USING (symbol) GROUP BY 1)"


def exposures(spark, sf_dir):
    return FR.portfolio_exposures(T.portfolio_weights(spark, sf_dir), loadings(spark, sf_dir), ["f0", "f1"])


RSP = ["b_f0", "b_f1", "factor_risk", "specific_risk", "total_risk", "contribution_f0", "contribution_f1"]
simple("factor_risk_split", with_(META, ASSET, FACTORS, *FIT, HOLDINGS, EXPO, "cv AS (SELECT covar_samp(f0, f0) * 252 AS c00, covar_samp(f0, f1) * 252 AS c01, covar_samp(f1, f1) * 252 AS c11 FROM factors)",
    "f0_ AS (SELECT *, b_f0 * b_f0 * c00 + 2 * b_f0 * b_f1 * c01 + b_f1 * b_f1 * c11 AS fv FROM ex, cv)",
    "f AS (SELECT portfolio, b_f0, b_f1, sqrt(fv) AS factor_risk, sqrt(sv) AS specific_risk, sqrt(fv + sv) AS total_risk, b_f0 * c00 / sqrt(fv + sv) AS contribution_f0, b_f1 * c11 / sqrt(fv + sv) AS contribution_f1 FROM f0_)",
    body=pick(RSP, 5, keys=PFK, ts=None, source="f")), RSP, 5, lambda s, d: FR.risk_split(exposures(s, d), FR.annual_factor_covariance(T.factor_returns(s, d).select("ts", "f0", "f1", "f2", "f3", "f4"), ["f0", "f1"]), ["f0", "f1"]), PFK)
simple("factor_forecast", with_(META, FACTORS, "f AS (SELECT " + ", ".join(f"avg({x}) * 30 AS {x}" for x in FC) + " FROM factors)", body=pick(FC, 6, keys=(), ts=None, source="f")), FC, 6, lambda s, d: FR.forecast(T.factor_returns(s, d), FC), ())
simple("factor_forecast_fading", with_(META, FACTORS, "g AS (SELECT *, exp(-0.01 * date_diff('day', ts, (SELECT max(ts) FROM factors))) AS w FROM factors)", "f AS (SELECT " + ", ".join(f"sum(w * {x}) / sum(w) * 30 AS {x}" for x in FC) + " FROM g)",
    body=pick(FC, 6, keys=(), ts=None, source="f")), FC, 6, lambda s, d: FR.forecast(T.factor_returns(s, d), FC, decay=0.01), ())
FSV = ["annual_return", "annual_volatility", "sharpe"]
simple("factor_summary", with_(META, FACTORS, "f AS (" + " UNION ALL ".join(f"SELECT '{x}' AS factor, avg({x}) * 252 AS annual_return, stddev_samp({x}) * sqrt(252) AS annual_volatility, avg({x}) * 252 / (stddev_samp({x}) * sqrt(252)) AS sharpe FROM factors" for x in FC) + ")",
    body=pick(FSV, 5, keys=("factor",), ts=None, source="f")), FSV, 5, lambda s, d: FR.factor_summary(T.factor_returns(s, d), FC), ("factor",))
SHK = ["impact_f0", "impact_f1", "impact"]
simple("factor_shock_impact", with_(META, ASSET, FACTORS, *FIT, HOLDINGS, EXPO, "f AS (SELECT portfolio, b_f0 * -0.1 AS impact_f0, b_f1 * 0.05 AS impact_f1, b_f0 * -0.1 + b_f1 * 0.05 AS impact FROM ex)",
    body=pick(SHK, 6, keys=PFK, ts=None, source="f")), SHK, 6, lambda s, d: FR.shock(exposures(s, d), {"f0": -0.1, "f1": 0.05}), PFK)

# ---- overall score of the sector portfolios ----------------------------------------------------------------------------
SP = (META, ASSET, MARKET, ASSET_MARKET, SECTOR_W, "srt AS (SELECT portfolio, ts, sum(w * ret) / sum(w) AS ret FROM asset JOIN sw USING (symbol) GROUP BY 1, 2)",
      steps("srt", [(n, e.replace("PARTITION BY symbol", "PARTITION BY portfolio")) for n, e in DRAW], part="portfolio", prefix="z"),
      "rk0 AS (SELECT portfolio, quantile_cont(ret, 0.05) AS var_95, stddev_samp(ret) * sqrt(252) AS volatility, min(dd) AS max_drawdown FROM zfinal GROUP BY 1)",
      "cc AS (SELECT portfolio, least(sum(w * w) * 200, 40) + least(max(w) * 300, 30) + 30 AS concentration_score FROM sw GROUP BY 1)",
      "bt AS (SELECT symbol, covar_samp(ret, bench) / nullif(var_samp(bench), 0) AS beta FROM am GROUP BY 1)",
      "st AS (SELECT portfolio, 100 * sum(w * beta) * -0.4 AS x, 100 * sum(w * beta) * -0.1 AS y FROM sw JOIN bt USING (symbol) GROUP BY 1)",
      "sr AS (SELECT portfolio, var_95, volatility, max_drawdown, concentration_score, least(x, y) AS worst_stress, 100 - 40 * least(volatility, 1) AS liquidity_score FROM rk0 JOIN cc USING (portfolio) JOIN st USING (portfolio))",
      "sc2 AS (SELECT *, least(100, least(abs(var_95) * 500, 25) + least(volatility * 80, 20) + least(abs(worst_stress) * 0.5, 25) + greatest(15 - liquidity_score * 0.15, 0) + least(concentration_score * 0.25, 15)) AS risk_score FROM sr)")


def risk_rows(spark, sf_dir):
    """Metrics of the sector portfolios side by side; the liquidity score falls with volatility."""
    w, assets = checkpointed(sector_portfolios(spark, sf_dir)), checkpointed(T.asset_returns(spark, sf_dir))
    rets = M.weighted_portfolio_returns(assets, w)
    d = M.with_drawdown(rets, ["portfolio"]).groupBy("portfolio").agg(
        F.percentile("ret", F.lit(.05)).alias("var_95"), (F.stddev_samp("ret") * 252 ** 0.5).alias("volatility"), F.min("drawdown").alias("max_drawdown"))
    pos = w.withColumns({"sector": F.col("portfolio"), "geography": F.lit(None).cast("string"), "currency": F.lit(None).cast("string")})
    con = C.concentration_metrics(pos).select("portfolio", "concentration_score")
    att = attributes(spark, sf_dir, assets).select("symbol", "beta", "volatility", "duration")
    stress = S.historical_shock(w.join(att, "symbol").withColumn("value", F.col("w")), SCEN).groupBy("portfolio").agg(F.min("pnl_percent").alias("worst_stress"))
    return d.join(con, "portfolio").join(stress, "portfolio").withColumn("liquidity_score", 100 - 40 * F.least(F.col("volatility"), F.lit(1.0)))


RSV = ["var_95", "volatility", "worst_stress", "liquidity_score", "concentration_score", "risk_score"]
simple("overall_risk_score", with_(*SP, body=pick(RSV, 4, keys=PFK, ts=None, source="sc2")), RSV, 4, lambda s, d: R.overall_score(risk_rows(s, d)), PFK)
simple("risk_recommendations", with_(*SP, body=advice_sql(R.ADVICE, "sr")), ["value"], 5, lambda s, d: R.recommendations(risk_rows(s, d)), ("portfolio", "rule"))
