"""Benchmark comparison, attribution and composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import attribution as A
from quantloom.plans import query
from quantloom.plans.kit import (ASSET, FACTORS, MARKET, META, SECTOR, U, pick, result, rnd, rounded, steps, with_)
from quantloom.plans.metrics import student
from quantloom.plans.risk import simple
from quantloom.plans.rolling import ASSET_MARKET, asset_market
from quantloom.sources import tables as T

CMP = ["portfolio_return", "benchmark_return", "excess_return", "portfolio_volatility", "tracking_error", "information_ratio", "treynor", "beta", "alpha", "correlation", "r_squared",
       "portfolio_drawdown", "benchmark_drawdown", "relative_drawdown", "excess_t", "excess_p", "alpha_t", "alpha_p", "hit_ratio", "up_beta", "down_beta", "up_capture", "down_capture"]
simple("benchmark_comparison", with_(ASSET, MARKET, ASSET_MARKET, steps("am", [("ex", "ret - bench"), ("gp", f"product(1 + ret) OVER {U()}"), ("gb", f"product(1 + bench) OVER {U()}"), ("q", "gp / gb"),
        ("q1", "q / first(q) OVER (PARTITION BY symbol ORDER BY ts)"), ("pk", f"max(CASE WHEN rn > 1 THEN q1 END) OVER {U()}"), ("dp", f"gp / max(gp) OVER {U()} - 1"), ("db", f"gb / max(gb) OVER {U()} - 1"), ("dr", "q1 / pk - 1")]),
    """g AS (SELECT symbol, count(*)::DOUBLE AS n, product(1 + ret) AS gp, product(1 + bench) AS gb, avg(ret) AS mp, avg(bench) AS mb, stddev_samp(ret) AS sp, avg(ex) AS mx, stddev_samp(ex) AS sx, covar_samp(ret, bench) / var_samp(bench) AS beta, var_samp(bench) AS vb,
  corr(ret, bench) AS correlation, min(dp) AS portfolio_drawdown, min(db) AS benchmark_drawdown, min(dr) AS relative_drawdown, avg(CASE WHEN ex > 0 THEN 1.0 ELSE 0.0 END) AS hit_ratio,
  coalesce(covar_samp(ret, bench) FILTER (bench > 0) / nullif(var_samp(bench) FILTER (bench > 0), 0), 0) AS up_beta, coalesce(covar_samp(ret, bench) FILTER (bench < 0) / nullif(var_samp(bench) FILTER (bench < 0), 0), 0) AS down_beta,
  coalesce(avg(ret) FILTER (bench > 0) / nullif(avg(bench) FILTER (bench > 0), 0), 0) AS up_capture, coalesce(avg(ret) FILTER (bench < 0) / nullif(avg(bench) FILTER (bench < 0), 0), 0) AS down_capture FROM final GROUP BY symbol)""",
    """h AS (SELECT *, pow(gp, 252 / n) - 1 AS portfolio_return, pow(gb, 252 / n) - 1 AS benchmark_return, sp * sqrt(252) AS portfolio_volatility, sx * sqrt(252) AS tracking_error, mx / sx * sqrt(252) AS information_ratio, (mp - beta * mb) * 252 AS alpha,
  correlation * correlation AS r_squared, mx / (sx / sqrt(n)) AS excess_t, (mp - beta * mb) / sqrt((n - 1) / n * sp * sp * (1 - correlation * correlation) * (1 / n + mb * mb / (n * vb))) AS alpha_t, n - 1 AS d1, n - 2 AS d2 FROM g)""",
    f"f AS (SELECT *, portfolio_return - benchmark_return AS excess_return, (portfolio_return - 0.02) / beta AS treynor, {student('excess_t', 'd1')} AS excess_p, {student('alpha_t', 'd2')} AS alpha_p FROM h)",
    body=pick(CMP, 4, ts=None, source="f")), CMP, 4, lambda s, d: A.compare_with_benchmark(asset_market(s, d)))

MP = ["portfolio_return", "benchmark_return", "tracking_error", "information_ratio", "hit_ratio"]
simple("multi_period_comparison", with_(ASSET, MARKET, ASSET_MARKET, "r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM am)", "x AS (SELECT symbol, period, ret, bench, ret - bench AS ex FROM r JOIN (SELECT unnest([21, 63, 126, 252, 504, 756]) AS period) ON k <= period)",
    """f AS (SELECT symbol, period, count(*) AS n, pow(product(1 + ret), 252.0 / count(*)) - 1 AS portfolio_return, pow(product(1 + bench), 252.0 / count(*)) - 1 AS benchmark_return, stddev_samp(ex) * sqrt(252) AS tracking_error,
  coalesce(avg(ex) / nullif(stddev_samp(ex), 0) * sqrt(252), 0) AS information_ratio, avg(CASE WHEN ex > 0 THEN 1.0 ELSE 0.0 END) AS hit_ratio FROM x GROUP BY 1, 2 HAVING count(*) >= 10)""",
    body=pick(MP, 4, keys=("symbol", "period", "n"), ts=None, source="f")), MP, 4, lambda s, d: A.multi_period(asset_market(s, d)), ("symbol", "period", "n"))

FA = ["alpha", "r_squared", "beta_f0", "beta_f1", "contribution_f0", "contribution_f1"]
simple("factor_attribution", with_(META, ASSET, FACTORS, "af AS (SELECT * FROM asset JOIN factors USING (ts))", """g AS (SELECT symbol, count(*) AS n, var_pop(f0) AS a, covar_pop(f0, f1) AS b, var_pop(f1) AS c, covar_pop(f0, ret) AS p, covar_pop(f1, ret) AS q, var_pop(ret) AS v, avg(ret) AS m, avg(f0) AS m0, avg(f1) AS m1 FROM af GROUP BY symbol HAVING count(*) >= 10)""",
    "h AS (SELECT *, (c * p - b * q) / (a * c - b * b) AS beta_f0, (a * q - b * p) / (a * c - b * b) AS beta_f1 FROM g)",
    "f AS (SELECT *, m - beta_f0 * m0 - beta_f1 * m1 AS alpha, (beta_f0 * p + beta_f1 * q) / v AS r_squared, beta_f0 * m0 AS contribution_f0, beta_f1 * m1 AS contribution_f1 FROM h)",
    body=pick(FA, 5, keys=("symbol", "n"), ts=None, source="f")), FA, 5, lambda s, d: A.factor_attribution(T.asset_returns(s, d).join(T.factor_returns(s, d), "ts"), ["f0", "f1"]), ("symbol", "n"))
simple("factor_attribution_all", None, ["alpha", "r_squared", *[f"beta_f{i}" for i in range(5)]], 6, lambda s, d: A.factor_attribution(T.asset_returns(s, d).join(T.factor_returns(s, d), "ts"), [f"f{i}" for i in range(5)]), ("symbol", "n"))


# portfolio = a year; weights and returns of its sectors against those of all years
def brinson_rows(spark, sf_dir):
    m = F.round(F.col("l_discount") * 100) - F.round(F.col("l_tax") * 100)
    lines = T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.year("l_shipdate").alias("portfolio"), m.alias("m"))
    j = lines.groupBy("symbol", "portfolio").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("n")).join(T.symbol_metadata(spark, sf_dir), "symbol")
    p = j.groupBy("portfolio", "sector").agg(F.sum("n").alias("n"), (F.sum("m") / F.sum("n") / 100).alias("rp"))
    p = T.with_total(p, ["portfolio"], _t=F.sum("n")).select("portfolio", "sector", (F.col("n") / F.col("_t")).alias("wp"), "rp")
    b = j.groupBy("sector").agg(F.sum("n").alias("n"), (F.sum("m") / F.sum("n") / 100).alias("rb"))
    total = b.agg(F.sum("n").alias("_t"))
    b = b.join(F.broadcast(total), F.lit(True)).select("sector", (F.col("n") / F.col("_t")).alias("wb"), "rb")
    return p, b


BR = """l AS (SELECT year(l_shipdate) AS portfolio, sector, round(l_discount * 100) - round(l_tax * 100) AS m FROM lineitem JOIN meta ON symbol = l_suppkey),
pw AS (SELECT portfolio, sector, count(*) / sum(count(*)) OVER (PARTITION BY portfolio) AS wp, sum(m) / count(*) / 100 AS rp FROM l GROUP BY 1, 2), bw AS (SELECT sector, count(*) / sum(count(*)) OVER () AS wb, sum(m) / count(*) / 100 AS rb FROM l GROUP BY 1),
br AS (SELECT portfolio, sector, (wp - wb) * rb AS allocation, wb * (rp - rb) AS selection, (wp - wb) * (rp - rb) AS interaction, wp, wb, rp FROM pw JOIN bw USING (sector))"""
BV = ["allocation", "selection", "interaction", "total"]
simple("brinson_attribution", with_(META, BR, "f AS (SELECT portfolio, sector, allocation, selection, interaction, allocation + selection + interaction AS total FROM br UNION ALL SELECT portfolio, 'total', sum(allocation), sum(selection), sum(interaction), sum(allocation + selection + interaction) FROM br GROUP BY 1)",
    body=pick(BV, 7, keys=("portfolio", "sector"), ts=None, source="f")), BV, 7, lambda s, d: (lambda pb: A.brinson(pb[0].join(pb[1], "sector", "full_outer")))(brinson_rows(s, d)), ("portfolio", "sector"))
SV = ["wp", "wb", "contribution", "allocation", "selection"]
simple("sector_attribution", with_(META, BR, "sr AS (SELECT sector, sum(m) / count(*) / 100 AS ret FROM l GROUP BY 1)", "f AS (SELECT portfolio, sector, wp, wb, wp * ret AS contribution, (wp - wb) * ret AS allocation, 0.0 AS selection FROM br JOIN sr USING (sector))",
    body=pick(SV, 6, keys=("portfolio", "sector"), ts=None, source="f")), SV, 6,
    lambda s, d: (lambda pb: A.sector_attribution(pb[0].withColumnRenamed("wp", "w"), pb[1].select("sector", F.col("rb").alias("ret")), pb[1].select("sector", "wb")))(brinson_rows(s, d)), ("portfolio", "sector"))

# ---- composition: the sectors are the strategies -------------------------------------------------------------------------
ST = "st AS (SELECT sector AS strategy, avg(ret) * 252 AS ret, stddev_samp(ret) * sqrt(252) AS volatility, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe FROM sret GROUP BY 1)"
RAW = {"risk_parity": "1 / greatest(volatility, 0.01)", "sharpe": "greatest(sharpe, 0.01)", "dynamic": "greatest(sharpe * (1 + ret), 0.01)", "equal": "1.0"}


def comp_sql(scheme, name):
    return f"{name} AS (SELECT strategy, ret, volatility, sharpe, w / sum(w) OVER () AS w FROM (SELECT *, greatest(least(x / sum(x) OVER (), 0.05), 0.03) AS w FROM (SELECT *, {RAW[scheme]} AS x FROM st)))"


def stats(spark, sf_dir):
    r = T.group_returns(spark, sf_dir, "sector").withColumnRenamed("sector", "strategy")
    a = r.groupBy("strategy").agg((F.avg("ret") * 252).alias("ret"), (F.stddev_samp("ret") * 252 ** 0.5).alias("volatility"))
    return a.withColumn("sharpe", F.col("ret") / F.col("volatility"))


for _s in RAW:
    simple(f"compose_{_s}", with_(META, SECTOR, ST, comp_sql(_s, "f"), body=pick(["w"], 6, keys=("strategy",), ts=None, source="f")), ["w"], 6, lambda s, d, k=_s: A.compose(stats(s, d), k, 0.03, 0.05), ("strategy",))
CM = ["expected_return", "expected_risk", "effective_strategies", "concentration", "sharpe", "scale"]
simple("composition_metrics", with_(META, SECTOR, ST, comp_sql("risk_parity", "c"), "g AS (SELECT sum(w * ret) AS expected_return, sqrt(sum(pow(w * volatility, 2))) AS expected_risk, 1 / sum(w * w) AS effective_strategies, max(w) AS concentration FROM c)",
    "f AS (SELECT *, expected_return / expected_risk AS sharpe, 0.1 / expected_risk AS scale FROM g)", body=pick(CM, 5, keys=(), ts=None, source="f")), CM, 5, lambda s, d: A.composition_metrics(A.compose(stats(s, d), "risk_parity", 0.03, 0.05), 0.1), ())
simple("risk_utilization", with_(META, SECTOR, ST, comp_sql("sharpe", "c"), "f AS (SELECT strategy, w * volatility / sum(w * volatility) OVER () / 0.04 AS utilization FROM c)", body=pick(["utilization"], 5, keys=("strategy",), ts=None, source="f")), ["utilization"], 5,
    lambda s, d: A.risk_utilization(A.compose(stats(s, d), "sharpe", 0.03, 0.05), F.lit(0.04)), ("strategy",))
simple("composition_trades", with_(META, SECTOR, ST, comp_sql("equal", "c"), comp_sql("dynamic", "t"), "f AS (SELECT strategy, t.w - c.w AS trade FROM c JOIN t USING (strategy) WHERE abs(t.w - c.w) > 1e-6)", body=pick(["trade"], 6, keys=("strategy",), ts=None, source="f")), ["trade"], 6,
    lambda s, d: A.weight_trades(A.compose(stats(s, d), "equal", 0.03, 0.05), A.compose(stats(s, d), "dynamic", 0.03, 0.05)), ("strategy",))
