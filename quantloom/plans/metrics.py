"""Return, drawdown, distribution and matrix metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import held as HE, metrics as M
from quantloom.plans import query
from quantloom.plans.kit import (ASSET, FACTORS, MARKET, META, B, O, U, W, dv, lag, pick, result, rnd, roll, rounded,
                                 steps, with_)
from quantloom.plans.rolling import ASSET_MARKET, asset_market
from quantloom.session import checkpointed
from quantloom.sources import tables as T

SYM = ("symbol",)
DRAW = [("g", f"product(1 + ret) OVER {U()}"), ("pk", f"max(g) OVER {U()}"), ("dd", "g / pk - 1"),
        ("under", "dd < -1e-12"), ("run", f"sum(CASE WHEN under THEN 0 ELSE 1 END) OVER {U()}"), ("ex", "ret - 0.02 / 252")]


def simple(name, sql, values, digits, make, keys=SYM):
    @query(name, sql)
    def run(spark, sf_dir):
        return result(make(spark, sf_dir), values, digits, keys=keys, ts=None)


PERF = ["total_return", "annualized_return", "volatility", "sharpe", "sortino", "calmar", "max_drawdown",
        "average_drawdown", "recovery_factor", "drawdown_duration"]
simple("performance_metrics", with_(ASSET, steps("asset", DRAW), """runs AS (SELECT symbol, max(k) AS drawdown_duration FROM
  (SELECT symbol, run, count(*) FILTER (under) AS k FROM final GROUP BY symbol, run) GROUP BY symbol)""",
    """agg AS (SELECT symbol, count(*) AS n, product(1 + ret) AS gr, stddev_samp(ret) AS sd, avg(ex) AS mx,
  stddev_samp(CASE WHEN ex < 0 THEN ex END) AS dn, min(dd) AS max_drawdown, coalesce(avg(CASE WHEN under THEN dd END), 0) AS average_drawdown FROM final GROUP BY symbol)""",
    """f2 AS (SELECT symbol, gr - 1 AS total_return, pow(gr, 252.0 / n) - 1 AS annualized_return, sd * sqrt(252) AS volatility,
  coalesce(mx / nullif(sd, 0) * sqrt(252), 0) AS sharpe, mx / nullif(dn, 0) * sqrt(252) AS sortino,
  coalesce((pow(gr, 252.0 / n) - 1) / nullif(abs(max_drawdown), 0), 0) AS calmar, max_drawdown, average_drawdown,
  coalesce((gr - 1) / nullif(abs(max_drawdown), 0), 0) AS recovery_factor, drawdown_duration FROM agg JOIN runs USING (symbol))""",
    body=pick(PERF, 4, ts=None, source="f2")), PERF, 4, lambda s, d: M.performance(T.asset_returns(s, d)))

Q = """q AS (SELECT symbol, quantile_cont(ret, 0.05) AS q5, quantile_cont(ret, 0.01) AS q1, quantile_cont(ret, 0.95) AS q95 FROM asset GROUP BY symbol)"""
DIST = ["skewness", "kurtosis", "var_95", "var_99", "cvar_95", "cvar_99"]
POPSKEW = "(sum(pow(ret - m, 3)) / count(*)) / pow(var_pop(ret), 1.5)"
POPKURT = "(sum(pow(ret - m, 4)) / count(*)) / pow(var_pop(ret), 2) - 3"
CENTRE = "asm AS (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS m FROM asset)"
simple("return_distribution", with_(ASSET, CENTRE, Q, f"""f AS (SELECT symbol, {POPSKEW} AS skewness, {POPKURT} AS kurtosis, any_value(q5) AS var_95,
  any_value(q1) AS var_99, avg(ret) FILTER (ret <= q5) AS cvar_95, avg(ret) FILTER (ret <= q1) AS cvar_99 FROM asm JOIN q USING (symbol) GROUP BY symbol)""",
    body=pick(DIST, 5, ts=None, source="f")), DIST, 5, lambda s, d: M.distribution(T.asset_returns(s, d)))

WL = ["win_rate", "profit_factor", "average_win", "average_loss", "largest_win", "largest_loss"]


def wl_sql(x):
    return (f"avg(CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, CASE WHEN count(*) FILTER ({x} > 0) = 0 THEN 0 ELSE "
            f"sum({x}) FILTER ({x} > 0) / nullif(abs(sum({x}) FILTER ({x} < 0)), 0) END AS profit_factor, "
            f"coalesce(avg({x}) FILTER ({x} > 0), 0) AS average_win, coalesce(avg({x}) FILTER ({x} < 0), 0) AS average_loss, "
            f"coalesce(max({x}) FILTER ({x} > 0), 0) AS largest_win, coalesce(min({x}) FILTER ({x} < 0), 0) AS largest_loss")


simple("trading_metrics", with_(ASSET, f"f AS (SELECT symbol, {wl_sql('ret')} FROM asset GROUP BY symbol)",
    body=pick(WL, 5, ts=None, source="f")), WL, 5, lambda s, d: M.trading_metrics(T.asset_returns(s, d)))

simple("tail_metrics", with_(ASSET, Q, """f AS (SELECT symbol, any_value(abs(q95 / nullif(q5, 0))) AS tail_ratio, any_value(abs(q95 / nullif(q5, 0)))
  * CASE WHEN count(*) FILTER (ret > 0) = 0 THEN 0 ELSE sum(ret) FILTER (ret > 0) / nullif(abs(sum(ret) FILTER (ret < 0)), 0) END AS common_sense_ratio
  FROM asset JOIN q USING (symbol) GROUP BY symbol)""", body=pick(["tail_ratio", "common_sense_ratio"], 5, ts=None, source="f")),
    ["tail_ratio", "common_sense_ratio"], 5, lambda s, d: M.tail_metrics(T.asset_returns(s, d)))

simple("stability_ratio", with_(ASSET, steps("asset", [("m", roll("avg", "ret", 252)), ("sd", roll("stddev_samp", "ret", 252)),
    ("sh", "CASE WHEN sd > 0 THEN m / sd * sqrt(252) WHEN sd = 0 THEN 0 END")]),
    "f AS (SELECT symbol, CASE WHEN count(*) < 504 THEN 0 ELSE coalesce(greatest(0, 1 - stddev_samp(sh) / nullif(abs(avg(sh)), 0)), 0) END AS stability FROM final GROUP BY symbol)",
    body=pick(["stability"], 5, ts=None, source="f")), ["stability"], 5, lambda s, d: M.stability_ratio(T.asset_returns(s, d)))


def student(t, dof):
    """Two-sided tail by Simpson's rule over the density."""
    pdf = f"exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt(pi() * {dof}) * pow(1 + x * x / {dof}, -({dof} + 1) / 2.0)"
    h = f"(abs({t}) / 400)"
    return (f"1 - 2 * {h} / 3 * list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * "
            + pdf.replace("x * x", f"(i * {h}) * (i * {h})") + "))")


SIG = ["t_stat", "p_value", "t_excess", "p_excess", "normality_p"]
K2 = [("y", "sk * sqrt((n + 1) * (n + 3) / (6 * (n - 2)))"),
      ("b2", "3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))"),
      ("w2", "sqrt(2 * (b2 - 1)) - 1"), ("z1", "asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2))"),
      ("x", "(ku + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))"),
      ("bt", "6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))"),
      ("a", "6 + 8 / bt * (2 / bt + sqrt(1 + 4 / (bt * bt)))"), ("co", "(1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))"),
      ("z2", "((1 - 2 / (9 * a)) - sign(co) * cbrt(abs(co))) / sqrt(2 / (9 * a))"),
      ("normality_p", "exp(-(z1 * z1 + z2 * z2) / 2)"), ("se", "sd / sqrt(n)"), ("t_stat", "m / nullif(se, 0)"),
      ("t_excess", "(m - 0.02 / 252) / nullif(se, 0)"), ("dof", "n - 1"), ("p_value", student("t_stat", "dof")),
      ("p_excess", student("t_excess", "dof"))]
simple("significance_tests", with_(ASSET, CENTRE, f"""base AS (SELECT symbol, 0 AS ts, count(*)::DOUBLE AS n, avg(ret) AS m, stddev_samp(ret) AS sd, {POPSKEW} AS sk, {POPKURT} AS ku
  FROM asm GROUP BY symbol)""".replace("avg(ret) AS m,", "any_value(asm.m) AS m,"), steps("base", K2), body=pick(SIG, 5, ts=None)), SIG, 5,
    lambda s, d: M.significance(T.asset_returns(s, d)))

PM = ["omega", "kappa_3", "gain_loss", "upside_potential"]
simple("partial_moment_ratios", with_(ASSET, """f AS (SELECT symbol, sum(ret) FILTER (ret > 0) / nullif(abs(sum(ret) FILTER (ret < 0)), 0) AS omega,
  avg(ret) / nullif(cbrt(abs(avg(pow(ret, 3)) FILTER (ret < 0))), 0) AS kappa_3, avg(ret) FILTER (ret > 0) / nullif(abs(avg(ret) FILTER (ret < 0)), 0) AS gain_loss,
  avg(ret) FILTER (ret > 0) / nullif(sqrt(avg(pow(ret, 2)) FILTER (ret < 0)), 0) AS upside_potential FROM asset GROUP BY symbol)""",
    body=pick(PM, 5, ts=None, source="f")), PM, 5, lambda s, d: M.partial_moments(T.asset_returns(s, d)))

AC = ["jarque_bera", "jb_p", "ljung_box", "lb_p"]
simple("autocorrelation_tests", with_(ASSET, CENTRE, steps("asm", [("d", "ret - m")] + [(f"l{k}", f"d * {lag('d', k)}") for k in range(1, 11)]),
    f"g AS (SELECT symbol, count(*)::DOUBLE AS n, {POPSKEW} AS sk, {POPKURT} AS ku, sum(d * d) AS v, " + ", ".join(f"sum(l{k}) AS l{k}" for k in range(1, 11)) + " FROM final GROUP BY symbol)",
    "h AS (SELECT symbol, n / 6 * (sk * sk + ku * ku / 4) AS jarque_bera, n * (n + 2) * (" + " + ".join(f"pow(l{k} / v, 2) / (n - {k})" for k in range(1, 11)) + ") AS ljung_box FROM g)",
    """f AS (SELECT *, exp(-jarque_bera / 2) AS jb_p, exp(-ljung_box / 2) * (1 + ljung_box / 2 + pow(ljung_box / 2, 2) / 2 + pow(ljung_box / 2, 3) / 6 + pow(ljung_box / 2, 4) / 24) AS lb_p FROM h)""",
    body=pick(AC, 4, ts=None, source="f")), AC, 4, lambda s, d: M.autocorrelation_tests(T.asset_returns(s, d)))

simple("arch_lm", with_(ASSET, steps("asset", [("y", "ret * ret"), ("x1", lag("y")), ("x2", lag("y", 2))]),
    """g AS (SELECT symbol, count(*) AS n, covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x2, x2) AS c, covar_pop(x1, y) AS p, covar_pop(x2, y) AS q, var_pop(y) AS v
  FROM final WHERE x2 IS NOT NULL GROUP BY symbol)""",
    "f AS (SELECT symbol, n * ((c * p - b * q) * p + (a * q - b * p) * q) / (a * c - b * b) / v AS lm FROM g)",
    body=pick(["lm"], 4, ts=None, source="f")), ["lm"], 4, lambda s, d: M.arch_lm(T.asset_returns(s, d), lags=2))

HS = ["first_half", "second_half", "change"]
simple("half_split_correlation", with_(ASSET, MARKET, ASSET_MARKET, steps("am", [("n", "count(*) OVER (PARTITION BY symbol)")]),
    """f AS (SELECT symbol, coalesce(corr(ret, bench) FILTER (rn <= n // 2), 0) AS first_half, coalesce(corr(ret, bench) FILTER (rn > n // 2), 0) AS second_half,
  abs(coalesce(corr(ret, bench) FILTER (rn > n // 2), 0) - coalesce(corr(ret, bench) FILTER (rn <= n // 2), 0)) AS change FROM final WHERE n > 30 GROUP BY symbol)""",
    body=pick(HS, 5, ts=None, source="f")), HS, 5, lambda s, d: M.half_split_correlation(asset_market(s, d)))

RSUM = ["mean_return", "volatility", "var_95", "var_99", "cvar_95", "max_drawdown", "skewness", "kurtosis", "downside_deviation", "sharpe", "sortino", "calmar"]
simple("risk_summary", with_(ASSET, Q, steps("asset", DRAW), """g AS (SELECT symbol, avg(ret) * 252 AS mean_return, stddev_samp(ret) * sqrt(252) AS volatility, any_value(q5) * sqrt(252) AS var_95,
  any_value(q1) * sqrt(252) AS var_99, avg(ret) FILTER (ret <= q5) * sqrt(252) AS cvar_95, min(dd) AS max_drawdown, skewness(ret) AS skewness, kurtosis(ret) AS kurtosis,
  coalesce(stddev_samp(ret) FILTER (ret < 0) * sqrt(252), 0) AS downside_deviation FROM final JOIN q USING (symbol) GROUP BY symbol)""",
    """f AS (SELECT *, coalesce(mean_return / nullif(volatility, 0), 0) AS sharpe, coalesce(mean_return / nullif(downside_deviation, 0), 0) AS sortino,
  coalesce(mean_return / nullif(abs(max_drawdown), 0), 0) AS calmar FROM g)""", body=pick(RSUM, 4, ts=None, source="f")), RSUM, 4,
    lambda s, d: M.risk_summary(T.asset_returns(s, d)))

SVC = ["total_return", "annualized_return", "volatility", "max_drawdown", "win_rate", "avg_win", "avg_loss", "sharpe", "profit_factor"]
simple("service_metrics", with_(ASSET, steps("asset", DRAW), """g AS (SELECT symbol, product(1 + ret) - 1 AS total_return, pow(1 + avg(ret), 252) - 1 AS annualized_return, stddev_samp(ret) * sqrt(252) AS volatility,
  min(dd) AS max_drawdown, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, coalesce(avg(ret) FILTER (ret > 0), 0) AS avg_win, coalesce(avg(ret) FILTER (ret < 0), 0) AS avg_loss FROM final GROUP BY symbol)""",
    "f AS (SELECT *, coalesce(annualized_return / nullif(volatility, 0), 0) AS sharpe, abs(avg_win / nullif(avg_loss, 0)) AS profit_factor FROM g)",
    body=pick(SVC, 4, ts=None, source="f")), SVC, 4, lambda s, d: M.service_metrics(T.asset_returns(s, d)))

simple("benchmark_ratios", with_(ASSET, MARKET, ASSET_MARKET, """g AS (SELECT symbol, count(*) AS n, coalesce(avg(ret - bench) / nullif(stddev_samp(ret - bench), 0) * sqrt(252), 0) AS information_ratio,
  covar_samp(ret, bench) / nullif(var_samp(bench), 0) AS beta, product(1 + ret) AS gr FROM am GROUP BY symbol)""",
    "f AS (SELECT *, coalesce((pow(gr, 252.0 / n) - 1 - 0.02) / nullif(beta, 0), 0) AS treynor FROM g)",
    body=pick(["information_ratio", "beta", "treynor"], 4, ts=None, source="f")), ["information_ratio", "beta", "treynor"], 4,
    lambda s, d: M.benchmark_ratios(asset_market(s, d)))

SECTOR_W = "sw AS (SELECT sector AS portfolio, symbol, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY sector) AS w FROM lineitem JOIN meta ON l_suppkey = symbol GROUP BY 1, 2)"


def sector_portfolios(spark, sf_dir):
    """(portfolio = sector, symbol, w = share of the sector's lines)"""
    lines = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(F.count(F.lit(1)).alias("_n"))
    j = T.with_total(lines.join(T.symbol_metadata(spark, sf_dir), "symbol"), ["sector"], _t=F.sum("_n"))
    return j.select(F.col("sector").alias("portfolio"), "symbol", (F.col("_n").cast("double") / F.col("_t")).alias("w"))


AC = ("hp AS (SELECT a.portfolio, a.symbol AS i, b.symbol AS j FROM sw a JOIN sw b ON a.portfolio = b.portfolio AND a.symbol <= b.symbol)",
      "ac AS (SELECT i, j, count(*) AS n, covar_samp(x.ret, y.ret) AS cov, corr(x.ret, y.ret) AS corr FROM (SELECT DISTINCT i, j FROM hp) JOIN asset x ON x.symbol = i JOIN asset y ON y.symbol = j AND y.ts = x.ts GROUP BY 1, 2)")


def stored_held(spark, sf_dir):
    """Returns as lists and weights, stored once: every step of the robust covariance reads both."""
    return checkpointed(HE.day_lists(T.asset_returns(spark, sf_dir))), checkpointed(sector_portfolios(spark, sf_dir))


simple("asset_covariance", with_(META, ASSET, SECTOR_W, *AC, body=pick(["cov", "corr"], 7, keys=("i", "j", "n"), ts=None, source="ac")), ["cov", "corr"], 7,
       lambda s, d: HE.held_asset_covariance(T.asset_returns(s, d), checkpointed(sector_portfolios(s, d))), ("i", "j", "n"))
simple("asset_mean_returns", with_(ASSET, "f AS (SELECT symbol, avg(ret) AS mean, var_samp(ret) AS variance FROM asset GROUP BY 1)", body=pick(["mean", "variance"], 7, ts=None, source="f")), ["mean", "variance"], 7,
       lambda s, d: T.asset_returns(s, d).groupBy("symbol").agg(F.avg("ret").alias("mean"), F.var_samp("ret").alias("variance")))
simple("shrunk_asset_covariance", with_(META, ASSET, SECTOR_W, *AC, """f AS (SELECT portfolio, i, j, 0.9 * cov + CASE WHEN i = j THEN 0.1 * avg(cov) FILTER (i = j) OVER (PARTITION BY portfolio) ELSE 0 END AS cov FROM hp JOIN ac USING (i, j))""",
    body=pick(["cov"], 7, keys=("portfolio", "i", "j"), ts=None, source="f")), ["cov"], 7, lambda s, d: HE.held_shrunk_covariance(T.asset_returns(s, d), checkpointed(sector_portfolios(s, d))), ("portfolio", "i", "j"))


THRESHOLD = 0.08        # some days of every sector lie beyond it
simple("robust_asset_covariance", with_(META, ASSET, SECTOR_W, AC[0], "cx AS (SELECT symbol, ts, ret - quantile_disc(ret, 0.5) OVER (PARTITION BY symbol) AS x FROM asset)",
    f"dw AS (SELECT portfolio, ts, CASE WHEN sqrt(sum(x * x)) > {THRESHOLD} THEN {THRESHOLD} / sqrt(sum(x * x)) ELSE 1 END AS w FROM cx JOIN (SELECT DISTINCT portfolio, symbol FROM sw) USING (symbol) GROUP BY 1, 2)",
    "f AS (SELECT hp.portfolio, i, j, count(*) AS n, sum(w * a.x * b.x) / sum(w) AS cov FROM hp JOIN cx a ON a.symbol = i JOIN cx b ON b.symbol = j AND b.ts = a.ts JOIN dw ON dw.portfolio = hp.portfolio AND dw.ts = a.ts GROUP BY 1, 2, 3)",
    body=pick(["cov"], 8, keys=("portfolio", "i", "j", "n"), ts=None, source="f")), ["cov"], 8, lambda s, d: HE.held_robust_covariance(*stored_held(s, d), threshold=THRESHOLD), ("portfolio", "i", "j", "n"))


@query("weighted_portfolio_returns", with_(ASSET, META, SECTOR_W, "f AS (SELECT portfolio, ts, sum(w * ret) / nullif(sum(w), 0) AS ret FROM asset JOIN sw USING (symbol) GROUP BY 1, 2)",
    body=pick(["ret"], keys=("portfolio",), source="f")))
def weighted_portfolio_returns(spark, sf_dir):
    return result(M.weighted_portfolio_returns(T.asset_returns(spark, sf_dir), sector_portfolios(spark, sf_dir)), ["ret"], keys=("portfolio",))


FC = ["f0", "f1", "f2", "f3", "f4"]
PAIRS = "pr AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, covar_samp({a}, {b}) AS cov, corr({a}, {b}) AS corr FROM factors" for a in FC for b in FC) + "))"


@query("covariance_matrix", with_(META, FACTORS, PAIRS, body=pick(["cov", "corr"], 8, keys=("i", "j"), ts=None, source="pr")))
def covariance_matrix(spark, sf_dir):
    return result(M.column_moments(T.factor_returns(spark, sf_dir), FC)[1], ["cov", "corr"], 8, keys=("i", "j"), ts=None)


@query("mean_returns", with_(META, FACTORS, body=" UNION ALL ".join(f"SELECT '{a}' AS i, {rnd(f'avg({a})', 8, 'mean')} FROM factors" for a in FC)))
def mean_returns(spark, sf_dir):
    return result(M.column_moments(T.factor_returns(spark, sf_dir), FC)[0], ["mean"], 8, keys=("i",), ts=None)


@query("shrunk_covariance", with_(META, FACTORS, PAIRS, body=f"""SELECT i, j, {rnd("0.9 * cov + CASE WHEN i = j THEN 0.1 * (SELECT avg(cov) FROM pr WHERE i = j) ELSE 0 END", 8, 'cov')} FROM pr"""))
def shrunk_covariance(spark, sf_dir):
    return result(M.shrunk_covariance(M.column_moments(T.factor_returns(spark, sf_dir), FC)[1]), ["cov"], 8, keys=("i", "j"), ts=None)


# factors scaled by 100 so that some rows lie beyond the norm of two
@query("robust_covariance", with_(META, FACTORS, "md AS (SELECT " + ", ".join(f"quantile_disc({a} * 100, 0.5) AS m{a}" for a in FC) + " FROM factors)",
    "x AS (SELECT " + ", ".join(f"{a} * 100 - m{a} AS {a}" for a in FC) + " FROM factors, md)",
    "w AS (SELECT *, CASE WHEN sqrt(" + " + ".join(f"{a} * {a}" for a in FC) + ") > 2 THEN 2 / sqrt(" + " + ".join(f"{a} * {a}" for a in FC) + ") ELSE 1 END AS w FROM x)",
    body=" UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, {rnd(f'sum(w * {a} * {b}) / sum(w)', 7, 'cov')} FROM w" for a in FC for b in FC)))
def robust_covariance(spark, sf_dir):
    wide = T.factor_returns(spark, sf_dir).select(*[(F.col(c) * 100).alias(c) for c in FC])
    return result(M.robust_covariance(wide, FC), ["cov"], 7, keys=("i", "j"), ts=None)


@query("alert_counts", """SELECT coalesce(event_type, 'all') AS kind, coalesce(sev, 'all') AS severity, count(*) AS n FROM (SELECT event_type,
  CASE WHEN value > 300 THEN 'high' WHEN value > 100 THEN 'medium' ELSE 'low' END AS sev FROM events WHERE ts >= TIMESTAMP '2024-01-10') GROUP BY CUBE (event_type, sev)""")
def alert_counts(spark, sf_dir):
    v = F.col("value")
    alerts = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "ts", F.when(v > 300, "high").when(v > 100, "medium").otherwise("low").alias("severity"))
    return M.alert_counts(alerts, "2024-01-10").fillna("all", ["kind", "severity"])


@query("limit_states", f"""SELECT user_id, {rnd('u', 4, 'used')}, CASE WHEN u > 100 THEN 'breach' WHEN u > 80 THEN 'warning' ELSE 'ok' END AS state FROM (
  SELECT user_id, 100 * sum(round(value * 100)) / 100 / 4000 AS u FROM events GROUP BY user_id)""")
def limit_states(spark, sf_dir):
    per = T.table(spark, sf_dir, "events").groupBy("user_id").agg((F.sum(F.round(F.col("value") * 100)) / 100).alias("_v"))
    used, state = M.utilization(F.col("_v"), F.lit(4000.0))
    return per.select("user_id", rounded(used, 4).alias("used"), state.alias("state"))


@query("signal_distribution", """SELECT l_suppkey AS symbol, l_returnflag AS kind, count(*) AS n, floor(count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey) * 1e6 + 0.50071234567) / 1e6 AS share,
  max(count(*)) OVER (PARTITION BY l_suppkey) / sum(count(*)) OVER (PARTITION BY l_suppkey) > 0.8 AS unbalanced FROM lineitem GROUP BY 1, 2""")
def signal_distribution(spark, sf_dir):
    c = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.col("l_returnflag").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    j = T.with_total(c, ["symbol"], _t=F.sum("n"), _m=F.max("n"))
    return j.select("symbol", "kind", "n", rounded(F.col("n") / F.col("_t")).alias("share"), (F.col("_m") / F.col("_t") > 0.8).alias("unbalanced"))


@query("distinct_and_mode", """SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers,
  (SELECT l_quantity FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_quantity LIMIT 1) AS quantity_mode FROM lineitem""")
def distinct_and_mode(spark, sf_dir):
    return T.table(spark, sf_dir, "lineitem").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"),
        F.mode("l_quantity", deterministic=True).alias("quantity_mode"))
