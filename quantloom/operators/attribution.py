"""Benchmark comparison, factor and Brinson attribution, composition of strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.functions.scalar import TRADING_DAYS, corr_of, div
from quantloom.functions.stats import student_tail
from quantloom.operators.metrics import YEAR, annualized, least_squares, or_zero
from quantloom.operators.series import Series


def compare_with_benchmark(aligned: DataFrame, keys=("symbol",), rf=0.02) -> DataFrame:
    """(keys, ts, ret, bench) to one row per key: returns, risk, regression, capture, significance."""
    s = Series(aligned.dropna(subset=["ret", "bench"]), list(keys))
    p, b = F.col("ret"), F.col("bench")
    gp, gb = s.let(s.running_product(s.let(1 + p))), s.let(s.running_product(s.let(1 + b)))
    ratio = s.let(div(gp, gb))
    first = s.let(F.first(ratio).over(s.order.rowsBetween(Window.unboundedPreceding, 0)))
    rel = s.let(ratio / first)
    # relative drawdown starts at the second row: the first one has no change
    peak = s.let(F.max(F.when(s.row > 1, rel)).over(s.order.rowsBetween(Window.unboundedPreceding, 0)))
    d = s.frame({"ex": p - b, "dp": gp / s.running_max(gp) - 1, "db": gb / s.running_max(gb) - 1, "dr": div(rel, peak) - 1})
    ex, up, down = F.col("ex"), b > 0, b < 0

    def when(c, x):
        return F.when(c, x)
    cov = lambda c: div(F.covar_samp(when(c, p), when(c, b)), F.var_samp(when(c, b)))
    a = d.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.product(1 + p).alias("_gp"), F.product(1 + b).alias("_gb"), F.avg(p).alias("_mp"), F.avg(b).alias("_mb"),
        F.stddev_samp(p).alias("_sp"), F.stddev_samp(b).alias("_sb"), F.avg(ex).alias("_mx"), F.stddev_samp(ex).alias("_sx"),
        or_zero(div(F.covar_samp(p, b), F.var_samp(b))).alias("beta"), F.var_samp(b).alias("_vb"), or_zero(corr_of(p, b)).alias("correlation"),
        F.min("dp").alias("portfolio_drawdown"), F.min("db").alias("benchmark_drawdown"), F.min("dr").alias("relative_drawdown"),
        F.avg(F.when(ex > 0, 1.0).otherwise(0.0)).alias("hit_ratio"), or_zero(cov(up)).alias("up_beta"), or_zero(cov(down)).alias("down_beta"),
        or_zero(div(F.avg(when(up, p)), F.avg(when(up, b)))).alias("up_capture"), or_zero(div(F.avg(when(down, p)), F.avg(when(down, b)))).alias("down_capture"))
    n = F.col("n")
    daily_alpha = F.col("_mp") - F.col("beta") * F.col("_mb")
    a = a.withColumns({"portfolio_return": annualized(F.col("_gp"), n), "benchmark_return": annualized(F.col("_gb"), n)})
    residual = (n - 1) / n * (F.col("_sp") ** 2) * (1 - F.col("correlation") ** 2)
    se = F.sqrt(residual * (1 / n + F.col("_mb") ** 2 / (n * F.col("_vb"))))
    a = a.withColumns({"alpha_t": or_zero(div(daily_alpha, se)), "excess_t": or_zero(div("_mx", F.col("_sx") / F.sqrt(n)))})
    return a.select(
        *keys, "portfolio_return", "benchmark_return", (F.col("portfolio_return") - F.col("benchmark_return")).alias("excess_return"),
        (F.col("_sp") * YEAR).alias("portfolio_volatility"), (F.col("_sx") * YEAR).alias("tracking_error"), or_zero(div("_mx", "_sx") * YEAR).alias("information_ratio"),
        or_zero(div(F.col("portfolio_return") - rf, "beta")).alias("treynor"), "beta", (daily_alpha * TRADING_DAYS).alias("alpha"), "correlation",
        (F.col("correlation") ** 2).alias("r_squared"), "portfolio_drawdown", "benchmark_drawdown", "relative_drawdown", "excess_t",
        student_tail("excess_t", n - 1).alias("excess_p"), "alpha_t", student_tail("alpha_t", n - 2).alias("alpha_p"), "hit_ratio", "up_beta", "down_beta",
        "up_capture", "down_capture")


def multi_period(aligned: DataFrame, periods=(21, 63, 126, 252, 504, 756), keys=("symbol",)) -> DataFrame:
    """Metrics of the last k rows for each k; periods with fewer than ten rows are left out.

    Rows are ranked once from the newest; each row belongs to every period that reaches it.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc("ts"))
    ranked = aligned.dropna(subset=["ret", "bench"]).withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= max(periods))
    rows = ranked.select("*", F.explode(F.array(*[F.lit(k) for k in periods])).alias("period")).where(F.col("_k") <= F.col("period"))
    ex = F.col("ret") - F.col("bench")
    a = rows.groupBy(*keys, "period").agg(
        F.count(F.lit(1)).alias("n"), F.product(1 + F.col("ret")).alias("_gp"), F.product(1 + F.col("bench")).alias("_gb"),
        (F.stddev_samp(ex) * YEAR).alias("tracking_error"), or_zero(div(F.avg(ex), F.stddev_samp(ex)) * YEAR).alias("information_ratio"),
        F.avg(F.when(ex > 0, 1.0).otherwise(0.0)).alias("hit_ratio"))
    n = F.col("n")
    return a.where("n >= 10").select(*keys, "period", "n", annualized(F.col("_gp"), n).alias("portfolio_return"),
                                     annualized(F.col("_gb"), n).alias("benchmark_return"), "tracking_error", "information_ratio", "hit_ratio")


def factor_attribution(rows: DataFrame, factors: list[str], keys=("symbol",), minimum=10) -> DataFrame:
    """Least squares of ret on the factors: alpha, betas, beta x mean contributions, R-squared."""
    f = least_squares(rows, "ret", factors, keys).where(F.col("n") >= minimum)
    return f.select(*keys, "n", "alpha", "r_squared", *[f"beta_{x}" for x in factors],
                    *[(F.col(f"beta_{x}") * F.col(f"mean_{x}")).alias(f"contribution_{x}") for x in factors])


def brinson(rows: DataFrame, key="portfolio", sector="sector") -> DataFrame:
    """(key, sector, wp, wb, rp, rb) to allocation, selection and interaction, with a total row per key."""
    wp, wb, rp, rb = (F.coalesce(c, F.lit(0.0)) for c in ("wp", "wb", "rp", "rb"))
    e = rows.select(key, sector, ((wp - wb) * rb).alias("allocation"), (wb * (rp - rb)).alias("selection"), ((wp - wb) * (rp - rb)).alias("interaction"))
    g = e.groupingSets([[key, sector], [key]], key, sector).agg(*[F.sum(c).alias(c) for c in ("allocation", "selection", "interaction")])
    return g.withColumn(sector, F.coalesce(sector, F.lit("total"))).withColumn("total", F.col("allocation") + F.col("selection") + F.col("interaction"))


def sector_table(wp: DataFrame, wb: DataFrame, rp: DataFrame, rb: DataFrame, on) -> DataFrame:
    """Union of the keys of four tables, missing numbers are zero."""
    out = wp
    for t in (wb, rp, rb):
        out = out.join(t, on, "full_outer")
    return out.fillna(0.0)


def sector_attribution(holdings: DataFrame, sector_returns: DataFrame, benchmark: DataFrame, key="portfolio") -> DataFrame:
    """Sector weight of the holdings, its return contribution and the allocation effect; selection is zero."""
    w = holdings.groupBy(key, "sector").agg(F.sum("w").alias("wp"))
    j = w.join(sector_returns, "sector").join(benchmark, "sector", "left").fillna(0.0, ["wb"])
    return j.select(key, "sector", "wp", "wb", (F.col("wp") * F.col("ret")).alias("contribution"),
                    ((F.col("wp") - F.col("wb")) * F.col("ret")).alias("allocation"), F.lit(0.0).alias("selection"))


# ---- composition of strategies: one row per strategy ----------------------------------------------------------------
def compose(stats: DataFrame, scheme: str, low: float, high: float) -> DataFrame:
    """(strategy, ret, volatility, sharpe) to weights, clipped to [low, high] and rescaled to one."""
    raw = {"risk_parity": 1 / F.greatest("volatility", F.lit(0.01)), "sharpe": F.greatest("sharpe", F.lit(0.01)),
           "dynamic": F.greatest(F.col("sharpe") * (1 + F.col("ret")), F.lit(0.01)), "equal": F.lit(1.0)}[scheme]
    whole = Window.partitionBy(F.lit(0))            # as many rows as strategies
    w = stats.withColumn("w", raw / F.sum(raw).over(whole)).withColumn("w", F.greatest(F.least("w", F.lit(high)), F.lit(low)))
    return w.withColumn("w", F.col("w") / F.sum("w").over(whole))


def composition_metrics(alloc: DataFrame, target_volatility: float | None = None) -> DataFrame:
    """Return, zero-correlation risk, Sharpe, effective number, largest weight, and the scale to a target volatility."""
    a = alloc.agg(F.sum(F.col("w") * F.col("ret")).alias("expected_return"), F.sqrt(F.sum(F.pow(F.col("w") * F.col("volatility"), 2))).alias("expected_risk"),
                  (1 / F.sum(F.col("w") * F.col("w"))).alias("effective_strategies"), F.max("w").alias("concentration"))
    a = a.withColumn("sharpe", or_zero(div("expected_return", "expected_risk")))
    return a if target_volatility is None else a.withColumn("scale", or_zero(div(F.lit(target_volatility), "expected_risk")))


def risk_utilization(alloc: DataFrame, budget: Column) -> DataFrame:
    """Share of w x volatility in its sum over the budget of the strategy."""
    whole = Window.partitionBy(F.lit(0))
    x = F.col("w") * F.col("volatility")
    return alloc.select("strategy", "w", or_zero(div(div(x, F.sum(x).over(whole)), budget)).alias("utilization"))


def weight_trades(current: DataFrame, target: DataFrame, on="strategy", smallest=1e-6) -> DataFrame:
    j = current.select(on, F.col("w").alias("_c")).join(target.select(on, F.col("w").alias("_t")), on, "full_outer").fillna(0.0)
    return j.select(on, (F.col("_t") - F.col("_c")).alias("trade")).where(F.abs("trade") > smallest)
