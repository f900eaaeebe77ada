"""Return and drawdown metrics per key: one exchange by key, one aggregate.

A return series holds one row per key and period; a key is bounded by the calendar, whatever the data size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.functions.linear import dot, solve_symmetric
from quantloom.functions.scalar import TRADING_DAYS, corr_of, div
from quantloom.functions.stats import chi2_tail_even, student_tail, unbiased_kurtosis, unbiased_skewness
from quantloom.operators.series import Layers, Series

YEAR = math.sqrt(TRADING_DAYS)
ZERO = 1e-12          # a drawdown smaller than this is the rounding of a new peak
R = "ret"


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def growth_factor(r=R) -> Column:
    return F.product(1 + F.col(r))


def annualized(factor: Column, n: Column) -> Column:
    return F.when(factor > 0, F.pow(factor, TRADING_DAYS / n) - 1)


def with_drawdown(returns: DataFrame, keys, ts="ts") -> DataFrame:
    """Growth, drawdown from the running peak (which starts at the first value), and the id of the run below it."""
    s = Series(returns, keys, ts)
    growth = s.let(s.running_product(s.let(1 + F.col(R))))
    dd = s.let(div(growth, s.running_max(growth)) - 1)
    under = dd < -ZERO
    run = s.running_sum(s.let(F.when(under, 0).otherwise(1)))
    return s.frame({"growth": growth, "drawdown": dd, "under": under, "run": run})


def performance(returns: DataFrame, keys=("symbol",), rf: float = 0.02) -> DataFrame:
    """Return, volatility, Sharpe, Sortino, Calmar and drawdown metrics of each key."""
    d = with_drawdown(returns.select(*keys, "ts", R), keys)
    per_run = Window.partitionBy(*keys, "run")
    d = d.withColumn("run_length", F.count_if(F.col("under")).over(per_run))
    n, ex = F.count(R), F.col(R) - rf / TRADING_DAYS
    a = d.groupBy(*keys).agg(
        n.alias("n"), growth_factor().alias("_g"), F.avg(R).alias("_m"), F.stddev_samp(R).alias("_sd"),
        F.avg(ex).alias("_mx"), F.stddev_samp(F.when(ex < 0, ex)).alias("_dn"), F.min("drawdown").alias("max_drawdown"),
        F.avg(F.when(F.col("under"), F.col("drawdown"))).alias("average_drawdown"),
        F.max("run_length").alias("drawdown_duration"))
    total = F.col("_g") - 1
    ann = annualized(F.col("_g"), F.col("n"))
    depth = F.abs("max_drawdown")
    return a.select(*keys, "n", total.alias("total_return"), ann.alias("annualized_return"),
                    or_zero(F.col("_sd") * YEAR).alias("volatility"),
                    or_zero(div("_mx", "_sd") * YEAR).alias("sharpe"), (div("_mx", "_dn") * YEAR).alias("sortino"),
                    or_zero(div(ann, depth)).alias("calmar"), "max_drawdown",
                    or_zero(F.col("average_drawdown")).alias("average_drawdown"),
                    or_zero(div(total, depth)).alias("recovery_factor"), "drawdown_duration")


def distribution(returns: DataFrame, keys=("symbol",)) -> DataFrame:
    """Population moments, interpolated percentiles and the mean of the tail below them."""
    whole = Window.partitionBy(*keys)
    q = returns.withColumn("_q", F.percentile(R, F.array(F.lit(.05), F.lit(.01))).over(whole))
    tail = lambda i: F.avg(F.when(F.col(R) <= F.col("_q")[i], F.col(R)))
    return q.groupBy(*keys).agg(
        F.skewness(R).alias("skewness"), F.kurtosis(R).alias("kurtosis"), F.first(F.col("_q")[0]).alias("var_95"),
        F.first(F.col("_q")[1]).alias("var_99"), tail(0).alias("cvar_95"), tail(1).alias("cvar_99"))


def win_loss(x: Column) -> dict[str, Column]:
    """Share of gains and average, largest and total gains and losses; no profit factor without a loss."""
    up, down = F.when(x > 0, x), F.when(x < 0, x)
    return {"win_rate": F.avg(F.when(x > 0, 1.0).otherwise(0.0)),
            "profit_factor": F.when(F.sum(up).isNull(), 0.0).otherwise(div(F.sum(up), F.abs(F.sum(down)))),
            "average_win": or_zero(F.avg(up)), "average_loss": or_zero(F.avg(down)),
            "largest_win": or_zero(F.max(up)), "largest_loss": or_zero(F.min(down))}


def trading_metrics(rows: DataFrame, value: str = R, keys=("symbol",), skip_zero=False) -> DataFrame:
    """From returns, or from non-zero trade profits."""
    rows = rows.where(F.col(value) != 0) if skip_zero else rows
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in win_loss(F.col(value)).items()])


def tail_metrics(returns: DataFrame, keys=("symbol",)) -> DataFrame:
    p = F.percentile(R, F.array(F.lit(.95), F.lit(.05)))
    a = returns.groupBy(*keys).agg(p.alias("_p"), win_loss(F.col(R))["profit_factor"].alias("_pf"))
    ratio = F.abs(div(F.col("_p")[0], F.col("_p")[1]))
    return a.select(*keys, ratio.alias("tail_ratio"), (ratio * F.col("_pf")).alias("common_sense_ratio"))


def stability_ratio(returns: DataFrame, window=252, keys=("symbol",)) -> DataFrame:
    """max(0, 1 - deviation/|mean|) of the rolling Sharpe ratio; 0 below two windows of rows."""
    s = Series(returns.select(*keys, "ts", R), keys)
    sd = s.roll(F.stddev_samp, window, R)
    sharpe = F.when(sd > 0, s.roll(F.avg, window, R) / sd * YEAR).when(sd == 0, 0.0)
    a = s.frame({"_s": sharpe}, keep=list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_s").alias("_m"), F.stddev_samp("_s").alias("_d"))
    ratio = F.greatest(F.lit(0.0), 1 - div("_d", F.abs("_m")))
    return a.select(*keys, F.when(F.col("_n") < 2 * window, 0.0).otherwise(or_zero(ratio)).alias("stability"))


def normality_p(n: Column, skew: Column, kurt: Column) -> Column:
    """D'Agostino K-squared p value from population skewness and excess kurtosis."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.ln(w2))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurt + 3 - mean) / F.sqrt(var)
    beta = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / beta * (2 / beta + F.sqrt(1 + 4 / (beta * beta)))
    core = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = ((1 - 2 / (9 * a)) - F.signum(core) * F.cbrt(F.abs(core))) / F.sqrt(2 / (9 * a))
    return F.exp(-(z1 * z1 + z2 * z2) / 2)


def significance(returns: DataFrame, keys=("symbol",), rf=0.02) -> DataFrame:
    """One-sample t of the mean and of the excess mean with two-sided p values, and a normality p value."""
    a = returns.groupBy(*keys).agg(
        F.count(R).cast("double").alias("n"), F.avg(R).alias("_m"), F.stddev_samp(R).alias("_sd"),
        F.skewness(R).alias("_sk"), F.kurtosis(R).alias("_ku"))
    se = F.col("_sd") / F.sqrt("n")
    a = a.withColumns({"t_stat": div("_m", se), "t_excess": div(F.col("_m") - rf / TRADING_DAYS, se)})
    return a.select(*keys, "t_stat", student_tail("t_stat", F.col("n") - 1).alias("p_value"), "t_excess",
                    student_tail("t_excess", F.col("n") - 1).alias("p_excess"),
                    F.when(F.col("n") >= 20, normality_p(F.col("n"), F.col("_sk"), F.col("_ku"))).alias("normality_p"))


def partial_moments(returns: DataFrame, keys=("symbol",), threshold=0.0) -> DataFrame:
    """Omega, kappa-3, gain/loss and upside potential; means over the conditional subset only."""
    x = F.col(R) - threshold
    up, down = F.when(x > 0, x), F.when(x < 0, x)
    a = returns.groupBy(*keys).agg(
        div(F.sum(up), F.abs(F.sum(down))).alias("omega"),
        div(F.avg(x), F.cbrt(F.abs(F.avg(F.pow(down, 3))))).alias("kappa_3"),
        div(F.avg(up), F.abs(F.avg(down))).alias("gain_loss"),
        div(F.avg(up), F.sqrt(F.avg(F.pow(down, 2)))).alias("upside_potential"))
    return a


def autocorrelation_tests(returns: DataFrame, keys=("symbol",), lags=10) -> DataFrame:
    """Jarque-Bera and Ljung-Box statistics with closed-form p values."""
    s = Series(returns.select(*keys, "ts", R), keys)
    d = s.let(F.col(R) - F.avg(R).over(Window.partitionBy(*keys)))
    wide = s.frame({"_d": d, **{f"_l{k}": d * s.lag(d, k) for k in range(1, lags + 1)}}, keep=[*keys, R])
    a = wide.groupBy(*keys).agg(
        F.count(R).cast("double").alias("n"), F.skewness(R).alias("_s"), F.kurtosis(R).alias("_k"),
        F.sum(F.col("_d") * F.col("_d")).alias("_v"), *[F.sum(f"_l{k}").alias(f"_l{k}") for k in range(1, lags + 1)])
    n = F.col("n")
    jb = n / 6 * (F.col("_s") ** 2 + F.col("_k") ** 2 / 4)
    q = n * (n + 2) * sum((F.pow(div(f"_l{k}", "_v"), 2) / (n - k) for k in range(1, lags + 1)), F.lit(0.0))
    a = a.select(*keys, jb.alias("jarque_bera"), q.alias("ljung_box"))
    return a.select("*", chi2_tail_even("jarque_bera", 2).alias("jb_p"), chi2_tail_even("ljung_box", lags).alias("lb_p"))


def arch_lm(returns: DataFrame, keys=("symbol",), lags=5) -> DataFrame:
    """rows x R-squared of the squared values on their own lags (normal equations from one aggregate)."""
    s = Series(returns.select(*keys, "ts", R), keys)
    sq = s.let(F.col(R) * F.col(R))
    names = [f"x{k}" for k in range(1, lags + 1)]
    w = s.frame({"y": sq, **{f"x{k}": s.lag(sq, k) for k in range(1, lags + 1)}}, keep=list(keys)).dropna()
    return least_squares(w, "y", names, keys).select(*keys, (F.col("n") * F.col("r_squared")).alias("lm"))


def least_squares(rows: DataFrame, y: str, xs: list[str], keys=(), ridge: float = 0.0) -> DataFrame:
    """Per key: n, alpha, beta_*, r_squared of y on xs.

    The products are algebraic aggregates (combined map-side); the small system is solved by column expressions.
    `ridge` penalises the slopes, not the intercept.
    """
    rows = rows.dropna(subset=[y, *xs])
    k = len(xs)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("_my"), F.var_pop(y).alias("_vy")]
    aggs += [F.avg(x).alias(f"_m_{x}") for x in xs] + [F.covar_pop(x, y).alias(f"_y_{x}") for x in xs]
    aggs += [F.covar_pop(xs[i], xs[j]).alias(f"_c_{i}_{j}") for i in range(k) for j in range(i, k)]
    a = rows.groupBy(*keys).agg(*aggs)
    ly = Layers(a)
    cov = [[F.col(f"_c_{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)]
    for i in range(k):
        if ridge:
            cov[i][i] = ly.let(cov[i][i] + ridge / F.col("n"))
    rhs = [F.col(f"_y_{x}") for x in xs]
    beta = solve_symmetric(ly.let, cov, rhs)
    # explained variance written for any slopes, so that it also holds for the penalised fit
    base = [[F.col(f"_c_{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)]
    fitted = dot(beta, [dot(row, beta) for row in base])
    unexplained = F.col("_vy") - 2 * dot(beta, rhs) + fitted
    out = {"alpha": F.col("_my") - dot(beta, [F.col(f"_m_{x}") for x in xs]),
           **{f"beta_{x}": b for x, b in zip(xs, beta)}, "r_squared": 1 - div(unexplained, F.col("_vy")),
           "residual_variance": F.greatest(unexplained, F.lit(0.0)), **{f"mean_{x}": F.col(f"_m_{x}") for x in xs}}
    return ly.frame(out, keep=[*keys, "n"])


def half_split_correlation(aligned: DataFrame, keys=("symbol",)) -> DataFrame:
    """Correlation with the benchmark in the first and second half of the rows (more than 30)."""
    s = Series(aligned, keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    d = s.frame({"_n": n, "_first": s.row <= F.floor(n / 2)}, keep=[*keys, R, "bench"]).where("_n > 30")
    half = lambda first: or_zero(corr_of(F.when(F.col("_first") == first, F.col(R)), F.when(F.col("_first") == first, F.col("bench"))))
    a = d.groupBy(*keys).agg(half(True).alias("first_half"), half(False).alias("second_half"))
    return a.withColumn("change", F.abs(F.col("second_half") - F.col("first_half")))


def risk_summary(returns: DataFrame, keys=("symbol",)) -> DataFrame:
    """Annualised mean and deviation, tail percentiles, ratios without risk-free rate, bias-corrected moments."""
    whole = Window.partitionBy(*keys)
    d = with_drawdown(returns.select(*keys, "ts", R), keys).withColumn(
        "_q", F.percentile(R, F.array(F.lit(.05), F.lit(.01))).over(whole))
    r = F.col(R)
    a = d.groupBy(*keys).agg(
        (F.avg(R) * TRADING_DAYS).alias("mean_return"), (F.stddev_samp(R) * YEAR).alias("volatility"),
        (F.first(F.col("_q")[0]) * YEAR).alias("var_95"), (F.first(F.col("_q")[1]) * YEAR).alias("var_99"),
        (F.avg(F.when(r <= F.col("_q")[0], r)) * YEAR).alias("cvar_95"), F.min("drawdown").alias("max_drawdown"),
        unbiased_skewness(R).alias("skewness"), unbiased_kurtosis(R).alias("kurtosis"),
        or_zero(F.stddev_samp(F.when(r < 0, r)) * YEAR).alias("downside_deviation"))
    m = F.col("mean_return")
    return a.select("*", or_zero(div(m, "volatility")).alias("sharpe"), or_zero(div(m, "downside_deviation")).alias("sortino"),
                    or_zero(div(m, F.abs("max_drawdown"))).alias("calmar"))


def service_metrics(returns: DataFrame, keys=("symbol",)) -> DataFrame:
    """Variant that annualises the mean as (1+mean)^252 - 1 and takes profit factor as |average win / average loss|."""
    d = with_drawdown(returns.select(*keys, "ts", R), keys)
    r = F.col(R)
    a = d.groupBy(*keys).agg(
        (growth_factor() - 1).alias("total_return"), (F.pow(1 + F.avg(R), TRADING_DAYS) - 1).alias("annualized_return"),
        (F.stddev_samp(R) * YEAR).alias("volatility"), F.min("drawdown").alias("max_drawdown"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"), or_zero(F.avg(F.when(r > 0, r))).alias("avg_win"),
        or_zero(F.avg(F.when(r < 0, r))).alias("avg_loss"))
    return a.select("*", or_zero(div("annualized_return", "volatility")).alias("sharpe"),
                    F.abs(div("avg_win", "avg_loss")).alias("profit_factor"))


def benchmark_ratios(aligned: DataFrame, keys=("symbol",), rf=0.02) -> DataFrame:
    """Information ratio and Treynor ratio over rows (keys, ts, ret, bench)."""
    ex = F.col(R) - F.col("bench")
    a = aligned.dropna(subset=[R, "bench"]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (div(F.avg(ex), F.stddev_samp(ex)) * YEAR).alias("information_ratio"),
        div(F.covar_samp(R, "bench"), F.var_samp("bench")).alias("beta"), growth_factor().alias("_g"))
    return a.select(*keys, "n", or_zero(F.col("information_ratio")).alias("information_ratio"), "beta",
                    or_zero(div(annualized(F.col("_g"), F.col("n")) - rf, "beta")).alias("treynor"))


def weighted_portfolio_returns(returns: DataFrame, weights: DataFrame, portfolio="portfolio") -> DataFrame:
    """Sum of w x r per portfolio and date, weights rescaled to the symbols that traded on the date."""
    j = returns.join(weights.select(portfolio, "symbol", "w"), "symbol")
    return j.groupBy(portfolio, "ts").agg(div(F.sum(F.col("w") * F.col(R)), F.sum("w")).alias(R))


def matrix_rows(spark, names, values, value="c") -> DataFrame:
    """k x k numbers (k = number of columns) as rows (i, j, value)."""
    rows = [(a, b, float(values[i][j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return spark.createDataFrame(rows, f"i string, j string, {value} double")


def column_moments(wide: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(mean per column, sample covariance and correlation per column pair) over complete rows.

    The number of columns is fixed by the schema; each pair is an algebraic aggregate of one pass.
    """
    rows = wide.dropna(subset=columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    flat = rows.agg(*[F.avg(c).alias(f"m|{c}") for c in columns], *[F.covar_samp(a, b).alias(f"c|{a}|{b}") for a, b in pairs])
    means = flat.select(F.explode(F.array(*[F.struct(F.lit(c).alias("i"), F.col(f"`m|{c}`").alias("mean")) for c in columns])).alias("r")).select("r.*")
    cells = []
    for a in columns:
        for b in columns:
            x, y = (a, b) if (a, b) in pairs else (b, a)
            cov = F.col(f"`c|{x}|{y}`")
            cells.append(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), cov.alias("cov"),
                                  div(cov, F.sqrt(F.col(f"`c|{a}|{a}`") * F.col(f"`c|{b}|{b}`"))).alias("corr")))
    return means, flat.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def held_pairs(weights: DataFrame, portfolio="portfolio") -> DataFrame:
    """(portfolio, i, j) with i <= j: the cells of each portfolio's matrix, and no others."""
    w = weights.select(portfolio, "symbol").distinct()
    return w.withColumnRenamed("symbol", "i").join(w.withColumnRenamed("symbol", "j"), portfolio).where("i <= j")


def asset_covariance(returns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, n, cov, corr) of the requested pairs, in long form: a pair's sums are combined map-side over the days that both have.

    Nothing is pivoted, so the universe may have any size; the work is requested pairs x days.
    """
    r = returns.where(F.col(R).isNotNull())
    x, y = (r.select(F.col("symbol").alias(s), "ts", F.col(R).alias(f"_{s}")) for s in ("i", "j"))
    d = pairs.select("i", "j").distinct().join(x, "i").join(y, ["j", "ts"])
    return d.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("_i", "_j").alias("cov"), corr_of("_i", "_j").alias("corr"))


def shrunk_asset_covariance(cov: DataFrame, pairs: DataFrame, share=0.1, portfolio="portfolio") -> DataFrame:
    """Per portfolio (1-share) S + share (mean variance of its assets) I, over the cells i <= j."""
    c = pairs.select(portfolio, "i", "j").join(cov, ["i", "j"])
    own = c.where("i = j").groupBy(portfolio).agg(F.avg("cov").alias("_t"))
    s = (1 - share) * F.col("cov") + F.when(F.col("i") == F.col("j"), share * F.col("_t")).otherwise(0.0)
    return c.join(own, portfolio).select(portfolio, "i", "j", s.alias("cov"))


def robust_asset_covariance(returns: DataFrame, weights: DataFrame, pairs: DataFrame | None = None, threshold: float = 2.0, portfolio="portfolio") -> DataFrame:
    """(portfolio, i, j, n, cov) of the held (or the requested) pairs i <= j: sum(w x_i x_j) / sum(w) over the days that both have.

    x is the return around the asset's lower median.  A day's weight w in a portfolio is min(1, threshold / norm) with the norm of all its assets' x of that day; an asset
    without a return adds nothing to a day's norm, so gaps are the portfolio's own.  Where no day is missing, this is the Huber-weighted estimate of the whole matrix.
    Everything is long: a median per asset, a weight per portfolio and day, sums per pair; nothing is pivoted.  Null returns are left out, repeated holdings count once.
    """
    held = weights.select(F.col(portfolio).alias("_p"), "symbol").distinct()
    r = returns.where(F.col(R).isNotNull()).join(held.select("symbol").distinct(), "symbol", "left_semi").select("symbol", "ts", F.col(R).alias("_r"))
    middle = r.groupBy("symbol").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _r)").alias("_m"))
    x = r.join(middle, "symbol").select("symbol", "ts", (F.col("_r") - F.col("_m")).alias("_x"))
    norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")))
    days = held.join(x, "symbol").groupBy("_p", "ts").agg(F.when(norm > threshold, threshold / norm).otherwise(1.0).alias("_w"))
    asked = (held_pairs(weights, portfolio) if pairs is None else pairs.select(portfolio, "i", "j").distinct()).withColumnRenamed(portfolio, "_p")
    a, b = (x.select(F.col("symbol").alias(s), "ts", F.col("_x").alias(f"_{s}")) for s in ("i", "j"))
    d = asked.join(a, "i").join(b, ["j", "ts"]).join(days, ["_p", "ts"])
    w = F.col("_w")
    return d.groupBy("_p", "i", "j").agg(F.count(F.lit(1)).alias("n"), div(F.sum(w * F.col("_i") * F.col("_j")), F.sum(w)).alias("cov")).withColumnRenamed("_p", portfolio)


def shrunk_covariance(cov: DataFrame, share=0.1) -> DataFrame:
    """(1-share) S + share (trace S / n) I over rows (i, j, cov)."""
    diag = cov.where("i = j").agg(F.avg("cov").alias("_t"))            # one row
    own = F.when(F.col("i") == F.col("j"), share * F.col("_t")).otherwise(0.0)
    return cov.join(F.broadcast(diag), F.lit(True)).select("i", "j", ((1 - share) * F.col("cov") + own).alias("cov"))


def robust_covariance(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Centred on the lower median, rows weighted by min(1, 2/norm): sum(w x x') / sum(w)."""
    rows = wide.dropna(subset=columns)
    med = rows.agg(*[F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").alias(f"_m_{c}") for c in columns])
    x = {c: F.col(c) - F.col(f"_m_{c}") for c in columns}
    norm = F.sqrt(sum((v * v for v in x.values()), F.lit(0.0)))
    d = rows.join(F.broadcast(med), F.lit(True)).select(
        F.when(norm > 2, 2 / norm).otherwise(1.0).alias("_w"), *[v.alias(c) for c, v in x.items()])
    pairs = [(a, b) for a in columns for b in columns]
    flat = d.agg(*[div(F.sum(F.col("_w") * F.col(a) * F.col(b)), F.sum("_w")).alias(f"{a}|{b}") for a, b in pairs])
    return flat.select(F.explode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"`{a}|{b}`").alias("cov"))
                                           for a, b in pairs])).alias("r")).select("r.*")


def alert_counts(alerts: DataFrame, since) -> DataFrame:
    """Counts by kind x severity with subtotals, from the given time on."""
    return alerts.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")).cube("kind", "severity").agg(
        F.count(F.lit(1)).alias("n"))


def utilization(value, limit) -> tuple[Column, Column]:
    """Percent of the limit in use and its state: ok, warning above 80, breach above 100."""
    u = 100 * div(value, limit)
    return u, F.when(u > 100, "breach").when(u > 80, "warning").otherwise("ok")
