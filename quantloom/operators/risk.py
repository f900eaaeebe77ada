"""Value at risk, its backtest, and the overall risk score."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.functions.scalar import TRADING_DAYS, div
from quantloom.functions.stats import Z_ONE_SIDED, normal_density, normal_tail
from quantloom.operators.series import Series
from quantloom.operators.sets import top_per_key
from quantloom.operators.student import student_fit

LEVELS = (0.95, 0.99)


def tag(level: float) -> str:
    return str(int(round(level * 100)))


def recent(returns: DataFrame, keys=("symbol",), rows: int = 252, minimum: int = 30) -> DataFrame:
    """The last `rows` returns of each key that has at least `minimum`."""
    last = top_per_key(returns.select(*keys, "ts", "ret"), list(keys), [F.desc("ts")], rows, "_k")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return last.withColumn("_n", n).where(F.col("_n") >= minimum).drop("_k", "_n")


def historical_var(returns: DataFrame, value: float = 1.0, keys=("symbol",), rows=252, levels=LEVELS) -> DataFrame:
    """Interpolated percentile of the recent returns and the mean beyond it, as losses in money."""
    whole = Window.partitionBy(*keys)
    q = F.percentile("ret", F.array(*[F.lit(1 - c) for c in levels])).over(whole)
    d = recent(returns, keys, rows).withColumn("_q", q)
    out = []
    for i, c in enumerate(levels):
        out += [(-F.first(F.col("_q")[i]) * value).alias(f"var_{tag(c)}"),
                (-F.avg(F.when(F.col("ret") <= F.col("_q")[i], F.col("ret"))) * value).alias(f"cvar_{tag(c)}")]
    return d.groupBy(*keys).agg(*out)


def normal_var(returns: DataFrame, value: float = 1.0, keys=("symbol",), rows=252, levels=LEVELS) -> DataFrame:
    m = recent(returns, keys, rows).groupBy(*keys).agg(F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"))
    out = []
    for c in levels:
        z = Z_ONE_SIDED[c]
        out += [(-(F.col("_m") - z * F.col("_s")) * value).alias(f"var_{tag(c)}"),
                (-(F.col("_m") - F.col("_s") * normal_density(z) / (1 - c)) * value).alias(f"cvar_{tag(c)}")]
    return m.select(*keys, *out)


def student_quantile(p: float, dof: Column) -> Column:
    """Lower quantile of Student's t by the Cornish-Fisher expansion in 1/dof, refined with Newton steps on the
    numerically integrated distribution up to 1000 degrees (beyond, the expansion is exact to 1e-8); null dof is the normal limit.
    Runs on aggregated rows."""
    @F.pandas_udf("double")
    def f(nu: pd.Series) -> pd.Series:
        nodes, weights = np.polynomial.legendre.leggauss(200)
        from statistics import NormalDist
        z = NormalDist().inv_cdf(p)
        every = nu.fillna(math.inf).to_numpy(float)
        wide = z + (z**3 + z) / (4 * every) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * every**2)
        n = np.minimum(every, 1000.0)
        x = z + (z**3 + z) / (4 * n)
        scale = np.array([math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi) for v in n])
        for _ in range(60):
            low = np.arctan(np.abs(x) / np.sqrt(n))
            half = (math.pi / 2 - low) / 2
            angle = low[:, None] + half[:, None] * (nodes[None, :] + 1)
            upper = scale * half * ((np.cos(angle) ** (n[:, None] - 1)) @ weights)
            cdf = np.where(x < 0, upper, 1 - upper)
            density = scale / np.sqrt(n) * (1 + x * x / n) ** (-(n + 1) / 2)
            x = x - (cdf - p) / density
        return pd.Series(np.where(every > 1000, wide, x))
    return f(dof)


def student_var(returns: DataFrame, value: float = 1.0, keys=("symbol",), rows=252, levels=LEVELS, fit: str = "likelihood") -> DataFrame:
    """Value at risk of a Student-t fitted by maximum likelihood, or with `fit="moments"` by the kurtosis (4 + 6/excess).

    dof is null where the fit has its normal limit: no finite maximum, or no excess kurtosis.  The limit takes the sample deviation.
    """
    last = recent(returns, keys, rows)
    if fit == "likelihood":
        m = student_fit(last, keys, "ret")
        own = F.when(F.col("dof").isNotNull(), F.col("scale")).otherwise(F.col("scale") * F.sqrt(F.col("n") / (F.col("n") - 1)))
        m = m.select(*keys, "dof", F.col("location").alias("_m"), own.alias("_scale"))
    elif fit == "moments":
        m = last.groupBy(*keys).agg(F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"), F.kurtosis("ret").alias("_k"))
        m = m.withColumn("dof", F.when(F.col("_k") > 0, 4 + 6 / F.col("_k")))
        m = m.withColumn("_scale", F.col("_s") * F.coalesce(F.sqrt(1 - 2 / F.col("dof")), F.lit(1.0)))
    else:
        raise ValueError(f"unknown fit {fit}")
    out = m
    for c in levels:
        q = f"_q{tag(c)}"
        out = out.withColumn(q, student_quantile(1 - c, F.col("dof")))
        density = F.pow(1 + F.col(q) ** 2 / F.col("dof"), -(F.col("dof") + 1) / 2) * _student_scale("dof")
        normal = F.exp(-F.col(q) ** 2 / 2) / math.sqrt(2 * math.pi) / (1 - c)
        tail = F.when(F.col("dof").isNull(), normal).when(F.col("dof") > 1, density / (1 - c) * (F.col("dof") + F.col(q) ** 2) / (F.col("dof") - 1))     # no mean, no tail mean
        out = out.withColumns({f"var_{tag(c)}": -(F.col("_m") + F.col("_scale") * F.col(q)) * value,
                               f"cvar_{tag(c)}": -(F.col("_m") - F.col("_scale") * tail) * value})
    return out.select(*keys, "dof", *[f"{k}_{tag(c)}" for c in levels for k in ("var", "cvar")])


def _student_scale(dof: str) -> Column:
    @F.pandas_udf("double")
    def f(n: pd.Series) -> pd.Series:
        # ratio of gamma functions; its series where the logarithms would cancel
        return n.map(lambda v: None if pd.isna(v) else math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi * v) if v <= 1000
                     else (1 - 1 / (4 * v) + 1 / (32 * v * v)) / math.sqrt(2 * math.pi))
    return f(F.col(dof))


def bootstrap_var(returns: DataFrame, confidence=0.95, value=1.0, replicates=1000, key="symbol", rows=252) -> DataFrame:
    """2.5% and 97.5% percentiles of the resampled historical VaR.

    A group is the recent window of one key (at most `rows` rows); the draw is seeded by the key, so a repeated task
    gives the same interval.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("ts")["ret"].to_numpy(float)
        rng = np.random.default_rng(zlib.crc32(str(pdf[key].iloc[0]).encode()))
        draws = r[rng.integers(0, len(r), size=(replicates, len(r)))]
        var = -np.percentile(draws, 100 * (1 - confidence), axis=1) * value
        return pd.DataFrame({key: [pdf[key].iloc[0]], "low": [np.percentile(var, 2.5)], "high": [np.percentile(var, 97.5)]})
    d = recent(returns, [key], rows)
    kind = dict(d.dtypes)[key]
    return d.groupBy(key).applyInPandas(run, f"{key} {kind}, low double, high double")


def component_var(returns: DataFrame, weights: DataFrame, confidence=0.95, epsilon=0.001, rows=252,
                  portfolio="portfolio") -> DataFrame:
    """Weight times the change of the historical VaR when the weight grows by epsilon and all are rescaled.

    With weights that sum to W the disturbed portfolio earns (W R + epsilon r) / (W + epsilon), so every disturbed
    series follows from the portfolio return and the own return of a row; all of them are one aggregate.
    """
    w = weights.select(portfolio, "symbol", "w")
    j = returns.select("symbol", "ts", "ret").join(w, "symbol")
    total = w.groupBy(portfolio).agg(F.sum("w").alias("_w"))
    port = j.groupBy(portfolio, "ts").agg(F.sum(F.col("w") * F.col("ret")).alias("_r"))
    last = top_per_key(port, [portfolio], [F.desc("ts")], rows, "_k").join(total, portfolio)
    level = F.percentile("_r", F.lit(1 - confidence))
    base = last.groupBy(portfolio).agg((-level).alias("portfolio_var"))
    grid = last.join(w, portfolio).join(returns.select("symbol", "ts", "ret"), ["symbol", "ts"], "left")
    moved = (F.col("_r") + epsilon * F.coalesce("ret", F.lit(0.0))) / (F.col("_w") + epsilon)
    per = grid.withColumn("_moved", moved).groupBy(portfolio, "symbol", "w").agg(
        (-F.percentile("_moved", F.lit(1 - confidence))).alias("_v"))
    return per.join(base, portfolio).select(
        portfolio, "symbol", "w", "portfolio_var", ((F.col("_v") - F.col("portfolio_var")) / epsilon * F.col("w")).alias("component_var"))


def var_backtest(returns: DataFrame, estimates: DataFrame, confidence=0.95, keys=("symbol",)) -> DataFrame:
    """Violations of the estimate, Kupiec likelihood ratio with p value, runs of violations, mean violation.

    The ratio is the textbook one: -2 ln of the expected over the observed likelihood.
    """
    p = 1 - confidence
    d = returns.join(estimates, [*keys, "ts"]).dropna(subset=["ret", "var"])
    s = Series(d.withColumn("_v", (F.col("ret") < -F.col("var")).cast("int")), list(keys))
    start = F.when((F.col("_v") == 1) & (F.coalesce(s.lag("_v"), F.lit(0)) == 0), 1).otherwise(0)
    a = s.frame({"_start": start}).groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("_v").cast("double").alias("x"), F.sum("_start").alias("clusters"),
        F.coalesce(F.avg(F.when(F.col("_v") == 1, F.col("ret"))), F.lit(0.0)).alias("average_violation"))
    n, x = F.col("n"), F.col("x")
    rate = x / n
    lr = 2 * (x * F.ln(F.when(x > 0, rate) / p) + (n - x) * F.ln(F.when(x < n, 1 - rate) / (1 - p)))
    a = a.withColumns({"violation_rate": rate, "kupiec": lr})
    return a.select(*keys, "violation_rate", "kupiec", normal_tail(F.sqrt(F.greatest("kupiec", F.lit(0.0)))).alias("kupiec_p"),
                    "clusters", "average_violation")


def rolling_normal_var(returns: DataFrame, window=60, confidence=0.95, keys=("symbol",)) -> DataFrame:
    """(keys, ts, var) from the `window` returns before each row."""
    s = Series(returns.select(*keys, "ts", "ret"), keys)
    w = s.order.rowsBetween(-window, -1)
    var = -(F.avg("ret").over(w) - Z_ONE_SIDED[confidence] * F.stddev_samp("ret").over(w))
    return s.frame({"var": F.when(s.row > window, var)}, keep=[*keys, "ts"]).dropna()


def overall_score(m: DataFrame) -> DataFrame:
    """0-100 score from var_95, volatility, worst_stress (percent), liquidity_score and concentration_score."""
    score = (F.least(F.abs("var_95") * 500, F.lit(25.0)) + F.least(F.col("volatility") * 80, F.lit(20.0))
             + F.coalesce(F.least(F.abs("worst_stress") * 0.5, F.lit(25.0)), F.lit(10.0))
             + F.greatest(15 - F.col("liquidity_score") * 0.15, F.lit(0.0))
             + F.least(F.col("concentration_score") * 0.25, F.lit(15.0)))
    return m.withColumn("risk_score", F.least(score, F.lit(100.0)))


# Fixed values: (name, metric, comparison, limit, advice).  The stress limit is in percent.
ADVICE = (
    ("value_at_risk", "var_95", ">", 0.05, "reduce position sizes or hedge"),
    ("volatility", "volatility", ">", 0.25, "diversify"),
    ("drawdown", "max_drawdown", ">", 0.15, "review the drawdown rules"),
    ("stress", "worst_stress", "<", -20.0, "hedge the stress scenarios"),
    ("liquidity", "liquidity_score", "<", 50.0, "hold more liquid assets"),
    ("concentration", "concentration_score", ">", 50.0, "spread over more positions and sectors"),
)
ABSOLUTE = ("var_95", "max_drawdown")


def recommendations(m: DataFrame, key="portfolio", rules=ADVICE) -> DataFrame:
    """(key, rule, value, limit, advice) for each rule a metric row meets."""
    hits = []
    for name, metric, op, limit, advice in rules:
        v = F.abs(metric) if metric in ABSOLUTE else F.col(metric)
        hits.append(F.when((v > limit) if op == ">" else (v < limit), F.struct(
            F.lit(name).alias("rule"), v.cast("double").alias("value"), F.lit(float(limit)).alias("limit"), F.lit(advice).alias("advice"))))
    return m.select(key, F.inline(F.array_compact(F.array(*hits))))
