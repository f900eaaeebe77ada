"""Linear factor models: fit per asset, portfolio exposures, forecasts and shocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from quantloom.functions.scalar import TRADING_DAYS, div
from quantloom.operators.metrics import column_moments, least_squares


def fit_assets(returns: DataFrame, factors: list[str], alpha: float = 0.1, minimum: int = 60, key="symbol") -> DataFrame:
    """Ridge loadings and annualised specific risk; an asset with too few rows has zero loadings and 0.1."""
    f = least_squares(returns, "ret", factors, [key], ridge=alpha)
    enough = F.col("n") >= minimum
    return f.select(key, "n", *[F.when(enough, F.col(f"beta_{x}")).otherwise(0.0).alias(f"beta_{x}") for x in factors],
                    F.when(enough, F.sqrt("residual_variance") * math.sqrt(TRADING_DAYS)).otherwise(0.1).alias("specific_risk"))


def annual_factor_covariance(factors: DataFrame, names: list[str]) -> DataFrame:
    """(i, j, cov) annualised; as many rows as factor pairs."""
    return column_moments(factors, names)[1].select("i", "j", (F.col("cov") * TRADING_DAYS).alias("cov"))


def portfolio_exposures(weights: DataFrame, loadings: DataFrame, factors: list[str], key="portfolio") -> DataFrame:
    """Weighted loadings and the specific variance per portfolio."""
    j = weights.join(loadings, "symbol")
    return j.groupBy(key).agg(*[F.sum(F.col("w") * F.col(f"beta_{x}")).alias(f"b_{x}") for x in factors],
                              F.sum(F.pow(F.col("w") * F.col("specific_risk"), 2)).alias("specific_variance"))


def risk_split(exposures: DataFrame, cov: DataFrame, factors: list[str], key="portfolio") -> DataFrame:
    """Factor, specific and total risk, and exposure x own variance / total per factor.

    The factor covariance (factors squared) becomes one row beside each portfolio.
    """
    cell = lambda a, b: F.max(F.when((F.col("i") == a) & (F.col("j") == b), F.col("cov"))).alias(f"c_{a}_{b}")
    one = cov.agg(*[cell(a, b) for a in factors for b in factors])
    d = exposures.join(F.broadcast(one), F.lit(True))
    var = sum((F.col(f"b_{a}") * F.col(f"b_{b}") * F.col(f"c_{a}_{b}") for a in factors for b in factors), F.lit(0.0))
    d = d.withColumn("factor_variance", F.greatest(var, F.lit(0.0)))
    total = F.sqrt(F.col("factor_variance") + F.col("specific_variance"))
    return d.select(key, *[f"b_{x}" for x in factors], F.sqrt("factor_variance").alias("factor_risk"), F.sqrt("specific_variance").alias("specific_risk"),
                    total.alias("total_risk"), *[div(F.col(f"b_{x}") * F.col(f"c_{x}_{x}"), total).alias(f"contribution_{x}") for x in factors])


def forecast(factors: DataFrame, names: list[str], horizon=30, decay: float | None = None) -> DataFrame:
    """Mean x horizon, or with exponentially fading weights by calendar age in rows."""
    if decay is None:
        return factors.agg(*[(F.avg(x) * horizon).alias(x) for x in names])
    # age in days before the newest row: a one-row scalar
    newest = factors.agg(F.max("ts").alias("_last"))
    w = F.exp(-decay * F.datediff("_last", "ts"))
    d = factors.join(F.broadcast(newest), F.lit(True)).withColumn("_w", w)
    return d.agg(*[(F.sum(F.col("_w") * F.col(x)) / F.sum("_w") * horizon).alias(x) for x in names])


def factor_summary(factors: DataFrame, names: list[str]) -> DataFrame:
    long = factors.select("ts", F.inline(F.array(*[F.struct(F.lit(x).alias("factor"), F.col(x).alias("ret")) for x in names])))
    a = long.groupBy("factor").agg((F.avg("ret") * TRADING_DAYS).alias("annual_return"),
                                   (F.stddev_samp("ret") * math.sqrt(TRADING_DAYS)).alias("annual_volatility"))
    return a.withColumn("sharpe", F.coalesce(div("annual_return", "annual_volatility"), F.lit(0.0)))


def shock(exposures: DataFrame, shocks: dict[str, float], key="portfolio") -> DataFrame:
    parts = {f"impact_{x}": F.col(f"b_{x}") * s for x, s in shocks.items()}
    total = sum(parts.values(), F.lit(0.0))
    return exposures.select(key, *[c.alias(n) for n, c in parts.items()], total.alias("impact"))
