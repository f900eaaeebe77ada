"""Stress scenarios.  Losses are linear in the scenario, so positions are added up once per portfolio and the few
scenarios are applied to the sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Shock multiplier per sector, 1.0 for any other.
SECTOR_MULTIPLIER = {"Technology": 1.2, "Financials": 1.5, "Healthcare": 0.8, "Consumer": 1.0, "Energy": 1.8,
                     "Utilities": 0.6, "Real Estate": 1.4}


def multiplier(sector) -> Column:
    table = F.create_map(*[F.lit(v) for kv in SECTOR_MULTIPLIER.items() for v in kv])
    return F.coalesce(table[F.col(sector)], F.lit(1.0))


def scenario_rows(scenarios: list[dict]) -> Column:
    """Scenario literals as an exploded struct: name, market_shock, vol_mult, liquidity."""
    return F.inline(F.array(*[F.struct(
        F.lit(s["name"]).alias("scenario"), F.lit(float(s.get("market_shock", -0.2))).alias("market_shock"),
        F.lit(float(s.get("vol_mult", 1.5))).alias("vol_mult"), F.lit(float(s.get("liquidity", 0.01))).alias("liquidity"))
        for s in scenarios]))


def portfolio_sums(positions: DataFrame) -> DataFrame:
    """Sums of value x beta, value x weight, value x volatility and value x duration per portfolio."""
    v = F.col("value")
    return positions.groupBy("portfolio").agg(
        F.sum(v).alias("base_value"), F.sum(v * F.coalesce("beta", F.lit(1.0))).alias("_beta"), F.sum(v * F.col("w")).alias("_w"),
        F.sum(v * F.col("volatility")).alias("_vol"), F.sum(v * F.col("duration")).alias("_dur"))


def _pnl(df: DataFrame, pnl: Column) -> DataFrame:
    return df.withColumn("pnl", pnl).select(
        "portfolio", "scenario", "base_value", (F.col("base_value") + F.col("pnl")).alias("stressed_value"), "pnl",
        F.when(F.col("base_value") > 0, 100 * F.col("pnl") / F.col("base_value")).otherwise(0.0).alias("pnl_percent"))


def historical_shock(positions: DataFrame, scenarios: list[dict]) -> DataFrame:
    """Value x beta x market shock."""
    s = portfolio_sums(positions).select("*", scenario_rows(scenarios))
    return _pnl(s, F.col("_beta") * F.col("market_shock"))


def custom_shock(positions: DataFrame, scenarios: list[dict]) -> DataFrame:
    """Market loss, liquidity cost that grows with the weight, and a volatility cost."""
    s = portfolio_sums(positions).select("*", scenario_rows(scenarios))
    return _pnl(s, F.col("_beta") * 0 + F.col("base_value") * F.col("market_shock") - F.col("_w") * F.col("liquidity") * 10
                - F.col("_vol") * (F.col("vol_mult") - 1))


def sector_exposures(positions: DataFrame) -> DataFrame:
    """(portfolio, sector, exposure = share of value, base_value)."""
    per = positions.groupBy("portfolio", "sector").agg(F.sum("value").alias("_v"))
    total = positions.groupBy("portfolio").agg(F.sum("value").alias("base_value"))
    return per.join(total, "portfolio").select("portfolio", "sector", "base_value", (F.col("_v") / F.col("base_value")).alias("exposure"))


def sector_impacts(exposures: DataFrame, scenarios: list[dict]) -> DataFrame:
    s = exposures.select("*", scenario_rows(scenarios))
    return s.select("portfolio", "sector", "scenario",
                    (F.col("base_value") * F.col("exposure") * F.col("market_shock") * multiplier("sector") * F.col("vol_mult")).alias("impact"))


def factor_shock(positions: DataFrame, exposures: DataFrame, rate_change: float, duration_impact=-0.05,
                 sector_shocks: dict | None = None, name="factor_shock") -> DataFrame:
    """Rate move through duration plus sector moves; VaR is a fixed multiple of the impact."""
    p = portfolio_sums(positions).withColumn("scenario", F.lit(name))
    items = [F.lit(v) for kv in (sector_shocks or {}).items() for v in kv]
    shock = F.create_map(*items)[F.col("sector")] if items else F.lit(None).cast("double")
    sec = exposures.groupBy("portfolio").agg(F.coalesce(F.sum(F.col("base_value") * F.col("exposure") * shock), F.lit(0.0)).alias("_sec"))
    out = _pnl(p.join(sec, "portfolio"), F.col("_dur") * rate_change * duration_impact + F.col("_sec"))
    return out.withColumns({"var_95": F.col("pnl") * 1.2, "var_99": F.col("pnl") * 1.5})


def uniform(*parts) -> Column:
    """Reproducible number in (0, 1) from a hash of its parts: a retried task draws the same."""
    return (F.pmod(F.xxhash64(*parts), F.lit(2 ** 52)).cast("double") + 0.5) / 2.0 ** 52


def normal_draw(*parts) -> Column:
    a, b = uniform(F.lit("a"), *parts), uniform(F.lit("b"), *parts)
    return F.sqrt(-2 * F.ln(a)) * F.cos(2 * 3.141592653589793 * b)


def one_factor_scenarios(assets: DataFrame, paths: int, horizon: int, correlation_up=0.0, seed=42) -> DataFrame:
    """(portfolio, path, ret): horizon sums of correlated normal returns of the positions, weighted.

    Correlation is 0.3 plus the increase, at most 0.9; the common part of a path is drawn once by its hash.
    """
    rho = min(0.3 + correlation_up, 0.9)
    d = assets.select("portfolio", "symbol", "w", "volatility", F.explode(F.sequence(F.lit(1), F.lit(paths))).alias("path"))
    z0 = normal_draw(F.lit(seed), F.col("path"))
    zi = normal_draw(F.lit(seed), F.col("path"), F.col("symbol"))
    ret = F.col("w") * F.col("volatility") * (horizon / 252.0) ** 0.5 * (rho ** 0.5 * z0 + (1 - rho) ** 0.5 * zi)
    return d.groupBy("portfolio", "path").agg(F.sum(ret).alias("ret"))


def scenario_distribution(scenario_returns: DataFrame, key="portfolio") -> DataFrame:
    """Mean, deviation and loss percentiles of a scenario-return table."""
    p = F.percentile("ret", F.array(F.lit(.05), F.lit(.01)))
    return scenario_returns.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"),
                                             F.min("ret").alias("worst"), p.alias("_p")).select(
        key, "n", "mean", "sd", "worst", F.col("_p")[0].alias("var_95"), F.col("_p")[1].alias("var_99"))


def result_history(results: DataFrame, portfolio=None, start=None, end=None, time="ts") -> DataFrame:
    """Stored results of one portfolio and period, newest first."""
    if portfolio is not None:
        results = results.where(F.col("portfolio") == portfolio)
    if start is not None:
        results = results.where(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        results = results.where(F.col(time) <= F.lit(end).cast("timestamp_ntz"))
    return results.orderBy(F.desc(time))
