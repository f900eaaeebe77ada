"""Liquidity of symbols and portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quantloom.functions.scalar import corr_of, div
from quantloom.operators.series import Series

# Lower bounds of dollar volume and upper bounds of spread for tiers 1 to 3.
VOLUME_TIERS = (100e6, 10e6, 1e6)
SPREAD_TIERS = (0.001, 0.005, 0.02)
MAX_PARTICIPATION = 0.20


def symbol_liquidity(bars: DataFrame) -> DataFrame:
    """Spread (half the mean relative range), dollar volume, volume-weighted spread, Amihud, Roll, volatility."""
    s = Series(bars.select("symbol", "ts", "high", "low", "close", "volume"))
    r = s.let(s.pct(s.close))
    spread = div(s.high - s.low, s.close) * 0.5
    d = s.frame({"r": r, "r1": s.lag(r), "spread": spread, "dollars": s.volume * s.close}, keep=["symbol", "volume"])
    amihud = F.avg(F.when((F.col("dollars") > 0) & F.col("r").isNotNull(), F.abs("r") / F.col("dollars"))) * 1e6
    auto = corr_of("r", "r1")
    a = d.groupBy("symbol").agg(
        F.avg("spread").alias("spread"), F.avg("dollars").alias("adv"),
        div(F.sum(F.col("spread") * F.col("volume")), F.sum("volume")).alias("vw_spread"),
        F.coalesce(amihud, F.lit(0.001)).alias("amihud"), auto.alias("_auto"), F.stddev_samp("r").alias("volatility"))
    roll = F.when(F.col("_auto") < 0, 2 * F.sqrt(-F.col("_auto"))).otherwise(0.005)
    return a.withColumn("roll", F.least(roll, F.lit(0.05))).drop("_auto")


def impact_cost(position, adv, volatility) -> Column:
    share = F.least(div(position, adv), F.lit(1.0))
    return F.when(adv <= 0, 0.05).otherwise(F.least(0.1 * F.sqrt(share) * volatility, F.lit(0.10)))


def days_to_liquidate(position, adv) -> Column:
    return F.when(adv <= 0, 30.0).otherwise(F.least(div(position, adv * MAX_PARTICIPATION), F.lit(90.0)))


def tier(adv, spread) -> Column:
    """Worse of the volume tier and the spread tier, 1 (best) to 4."""
    v, s = VOLUME_TIERS, SPREAD_TIERS
    by_volume = F.when(adv >= v[0], 1).when(adv >= v[1], 2).when(adv >= v[2], 3).otherwise(4)
    by_spread = F.when(spread <= s[0], 1).when(spread <= s[1], 2).when(spread <= s[2], 3).otherwise(4)
    return F.greatest(by_volume, by_spread)


def risk_class(spread, days, impact) -> Column:
    ten = F.lit(10.0)
    score = F.least(spread * 1000, ten) + F.least(days / 10, ten) + F.least(impact * 100, ten)
    return F.when(score <= 3, "low").when(score <= 6, "medium").when(score <= 15, "high").otherwise("critical")


def position_liquidity(positions: DataFrame, symbols: DataFrame) -> DataFrame:
    """(portfolio, symbol, value, w) with cost, time, tier and risk class."""
    j = positions.join(symbols, "symbol")
    v, adv = F.col("value"), F.col("adv")
    j = j.withColumns({"impact": impact_cost(v, adv, F.col("volatility")), "days": days_to_liquidate(v, adv), "tier": tier(adv, F.col("spread"))})
    return j.withColumn("risk", risk_class(F.col("spread"), F.col("days"), F.col("impact")))


def portfolio_liquidity(p: DataFrame) -> DataFrame:
    """Weighted spread and time, concentration of the liquid weights, tier shares, stress cost, score.

    Sums and one maximum per portfolio: everything is combined map-side, also for a very large portfolio.
    """
    w = F.col("w")
    lw = w / (1 + F.col("days"))
    share = lambda k: F.coalesce(F.sum(F.when(F.col("tier") == k, w)), F.lit(0.0)).alias(f"tier_{k}")
    a = p.groupBy("portfolio").agg(
        F.sum(w).alias("_w"), F.sum(F.col("spread") * w).alias("_sp"), F.sum(F.col("days") * w).alias("_t"), F.sum(lw).alias("_lw"),
        F.sum(lw * lw).alias("_lw2"), *[share(k) for k in (1, 2, 3, 4)], (2 * F.sum(F.col("impact") * w)).alias("stress_cost"),
        F.max(F.struct("w", F.negative("symbol"), "days"))["days"].alias("largest_days"))
    floor = F.greatest("_w", F.lit(0.01))
    a = a.select("portfolio", (F.col("_sp") / floor).alias("spread"), (F.col("_t") / floor).alias("days"),
                 F.coalesce(div("_lw2", F.col("_lw") * F.col("_lw")), F.lit(1.0)).alias("concentration"),
                 (F.col("tier_1") + F.col("tier_2")).alias("liquid_share"), "tier_1", "tier_2", "tier_3", "tier_4", "stress_cost", "largest_days")
    zero = F.lit(0.0)
    score = (F.greatest(zero, 100 - F.col("spread") * 10000) * 0.4 + F.greatest(zero, 100 - F.col("days") * 10) * 0.4
             + F.greatest(zero, 100 - F.col("concentration") * 100) * 0.2)
    return a.withColumn("liquidity_score", score)


def liquidity_stress(profile: DataFrame, market=2.0, volume=0.5, spread=3.0) -> DataFrame:
    cost = F.col("stress_cost") * (market - 1)
    time = F.col("days") / volume - F.col("days")
    wide = F.col("spread") * (spread - 1)
    return profile.select("portfolio", cost.alias("cost_increase"), time.alias("time_increase"), wide.alias("spread_increase"),
                          (cost + time * 0.01 + wide).alias("stress_impact"))


# Advice rules over a portfolio profile.
ADVICE = (
    ("liquid_share", "liquid_share", "<", 0.4, "hold more tier 1 and 2 assets"),
    ("time", "days", ">", 7.0, "reduce illiquid positions"),
    ("concentration", "concentration", ">", 0.4, "diversify across liquidity profiles"),
    ("stress_cost", "stress_cost", ">", 0.08, "keep liquidity buffers"),
    ("largest_position", "largest_days", ">", 10.0, "reduce the largest illiquid position"),
)
