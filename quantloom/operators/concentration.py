"""Concentration of portfolios by position, sector, geography and currency."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quantloom.functions.scalar import div, excess_severity
from quantloom.operators.sets import top_per_key

# Default limits.
LIMITS = {"position": 0.05, "top_5": 0.20, "top_10": 0.30, "country": 0.10, "sector": 0.25, "geography": 0.40,
          "currency": 0.60, "hhi": 0.15}


def normalized(positions: DataFrame, keys) -> DataFrame:
    total = positions.groupBy(*keys).agg(F.sum("w").alias("_t"))
    return positions.join(total, list(keys)).withColumn("w", div("w", "_t")).drop("_t")


def group_shares(p: DataFrame, keys) -> DataFrame:
    """(keys, dimension, entity, share): one aggregate with grouping sets over sector, geography and currency."""
    dims = ["sector", "geography", "currency"]
    sets = [[*keys, d] for d in dims]
    g = p.groupingSets(sets, *keys, *dims).agg(
        F.sum("w").alias("share"),
        F.when(F.grouping("sector") == 0, "sector").when(F.grouping("geography") == 0, "geography").otherwise("currency").alias("dimension"))
    return g.select(*keys, "dimension", F.coalesce(*dims).alias("entity"), "share")


def concentration_metrics(positions: DataFrame, keys=("portfolio",)) -> DataFrame:
    """HHI, effective positions, top 5 / top 10, largest position and group, 0-100 score."""
    keys = list(keys)
    p = normalized(positions.fillna("Unknown", ["sector", "geography", "currency"]), keys)
    base = p.groupBy(*keys).agg(F.sum(F.col("w") * F.col("w")).alias("hhi"), F.max("w").alias("max_position"))
    top = top_per_key(p.select(*keys, "symbol", "w"), keys, [F.desc("w"), "symbol"], 10).groupBy(*keys).agg(
        F.sum(F.when(F.col("rank") <= 5, F.col("w"))).alias("top_5"), F.sum("w").alias("top_10"))
    groups = group_shares(p, keys).groupBy(*keys).agg(*[
        F.max(F.when(F.col("dimension") == d, F.col("share"))).alias(f"max_{d}") for d in ("sector", "geography", "currency")])
    m = base.join(top, keys).join(groups, keys)
    score = (F.least(F.col("hhi") * 200, F.lit(40.0)) + F.least(F.col("max_position") * 300, F.lit(30.0))
             + F.least(F.col("max_sector") * 150, F.lit(30.0)))
    return m.select(*keys, "hhi", (1 / F.col("hhi")).alias("effective_positions"), "top_5", "top_10", "max_position",
                    "max_sector", "max_geography", "max_currency", score.alias("concentration_score"))


def limit_alerts(positions: DataFrame, limits=LIMITS, key="portfolio") -> DataFrame:
    """(key, kind, entity, exposure, limit, excess, severity) for everything above its limit."""
    p = normalized(positions.fillna("Unknown", ["sector", "geography", "currency"]), [key])
    m = concentration_metrics(positions, [key])
    table = F.create_map(*[F.lit(v) for kv in limits.items() for v in kv])
    single = p.select(key, F.lit("position").alias("kind"), F.col("symbol").cast("string").alias("entity"), F.col("w").alias("exposure"))
    groups = group_shares(p, [key]).select(key, F.col("dimension").alias("kind"), "entity", F.col("share").alias("exposure"))
    whole = m.select(key, F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit("portfolio").alias("entity"), F.col(k).alias("exposure"))
                                             for k in ("top_5", "top_10", "hhi")])))
    every = single.unionByName(groups).unionByName(whole).withColumn("limit", table[F.col("kind")])
    return every.where(F.col("exposure") > F.col("limit")).select(
        key, "kind", "entity", "exposure", "limit", (F.col("exposure") - F.col("limit")).alias("excess"),
        excess_severity("exposure", "limit").alias("severity"))


def rebalance_suggestions(alerts: DataFrame, key="portfolio") -> DataFrame:
    """Cut each position or sector above its limit to 90% of the limit."""
    s = alerts.where(F.col("kind").isin("position", "sector")).withColumn("target", F.col("limit") * 0.9)
    return s.select(key, "kind", "entity", "exposure", "target", (F.col("exposure") - F.col("target")).alias("reduction"), "severity")


def sector_members(suggestions: DataFrame, positions: DataFrame, key="portfolio") -> DataFrame:
    """Positions of each sector to be cut; rows, largest first within a sector when ordered by w."""
    s = suggestions.where("kind = 'sector'").select(key, F.col("entity").alias("sector"), "reduction")
    return positions.join(s, [key, "sector"]).select(key, "sector", "symbol", "w", "reduction")


def diversification_flags(positions: DataFrame, key="portfolio") -> DataFrame:
    """Sector HHI above .25, geography HHI above .5, fewer than ten effective positions."""
    p = normalized(positions.fillna("Unknown", ["sector", "geography", "currency"]), [key])
    g = group_shares(p, [key]).groupBy(key).agg(*[
        F.sum(F.when(F.col("dimension") == d, F.col("share") * F.col("share"))).alias(f"{d}_hhi") for d in ("sector", "geography")])
    m = p.groupBy(key).agg((1 / F.sum(F.col("w") * F.col("w"))).alias("effective_positions"))
    return g.join(m, key).select(key, "sector_hhi", "geography_hhi", "effective_positions", (F.col("sector_hhi") > 0.25).alias("more_sectors"),
                                 (F.col("geography_hhi") > 0.5).alias("more_regions"), (F.col("effective_positions") < 10).alias("more_positions"))


def rebalance_effect(suggestions: DataFrame, metrics: DataFrame, key="portfolio") -> DataFrame:
    """HHI falls by half of the summed position reductions, to no less than .02."""
    cut = suggestions.where("kind = 'position'").groupBy(key).agg(F.sum("reduction").alias("_r"))
    m = metrics.join(cut, key, "left")
    new = F.greatest(F.lit(0.02), F.col("hhi") - 0.5 * F.coalesce("_r", F.lit(0.0)))
    return m.select(key, "hhi", new.alias("new_hhi"), (F.col("hhi") - new).alias("hhi_improvement"),
                    (F.col("concentration_score") * (1 - new / F.col("hhi"))).alias("score_improvement"))


def limit_utilization(metrics: DataFrame, limits=LIMITS, keys=("portfolio",)) -> DataFrame:
    pairs = {"max_position": "position", "top_5": "top_5", "top_10": "top_10", "hhi": "hhi", "max_sector": "sector"}
    return metrics.select(*keys, *[(100 * F.col(c) / limits[k]).alias(f"{c}_used") for c, k in pairs.items()])
