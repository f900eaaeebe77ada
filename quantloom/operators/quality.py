"""Data quality rules.  A rule maps a bar table to findings (entity, rule, severity, column, value, threshold)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quantloom.functions.scalar import business_days_between, div
from quantloom.operators.series import Series

PRICES = ("open", "high", "low", "close")

# Penalty of one finding per severity.
SEVERITY_WEIGHT = {"critical": 10, "error": 5, "warning": 2, "info": 1}


def finding(entity, rule: str, severity, column, value, threshold) -> list[Column]:
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    name = column if isinstance(column, Column) else F.lit(column)
    ent = F.lit(entity) if isinstance(entity, str) else entity
    return [ent.cast("string").alias("entity"), F.lit(rule).alias("rule"), sev.alias("severity"),
            name.alias("column"), value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold")]


def _melt(row: DataFrame, keys=()) -> DataFrame:
    """Columns other than the keys become (column, value) rows."""
    names = [c for c in row.columns if c not in keys]
    return row.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(n).cast("double").alias("value")) for n in names])).alias("r")).select(
            *keys, "r.*")


def missing_values(df, threshold=0.05):
    cols = [c for c in df.columns if c not in ("symbol", "ts")]
    rates = _melt(df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]))
    sev = F.when(F.col("column").isin("close", "volume"), "error").otherwise("warning")
    return rates.where(F.col("value") > threshold).select(
        *finding("all", "missing_values", sev, F.col("column"), F.col("value"), threshold))


def duplicates(df, keys=("symbol", "ts")):
    """All members of a duplicated key count."""
    n = df.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    return n.where("n > 0").select(*finding("all", "duplicate_records", "error", "symbol,ts", F.col("n"), 0))


def _outliers(df, values: dict, limit, minimum, rule, severity):
    """Count of rows beyond `limit` sample deviations from the mean of their symbol.

    Moments per symbol are aggregated map-side and joined back; the rows are not grouped.
    """
    stats = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), *[
        f(x).alias(f"_{p}_{c}") for c, x in values.items() for p, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = {c: F.abs(div(x - F.col(f"_m_{c}"), F.col(f"_s_{c}"))) for c, x in values.items()}
    counts = df.join(stats.where(F.col("_n") >= minimum), "symbol").groupBy("symbol").agg(
        *[F.count_if(v > limit).alias(c) for c, v in z.items()])
    return _melt(counts, ("symbol",)).where("value > 0").select(
        *finding(F.col("symbol"), rule, severity, F.col("column"), F.col("value"), limit))


def price_outliers(df, limit=3.0, minimum=10):
    return _outliers(df, {c: F.col(c) for c in PRICES}, limit, minimum, "price_outliers", "warning")


def volume_outliers(df, limit=4.0, minimum=10):
    return _outliers(df, {"volume": F.log1p("volume")}, limit, minimum, "volume_outliers", "warning")


def price_consistency(df):
    high = F.count_if(F.col("high") < F.greatest("open", "close")).alias("high")
    low = F.count_if(F.col("low") > F.least("open", "close")).alias("low")
    return _melt(df.agg(high, low)).where("value > 0").select(
        *finding("all", "price_consistency", "error", F.col("column"), F.col("value"), 0))


def date_continuity(df, max_gap=7, business_days=True):
    if business_days:
        per = df.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n"))
        gap = per.where("n >= 2").select("symbol", ((business_days_between(F.to_date("a"), F.to_date("b")) - 1)
                                                    - (F.col("n") - 1)).alias("value"))
        hit = gap.where(F.col("value") > max_gap)
    else:
        s = Series(df.select("symbol", "ts"))
        step = s.frame({"gap": F.datediff("ts", s.lag("ts"))}, keep=["symbol"])
        hit = step.groupBy("symbol").agg(F.count_if(F.col("gap") > max_gap).alias("value")).where("value > 0")
    return hit.select(*finding(F.col("symbol"), "date_continuity", "warning", "ts", F.col("value"), max_gap))


def negative_prices(df, columns=PRICES):
    counts = _melt(df.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in columns]))
    return counts.where("value > 0").select(
        *finding("all", "negative_prices", "critical", F.col("column"), F.col("value"), 0))


def zero_volume(df, threshold=0.01):
    share = df.agg(F.avg((F.col("volume") == 0).cast("double")).alias("value"))
    return share.where(F.col("value") > threshold).select(
        *finding("all", "zero_volume", "warning", "volume", F.col("value"), threshold))


def freshness(df, as_of, max_age=2):
    """Age of the newest row on the given day."""
    age = df.agg(F.datediff(F.lit(as_of).cast("date"), F.max("ts")).alias("value"))
    return age.where(F.col("value") > max_age).select(
        *finding("all", "data_freshness", "warning", "ts", F.col("value"), max_age))


def corporate_actions(df, adjusted="adj_close", split=-0.5, dividend=0.1):
    """Sudden halvings of the close, and closes well above their adjusted value."""
    s = Series(df.select("symbol", "ts", "close", adjusted))
    d = s.frame({"drop": s.pct(s.close), "gap": div(s.close - F.col(adjusted), s.close)}, keep=["symbol"])
    counts = d.groupBy("symbol").agg(F.count_if(F.col("drop") < split).alias("split"),
                                     F.count_if(F.col("gap") > dividend).alias("dividend"))
    return _melt(counts, ("symbol",)).where("value > 0").select(
        *finding(F.col("symbol"), "corporate_actions", "info", F.col("column"), F.col("value"), 0))


@dataclass(frozen=True)
class Rule:
    name: str
    check: Callable[[DataFrame], DataFrame]
    enabled: bool = True


def standard_rules(as_of, adjusted="close") -> list[Rule]:
    return [Rule("missing_values", missing_values), Rule("duplicate_records", duplicates),
            Rule("price_outliers", price_outliers), Rule("volume_outliers", volume_outliers),
            Rule("price_consistency", price_consistency), Rule("date_continuity", date_continuity),
            Rule("negative_prices", negative_prices), Rule("zero_volume", zero_volume),
            Rule("data_freshness", lambda d: freshness(d, as_of)),
            Rule("corporate_actions", lambda d: corporate_actions(d, adjusted))]


def run_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of all enabled rules; a user rule is any function from a table to findings."""
    out = None
    for rule in rules:
        if rule.enabled:
            out = rule.check(df) if out is None else out.unionByName(rule.check(df))
    if out is None:
        raise ValueError("no enabled rule")
    return out


def quality_score(df: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: rows, findings, valid (no error, no critical) and the 0-100 score."""
    weight = F.create_map(*[F.lit(v) for kv in SEVERITY_WEIGHT.items() for v in kv])
    bad = findings.agg(F.count(F.lit(1)).alias("findings"), F.coalesce(F.sum(weight[F.col("severity")]), F.lit(0)).alias("_p"),
                       F.count_if(F.col("severity").isin("error", "critical")).alias("_bad"))
    total = sum(SEVERITY_WEIGHT.values())
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    score = F.when(F.col("rows") == 0, 0.0).otherwise(
        F.greatest(F.lit(0.0), 100 - 100 * F.col("_p") / F.nullif(F.col("rows") * total, F.lit(0))))
    # both sides are one row
    return rows.join(F.broadcast(bad), F.lit(True)).select(
        "rows", "findings", (F.col("_bad") == 0).alias("valid"), score.alias("score"))


def simple_quality_score(df: DataFrame) -> DataFrame:
    """100 - 2 x missing percent - 5 x duplicate-row percent."""
    cols = df.columns
    missing = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    missing_once = groups.withColumn("_m", missing * F.col("_n"))
    return missing_once.agg(
        F.sum("_n").alias("rows"), F.sum("_m").alias("missing"), F.sum(F.col("_n") - 1).alias("duplicates")).select(
        "rows", "missing", "duplicates",
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 200.0 * F.col("missing") / (F.col("rows") * len(cols))
                                       - 500.0 * F.col("duplicates") / F.col("rows"))).alias("score"))
