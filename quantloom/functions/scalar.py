"""Column helpers shared by every operator.  All of them stay JVM-side.

Null policy: a division by zero gives null (never inf or NaN); the few indicators for which an infinite
ratio has a meaning say so where they are defined.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TRADING_DAYS = 252


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a, b) -> Column:
    """a / b, null when b is zero."""
    return F.try_divide(col(a), col(b))


def log_ratio(a, b) -> Column:
    """ln(a / b) that is infinite where one of the two is zero; null where both are or the ratio is negative."""
    a, b = col(a), col(b)
    infinite = F.when((a > 0) & (b == 0), float("inf")).when((a == 0) & (b > 0), float("-inf"))
    return F.coalesce(infinite, F.ln(div(a, b)))


def corr_of(x, y, over=None) -> Column:
    """Correlation of complete pairs, null when one side does not vary (`corr` raises an error there)."""
    x, y = col(x), col(y)
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    cov, sx, sy = parts if over is None else [p.over(over) for p in parts]
    return F.try_divide(cov, sx * sy)


def true_or_false(cond: Column) -> Column:
    """A comparison with null counts as false."""
    return F.coalesce(cond, F.lit(False))


def strict_greatest(*cols) -> Column:
    """Like greatest, but null as soon as one input is null."""
    return _strict(F.greatest, cols)


def strict_least(*cols) -> Column:
    return _strict(F.least, cols)


def _strict(f, cols) -> Column:
    cols = [col(c) for c in cols]
    any_null = cols[0].isNull()
    for c in cols[1:]:
        any_null = any_null | c.isNull()
    return F.when(~any_null, f(*cols))


def clip(x, low, high) -> Column:
    """Bounds that keep null as null."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


# Periods per year for each period code.
PERIODS_PER_YEAR = {"1D": 252, "1W": 52, "1M": 12, "3M": 4, "1Y": 1}


def annualize_return(ret, kind, period) -> Column:
    """(1+r)^m - 1 for simple returns, r*m for log returns; m comes from the period code."""
    m = F.create_map(*[F.lit(v) for kv in PERIODS_PER_YEAR.items() for v in kv])[col(period)]
    m = F.coalesce(m, F.lit(TRADING_DAYS)).cast("double")
    return F.when(col(kind) == "LOG", col(ret) * m).otherwise(F.pow(1 + col(ret), m) - 1)


def to_log_return(ret, kind) -> Column:
    return F.when(col(kind) == "LOG", col(ret)).otherwise(F.log1p(col(ret)))


def to_simple_return(ret, kind) -> Column:
    return F.when(col(kind) == "LOG", F.expm1(col(ret))).otherwise(col(ret))


def is_currency_code(c) -> Column:
    return F.length(col(c)) == 3


def business_day(ts) -> Column:
    """Monday to Friday."""
    return F.weekday(col(ts)) < 5


def business_days_between(first, last) -> Column:
    """Number of Monday-Friday dates in [first, last], in closed form (no sequence is built)."""
    first, last = col(first), col(last)
    days = F.datediff(last, first) + 1
    full, rest = F.floor(days / 7), days % 7
    start = F.weekday(first)
    # weekend days among the `rest` days that start on weekday `start`
    sat = F.when((start <= 5) & (start + rest > 5), 1).otherwise(0)
    sun = F.when((start <= 6) & (start + rest > 6), 1).otherwise(0)
    return (full * 5 + rest - sat - sun).cast("long")


def excess_severity(value, limit) -> Column:
    """Severity of a limit excess in percent of the limit: up to 10, 25, 50, above."""
    pct = 100 * div(col(value) - col(limit), limit)
    return (F.when(pct <= 10, "low").when(pct <= 25, "medium").when(pct <= 50, "high").otherwise("critical"))


def p_value_severity(p) -> Column:
    p = col(p)
    return F.when(p < 0.001, "high").when(p < 0.01, "medium").otherwise("low")


def change_severity(change) -> Column:
    c = F.abs(col(change))
    return F.when(c > 0.30, "high").when(c > 0.15, "medium").otherwise("low")


def equal_width_bin(x, low, high, bins: int) -> Column:
    """0-based bin between low and high; the last bin is closed on both sides."""
    x, low, high = col(x), col(low), col(high)
    pos = F.floor(div(x - low, high - low) * bins)
    return F.when(high == low, F.lit(bins // 2).cast("long")).otherwise(F.least(pos, F.lit(bins - 1).cast("long")))


def price_field_of(name) -> Column:
    """Text after the last underscore of a `TICKER_Field` name."""
    return F.regexp_extract(col(name), r"^(.*)_([^_]+)$", 2)


def ticker_of(name) -> Column:
    return F.regexp_extract(col(name), r"^(.*)_([^_]+)$", 1)
