"""Building blocks of the registered queries: final rounding on the Spark side, SQL text on the other."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

TS_FORMAT = {"daily": ("yyyy-MM-dd", "%Y-%m-%d"), "hourly": ("yyyy-MM-dd HH", "%Y-%m-%d %H")}


# ---- Spark side ---------------------------------------------------------------------------------------------

# Both sides round with the same arithmetic.  The small guard moves exact halves, which prices such as cents / 16 do
# produce, away from the boundary, so that the last bit of a sum cannot decide them.
GUARD = 0.50071234567


def rounded(c, digits: int = 6):
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    x = c.cast("double") * scale
    return F.when(~F.isnan(c), F.when(F.abs(x) < 2.0 ** 53, F.floor(x + GUARD)).otherwise(x) / scale)      # whole from there on, and floor() ends at the largest long


def result(df: DataFrame, values, digits=6, keys=("symbol",), ts="ts", base="daily") -> DataFrame:
    """keys, the time as text, and the rounded values."""
    digits = digits if isinstance(digits, dict) else dict.fromkeys(values, digits)
    time = [F.date_format(ts, TS_FORMAT[base][0]).alias("day")] if ts else []
    return df.select(*keys, *time, *[rounded(v, digits.get(v, 6)).alias(v) for v in values])


# ---- SQL side -----------------------------------------------------------------------------------------------

DAILY = """ticks AS (SELECT l_suppkey AS symbol, l_shipdate AS ts, l_orderkey, l_linenumber,
  l_extendedprice / l_quantity AS price, l_quantity FROM lineitem),
daily AS (SELECT symbol, ts, first(price ORDER BY l_orderkey, l_linenumber, price) AS open, max(price) AS high,
  min(price) AS low, last(price ORDER BY l_orderkey, l_linenumber, price) AS close, sum(l_quantity) AS volume
  FROM ticks GROUP BY symbol, ts)"""

HOURLY = """hourly AS (SELECT event_type AS symbol, date_trunc('hour', events.ts) AS ts,
  first(value ORDER BY events.ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY events.ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""

META = """meta AS (SELECT s_suppkey AS symbol, n_name AS sector, r_name AS geography FROM supplier
  LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

RETURNS = """rets AS (SELECT * FROM (SELECT symbol, ts, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret
  FROM daily) WHERE ret IS NOT NULL)"""

BENCH = "bench AS (SELECT ts, avg(ret) AS bench FROM rets GROUP BY ts)"

SECTOR_RETURNS = """srets AS (SELECT sector, ts, avg(ret) AS ret FROM rets JOIN meta USING (symbol)
  GROUP BY sector, ts)"""

_M = "CAST(round(l_discount * 100) - round(l_tax * 100) AS BIGINT)"
ASSET = f"""asset AS (SELECT l_suppkey AS symbol, l_shipdate AS ts, sum({_M}) / (count(*) * 100.0::DOUBLE) AS ret
  FROM lineitem GROUP BY 1, 2)"""
MARKET = f"""market AS (SELECT l_shipdate AS ts, sum({_M}) / (count(*) * 100.0::DOUBLE) AS bench FROM lineitem GROUP BY 1)"""
SECTOR = f"""sret AS (SELECT sector, l_shipdate AS ts, sum({_M}) / (count(*) * 100.0::DOUBLE) AS ret
  FROM lineitem JOIN meta ON l_suppkey = symbol GROUP BY 1, 2)"""
FACTORS = f"""factors AS (SELECT * FROM (SELECT l_shipdate AS ts, """ + ", ".join(
    f"sum({_M}) FILTER (geography = '{n}') / (nullif(count(*) FILTER (geography = '{n}'), 0) * 100.0::DOUBLE) AS f{i}"
    for i, n in enumerate(("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))) + """
  FROM lineitem JOIN meta ON l_suppkey = symbol GROUP BY 1) WHERE f0 + f1 + f2 + f3 + f4 IS NOT NULL)"""

HOLDINGS = """holdings AS (SELECT o_custkey AS portfolio, l_suppkey AS symbol, sum(l_extendedprice) AS value,
  sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
weights AS (SELECT *, value / nullif(sum(value) OVER (PARTITION BY portfolio), 0) AS w FROM holdings)"""


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def steps(base: str, todo, source: str | None = None, part="symbol", prefix="s") -> str:
    """One CTE per derived column over `base`, ending in `final`."""
    out = [f"{prefix}0 AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY ts) AS rn FROM {source or base})"]
    for i, (name, expr) in enumerate(todo, 1):
        out.append(f"{prefix}{i} AS (SELECT *, {expr} AS {name} FROM {prefix}{i - 1})")
    end = "final" if prefix == "s" else f"{prefix}final"
    out.append(f"{end} AS (SELECT * FROM {prefix}{len(todo)})")
    return ",\n".join(out)


def rnd(x: str, digits: int = 6, name: str | None = None) -> str:
    scale = f"1e{digits}"
    return f"floor(CASE WHEN NOT isnan(CAST({x} AS DOUBLE)) THEN CAST({x} AS DOUBLE) END * {scale} + {GUARD}) / {scale} AS {name or x}"


def pick(values, digits=6, keys=("symbol",), base="daily", ts="ts", source="final") -> str:
    digits = digits if isinstance(digits, dict) else dict.fromkeys(values, digits)
    time = [f"strftime({ts}, '{TS_FORMAT[base][1]}') AS day"] if ts else []
    return "SELECT " + ", ".join([*keys, *time, *[rnd(v, digits.get(v, 6)) for v in values]]) + f" FROM {source}"


def O(part="symbol"):
    return f"(PARTITION BY {part} ORDER BY ts)"


def U(part="symbol"):
    return f"(PARTITION BY {part} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def W(n, part="symbol"):
    return f"(PARTITION BY {part} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def B(a, b, part="symbol"):
    """Rows a..b relative to the current row (negative = before)."""
    def edge(k):
        return "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    return f"(PARTITION BY {part} ORDER BY ts ROWS BETWEEN {edge(a)} AND {edge(b)})"


def dv(a, b):
    return f"(({a}) / nullif({b}, 0))"


def lag(x, n=1, part="symbol"):
    return f"lag({x}, {n}) OVER {O(part)}"


def pct(x, n=1, part="symbol"):
    return f"({dv(x, lag(x, n, part))} - 1)"


def roll(f, x, n, part="symbol"):
    first = x.split(",")[0] if "," in x else x
    return f"CASE WHEN count({first}) OVER {W(n, part)} = {n} THEN {f}({x}) OVER {W(n, part)} END"


def roll2(f, x, y, n, part="symbol"):
    both = f"CASE WHEN {y} IS NOT NULL THEN {x} END"
    return f"CASE WHEN count({both}) OVER {W(n, part)} = {n} THEN {f}({x}, {y}) OVER {W(n, part)} END"


def ewm(x, span=None, alpha=None, part="symbol"):
    lam = -math.log(1 - (alpha if alpha is not None else 2.0 / (span + 1)))
    w = f"exp({lam!r}::DOUBLE * rn)"
    return (f"sum({x} * {w}) OVER {U(part)} / nullif(sum(CASE WHEN {x} IS NOT NULL THEN {w} END) OVER {U(part)}, 0)")


def integer_draws(source: str, key: str, replicates: int, seed: int, prefix: str = "d") -> str:
    """`{prefix}w`: the rows of `source` times the replicates with `rep` and their Poisson weight `w`, as `integer_weights` draws it."""
    p = 2147483647
    out = [f"{prefix}0 AS (SELECT *, (({key}) % {p} + {p}) % {p} AS a FROM {source}, (SELECT unnest(range(1, {replicates + 1})) AS rep))",
           f"{prefix}1 AS (SELECT *, (a * 48271 + rep * 69621 + {seed}) % {p} AS x1 FROM {prefix}0)"]
    for k, add in enumerate(("rep * 40692", "a", "rep"), 2):
        out.append(f"{prefix}{k} AS (SELECT * EXCLUDE x{k - 1}, ((x{k - 1} * x{k - 1} % {p}) + {add}) % {p} * 16807 % {p} AS x{k} FROM {prefix}{k - 1})")
    steps = [int(p * sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1))) for k in range(12)]
    out.append(f"{prefix}w AS (SELECT * EXCLUDE (a, x4), " + " + ".join(f"CAST(x4 >= {s} AS INTEGER)" for s in steps) + f" AS w FROM {prefix}4)")
    return ",\n".join(out)
