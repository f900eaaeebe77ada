"""Cleaning, imputation and quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import clean as CL, features as FT, quality as Q
from quantloom.plans import query
from quantloom.plans.kit import (DAILY, O, U, dv, lag, pct, pick, result, rnd, rounded, steps, with_)
from quantloom.sources import tables as T

# Gaps that follow from the data: a close is missing where the whole volume divides by seven.
GAPPY = "gappy AS (SELECT symbol, ts, open, CASE WHEN volume % 7 <> 0 THEN close END AS x, volume FROM daily)"


def gappy(spark, sf_dir):
    return T.daily_bars(spark, sf_dir).select(
        "symbol", "ts", "open", F.when(F.col("volume") % 7 != 0, F.col("close")).alias("x"), "volume")


def add_fill(name, make, todo, digits=4):
    @query(name, with_(DAILY, GAPPY, steps("gappy", todo), body="SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, "
                       + rnd("y", digits, "x") + " FROM final"))
    def run(spark, sf_dir):
        return result(make(gappy(spark, sf_dir)), ["x"], digits)


PREV = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
NEXT = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
LEFT = [("px", f"last_value(x IGNORE NULLS) OVER {PREV}"),
        ("pr", f"last_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER {PREV}")]
RIGHT = [("nx", f"first_value(x IGNORE NULLS) OVER {NEXT}"),
         ("nr", f"first_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER {NEXT}")]

add_fill("fill_forward", lambda d: CL.forward_fill(d, ["x"]), [("y", f"last_value(x IGNORE NULLS) OVER {PREV}")])
add_fill("fill_forward_limit", lambda d: CL.forward_fill(d, ["x"], 1),
         [("y", f"coalesce(x, {lag('x')})")])
add_fill("fill_backward", lambda d: CL.backward_fill(d, ["x"]), [("y", f"first_value(x IGNORE NULLS) OVER {NEXT}")])
add_fill("fill_linear", lambda d: CL.linear_interpolation(d, ["x"]), LEFT + RIGHT + [
    ("y", "CASE WHEN x IS NOT NULL THEN x WHEN nr IS NULL THEN px ELSE px + (nx - px) * (rn - pr) / (nr - pr) END")])
BEYOND = [("vn", f"CASE WHEN x IS NOT NULL THEN count(x) OVER {PREV} END"), ("k", f"count(x) OVER {PREV}")]


def lagrange(n):
    pts = range(n)
    return " + ".join(f"x{i} * " + " * ".join(f"(rn - r{j})::DOUBLE / (r{i} - r{j})" for j in pts if j != i) for i in pts)


def poly_sql(n):
    """Each value knows its neighbours, the one before it and the n - 2 after; a gap takes those of the last value before it."""
    near = ", ".join(f"lag(x) OVER o AS x{i}, lag(rn) OVER o AS r{i}" if i == 0 else f"lead(x, {i - 1}) OVER o AS x{i}, lead(rn, {i - 1}) OVER o AS r{i}" for i in range(n))
    last = ", ".join(f"last_value(p{k}) OVER u AS {k}" for k in [f"{c}{i}" for i in range(n) for c in "xr"])
    cols = ", ".join(f"v.{c}{i} AS p{c}{i}" for i in range(n) for c in "xr")
    return with_(DAILY, GAPPY, "g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(x) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM gappy)",
                 f"v AS MATERIALIZED (SELECT symbol, rn, {near} FROM g WHERE x IS NOT NULL WINDOW o AS (PARTITION BY symbol ORDER BY rn))",
                 f"h AS MATERIALIZED (SELECT g.symbol, g.ts, g.x, g.rn, g.k, {cols} FROM g LEFT JOIN v ON v.symbol = g.symbol AND v.rn = g.rn)",
                 "j AS MATERIALIZED (SELECT symbol, ts, x, rn, " + last.replace("last_value(", "first_value(") + " FROM h WINDOW u AS (PARTITION BY symbol, k ORDER BY rn))",
                 f"f AS MATERIALIZED (SELECT symbol, ts, coalesce(x, {lagrange(n)}) AS x FROM j)", body=pick(["x"], 3, source="f"))


for _order in (2, 3):
    def _poly(spark, sf_dir, order=_order):
        return result(CL.polynomial_interpolation(gappy(spark, sf_dir), ["x"], order), ["x"], 3)
    query(f"fill_polynomial_{_order}", poly_sql(_order + 1))(_poly)

for _stat, _sql in (("mean", "avg(x)"), ("median", "quantile_cont(x, 0.5)")):
    add_fill(f"fill_{_stat}", lambda d, s=_stat: CL.fill_with_statistic(d, ["x"], s),
             [("y", f"coalesce(x, {_sql} OVER (PARTITION BY symbol))")])


@query("fill_mode", with_(DAILY, "g AS (SELECT symbol, ts, CASE WHEN volume % 7 <> 0 THEN volume END AS v FROM daily)",
    """m AS (SELECT symbol, v, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, v) AS k FROM g
  WHERE v IS NOT NULL GROUP BY symbol, v)""", body="""SELECT g.symbol, strftime(ts, '%Y-%m-%d') AS day, coalesce(g.v, m.v) AS v
  FROM g JOIN m ON m.symbol = g.symbol AND m.k = 1"""))
def fill_mode(spark, sf_dir):
    d = T.daily_bars(spark, sf_dir).select("symbol", "ts", F.when(F.col("volume") % 7 != 0, F.col("volume")).alias("v"))
    return result(CL.fill_with_statistic(d, ["v"], "mode"), ["v"], 2)


add_fill("fill_seasonal", lambda d: CL.seasonal_fill(d, ["x"], 126), [
    (f"l{k}", lag("x", 126 * k)) for k in range(1, 5)] + [
    ("z", "coalesce(x, list_avg(list_filter([l1, l2, l3, l4], lambda v: v IS NOT NULL)))"),
    ("y", f"last_value(z IGNORE NULLS) OVER {PREV}")])
add_fill("fill_decay", lambda d: CL.decayed_fill(d, ["x"]), LEFT + [("y", "px * pow(0.95, rn - pr)")])


@query("fill_nearest_rows", with_(DAILY, GAPPY, "g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM gappy)",
    """near AS (SELECT a.symbol, a.rn, b.x, row_number() OVER (PARTITION BY a.symbol, a.rn
    ORDER BY ((a.open - b.open) * (a.open - b.open) + (a.volume - b.volume) * (a.volume - b.volume)) * 3 / 2, b.rn) AS k
    FROM g a JOIN g b ON a.symbol = b.symbol AND a.x IS NULL AND b.x IS NOT NULL)""",
    "m AS (SELECT symbol, rn, avg(x) AS m FROM near WHERE k <= 5 GROUP BY symbol, rn)",
    body=f"""SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, {rnd('coalesce(x, m)', 4, 'x')}
  FROM g LEFT JOIN m USING (symbol, rn)"""))
def fill_nearest_rows(spark, sf_dir):
    return result(CL.nearest_rows_fill(gappy(spark, sf_dir), ["open", "x", "volume"]), ["x"], 4)


RIDGE = 0.001


@query("fill_regression", with_(DAILY, GAPPY, f"""m AS (SELECT var_pop(open) * {1 + RIDGE} AS a, covar_pop(open, volume) AS b, var_pop(volume) * {1 + RIDGE} AS c, covar_pop(open, x) AS p, covar_pop(volume, x) AS q,
  avg(x) AS mx, avg(open) AS mo, avg(volume) AS mv FROM gappy WHERE x IS NOT NULL)""",
    "f AS (SELECT symbol, ts, coalesce(x, mx + (c * p - b * q) / (a * c - b * b) * (open - mo) + (a * q - b * p) / (a * c - b * b) * (volume - mv)) AS x FROM gappy, m)", body=pick(["x"], 4, source="f")))
def fill_regression(spark, sf_dir):
    return result(CL.regression_fill(gappy(spark, sf_dir), ["open", "x", "volume"], rounds=2), ["x"], 4)


def two_gaps(spark, sf_dir):
    """Opens and their logarithms, either or both missing by day and volume."""
    d = T.daily_bars(spark, sf_dir)
    day = F.unix_date(F.col("ts").cast("date"))
    return d.select("symbol", "ts", F.when((day + F.col("symbol")) % 5 != 0, F.col("open") / 100).alias("u"), F.when((day + 2 * F.col("volume").cast("long")) % 7 != 0, F.ln("open")).alias("v"))


def alternating(rounds: int) -> str:
    """Fills of u from v and of v from u, in turn, from the columns' means."""
    day = "date_diff('day', TIMESTAMP '1970-01-01', ts)"
    out = [f"g AS (SELECT symbol, ts, CASE WHEN ({day} + symbol) % 5 <> 0 THEN open / 100 END AS u, CASE WHEN ({day} + 2 * CAST(volume AS BIGINT)) % 7 <> 0 THEN ln(open) END AS v FROM daily)",
           "w0 AS MATERIALIZED (SELECT *, coalesce(u, avg(u) OVER ()) AS fu, coalesce(v, avg(v) OVER ()) AS fv FROM g)"]
    for k in range(rounds):
        for at, (y, x) in enumerate((("u", "v"), ("v", "u"))):
            n = 2 * k + at
            out.append(f"k{n} AS (SELECT covar_pop(f{x}, {y}) / (var_pop(f{x}) * {1 + RIDGE}) AS b, avg({y}) AS my, avg(f{x}) AS mx FROM w{n} WHERE {y} IS NOT NULL)")
            out.append(f"w{n + 1} AS MATERIALIZED (SELECT symbol, ts, u, v, {f'coalesce(u, my + b * (fv - mx)) AS fu, fv' if y == 'u' else 'fu, coalesce(v, my + b * (fu - mx)) AS fv'} FROM w{n}, k{n})")
    return ",\n".join([*out, f"f AS (SELECT symbol, ts, fu AS u, fv AS v FROM w{2 * rounds})"])


@query("fill_regression_rounds", with_(DAILY, alternating(3), body=pick(["u", "v"], 6, source="f")))
def fill_regression_rounds(spark, sf_dir):
    return result(CL.regression_fill(two_gaps(spark, sf_dir), ["u", "v"], rounds=3), ["u", "v"], 6)


@query("clean_prices", with_(DAILY, GAPPY,
    f"f AS (SELECT symbol, ts, open, coalesce(last_value(x IGNORE NULLS) OVER {PREV}, first_value(x IGNORE NULLS) OVER {NEXT}) AS x FROM gappy)",
    "b1 AS (SELECT symbol, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM f GROUP BY symbol)",
    "f1 AS (SELECT f.* FROM f JOIN b1 USING (symbol) WHERE x BETWEEN lo AND hi)",
    "b2 AS (SELECT symbol, quantile_cont(open, 0.01) AS lo, quantile_cont(open, 0.99) AS hi FROM f1 GROUP BY symbol)",
    body=f"""SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, {rnd('x', 4)}, {rnd('open', 4)} FROM f1 JOIN b2 USING (symbol)
  WHERE open BETWEEN lo AND hi"""))
def clean_prices(spark, sf_dir):
    return result(CL.clean_prices(gappy(spark, sf_dir), ["x", "open"]), ["x", "open"], 4)


@query("repair_bars", with_(
    """raw AS (SELECT l_suppkey AS symbol, l_shipdate AS ts, l_orderkey, l_linenumber,
  CASE WHEN l_discount > 0.08 THEN -l_extendedprice ELSE l_extendedprice END AS close,
  CASE WHEN l_tax > 0.07 THEN NULL ELSE l_quantity END AS volume FROM lineitem)""",
    """one AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY l_orderkey, l_linenumber, close, volume NULLS FIRST) AS k FROM raw)""",
    body=f"""SELECT symbol, strftime(ts, '%Y-%m-%d') AS day,
  {rnd('last_value(CASE WHEN close >= 0 THEN close END IGNORE NULLS) OVER ' + PREV, 2, 'close')}, coalesce(volume, 0) AS volume FROM one WHERE k = 1"""))
def repair_bars(spark, sf_dir):
    raw = T.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber",
        F.when(F.col("l_discount") > 0.08, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("close"),
        F.when(F.col("l_tax") > 0.07, None).otherwise(F.col("l_quantity")).alias("volume"))
    return result(CL.repair_bars(raw, ["l_orderkey", "l_linenumber"], prices=["close"]), ["close", "volume"], 2)


# ---- quality rules -------------------------------------------------------------------------------------------------
def findings(df):
    return df.select("entity", "rule", "severity", "column", rounded("value", 6).alias("value"), "threshold")


def row(entity, rule, severity, column, value, threshold):
    return (f"SELECT CAST({entity} AS VARCHAR) AS entity, '{rule}' AS rule, {severity} AS severity, {column} AS \"column\", "
            f"{rnd(value, 6, 'value')}, {float(threshold)}::DOUBLE AS threshold")


MISSING = ("SELECT entity, rule, severity, \"column\", value, threshold FROM (" + " UNION ALL ".join(
    row("'all'", "missing_values", f"'{'error' if c == 'volume' else 'warning'}'", f"'{c}'",
        f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)", 0.05) + " FROM gappy" for c in ("open", "x", "volume"))
    + ") WHERE value > 0.05")


@query("rule_missing_values", with_(DAILY, GAPPY, body=MISSING))
def rule_missing_values(spark, sf_dir):
    return findings(Q.missing_values(gappy(spark, sf_dir)))


@query("rule_duplicates", row("'all'", "duplicate_records", "'error'", "'symbol,ts'", "sum(n)", 0)
       + " FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_shipdate HAVING count(*) > 1) HAVING sum(n) > 0")
def rule_duplicates(spark, sf_dir):
    ticks = T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"))
    return findings(Q.duplicates(ticks))


def outlier_sql(rule, columns, limit):
    one = " UNION ALL ".join(
        row("symbol", rule, "'warning'", f"'{c}'", f"count(*) FILTER (abs((v - m) / nullif(s, 0)) > {limit})", limit)
        + f" FROM (SELECT symbol, {x} AS v, avg({x}) OVER p AS m, stddev_samp({x}) OVER p AS s, count(*) OVER p AS n FROM daily"
          f" WINDOW p AS (PARTITION BY symbol)) WHERE n >= 10 GROUP BY symbol" for c, x in columns)
    return with_(DAILY, body=f"SELECT * FROM ({one}) WHERE value > 0")


@query("rule_price_outliers", outlier_sql("price_outliers", [(c, c) for c in ("open", "high", "low", "close")], 3.0))
def rule_price_outliers(spark, sf_dir):
    return findings(Q.price_outliers(T.daily_bars(spark, sf_dir)))


# every 97th day of a symbol's calendar trades a million times its volume: the given volumes alone have no outlier
@query("rule_volume_outliers", outlier_sql("volume_outliers", [("volume", "ln(1 + volume)")], 4.0).replace(
    " FROM daily WINDOW", " FROM (SELECT symbol, CASE WHEN (date_diff('day', TIMESTAMP '1970-01-01', ts) + symbol) % 97 = 0 THEN volume * 1e6 ELSE volume END AS volume FROM daily) WINDOW"))
def rule_volume_outliers(spark, sf_dir):
    spike = (F.unix_date(F.col("ts").cast("date")) + F.col("symbol")) % 97 == 0
    return findings(Q.volume_outliers(T.daily_bars(spark, sf_dir).withColumn("volume", F.when(spike, F.col("volume") * 1e6).otherwise(F.col("volume")))))


SHAKEN = """sh AS (SELECT symbol, ts, open, CASE WHEN volume % 11 = 0 THEN low ELSE high END AS high,
  CASE WHEN volume % 13 = 0 THEN high + 1 ELSE low END AS low, CASE WHEN volume % 17 = 0 THEN -close ELSE close END AS close, volume FROM daily)"""


def shaken(spark, sf_dir):
    d, v = T.daily_bars(spark, sf_dir), F.col("volume")
    return d.select("symbol", "ts", "open", F.when(v % 11 == 0, F.col("low")).otherwise(F.col("high")).alias("high"),
                    F.when(v % 13 == 0, F.col("high") + 1).otherwise(F.col("low")).alias("low"),
                    F.when(v % 17 == 0, -F.col("close")).otherwise(F.col("close")).alias("close"), "volume")


@query("rule_price_consistency", with_(DAILY, SHAKEN, body="SELECT * FROM (" + " UNION ALL ".join(
    row("'all'", "price_consistency", "'error'", f"'{c}'", f"count(*) FILTER ({cond})", 0) + " FROM sh"
    for c, cond in (("high", "high < greatest(open, close)"), ("low", "low > least(open, close)"))) + ") WHERE value > 0"))
def rule_price_consistency(spark, sf_dir):
    return findings(Q.price_consistency(shaken(spark, sf_dir)))


@query("rule_negative_prices", with_(DAILY, SHAKEN, body="SELECT * FROM (" + " UNION ALL ".join(
    row("'all'", "negative_prices", "'critical'", f"'{c}'", f"count(*) FILTER ({c} < 0)", 0) + " FROM sh"
    for c in ("open", "high", "low", "close")) + ") WHERE value > 0"))
def rule_negative_prices(spark, sf_dir):
    return findings(Q.negative_prices(shaken(spark, sf_dir)))


@query("rule_date_continuity", with_(DAILY, body="SELECT * FROM (" + row(
    "symbol", "date_continuity", "'warning'", "'ts'",
    "max(b) - count(*)", 7) + """ FROM daily JOIN (SELECT symbol, len(list_filter(generate_series(min(ts), max(ts), INTERVAL 1 DAY), lambda d: isodow(d) < 6)) AS b
  FROM daily GROUP BY symbol) USING (symbol) GROUP BY symbol) WHERE value > 7"""))
def rule_date_continuity(spark, sf_dir):
    return findings(Q.date_continuity(T.daily_bars(spark, sf_dir)))


@query("rule_calendar_gaps", with_(DAILY, steps("daily", [("gap", f"date_diff('day', {lag('ts')}, ts)")]), body="SELECT * FROM ("
       + row("symbol", "date_continuity", "'warning'", "'ts'", "count(*) FILTER (gap > 7)", 7) + " FROM final GROUP BY symbol) WHERE value > 0"))
def rule_calendar_gaps(spark, sf_dir):
    return findings(Q.date_continuity(T.daily_bars(spark, sf_dir), business_days=False))


@query("rule_zero_volume", with_(DAILY, "z AS (SELECT CASE WHEN volume % 9 = 0 THEN 0 ELSE volume END AS volume FROM daily)",
    body="SELECT * FROM (" + row("'all'", "zero_volume", "'warning'", "'volume'", "avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0.0 END)", 0.01)
         + " FROM z) WHERE value > 0.01"))
def rule_zero_volume(spark, sf_dir):
    d = T.daily_bars(spark, sf_dir).select(F.when(F.col("volume") % 9 == 0, 0.0).otherwise(F.col("volume")).alias("volume"))
    return findings(Q.zero_volume(d))


@query("rule_freshness", "SELECT * FROM (" + row("'all'", "data_freshness", "'warning'", "'ts'",
       "date_diff('day', max(l_shipdate), TIMESTAMP '2002-01-01')", 2) + " FROM lineitem) WHERE value > 2")
def rule_freshness(spark, sf_dir):
    return findings(Q.freshness(T.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("ts")), "2002-01-01"))


ACTIONS = ("SELECT * FROM (" + " UNION ALL ".join(
    row("symbol", "corporate_actions", "'info'", f"'{c}'", f"count(*) FILTER ({cond})", 0) + " FROM final GROUP BY symbol"
    for c, cond in (("split", "drp < -0.5"), ("dividend", "(close - low) / nullif(close, 0) > 0.1"))) + ") WHERE value > 0")


@query("rule_corporate_actions", with_(DAILY, steps("daily", [("drp", pct("close"))]), body=ACTIONS))
def rule_corporate_actions(spark, sf_dir):
    return findings(Q.corporate_actions(T.daily_bars(spark, sf_dir), "low"))


@query("quality_report", with_(DAILY, "gx AS (SELECT symbol, ts, open, high, low, CASE WHEN volume % 7 <> 0 THEN close END AS close, volume FROM daily)",
    """g AS (SELECT 0 AS bad, 2 * count(*) AS pen, count(*) AS n FROM (SELECT symbol FROM (SELECT symbol, ln(1 + volume) AS v,
    avg(ln(1 + volume)) OVER p AS m, stddev_samp(ln(1 + volume)) OVER p AS s FROM gx WINDOW p AS (PARTITION BY symbol))
    GROUP BY symbol HAVING count(*) >= 10 AND count(*) FILTER (abs((v - m) / nullif(s, 0)) > 4) > 0)
  UNION ALL SELECT CASE WHEN avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END) > 0.05 THEN 1 ELSE 0 END,
    CASE WHEN avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END) > 0.05 THEN 5 ELSE 0 END,
    CASE WHEN avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END) > 0.05 THEN 1 ELSE 0 END FROM gx)""",
    body=f"""SELECT (SELECT count(*) FROM gx) AS rows, CAST(sum(n) AS BIGINT) AS findings, sum(bad) = 0 AS valid,
  {rnd('greatest(0, 100 - 100.0 * sum(pen) / ((SELECT count(*) FROM gx) * 18))', 4, 'score')} FROM g"""))
def quality_report(spark, sf_dir):
    d = T.daily_bars(spark, sf_dir).withColumn("close", F.when(F.col("volume") % 7 != 0, F.col("close")))
    rules = [Q.Rule("missing_values", Q.missing_values), Q.Rule("volume_outliers", Q.volume_outliers),
             Q.Rule("zero_volume", Q.zero_volume, enabled=False)]
    return Q.quality_score(d, Q.run_rules(d, rules)).select("rows", "findings", "valid", rounded("score", 4).alias("score"))


@query("simple_quality_score", f"""SELECT rows, missing, duplicates, {rnd('greatest(0, least(100, 100 - 200.0 * missing / (rows * 3) - 500.0 * duplicates / rows))', 4, 'score')} FROM (
  SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(CASE WHEN t IS NULL THEN n ELSE 0 END) AS BIGINT) AS missing, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (
  SELECT l_suppkey, l_shipdate, CASE WHEN l_tax <= 0.07 THEN l_tax END AS t, count(*) AS n FROM lineitem GROUP BY ALL))""")
def simple_quality_score(spark, sf_dir):
    d = T.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", F.when(F.col("l_tax") <= 0.07, F.col("l_tax")).alias("t"))
    return Q.simple_quality_score(d).select("rows", "missing", "duplicates", rounded("score", 4).alias("score"))


@query("validate_features", with_(DAILY, GAPPY, body="""SELECT "check", "column", other, value FROM (
  SELECT 'null' AS "check", 'x' AS "column", '' AS other, CAST(count(*) FILTER (x IS NULL) AS DOUBLE) AS value FROM gappy
  UNION ALL SELECT 'constant', 'one', '', 1.0
  UNION ALL SELECT 'correlated', 'volume', 'twice', 1.0)"""))
def validate_features(spark, sf_dir):
    d = gappy(spark, sf_dir).withColumns({"one": F.lit(1.0), "twice": F.col("volume") * 2})
    return FT.validate_features(d, ["open", "x", "volume", "one", "twice"]).select(
        "check", "column", "other", rounded("value", 6).alias("value"))


def summary_sql(c):
    return (f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct_values, "
            + ", ".join(rnd(f"{f}({c})", 3, n) for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"),
                        ("max", "max"), ("skewness", "skew"), ("kurtosis", "kurtosis"))) + " FROM gappy")


@query("feature_summary", with_(DAILY, GAPPY, body=" UNION ALL ".join(summary_sql(c) for c in ("open", "x", "volume"))))
def feature_summary(spark, sf_dir):
    d = FT.feature_summary(gappy(spark, sf_dir), ["open", "x", "volume"])
    return d.select("column", "nulls", "distinct_values",
                    *[rounded(c, 3).alias(c) for c in ("mean", "std", "min", "max", "skew", "kurtosis")])


@query("compact_types", "SELECT l_orderkey AS k, CAST(l_quantity AS DOUBLE) AS q, l_linenumber AS n FROM lineitem")
def compact_types(spark, sf_dir):
    d = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("q"),
                                                  F.col("l_linenumber").alias("n"))
    return FT.compact_types(d).select(F.col("k").cast("long"), F.col("q").cast("double"), F.col("n").cast("int"))


@query("required_columns", "SELECT 'l_quantity' AS \"column\", TRUE AS present, count(l_quantity) AS filled FROM lineitem UNION ALL SELECT 'l_shipdate', TRUE, count(l_shipdate) FROM lineitem UNION ALL SELECT 'close', FALSE, 0")
def required_columns(spark, sf_dir):
    return CL.column_report(T.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_shipdate", "close"])
