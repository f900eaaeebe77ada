"""Sources, sinks, resampling, scalar functions, sorts and set operations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quantloom.functions import scalar as S
from quantloom.operators import accounting as A, sets as ST
from quantloom.plans import query
from quantloom.plans.kit import (ASSET, DAILY, HOLDINGS, HOURLY, META, O, U, dv, lag, pct, pick, result, rnd, rounded,
                                 steps, with_)
from quantloom.sources import files, tables as T, vendor as V

BAR_COLS = ["open", "high", "low", "close", "volume"]
BARS_SQL = with_(DAILY, body=pick(BAR_COLS, 4, source="daily"))


@query("daily_bars", BARS_SQL)
def daily_bars(spark, sf_dir):
    return result(T.daily_bars(spark, sf_dir), BAR_COLS, 4)


@query("hourly_bars", with_(HOURLY, body=pick(BAR_COLS, 4, base="hourly", source="hourly")))
def hourly_bars(spark, sf_dir):
    return result(T.hourly_bars(spark, sf_dir), BAR_COLS, 4, base="hourly")


# ---- sinks and scans --------------------------------------------------------------------------------------------
@query("parquet_sink_scan", with_(DAILY, body=pick(["close"], 4, source="daily") + " WHERE close > 20000 AND volume <= 30"))
def parquet_sink_scan(spark, sf_dir):
    path = files.shared_folder(spark)
    files.write_parquet(T.daily_bars(spark, sf_dir), path, codec="zstd")
    df = files.read_parquet(spark, path, ["symbol", "ts", "close"], [("close", ">", 20000.0), ("volume", "<=", 30.0)])
    return result(df, ["close"], 4)


@query("parquet_partitioned_sink", "SELECT l_orderkey AS k, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R'")
def parquet_partitioned_sink(spark, sf_dir):
    path = files.shared_folder(spark)
    src = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("q"), "l_returnflag")
    files.write_parquet(src, path, partition_by=["l_returnflag"])
    return files.read_parquet(spark, path, ["k", "q"], [("l_returnflag", "==", "R")])


@query("csv_sink_scan", with_(DAILY, body="SELECT symbol, volume FROM daily WHERE volume <> 10"))
def csv_sink_scan(spark, sf_dir):
    path = files.shared_folder(spark)
    files.write_csv(T.daily_bars(spark, sf_dir).select("symbol", "ts", "volume"), path, compress=True)
    return files.read_csv(spark, path, "symbol bigint, ts string, volume double", ["symbol", "volume"],
                          [("volume", "!=", 10.0)])


@query("export_csv", "SELECT CAST(o_custkey AS BIGINT) AS k, count(*) AS n FROM orders GROUP BY 1")
def export_csv(spark, sf_dir):
    path = files.shared_folder(spark)
    counts = T.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("latest"))
    files.export_results(counts, path, "csv", time="latest")
    return files.read_csv(spark, path, "k bigint, n bigint, latest string", ["k", "n"])


@query("map_batches", "SELECT l_orderkey AS k, l_quantity * 2 AS q2 FROM lineitem")
def map_batches(spark, sf_dir):
    src = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("q"))
    return files.map_batches(src, lambda p: pd.DataFrame({"k": p.k, "q2": p.q * 2}), "k long, q2 double")


# ---- vendor payloads: text that Spark writes from the bars, one per symbol and month ----------------------------------
def monthly(spark, sf_dir, record, wrap):
    bars = T.daily_bars(spark, sf_dir)
    rows = bars.groupBy("symbol", F.date_trunc("month", "ts").alias("m")).agg(F.collect_list(record).alias("rows"))
    return rows.select(F.col("symbol").cast("string").alias("symbol"), F.to_json(wrap(F.col("rows"))).alias("payload"))


VENDOR_SQL = with_(DAILY, body="SELECT CAST(symbol AS VARCHAR) AS symbol, strftime(ts, '%Y-%m-%d') AS day, "
                   + ", ".join(rnd(c, 4) for c in BAR_COLS) + " FROM daily")
DAY = F_DAY = "yyyy-MM-dd"


@query("vendor_date_map", VENDOR_SQL)
def vendor_date_map(spark, sf_dir):
    rec = F.struct(F.date_format("ts", DAY).alias("key"), F.create_map(*[
        x for c in BAR_COLS for x in (F.lit(c), F.col(c).cast("string"))]).alias("value"))
    return result(V.date_map_bars(monthly(spark, sf_dir, rec, F.map_from_entries)), BAR_COLS, 4)


@query("vendor_record_array", VENDOR_SQL)
def vendor_record_array(spark, sf_dir):
    rec = F.struct(F.col("symbol").cast("string").alias("s"), F.struct(
        F.date_format("ts", DAY).alias("date"), *[F.col(to).alias(n) for n, to in V.RECORD_NAMES.items()]).alias("r"))
    wrap = lambda rows: F.create_map(rows[0]["s"], F.struct(F.transform(rows, lambda x: x["r"]).alias("chart")))
    return result(V.record_array_bars(monthly(spark, sf_dir, rec, wrap)), BAR_COLS, 4)


@query("vendor_column_table", VENDOR_SQL)
def vendor_column_table(spark, sf_dir):
    rec = F.array(F.date_format("ts", DAY), *[F.col(c).cast("string") for c in BAR_COLS])
    wrap = lambda rows: F.struct(F.array(*[F.lit(n) for n in ("date", *BAR_COLS)]).alias("column_names"),
                                 rows.alias("data"))
    return result(V.column_table_bars(monthly(spark, sf_dir, rec, wrap)), BAR_COLS, 4)


REGION_BARS = """rb AS (SELECT geography, ts, avg(open) AS open, avg(close) AS close FROM daily JOIN meta USING (symbol) GROUP BY 1, 2)"""


@query("wide_to_long", with_(DAILY, META, REGION_BARS, body=f"""SELECT geography AS symbol, strftime(ts, '%Y-%m-%d') AS day,
  {rnd('open', 3)}, {rnd('close', 3)} FROM rb"""))
def wide_to_long(spark, sf_dir):
    bars = T.daily_bars(spark, sf_dir).join(T.symbol_metadata(spark, sf_dir), "symbol")
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    wide = bars.groupBy("ts").agg(*[F.avg(F.when(F.col("geography") == n, F.col(c.lower()))).alias(f"{n}_{c}")
                                    for n in names for c in ("Open", "Close")])
    return result(V.wide_to_long(wide).where("close is not null"), ["open", "close"], 3)


@query("provider_priority", with_(DAILY, body=f"""SELECT symbol, strftime(ts, '%Y-%m-%d') AS day,
  CASE WHEN volume % 3 = 0 THEN 'b' WHEN volume % 2 = 0 THEN 'a' ELSE 'c' END AS provider,
  {rnd("CASE WHEN volume % 3 = 0 THEN close + 2 WHEN volume % 2 = 0 THEN close + 1 ELSE close END", 4, 'close')} FROM daily"""))
def provider_priority(spark, sf_dir):
    d, v = T.daily_bars(spark, sf_dir).select("symbol", "ts", "close", "volume"), F.col("volume")
    sources = {"a": d.where(v % 2 == 0).withColumn("close", F.col("close") + 1),
               "b": d.where(v % 3 == 0).withColumn("close", F.col("close") + 2), "c": d}
    return result(V.by_priority(sources, preferred="b"), ["close"], 4, keys=("symbol", "provider"))


@query("monthly_factors", f"""SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS month,
  {rnd('sum(round(l_discount * 100)) / count(*) / 100', 6, 'mkt')}, {rnd('sum(round(l_tax * 100)) / count(*) / 100', 6, 'smb')} FROM lineitem GROUP BY 1""")
def monthly_factors(spark, sf_dir):
    src = T.table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyyMM").alias("period")).agg(
        *[(F.sum(F.round(F.col(c) * 100)) / F.count(F.lit(1))).alias(n) for c, n in (("l_discount", "mkt"), ("l_tax", "smb"))])
    out = V.monthly_factors(src, "period", ["mkt", "smb"])
    return out.select(F.date_format("month", DAY).alias("month"), rounded("mkt").alias("mkt"), rounded("smb").alias("smb"))


def resample_sql(label):
    return with_(DAILY, body=f"""SELECT symbol, strftime({label}, '%Y-%m-%d') AS day, {rnd('arg_min(open, ts)', 4, 'open')},
  {rnd('max(high)', 4, 'high')}, {rnd('min(low)', 4, 'low')}, {rnd('arg_max(close, ts)', 4, 'close')}, {rnd('sum(volume)', 4, 'volume')}
  FROM daily GROUP BY symbol, 2""")


@query("resample_weekly", resample_sql("date_trunc('week', ts) + INTERVAL 6 DAY"))
def resample_weekly(spark, sf_dir):
    return result(V.resample(T.daily_bars(spark, sf_dir), "W"), BAR_COLS, 4, ts="bucket")


@query("resample_month_end", resample_sql("last_day(ts)"))
def resample_month_end(spark, sf_dir):
    return result(V.resample(T.daily_bars(spark, sf_dir), "ME"), BAR_COLS, 4, ts="bucket")


# ---- scalar functions -----------------------------------------------------------------------------------------------
@query("price_changes", with_(DAILY, steps("daily", [("change", pct("close")), ("step", f"close - {lag('close')}"),
    ("before", lag("close", 3)), ("after", f"lead(close, 2) OVER {O()}"), ("total", f"sum(volume) OVER {U()}"),
    ("peak", f"max(close) OVER {U()}"), ("growth", f"ln(product(1 + coalesce(change, 0)) OVER {U()})")]),
    body=pick(["change", "step", "before", "after", "total", "peak", "growth"], 4)))
def price_changes(spark, sf_dir):
    from quantloom.operators.series import Series
    s = Series(T.daily_bars(spark, sf_dir).select("symbol", "ts", "close", "volume"))
    change = s.let(s.pct(s.close))
    out = {"change": change, "step": s.diff(s.close), "before": s.lag(s.close, 3), "after": s.lead(s.close, 2),
           "total": s.running_sum(s.volume), "peak": s.running_max(s.close),
           "growth": F.ln(s.running_product(s.let(1 + F.coalesce(change, F.lit(0.0)))))}
    return result(s.frame(out), list(out), 4)


@query("elementwise_math", f"""SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, {rnd('ln(l_extendedprice)', 6, 'log')}, {rnd('ln(1 + l_quantity)', 6, 'log1p')},
  {rnd('exp(l_discount)', 6, 'exp')}, {rnd('sqrt(l_extendedprice)', 6, 'root')}, {rnd('abs(l_discount - l_tax)', 6, 'size')},
  {rnd('sign(round(l_discount * 100) - round(l_tax * 100))', 1, 'direction')}, {rnd('greatest(least(l_quantity, 40), 5)', 2, 'clipped')} FROM lineitem""")
def elementwise_math(spark, sf_dir):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    d, t = F.col("l_discount"), F.col("l_tax")
    return T.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"),
        rounded(F.ln(p)).alias("log"), rounded(F.log1p(q)).alias("log1p"), rounded(F.exp(d)).alias("exp"),
        rounded(F.sqrt(p)).alias("root"), rounded(F.abs(d - t)).alias("size"),
        rounded(F.signum(F.round(d * 100) - F.round(t * 100)), 1).alias("direction"), rounded(S.clip(q, 5, 40), 2).alias("clipped"))


@query("return_conversions", f"""SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p,
  {rnd("CASE WHEN l_returnflag = 'R' THEN (l_discount - l_tax) * m ELSE pow(1 + l_discount - l_tax, m) - 1 END", 5, 'annual')},
  {rnd("CASE WHEN l_returnflag = 'R' THEN l_discount - l_tax ELSE ln(1 + l_discount - l_tax) END", 6, 'log_return')},
  {rnd("CASE WHEN l_returnflag = 'R' THEN exp(l_discount - l_tax) - 1 ELSE l_discount - l_tax END", 6, 'simple_return')}
  FROM (SELECT *, CASE l_linenumber WHEN 1 THEN 252 WHEN 2 THEN 52 WHEN 3 THEN 12 WHEN 4 THEN 4 WHEN 5 THEN 1 ELSE 252 END AS m FROM lineitem)""")
def return_conversions(spark, sf_dir):
    r = F.col("l_discount") - F.col("l_tax")
    kind = F.when(F.col("l_returnflag") == "R", "LOG").otherwise("SIMPLE")
    code = F.element_at(F.array(*[F.lit(c) for c in ("1D", "1W", "1M", "3M", "1Y", "?", "?")]), F.col("l_linenumber"))
    return T.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"),
        rounded(S.annualize_return(r, kind, code), 5).alias("annual"), rounded(S.to_log_return(r, kind)).alias("log_return"),
        rounded(S.to_simple_return(r, kind)).alias("simple_return"))


@query("currency_conversion", f"""SELECT c_custkey AS customer, currency, {rnd('c_acctbal * rate', 4, 'usd')} FROM (
  SELECT *, CASE c_nationkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'JPY' WHEN 2 THEN 'GBP' ELSE 'USD' END AS currency FROM customer)
  JOIN (VALUES ('EUR', 1.08), ('JPY', 0.0067), ('GBP', 1.27), ('USD', 1.0)) fx(currency, rate) USING (currency)""")
def currency_conversion(spark, sf_dir):
    rates = spark.createDataFrame([("EUR", 1.08), ("JPY", 0.0067), ("GBP", 1.27), ("USD", 1.0)], "currency string, rate double")
    codes = F.array(*[F.lit(c) for c in ("EUR", "JPY", "GBP", "USD")])
    money = T.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer"), F.get(codes, F.col("c_nationkey") % 4).alias("currency"), F.col("c_acctbal").alias("value"))
    return A.to_currency(money, rates, "usd").select("customer", "currency", rounded("usd", 4).alias("usd"))


POS = """px AS (SELECT symbol, arg_max(close, ts) AS price FROM daily GROUP BY symbol)"""


@query("position_values", with_(DAILY, HOLDINGS, POS, body=f"""SELECT portfolio, symbol, {rnd('qty * price', 2, 'market_value')},
  {rnd('qty * price - value', 2, 'pnl')}, {rnd('qty * price / (sum(qty * price) OVER (PARTITION BY portfolio) + 1000)', 6, 'weight')} FROM weights JOIN px USING (symbol)
  UNION ALL SELECT portfolio, -1, 1000.0, 0.0, {rnd('1000 / (sum(qty * price) + 1000)', 6, 'weight')} FROM weights JOIN px USING (symbol) GROUP BY portfolio"""))
def position_values(spark, sf_dir):
    last = T.daily_bars(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    pos = T.holdings(spark, sf_dir).join(last, "symbol").withColumn("avg_cost", F.col("value") / F.col("qty"))
    out = A.position_values(pos, cash=1000.0, cash_symbol=-1)
    return out.select("portfolio", "symbol", rounded("market_value", 2).alias("market_value"), rounded("pnl", 2).alias("pnl"),
                      rounded("weight").alias("weight"))


FILLS = """fills AS (SELECT o_custkey AS portfolio, l_suppkey % 5 AS symbol, l_orderkey * 8 + l_linenumber AS seq, l_partkey,
  CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS qty, l_extendedprice / l_quantity AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
FW = "OVER (PARTITION BY portfolio, symbol ORDER BY seq, l_partkey, price, qty)"


def fills(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("portfolio"))
    q = F.col("l_quantity")
    lines = T.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_suppkey") % 5).alias("symbol"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        "l_partkey", F.when(F.col("l_returnflag") == "R", -q).otherwise(q).alias("qty"), (F.col("l_extendedprice") / q).alias("price"))
    return lines.join(orders, "l_orderkey").withColumn("ts", F.struct("seq", "l_partkey", "price", "qty"))


def costed_fills(spark, sf_dir):
    """Fills of one (portfolio, symbol) have no calendar bound, so the blocked form is used."""
    return A.average_cost(fills(spark, sf_dir), ("portfolio", "symbol"), block_rows=100_000, chunk=F.floor(F.col("seq") / 2 ** 20))


@query("average_cost", with_(FILLS, f"a AS (SELECT *, sum(qty) {FW} AS held, row_number() {FW} AS rn FROM fills)",
    "b AS (SELECT *, coalesce(sum(CASE WHEN held = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio, symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS leg FROM a)",
    body=f"""SELECT portfolio, symbol, rn AS fill, {rnd('held', 2, 'held')},
  {rnd('CASE WHEN held <> 0 THEN sum(qty * price) OVER (PARTITION BY portfolio, symbol, leg ORDER BY rn) / held END', 3, 'avg_cost')} FROM b"""))
def average_cost(spark, sf_dir):
    c = costed_fills(spark, sf_dir)
    return c.select("portfolio", "symbol", F.col("fill").cast("long"), rounded("held", 2).alias("held"), rounded("avg_cost", 3).alias("avg_cost"))


@query("date_parsing", """SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month,
  isodow(o_orderdate) < 6 AS business_day FROM orders""")
def date_parsing(spark, sf_dir):
    src = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", DAY).alias("text"),
                                                  F.date_format("o_orderdate", "yyyyMM").alias("ym"))
    day, month = F.to_date("text", DAY), F.to_date(F.concat("ym", F.lit("01")), "yyyyMMdd")
    return src.select("k", F.date_format(day, DAY).alias("day"), F.date_format(month, DAY).alias("month"),
                      S.business_day(day).alias("business_day"))


@query("json_columns", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || ':' || json_extract_string(props, '$.k') AS tag FROM events")
def json_columns(spark, sf_dir):
    m = F.from_json("props", "map<string,string>")
    back = F.from_json(F.to_json(m), "map<string,string>")
    return T.table(spark, sf_dir, "events").select("event_id", back["k"].cast("long").alias("k"),
                                                   F.concat_ws(":", "event_type", m["k"]).alias("tag"))


@query("name_parsing", """SELECT DISTINCT n_name || '_Close' AS name, n_name AS ticker, 'Close' AS field, replace(n_name || '_Close', '_Close', '') AS bare,
  contains(lower(n_name || '_Close'), 'close') AS is_close FROM nation""")
def name_parsing(spark, sf_dir):
    n = T.table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit("_Close")).alias("name")).distinct()
    return n.select("name", S.ticker_of("name").alias("ticker"), S.price_field_of("name").alias("field"),
                    F.replace("name", F.lit("_Close"), F.lit("")).alias("bare"), F.contains(F.lower("name"), F.lit("close")).alias("is_close"))


@query("severity_bands", """SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p,
  CASE WHEN e <= 10 THEN 'low' WHEN e <= 25 THEN 'medium' WHEN e <= 50 THEN 'high' ELSE 'critical' END AS excess,
  CASE WHEN l_tax < 0.001 THEN 'high' WHEN l_tax < 0.01 THEN 'medium' ELSE 'low' END AS by_p,
  CASE WHEN l_discount * 5 > 0.30 THEN 'high' WHEN l_discount * 5 > 0.15 THEN 'medium' ELSE 'low' END AS by_change
  FROM (SELECT *, 100 * (l_quantity - 30) / 30 AS e FROM lineitem)""")
def severity_bands(spark, sf_dir):
    return T.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"),
        S.excess_severity(F.col("l_quantity"), F.lit(30.0)).alias("excess"), S.p_value_severity(F.col("l_tax")).alias("by_p"),
        S.change_severity(F.col("l_discount") * 5).alias("by_change"))


@query("histogram_bins", """SELECT CAST(least(floor((value - lo) / (hi - lo) * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM events,
  (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1""")
def histogram_bins(spark, sf_dir):
    return A.histogram(T.table(spark, sf_dir, "events"), "value", 10)


# ---- sorts, limits, top-k --------------------------------------------------------------------------------------------
W_SQL = lambda body: with_(HOLDINGS, body=body)


@query("top_holdings", W_SQL(f"""SELECT portfolio, symbol, CAST(rank AS BIGINT) AS rank, {rnd('w', 6)} FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY abs(w) DESC, symbol) AS rank FROM weights) WHERE rank <= 10"""))
def top_holdings(spark, sf_dir):
    t = ST.top_per_key(T.portfolio_weights(spark, sf_dir), ["portfolio"], [F.desc(F.abs("w")), "symbol"], 10)
    return t.select("portfolio", "symbol", F.col("rank").cast("long"), rounded("w").alias("w"))


@query("largest_trades", "SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS value FROM lineitem ORDER BY abs(l_extendedprice) DESC, l_orderkey, l_linenumber LIMIT 10")
def largest_trades(spark, sf_dir):
    src = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("value"))
    return ST.top_rows(src, [F.desc(F.abs("value")), "k", "n"], 10)


@query("lookback_rows", with_(ASSET, body=f"""SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, {rnd('ret', 6)} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM asset) WHERE k <= 252"""))
def lookback_rows(spark, sf_dir):
    return result(ST.top_per_key(T.asset_returns(spark, sf_dir), ["symbol"], [F.desc("ts")], 252), ["ret"])


@query("newest_first_page", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 10")
def newest_first_page(spark, sf_dir):
    from quantloom.sources.datasets import page
    return page(T.table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 20, 10).select("event_id", "event_type")


@query("keep_first", """SELECT symbol, day, price FROM (SELECT l_suppkey AS symbol, strftime(l_shipdate, '%Y-%m-%d') AS day, l_extendedprice AS price,
  row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS k FROM lineitem) WHERE k = 1""")
def keep_first(spark, sf_dir):
    from quantloom.operators.clean import keep_first as first
    src = T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"),
                                                    "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return first(src, ["symbol", "ts"], ["l_orderkey", "l_linenumber", "price"]).select(
        "symbol", F.date_format("ts", DAY).alias("day"), "price")


@query("sector_weights", with_(HOLDINGS, META, body=f"""SELECT portfolio, coalesce(sector, 'Unknown') AS sector, {rnd('sum(w)', 6, 'w')} FROM weights LEFT JOIN meta USING (symbol) GROUP BY 1, 2"""))
def sector_weights(spark, sf_dir):
    w = T.portfolio_weights(spark, sf_dir).join(T.symbol_metadata(spark, sf_dir), "symbol", "left")
    return w.groupBy("portfolio", F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(rounded(F.sum("w")).alias("w"))


# ---- set operations --------------------------------------------------------------------------------------------------
def universe(spark, sf_dir):
    """Customers with orders beside all customers."""
    return (T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("part")), T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("part")))


UNI = "a AS (SELECT o_custkey AS part FROM orders), b AS (SELECT c_custkey AS part FROM customer)"


@query("key_union", f"WITH {UNI} SELECT part FROM a UNION SELECT part FROM b")
def key_union(spark, sf_dir):
    return ST.union_keys(*universe(spark, sf_dir), ["part"])


@query("key_intersection", f"WITH {UNI} SELECT part FROM a INTERSECT SELECT part FROM b")
def key_intersection(spark, sf_dir):
    return ST.common_keys(*universe(spark, sf_dir), ["part"])


@query("key_difference", f"WITH {UNI} SELECT part FROM a EXCEPT SELECT part FROM b")
def key_difference(spark, sf_dir):
    return ST.missing_keys(*universe(spark, sf_dir), ["part"])


@query("frame_union", "SELECT l_returnflag AS flag, count(*) AS n, count(q) AS with_q FROM (SELECT l_returnflag, l_quantity AS q FROM lineitem UNION ALL SELECT l_returnflag, NULL FROM lineitem) GROUP BY 1")
def frame_union(spark, sf_dir):
    src = T.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("q"))
    return V.union_frames([src, src.select("flag")]).groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.count("q").alias("with_q"))
