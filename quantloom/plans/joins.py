"""Alignment, as-of and range joins, walk-forward windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import joins as J, metrics as M
from quantloom.plans import query
from quantloom.plans.kit import (ASSET, DAILY, FACTORS, HOLDINGS, MARKET, META, SECTOR, dv, lag, pct, pick, result, rnd, rounded,
                                 steps, with_)
from quantloom.plans.metrics import FC, PAIRS, SECTOR_W, sector_portfolios
from quantloom.plans.rolling import ASSET_MARKET
from quantloom.sources import tables as T

DAY = "yyyy-MM-dd"
d10 = lambda c: F.date_format(c, DAY)


@query("align_two_series", with_(ASSET, MARKET, ASSET_MARKET, body=pick(["ret", "bench"], source="am")))
def align_two_series(spark, sf_dir):
    return result(J.align([T.asset_returns(spark, sf_dir), T.market_returns(spark, sf_dir)], "ts"), ["ret", "bench"])


@query("align_many_series", with_(META, ASSET, MARKET, FACTORS, "j AS (SELECT symbol, ts, ret, bench, f0, f1, f2, f3, f4 FROM asset JOIN factors USING (ts) JOIN market USING (ts))",
    body=pick(["ret", "bench", *FC], source="j") + " WHERE symbol IN (SELECT symbol FROM j GROUP BY symbol HAVING count(*) >= 60)"))
def align_many_series(spark, sf_dir):
    j = J.align([T.asset_returns(spark, sf_dir), T.factor_returns(spark, sf_dir), T.market_returns(spark, sf_dir)], "ts", 60, ["symbol"])
    return result(j, ["ret", "bench", *FC])


def year_weights(spark, sf_dir, year, name):
    o = T.table(spark, sf_dir, "orders").where(F.year("o_orderdate") == year)
    t = o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_custkey").alias("portfolio")).agg(F.sum("o_totalprice").alias("v"))
    return T.with_total(t, ["portfolio"], _t=F.sum("v")).select("portfolio", "symbol", (F.col("v") / F.col("_t")).alias(name))


def yw(year, name):
    return f"{name} AS (SELECT o_custkey AS portfolio, o_orderpriority AS symbol, sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY o_custkey) AS {name} FROM orders WHERE year(o_orderdate) = {year} GROUP BY 1, 2)"


@query("weights_outer_join", with_(yw(1996, "current"), yw(1997, "target"), "j AS (SELECT portfolio, symbol, coalesce(current, 0) AS current, coalesce(target, 0) AS target FROM current FULL JOIN target USING (portfolio, symbol))",
    body=pick(["current", "target"], keys=("portfolio", "symbol"), ts=None, source="j")))
def weights_outer_join(spark, sf_dir):
    j = J.align_outer(year_weights(spark, sf_dir, 1996, "current"), year_weights(spark, sf_dir, 1997, "target"), ["portfolio", "symbol"], ["current", "target"])
    return result(j, ["current", "target"], keys=("portfolio", "symbol"), ts=None)


@query("metadata_lookup", with_(HOLDINGS, META, body=f"SELECT portfolio, symbol, coalesce(sector, 'Unknown') AS sector, coalesce(geography, 'Unknown') AS geography, {rnd('w')} FROM weights LEFT JOIN meta USING (symbol)"))
def metadata_lookup(spark, sf_dir):
    j = T.portfolio_weights(spark, sf_dir).join(T.symbol_metadata(spark, sf_dir), "symbol", "left").fillna("Unknown", ["sector", "geography"])
    return result(j, ["w"], keys=("portfolio", "symbol", "sector", "geography"), ts=None)


TRADES = "trades AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS symbol, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def trades(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("ts"))
    lines = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("symbol"))
    return lines.join(o, "k")


ASOF_B = "b AS (SELECT t.*, d.ts AS bts, d.close AS bc FROM trades t ASOF LEFT JOIN daily d ON t.symbol = d.symbol AND t.ts >= d.ts)"
ASOF_F = "f AS (SELECT b.*, d.ts AS fts, d.close AS fc FROM b ASOF LEFT JOIN daily d ON b.symbol = d.symbol AND b.ts <= d.ts)"
NEAR = "CASE WHEN bts IS NULL THEN {f} WHEN fts IS NULL THEN {b} WHEN date_diff('day', ts, fts) <= date_diff('day', bts, ts) THEN {f} ELSE {b} END"


@query("asof_nearest_price", with_(DAILY, TRADES, ASOF_B, ASOF_F, body=f"""SELECT k, n, p, symbol, strftime({NEAR.format(f='fts', b='bts')}, '%Y-%m-%d') AS matched,
  {rnd(NEAR.format(f='fc', b='bc'), 4, 'close')} FROM f"""))
def asof_nearest_price(spark, sf_dir):
    j = J.asof_join(trades(spark, sf_dir), T.daily_bars(spark, sf_dir), ["symbol"], "ts", ["close"], "nearest")
    return j.select("k", "n", "p", "symbol", d10("matched_ts").alias("matched"), rounded("close", 4).alias("close"))


@query("asof_backward_price", with_(DAILY, TRADES, ASOF_B, body=f"SELECT k, n, p, symbol, strftime(bts, '%Y-%m-%d') AS matched, {rnd('bc', 4, 'close')} FROM b"))
def asof_backward_price(spark, sf_dir):
    j = J.asof_join(trades(spark, sf_dir), T.daily_bars(spark, sf_dir), ["symbol"], "ts", ["close"], "backward")
    return j.select("k", "n", "p", "symbol", d10("matched_ts").alias("matched"), rounded("close", 4).alias("close"))


# corporate actions that follow from the bars: a split where the volume divides by 97, a dividend where it divides by 41
ACTIONS = """acts AS (SELECT symbol, ts AS ex_date, CASE WHEN volume % 97 = 0 THEN 'SPLIT' ELSE 'DIVIDEND' END AS action_type, 2.0::DOUBLE AS split_ratio, close / 100 AS amount
  FROM daily WHERE volume % 97 = 0 OR volume % 41 = 0)"""


def actions(spark, sf_dir):
    v = F.col("volume")
    return T.daily_bars(spark, sf_dir).where((v % 97 == 0) | (v % 41 == 0)).select(
        "symbol", F.col("ts").alias("ex_date"), F.when(v % 97 == 0, "SPLIT").otherwise("DIVIDEND").alias("action_type"),
        F.lit(2.0).alias("split_ratio"), (F.col("close") / 100).alias("amount"))


@query("corporate_action_adjustment", with_(DAILY, ACTIONS,
    "l AS (SELECT d.symbol, d.ts, d.close, d.volume, list({'t': action_type, 'd': amount} ORDER BY ex_date DESC) FILTER (ex_date IS NOT NULL) AS a FROM daily d LEFT JOIN acts ON acts.symbol = d.symbol AND acts.ex_date >= d.ts GROUP BY ALL)",
    body=f"""SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, {rnd("CASE WHEN a IS NULL THEN close ELSE list_reduce(list_prepend({'t': 'X', 'd': close}, a), lambda p, x: {'t': 'X', 'd': CASE WHEN x.t = 'SPLIT' THEN p.d / 2 ELSE p.d - x.d END}).d END", 3, 'close')},
  {rnd("volume * pow(2, coalesce(len(list_filter(a, lambda x: x.t = 'SPLIT')), 0))", 2, 'volume')} FROM l"""))
def corporate_action_adjustment(spark, sf_dir):
    adj = J.adjust_for_actions(T.daily_bars(spark, sf_dir), actions(spark, sf_dir), prices=["close"])
    return result(adj, ["close", "volume"], {"close": 3, "volume": 2})


DAY_ACTIONS = """da AS (SELECT s_suppkey AS symbol, CASE s_suppkey % 5 WHEN 0 THEN 'SPLIT' WHEN 1 THEN 'DIVIDEND' WHEN 2 THEN 'SPIN_OFF' WHEN 3 THEN 'MERGER' END AS action_type,
  CASE s_suppkey % 5 WHEN 0 THEN 2.0 WHEN 2 THEN 0.2 ELSE 0.5 END::DOUBLE AS ratio, 1.5::DOUBLE AS amount, CASE WHEN s_suppkey % 5 = 2 THEN s_suppkey + 1000000 ELSE s_suppkey + 1 END AS new_symbol FROM supplier WHERE s_suppkey % 5 < 4)"""


@query("ex_date_events", with_(HOLDINGS, DAY_ACTIONS, "p AS (SELECT portfolio, symbol, qty, value / qty AS c, value / qty AS px FROM holdings)",
    """e AS (SELECT portfolio, CASE WHEN action_type = 'MERGER' THEN new_symbol ELSE symbol END AS symbol, CASE WHEN action_type IN ('SPLIT', 'MERGER') THEN qty * ratio ELSE qty END AS qty,
  CASE WHEN action_type = 'SPLIT' THEN c / ratio ELSE c END AS c, CASE WHEN action_type = 'DIVIDEND' THEN qty * amount ELSE 0 END AS cash FROM p LEFT JOIN da USING (symbol)
  UNION ALL SELECT portfolio, new_symbol, qty * ratio, px * 0.1, 0 FROM p JOIN da USING (symbol) WHERE action_type = 'SPIN_OFF')""",
    body=f"SELECT portfolio, symbol, {rnd('sum(qty)', 4, 'qty')}, {rnd('sum(qty * c) / sum(qty)', 4, 'avg_cost')}, {rnd('sum(cash)', 4, 'cash')} FROM e GROUP BY portfolio, symbol"))
def ex_date_events(spark, sf_dir):
    h = T.holdings(spark, sf_dir).withColumns({"avg_cost": F.col("value") / F.col("qty"), "price": F.col("value") / F.col("qty")})
    s = F.col("s_suppkey")
    acts = T.table(spark, sf_dir, "supplier").where(s % 5 < 4).select(
        s.alias("symbol"), F.get(F.array(*[F.lit(k) for k in ("SPLIT", "DIVIDEND", "SPIN_OFF", "MERGER")]), (s % 5).cast("int")).alias("action_type"),
        F.when(s % 5 == 0, 2.0).when(s % 5 == 2, 0.2).otherwise(0.5).alias("ratio"), F.lit(1.5).alias("amount"),
        F.when(s % 5 == 2, s + 1000000).otherwise(s + 1).alias("new_symbol"))
    out = J.apply_actions(h, acts)
    return result(out, ["qty", "avg_cost", "cash"], 4, keys=("portfolio", "symbol"), ts=None)


WINDOWS = """span AS (SELECT CAST(min(ts) AS DATE) AS s, CAST(max(ts) AS DATE) AS e FROM asset),
  wins AS (SELECT w, s + CAST(30 * w AS INTEGER) AS a FROM (SELECT s, unnest(range(0, greatest(CAST(floor((e - s - 451) / 30) AS BIGINT) + 1, 0))) AS w FROM span))"""
WF = """wf AS (SELECT symbol, ts, ret, w AS "window", 'train' AS side FROM asset JOIN wins ON ts BETWEEN a AND a + 360
  UNION ALL SELECT symbol, ts, ret, w, 'test' FROM asset JOIN wins ON ts BETWEEN a + 361 AND a + 451)"""


def walk_rows(spark, sf_dir):
    return J.walk_forward_rows(T.asset_returns(spark, sf_dir))


@query("walk_forward_windows", with_(ASSET, WINDOWS, WF, body='SELECT symbol, "window", side, count(*) AS n, strftime(min(ts), \'%Y-%m-%d\') AS first_day, strftime(max(ts), \'%Y-%m-%d\') AS last_day FROM wf GROUP BY ALL'))
def walk_forward_windows(spark, sf_dir):
    return walk_rows(spark, sf_dir).groupBy("symbol", "window", "side").agg(
        F.count(F.lit(1)).alias("n"), d10(F.min("ts")).alias("first_day"), d10(F.max("ts")).alias("last_day"))


PERF = """perf AS (SELECT symbol, "window", side, count(*) AS n, pow(product(1 + ret), 252.0 / count(*)) - 1 AS annual, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 0) AS sharpe FROM wf GROUP BY 1, 2, 3)"""
WFS = ["mean_return", "sd_return", "mean_sharpe", "consistency", "return_degradation", "sharpe_degradation", "degradation_consistency"]


@query("walk_forward_summary", with_(ASSET, WINDOWS, WF, PERF,
    'm AS (SELECT symbol, "window", max(annual) FILTER (side = \'train\') AS ta, max(sharpe) FILTER (side = \'train\') AS ts_, max(annual) FILTER (side = \'test\') AS ea, max(sharpe) FILTER (side = \'test\') AS es FROM perf GROUP BY 1, 2)',
    """s AS (SELECT symbol, count(*) AS windows, avg(ea) AS mean_return, stddev_pop(ea) AS sd_return, avg(es) AS mean_sharpe, avg(CASE WHEN ea > 0 THEN 1.0 ELSE 0.0 END) AS consistency, avg(ta - ea) AS return_degradation,
  avg(ts_ - es) AS sharpe_degradation, avg(CASE WHEN ta - ea > 0 THEN 1.0 ELSE 0.0 END) AS degradation_consistency, count(*) FILTER (ts_ - es > 1) AS severe_windows FROM m WHERE ta IS NOT NULL AND ea IS NOT NULL GROUP BY symbol)""",
    body=pick(WFS, 3, keys=("symbol", "windows", "severe_windows"), ts=None, source="s")))
def walk_forward_summary(spark, sf_dir):
    s = J.walk_forward_summary(J.window_performance(walk_rows(spark, sf_dir)))
    return result(s, WFS, 3, keys=("symbol", "windows", "severe_windows"), ts=None)


@query("parameter_stability", with_(ASSET, WINDOWS, WF, PERF, "b AS (SELECT \"window\", symbol AS value, row_number() OVER (PARTITION BY \"window\" ORDER BY annual DESC, symbol) AS k FROM perf WHERE side = 'train')",
    body=f"SELECT 'symbol' AS parameter, count(*) AS n, {rnd('avg(value)', 4, 'mean')}, {rnd('stddev_pop(value)', 4, 'sd')}, {rnd('stddev_pop(value) / avg(value)', 4, 'cv')} FROM b WHERE k = 1"))
def parameter_stability(spark, sf_dir):
    from quantloom.operators.sets import top_per_key
    perf = J.window_performance(walk_rows(spark, sf_dir)).where("side = 'train'")
    best = top_per_key(perf, ["window"], [F.desc("annual"), "symbol"], 1)
    out = J.parameter_stability(best.select(F.lit("symbol").alias("parameter"), F.col("symbol").alias("value")))
    return out.select("parameter", "n", *[rounded(c, 4).alias(c) for c in ("mean", "sd", "cv")])


# every moving-average pair of a grid is scored over all bars in one job
@query("parameter_grid_backtest", with_(DAILY, steps("daily", [("r", pct("close"))] + [(f"m{n}", f"avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)") for n in (5, 10, 20, 50)]),
    "g AS (" + " UNION ALL ".join(f"SELECT {f} AS fast, {s} AS slow, symbol, r * lag(CASE WHEN m{f} > m{s} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS pr FROM final" for f in (5, 10) for s in (20, 50)) + ")",
    body=f"SELECT fast, slow, count(pr) AS n, {rnd('avg(pr)', 4, 'mean')} FROM g GROUP BY 1, 2"))
def parameter_grid_backtest(spark, sf_dir):
    from quantloom.operators.series import Series
    grid = J.parameter_grid(spark, fast=[5, 10], slow=[20, 50])
    s = Series(T.daily_bars(spark, sf_dir).select("symbol", "ts", "close"))
    means = {n: s.let(F.avg("close").over(s.last_rows(n))) for n in (5, 10, 20, 50)}
    levels = F.create_map(*[x for n, m in means.items() for x in (F.lit(n), m)])
    wide = s.frame({"ret": s.pct(s.close), "levels": s.let(s.lag(levels))}, keep=["symbol", "ts"])
    # the grid is a handful of parameter rows made of literals
    runs = wide.join(F.broadcast(grid), F.lit(True)).withColumn(
        "pr", F.when(F.col("levels").isNotNull(), F.col("ret") * (F.element_at("levels", F.col("fast")) > F.element_at("levels", F.col("slow"))).cast("double")))
    return runs.groupBy("fast", "slow").agg(F.count("pr").alias("n"), rounded(F.avg("pr"), 4).alias("mean"))


@query("correlated_pairs", with_(META, FACTORS, PAIRS, body=f"SELECT i, j, {rnd('corr', 6, 'corr')} FROM pr WHERE i < j AND abs(corr) > 0.02"))
def correlated_pairs(spark, sf_dir):
    return result(J.correlated_pairs(M.column_moments(T.factor_returns(spark, sf_dir), FC)[1], 0.02), ["corr"], keys=("i", "j"), ts=None)


@query("sector_factor_returns", with_(META, ASSET, "s AS (SELECT sector, ts, avg(ret) AS ret FROM asset JOIN meta USING (symbol) GROUP BY 1, 2)", body=pick(["ret"], keys=("sector",), source="s")))
def sector_factor_returns(spark, sf_dir):
    j = T.asset_returns(spark, sf_dir).join(T.symbol_metadata(spark, sf_dir), "symbol").groupBy("sector", "ts").agg(F.avg("ret").alias("ret"))
    return result(j, ["ret"], keys=("sector",))


@query("benchmark_column_join", with_(DAILY, body=f"SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, {rnd('close', 4)}, {rnd('avg(close) OVER (PARTITION BY ts)', 3, 'benchmark')} FROM daily"))
def benchmark_column_join(spark, sf_dir):
    from quantloom.plans.indicators import with_benchmark
    return result(with_benchmark(spark, sf_dir), ["close", "benchmark"], {"close": 4, "benchmark": 3})


@query("survivorship_check", """WITH a AS (SELECT DISTINCT l_partkey AS part FROM lineitem WHERE year(l_shipdate) = 1995), b AS (SELECT DISTINCT l_partkey AS part FROM lineitem WHERE year(l_shipdate) = 2001),
t AS (SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_quantity > 49)
SELECT """ + rnd("(SELECT count(*) FROM a WHERE part NOT IN (SELECT part FROM b)) / (SELECT count(*) FROM a)", 6, "disappeared") + ", "
       + rnd("(SELECT count(*) FROM t WHERE part IN (SELECT part FROM b)) / (SELECT count(*) FROM t)", 6, "survivor_overlap")
       + ", (SELECT count(*) FROM a WHERE part NOT IN (SELECT part FROM b)) / (SELECT count(*) FROM a) > 0.2 AS vanished_flag, (SELECT count(*) FROM t WHERE part IN (SELECT part FROM b)) / (SELECT count(*) FROM t) > 0.9 AS survivor_flag")
def survivorship_check(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.year("l_shipdate").alias("y"), "l_quantity")
    s = J.survivorship(li.where("l_quantity > 49"), li.where("y = 1995"), li.where("y = 2001"), "part")
    return s.select(rounded("disappeared").alias("disappeared"), rounded("survivor_overlap").alias("survivor_overlap"), "vanished_flag", "survivor_flag")


@query("trades_before_data", with_(DAILY, TRADES, body="SELECT k, n, p, symbol FROM trades t JOIN (SELECT symbol, min(ts) AS f FROM daily GROUP BY symbol) USING (symbol) WHERE t.ts < f"))
def trades_before_data(spark, sf_dir):
    return J.trades_before_data(trades(spark, sf_dir), T.daily_bars(spark, sf_dir)).select("k", "n", "p", "symbol")


@query("future_signals", "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p FROM lineitem WHERE l_shipdate > (SELECT max(o_orderdate) FROM orders)")
def future_signals(spark, sf_dir):
    sig = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_shipdate").alias("ts"))
    return J.future_signals(sig, T.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"))).select("k", "n", "p")


@query("signal_alignment", f"""SELECT symbol, strategy, strftime(ts, '%Y-%m-%d') AS day, {rnd('strength', 4)} FROM (SELECT l_suppkey AS symbol, l_shipdate AS ts, l_returnflag AS strategy, l_discount - l_tax AS strength,
  row_number() OVER (PARTITION BY l_suppkey, l_shipdate, l_returnflag ORDER BY l_orderkey DESC, l_discount - l_tax DESC) AS k FROM lineitem) WHERE k = 1""")
def signal_alignment(spark, sf_dir):
    sig = T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"), F.col("l_returnflag").alias("strategy"), F.col("l_orderkey").alias("seq"), (F.col("l_discount") - F.col("l_tax")).alias("strength"))
    return result(J.latest_per_strategy(sig), ["strength"], 4, keys=("symbol", "strategy"))


NAMES = ["Technology", "Healthcare", "Financials", "Consumer Discretionary", "Consumer Staples", "Industrials", "Energy", "Utilities", "Other", "Mixed"]


@query("missing_sectors", with_(HOLDINGS, "nm AS (SELECT i, n FROM (SELECT unnest(range(0, 10)) AS i, unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) AS n))",
    "sw AS (SELECT portfolio, n AS sector, sum(w) AS w FROM weights JOIN supplier ON s_suppkey = symbol JOIN nm ON i = s_nationkey % 10 GROUP BY 1, 2)",
    "wanted AS (SELECT unnest(range(0, 11)) AS pos, unnest([" + ", ".join(f"'{n}'" for n in J.REFERENCE_SECTORS) + "]) AS sector)",
    body="""SELECT portfolio, sector, rank FROM (SELECT a.portfolio, wanted.sector, row_number() OVER (PARTITION BY a.portfolio ORDER BY pos) AS rank
  FROM (SELECT DISTINCT portfolio FROM sw) a CROSS JOIN wanted LEFT JOIN sw ON sw.portfolio = a.portfolio AND sw.sector = wanted.sector WHERE coalesce(sw.w, 0) < 0.05) WHERE rank <= 5"""))
def missing_sectors(spark, sf_dir):
    sup = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), F.get(F.array(*[F.lit(n) for n in NAMES]), F.col("s_nationkey") % 10).alias("sector"))
    sw = T.portfolio_weights(spark, sf_dir).join(sup, "symbol").groupBy("portfolio", "sector").agg(F.sum("w").alias("w"))
    return J.missing_sectors(sw)
