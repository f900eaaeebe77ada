"""Streaming queries: they run over the events as a stream and return what the sink stored."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quantloom.plans import query
from quantloom.plans.kit import ASSET, HOLDINGS, META, pick, result, rnd, rounded, with_
from quantloom.plans.metrics import SECTOR_W, sector_portfolios
from quantloom.plans.risk import SP, risk_rows, simple
from quantloom.streaming import bars as SB, monitor as SM
from quantloom.session import checkpointed
from quantloom.sources import tables as T


def ticks(spark, sf_dir):
    return SB.event_stream(spark, sf_dir).select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"))


BAR = ["open", "high", "low", "close", "volume"]
BARS = """SELECT event_type AS symbol, {start} AS ts, first(value ORDER BY events.ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY events.ts, event_id) AS close, count(*) AS volume FROM events{extra} GROUP BY 1, 2"""


@query("stream_tumbling_bars", f"WITH final AS (SELECT * FROM ({BARS.format(start='''date_trunc('hour', events.ts)''', extra='')})) " + pick(BAR, 4, base="hourly"))
def stream_tumbling_bars(spark, sf_dir):
    return result(SB.newest(SB.run_available(SB.window_bars(ticks(spark, sf_dir)), "update"), ["symbol", "ts"]), BAR, 4, base="hourly")


@query("stream_sliding_bars", f"WITH final AS (SELECT * FROM ({BARS.format(start='''date_trunc('hour', events.ts) - k * INTERVAL 1 HOUR''', extra=', range(0, 4) r(k)')})) " + pick(BAR, 4, base="hourly"))
def stream_sliding_bars(spark, sf_dir):
    return result(SB.newest(SB.run_available(SB.window_bars(ticks(spark, sf_dir), "4 hours", "1 hour"), "update"), ["symbol", "ts"]), BAR, 4, base="hourly")


@query("stream_sessions", """SELECT symbol, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY symbol ORDER BY ts) AS s FROM (SELECT event_type AS symbol, ts,
  CASE WHEN ts < lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY symbol, s""")
def stream_sessions(spark, sf_dir):
    s = SB.last_batch(SB.run_available(SB.session_counts(ticks(spark, sf_dir)), "complete"))      # session windows have no update mode
    return s.select("symbol", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("stream_dedupe", "SELECT event_type AS symbol, count(*) AS n FROM events GROUP BY 1")
def stream_dedupe(spark, sf_dir):
    twice = ticks(spark, sf_dir).unionByName(ticks(spark, sf_dir))
    return SB.run_available(SB.without_repeats(twice, ["event_id"], "60 days")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("repeated_signals", "SELECT l_suppkey AS symbol, l_returnflag AS kind, strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1")
def repeated_signals(spark, sf_dir):
    sig = T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_returnflag").alias("kind"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return SB.repeated_rows(sig, ["symbol", "kind", "day"])


@query("stream_ab_moments", f"SELECT test, count(*) FILTER (a) AS n_A, count(*) FILTER (NOT a) AS n_B, {rnd('avg(v) FILTER (a) - avg(v) FILTER (NOT a)', 4, 'difference')} FROM (SELECT event_type AS test, user_id % 2 = 0 AS a, value AS v FROM events) GROUP BY 1")
def stream_ab_moments(spark, sf_dir):
    scores = SB.event_stream(spark, sf_dir).select(F.col("event_type").alias("test"), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("arm"), F.col("value").alias("score"))
    m = SB.last_batch(SB.run_available(SB.running_moments(scores), "complete"))
    return SB.test_from_moments(m).select("test", "n_A", "n_B", rounded("difference", 4).alias("difference"))


LIMITS = [("click", 100.0, "medium", True), ("error", 200.0, "high", True), ("view", 10.0, "low", False)]


def limit_table(spark, rows=LIMITS):
    return spark.createDataFrame(rows, "limit_type string, threshold double, severity string, enabled boolean")


@query("stream_limit_breaches", "SELECT user_id AS portfolio, event_type AS limit_type, value, CASE event_type WHEN 'click' THEN 100.0::DOUBLE ELSE 200.0::DOUBLE END AS threshold, CASE event_type WHEN 'click' THEN 'medium' ELSE 'high' END AS severity FROM events WHERE (event_type = 'click' AND value > 100) OR (event_type = 'error' AND value > 200)")
def stream_limit_breaches(spark, sf_dir):
    m = SB.event_stream(spark, sf_dir).select(F.col("user_id").alias("portfolio"), F.col("event_type").alias("limit_type"), "ts", "value")
    return SB.run_available(SM.limit_breaches(m, limit_table(spark))).select("portfolio", "limit_type", "value", "threshold", "severity")


RULES = [("max_weight", 0.25, "medium", True), ("max_sector", 0.6, "high", True), ("leverage", 1.5, "high", True), ("var_95", 0.04, "high", True), ("volatility", 0.3, "medium", True), ("max_drawdown", 0.3, "high", True)]
VALS = {"max_weight": "mw", "max_sector": "ms", "leverage": "lv", "var_95": "-var_95", "volatility": "volatility", "max_drawdown": "abs(max_drawdown)"}
simple("limit_breaches", with_(*SP, "mm AS (SELECT portfolio, max(w) AS mw, sum(abs(w)) AS lv FROM sw GROUP BY 1)", "ms AS (SELECT portfolio, max(s) AS ms FROM (SELECT portfolio, symbol % 3 AS g, sum(w) AS s FROM sw GROUP BY 1, 2) GROUP BY 1)", "j AS (SELECT * FROM mm JOIN ms USING (portfolio) JOIN rk0 USING (portfolio))",
    "f AS (" + " UNION ALL ".join(f"SELECT portfolio, '{n}' AS limit_type, '{s}' AS severity, {VALS[n]} AS value FROM j WHERE {VALS[n]} > {t}" for n, t, s, _ in RULES) + ")", body=pick(["value"], 5, keys=("portfolio", "limit_type", "severity"), ts=None, source="f")), ["value"], 5,
    lambda s, d: SM.limit_breaches(SM.portfolio_metrics(checkpointed(sector_portfolios(s, d)).withColumn("sector", F.col("symbol") % 3), risk_rows(s, d).withColumn("var_95", -F.col("var_95"))).withColumn("ts", F.lit(None).cast("timestamp")), limit_table(s, RULES)), ("portfolio", "limit_type", "severity"))


def actions(df):
    act = F.when(F.col("event_type") == "error", "open").when(F.col("event_type") == "view", "ack").when(F.col("event_type") == "purchase", "clear")
    return df.select(F.col("user_id").alias("alert"), "ts", F.col("event_id").alias("seq"), act.alias("action")).where("action is not null")


ALERTS = """WITH a AS (SELECT user_id AS alert, (ts, event_id) AS o, CASE event_type WHEN 'error' THEN 'open' WHEN 'view' THEN 'ack' ELSE 'clear' END AS act FROM events WHERE event_type IN ('error', 'view', 'purchase')),
l AS (SELECT alert, max(o) FILTER (act = 'open') AS op, count(*) AS actions FROM a GROUP BY 1)
SELECT l.alert, CASE WHEN any_value(op) IS NULL THEN 'none' WHEN count(*) FILTER (act = 'clear' AND o > op) > 0 THEN 'cleared' WHEN count(*) FILTER (act = 'ack' AND o > op) > 0 THEN 'acknowledged' ELSE 'active' END AS state, any_value(actions) AS actions FROM l JOIN a ON a.alert = l.alert GROUP BY l.alert"""


@query("stream_alert_states", ALERTS)
def stream_alert_states(spark, sf_dir):
    rows = SB.run_available(SM.alert_states(actions(SB.event_stream(spark, sf_dir))), "update")
    last = rows.groupBy("alert").agg(F.max_by(F.struct("state", "actions"), "b").alias("s"))
    return last.select("alert", "s.state", "s.actions")


@query("alert_states", ALERTS)
def alert_states(spark, sf_dir):
    return SM.alert_states_batch(actions(T.table(spark, sf_dir, "events")))


WEIGHTS = """WITH e AS (SELECT event_type AS ensemble, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY event_type) AS n,
  1 / (avg(pow(value - 20, 2)) OVER r + 1e-8) AS a, 1 / (avg(pow(value - 50, 2)) OVER r + 1e-8) AS b, 1 / (avg(pow(value - 120, 2)) OVER r + 1e-8) AS c FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id), r AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 99 PRECEDING)),
f AS (SELECT ensemble, i, n, greatest(a / (a + b + c), 0.01) AS a, greatest(b / (a + b + c), 0.01) AS b, greatest(c / (a + b + c), 0.01) AS c FROM e),
m AS (SELECT ensemble, n, i, unnest(['low', 'mid', 'high']) AS model, unnest([a, b, c]) / (a + b + c) AS x FROM f),
s AS (SELECT ensemble, model, any_value(n) AS updates, pow(0.9, any_value(n)) / 3 + 0.1 * sum(pow(0.9, n - i) * x) AS w FROM m GROUP BY 1, 2)
SELECT ensemble, model, updates, """ + rnd("w", 6, "w") + " FROM s"


@query("stream_model_weights", WEIGHTS)
def stream_model_weights(spark, sf_dir):
    e = lambda c: F.pow(F.col("value") - c, 2)
    errors = SB.event_stream(spark, sf_dir).select(F.col("event_type").alias("ensemble"), "ts", F.col("event_id").alias("seq"), e(20.0).alias("low"), e(50.0).alias("mid"), e(120.0).alias("high"))
    rows = SB.run_available(SM.online_weights(errors, ["low", "mid", "high"]), "update")
    last = rows.groupBy("ensemble", "model").agg(F.max_by(F.struct("w", "updates"), "b").alias("s"))
    return last.select("ensemble", "model", rounded("s.w", 6).alias("w"), "s.updates")
