"""Catalog, versions, audit, lineage, model registry and user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quantloom.operators import features as FT, quality as Q, user as US
from quantloom.operators.indicators import compute, indicator
from quantloom.plans import query
from quantloom.plans.kit import DAILY, ASSET, W, pick, result, rnd, roll, rounded, steps, with_
from quantloom.sources import datasets as DS, files, tables as T

CAT = """cat AS (SELECT CAST(l_suppkey AS VARCHAR) || '_' || l_returnflag AS dataset_id, l_returnflag AS format, max(l_linestatus) AS codec, CAST(sum(l_quantity) AS BIGINT) AS bytes, min(l_shipdate) AS created_at FROM lineitem GROUP BY l_suppkey, l_returnflag)"""


def catalog(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat_ws("_", F.col("l_suppkey").cast("string"), "l_returnflag").alias("dataset_id"), F.col("l_returnflag").alias("format")).agg(
        F.max("l_linestatus").alias("codec"), F.sum("l_quantity").cast("long").alias("bytes"), F.min("l_shipdate").alias("created_at"))


@query("catalog_entry", "SELECT 'orders' AS dataset_id, count(*) AS rows, CAST(6 AS BIGINT) AS columns, 'parquet' AS format, 'bigint' AS key_type, 'sales' AS owner FROM orders")
def catalog_entry(spark, sf_dir):
    d = DS.describe_dataset(T.table(spark, sf_dir, "orders"), "orders", tags={"owner": "sales"})
    return d.select("dataset_id", "rows", "columns", "format", F.col("schema")["o_orderkey"].alias("key_type"), F.col("tags")["owner"].alias("owner"))


@query("storage_stats", f"WITH {CAT} SELECT coalesce(format, 'all') AS format, coalesce(codec, 'all') AS codec, count(*) AS datasets, CAST(sum(bytes) AS BIGINT) AS bytes, arg_min(dataset_id, (created_at, dataset_id)) AS oldest, arg_max(dataset_id, (created_at, dataset_id)) AS newest FROM cat GROUP BY GROUPING SETS ((), (format), (codec))")
def storage_stats(spark, sf_dir):
    return DS.storage_stats(catalog(spark, sf_dir)).fillna("all", ["format", "codec"])


@query("expired_datasets", f"WITH {CAT} SELECT dataset_id, strftime(created_at, '%Y-%m-%d') AS day FROM cat WHERE created_at < TIMESTAMP '1995-03-01' - INTERVAL 30 DAY")
def expired_datasets(spark, sf_dir):
    return DS.expired_datasets(catalog(spark, sf_dir), "1995-03-01", 30).select("dataset_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


VER = "ver AS (SELECT o_custkey AS dataset_id, o_orderkey AS version_number, o_orderdate AS created_at FROM orders)"


@query("expired_versions", f"WITH {VER} SELECT dataset_id, version_number FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, version_number DESC) AS k FROM ver) WHERE k > 5 AND created_at < TIMESTAMP '2000-01-01' - INTERVAL 30 DAY")
def expired_versions(spark, sf_dir):
    v = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("version_number"), F.col("o_orderdate").alias("created_at"))
    return DS.expired_versions(v, "2000-01-01", 5, 30).select("dataset_id", "version_number")


def two_versions(spark, sf_dir):
    old = T.daily_bars(spark, sf_dir).select("symbol", "ts", "close", "volume")
    v = F.col("volume")
    new = old.where(v % 23 != 0).withColumn("close", F.when(v % 10 == 0, F.col("close") + 1).otherwise(F.col("close")))
    extra = old.where(v % 50 == 0).withColumn("symbol", -F.col("symbol") - 1)
    return old, new.unionByName(extra)


TWO = """nv AS (SELECT symbol, ts, CASE WHEN volume % 10 = 0 THEN close + 1 ELSE close END AS close, volume FROM daily WHERE volume % 23 <> 0 UNION ALL SELECT -symbol - 1, ts, close, volume FROM daily WHERE volume % 50 = 0)"""


@query("version_store", with_(DAILY, TWO, body="""SELECT 1 AS version_number, 'bars_v1' AS version_id, NULL AS parent_id, 'CREATE' AS change_type, (SELECT count(*) FROM daily) AS row_count, CAST(4 AS BIGINT) AS column_count
  UNION ALL SELECT 2, 'bars_v2', 'bars_v1', 'UPDATE', (SELECT count(*) FROM nv), 4"""))
def version_store(spark, sf_dir):
    store = DS.VersionStore(spark, files.shared_folder(spark))
    old, new = two_versions(spark, sf_dir)
    store.write("bars", old, "loader", "CREATE", "2024-01-01 00:00:00", ["raw"])
    store.write("bars", new, "loader", "UPDATE", "2024-01-02 00:00:00", ["raw"])
    return store.list("bars").select("version_number", "version_id", "parent_id", "change_type", "row_count", "column_count")


@query("version_diff", with_(DAILY, TWO, body="""SELECT count(o.symbol) AS rows_old, count(n.symbol) AS rows_new, count(*) FILTER (o.symbol IS NULL) AS added_rows, count(*) FILTER (n.symbol IS NULL) AS removed_rows,
  count(*) FILTER (o.close IS DISTINCT FROM n.close AND o.symbol IS NOT NULL AND n.symbol IS NOT NULL) AS changed_rows, count(*) FILTER (o.close IS DISTINCT FROM n.close AND o.symbol IS NOT NULL AND n.symbol IS NOT NULL) AS changed_cells
  FROM daily o FULL JOIN nv n ON o.symbol = n.symbol AND o.ts = n.ts"""))
def version_diff(spark, sf_dir):
    return DS.version_diff(*two_versions(spark, sf_dir), ["symbol", "ts"])


@query("keyless_diff", with_(DAILY, TWO, body="SELECT (SELECT count(*) FROM (SELECT symbol, ts, close, volume FROM nv EXCEPT ALL SELECT symbol, ts, close, volume FROM daily)) AS only_new, (SELECT count(*) FROM (SELECT symbol, ts, close, volume FROM daily EXCEPT ALL SELECT symbol, ts, close, volume FROM nv)) AS only_old"))
def keyless_diff(spark, sf_dir):
    return DS.keyless_diff(*two_versions(spark, sf_dir))


@query("schema_diff", """WITH a AS (SELECT column_name AS name, column_type AS t FROM (DESCRIBE SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem)), b AS (SELECT column_name AS name, column_type AS t FROM (DESCRIBE SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_tax FROM lineitem))
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.name = b.name WHERE a.t IS DISTINCT FROM b.t""")
def schema_diff(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem")
    return DS.schema_diff(spark, li.select("l_orderkey", "l_linenumber", "l_quantity"), li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_tax")).select("name", "change")


@query("content_checksum", "SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_returnflag)), 1, 15) AS BIGINT)) AS VARCHAR) AS checksum FROM lineitem")
def content_checksum(spark, sf_dir):
    return DS.content_checksum(T.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"], "md5")


@query("schema_checksum", "SELECT md5('n_name:string,n_nationkey:int,n_regionkey:int') AS checksum, count(*) AS rows FROM nation")
def schema_checksum(spark, sf_dir):
    n = T.table(spark, sf_dir, "nation")
    return n.agg(F.count(F.lit(1)).alias("rows")).select(DS.schema_checksum(n).alias("checksum"), "rows")


@query("audit_trail", "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 5")
def audit_trail(spark, sf_dir):
    a = T.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("dataset_id"), "user_id", "ts")
    return DS.audit_trail(a, dataset_id="click", start="2024-01-05", end="2024-01-20", limit=50, offset=5).select("event_id", "user_id")


@query("lineage_edges", "SELECT DISTINCT dataset, direction, other FROM (SELECT l_suppkey AS dataset, 'upstream' AS direction, l_partkey AS other FROM lineitem UNION ALL SELECT l_partkey, 'downstream', l_suppkey FROM lineitem)")
def lineage_edges(spark, sf_dir):
    e = T.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("upstream"), F.col("l_suppkey").alias("downstream"), F.lit("ships").alias("transformation"))
    return DS.lineage_edges(e).select("dataset", "direction", "other")


@query("registered_models", "SELECT name, version, price FROM (SELECT p_brand AS name, lpad(CAST(p_size AS VARCHAR), 3, '0') || '.' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS version, p_retailprice AS price, row_number() OVER (PARTITION BY p_brand ORDER BY lpad(CAST(p_size AS VARCHAR), 3, '0') || '.' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') DESC) AS k FROM part WHERE contains(p_brand, '#1')) WHERE k = 1")
def registered_models(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    m = p.select(F.col("p_brand").alias("name"), F.concat_ws(".", F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("version"), F.col("p_retailprice").alias("price"))
    return DS.registered_models(m, contains="#1").select("name", "version", "price")


# ---- user functions --------------------------------------------------------------------------------------------------
@indicator("MidPoint", needs=("high", "low"), period=5)
def mid_point(s, period):
    """Example of a user indicator: middle of the recent range."""
    return {"mid_point": (s.roll(F.max, period, "high") + s.roll(F.min, period, "low")) / 2}


@query("user_indicator", with_(DAILY, steps("daily", [("hh", roll("max", "high", 5)), ("ll", roll("min", "low", 5)), ("mid_point", "(hh + ll) / 2")]), body=pick(["mid_point"], 4)))
def user_indicator(spark, sf_dir):
    return result(compute(T.daily_bars(spark, sf_dir), "MidPoint"), ["mid_point"], 4)


@query("user_quality_rule", "SELECT 'all' AS entity, 'large_volume' AS rule, count(*)::DOUBLE AS value FROM (SELECT sum(l_quantity) AS v FROM lineitem GROUP BY l_suppkey, l_shipdate) WHERE v > 100 HAVING count(*) > 0")
def user_quality_rule(spark, sf_dir):
    def large_volume(df):
        n = df.agg(F.count_if(F.col("volume") > 100).alias("n"))
        return n.where("n > 0").select(*Q.finding("all", "large_volume", "info", "volume", F.col("n"), 100))
    return Q.run_rules(T.daily_bars(spark, sf_dir), [Q.Rule("large_volume", large_volume)]).select("entity", "rule", "value")


@query("user_group_function", with_(ASSET, "f AS (SELECT symbol, max(ret) - min(ret) AS span FROM asset GROUP BY 1)", body=pick(["span"], 6, ts=None, source="f")))
def user_group_function(spark, sf_dir):
    out = US.map_groups(T.asset_returns(spark, sf_dir), "symbol", lambda p: pd.DataFrame({"symbol": p.symbol.head(1), "span": [p.ret.max() - p.ret.min()]}), "symbol long, span double")
    return result(out, ["span"], 6, ts=None)


@query("user_aggregate", with_(ASSET, "f AS (SELECT symbol, sqrt(avg(ret * ret)) AS rms FROM asset GROUP BY 1)", body=pick(["rms"], 6, ts=None, source="f")))
def user_aggregate(spark, sf_dir):
    rms = US.aggregate_function(lambda x: float((x * x).mean() ** 0.5))
    return result(T.asset_returns(spark, sf_dir).groupBy("symbol").agg(rms("ret").alias("rms")), ["rms"], 6, ts=None)


class TickSpread(US.Aggregate):
    """Deviation of prices weighted by quantity, from mergeable weights, means and squared deviations."""

    def start(self):
        return 0.0, 0.0, 0.0

    def add(self, state, rows):
        w, x = rows["quantity"].to_numpy(float), rows["price"].to_numpy(float)
        total = w.sum()
        mean = (w * x).sum() / total
        return self.merge(state, (total, mean, (w * (x - mean) ** 2).sum()))

    def merge(self, a, b):
        total = a[0] + b[0]
        if not total:
            return a
        return total, (a[0] * a[1] + b[0] * b[1]) / total, a[2] + b[2] + (a[1] - b[1]) ** 2 * a[0] * b[0] / total

    def finish(self, state):
        return (state[2] / state[0]) ** 0.5 if state[0] else None


@query("user_partial_aggregate", with_("t AS (SELECT l_suppkey AS symbol, l_returnflag AS flag, l_quantity AS q, l_extendedprice / l_quantity AS p FROM lineitem)",
    "m AS (SELECT *, sum(q * p) OVER (PARTITION BY symbol, flag) / sum(q) OVER (PARTITION BY symbol, flag) AS m FROM t)", "f AS (SELECT symbol, flag, sqrt(sum(q * (p - m) * (p - m)) / sum(q)) AS spread FROM m GROUP BY 1, 2)",
    body=pick(["spread"], 4, keys=("symbol", "flag"), ts=None, source="f")))
def user_partial_aggregate(spark, sf_dir):
    ticks = T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return result(US.partial_aggregate(ticks, ["symbol", "flag"], ["quantity", "price"], TickSpread(), "spread"), ["spread"], 4, keys=("symbol", "flag"), ts=None)


@query("parameter_search", with_(ASSET, "f AS (SELECT unnest([0.0, 0.01, 0.02]) AS level, symbol, ret FROM asset)", "g AS (SELECT level, symbol, CASE WHEN level = 0.02 THEN NULL ELSE avg(ret) - level END AS score FROM f GROUP BY 1, 2)", "h AS (SELECT level::DOUBLE AS level, symbol, coalesce(score, -1e9) AS score FROM g)",
    body=pick(["level", "score"], 6, ts=None, source="h")))
def parameter_search(spark, sf_dir):
    def objective(pdf, level):
        if level == 0.02:
            raise ValueError("refused")
        return pdf.ret.mean() - level
    out = US.search_parameters(T.asset_returns(spark, sf_dir), "symbol", "level", [0.0, 0.01, 0.02], objective)
    return result(out.withColumn("score", F.greatest("score", F.lit(-1e9))), ["level", "score"], 6, ts=None)
