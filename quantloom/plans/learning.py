"""Feature selection, scaling, folds, models, ensembles, prediction metrics, drift and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import drift as D, learning as L, neighbours as NE, search as SE, selection as SL, uncertainty as UC
from quantloom.operators.series import Series
from quantloom.plans import query
from quantloom.plans.indicators import RET
from quantloom.plans.kit import (ASSET, DAILY, MARKET, B, O, U, W, dv, integer_draws, lag, pct, pick, result, rnd, roll, rounded, steps, with_)
from quantloom.plans.metrics import student
from quantloom.plans.risk import NORMAL_TAIL, simple
from quantloom.session import checkpointed
from quantloom.sources import tables as T

# features and target of each asset day: previous returns and means against the return of the day
FEAT = ["l1", "l2", "m5", "m20"]
FQ = (ASSET, steps("asset", [("l1", lag("ret")), ("l2", lag("ret", 2)), ("m5", f"round(avg(ret) OVER {B(-5, -1)}, 10)"), ("m20", f"CASE WHEN rn > 20 THEN round(avg(ret) OVER {B(-20, -1)}, 10) END")], prefix="x"), "fe AS (SELECT symbol, ts, ret, l1, l2, m5, m20 FROM xfinal WHERE m20 IS NOT NULL)")


def features(spark, sf_dir):
    s = Series(T.asset_returns(spark, sf_dir))
    out = {"l1": s.lag("ret"), "l2": s.lag("ret", 2), "m5": F.round(s.over(F.avg("ret"), -5, -1), 10), "m20": F.when(s.row > 20, F.round(s.over(F.avg("ret"), -20, -1), 10))}
    return s.frame(out).where("m20 is not null")


KF = ("feature",)
simple("f_score_selection", with_(*FQ, "f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, (count(*) - 2) * pow(corr({c}, ret), 2) / (1 - pow(corr({c}, ret), 2)) AS f FROM fe" for c in FEAT) + ")", body=pick(["f"], 4, keys=KF, ts=None, source="f") + " ORDER BY f DESC LIMIT 3"),
       ["f"], 4, lambda s, d: SL.top_features(SL.f_scores(features(s, d), FEAT, "ret"), "f", 3), KF)
BINS = lambda c: f"least(CAST(floor(({c} - (SELECT min({c}) FROM fe)) / ((SELECT max({c}) FROM fe) - (SELECT min({c}) FROM fe)) * 10) AS BIGINT), 9)"
simple("mutual_information", with_(*FQ, "b AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {BINS(c)} AS x, {BINS('ret')} AS y FROM fe" for c in FEAT) + ")", "n AS (SELECT feature, x, y, count(*) AS n FROM b GROUP BY 1, 2, 3)",
    "f AS (SELECT feature, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS t FROM n) GROUP BY 1)", body=pick(["mi"], 5, keys=KF, ts=None, source="f")),
    ["mi"], 5, lambda s, d: SL.mutual_information(features(s, d), FEAT, "ret"), KF)
simple("variance_filter", with_(*FQ, "f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({c} * 100) AS variance FROM fe" for c in FEAT) + ")", body=pick(["variance"], 5, keys=KF, ts=None, source="f") + " WHERE variance > 0.01 ORDER BY variance DESC LIMIT 3"),
    ["variance"], 5, lambda s, d: SL.variance_filter(features(s, d).select(*[(F.col(c) * 100).alias(c) for c in FEAT]), FEAT, 3), KF)


MARKET_FEAT = ["l1", "l2", "m5"]


def market_features(spark, sf_dir):
    """The market's day and what came before it; a row for each day."""
    d = T.market_returns(spark, sf_dir).withColumn("symbol", F.lit(0))
    s = Series(d)
    return s.frame({"l1": s.lag("bench"), "l2": s.lag("bench", 2), "m5": F.when(s.row > 5, F.round(s.over(F.avg("bench"), -5, -1), 10))}).where("m5 is not null")


simple("neighbour_information", with_(MARKET, f"mk AS (SELECT *, 0 AS symbol FROM market)", steps("mk", [("l1", lag("bench")), ("l2", lag("bench", 2)), ("m5", f"CASE WHEN rn > 5 THEN round(avg(bench) OVER {B(-5, -1)}, 10) END")], prefix="x"),
    "lg AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, rn, {c} AS x, bench AS y FROM xfinal WHERE m5 IS NOT NULL" for c in MARKET_FEAT) + ")",
    "un AS MATERIALIZED (SELECT feature, rn, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x, (y - avg(y) OVER w) / stddev_pop(y) OVER w AS y FROM lg WINDOW w AS (PARTITION BY feature))",
    "kd AS MATERIALIZED (SELECT a.feature, a.rn, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3)[3] AS r FROM un a JOIN un b ON a.feature = b.feature AND a.rn <> b.rn GROUP BY 1, 2)",
    """nn AS (SELECT a.feature, a.rn, count(*) FILTER (CASE WHEN r > 0 THEN abs(a.x - b.x) < r * (1 - 1e-10) ELSE a.x = b.x END) AS nx, count(*) FILTER (CASE WHEN r > 0 THEN abs(a.y - b.y) < r * (1 - 1e-10) ELSE a.y = b.y END) AS ny
  FROM un a JOIN kd ON kd.feature = a.feature AND kd.rn = a.rn JOIN un b ON a.feature = b.feature AND a.rn <> b.rn GROUP BY 1, 2)""",
    "hm AS (SELECT 0 AS i, 0.0::DOUBLE AS h UNION ALL SELECT i, sum(1.0::DOUBLE / i) OVER (ORDER BY i) FROM range(1, (SELECT count(*) + 2 FROM market)) t(i))",
    "f AS (SELECT feature, greatest(0, any_value(hn.h) + 1.5 - 0.5772156649015329 * 2 - avg(hx.h + hy.h - 2 * 0.5772156649015329)) AS mi, count(*) AS n FROM nn JOIN hm hx ON hx.i = nx JOIN hm hy ON hy.i = ny JOIN (SELECT feature AS g, count(*) - 1 AS m FROM un GROUP BY 1) c ON g = feature JOIN hm hn ON hn.i = m GROUP BY 1)",
    body=pick(["mi"], 6, keys=("feature", "n"), ts=None, source="f")), ["mi"], 6, lambda s, d: NE.neighbour_information(market_features(s, d), MARKET_FEAT, "bench"), ("feature", "n"))
simple("neighbour_information_assets", None, ["mi"], 6, lambda s, d: NE.neighbour_information(features(s, d), FEAT, "ret"), ("feature", "n"))


@query("correlation_filter", with_(*FQ, body="SELECT feature FROM (VALUES ('l1', 1.0::DOUBLE), ('l2', 1.0), ('m5', (SELECT greatest(abs(corr(l1, m5)), abs(corr(l2, m5))) FROM fe)), ('m20', (SELECT greatest(abs(corr(l1, m20)), abs(corr(l2, m20)), abs(corr(m5, m20))) FROM fe))) t(feature, c) WHERE feature IN ('l1', 'l2') OR c <= 0.42"))
def correlation_filter(spark, sf_dir):
    return SL.correlation_filter(features(spark, sf_dir), FEAT, 0.42)


simple("forest_importance", None, ["importance"], 6, lambda s, d: SL.forest_importance(features(s, d), FEAT, "ret"), KF)
simple("correlation_importance", with_(*FQ, "f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, ret)) AS importance FROM fe" for c in FEAT) + ")", body=pick(["importance"], 6, keys=KF, ts=None, source="f")), ["importance"], 6, lambda s, d: SL.correlation_importance(features(s, d), FEAT, "ret"), KF)


@query("recursive_elimination")
def recursive_elimination(spark, sf_dir):
    left = SL.recursive_elimination(features(spark, sf_dir), FEAT, "ret", 2)
    return spark.createDataFrame([(c,) for c in left], "feature string")


simple("principal_components", None, ["pc_1", "pc_2"], 4, lambda s, d: SL.principal_components(features(s, d), FEAT, 2, ["symbol", "ts"]).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ("symbol", "day"))
simple("factor_analysis", None, ["loading", "uniqueness"], 4, lambda s, d: SL.factor_analysis(features(s, d), FEAT, 1), ("feature", "factor"))

# ---- scaling -----------------------------------------------------------------------------------------------------------
SC = {"standard": ("(v - avg(v) OVER ()) / stddev_pop(v) OVER ()", "avg(volume)", "stddev_samp(volume)"), "minmax": ("(v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ())", "avg(volume)", "stddev_samp(volume)"),
      "robust": ("(v - (SELECT median(v) FROM x)) / (SELECT quantile_cont(v, 0.75) - quantile_cont(v, 0.25) FROM x)", "median(volume)", "(SELECT median(abs(volume - (SELECT median(volume) FROM daily))) FROM daily)")}
for _m, (_e, _c, _s) in SC.items():
    simple(f"scale_{_m}", with_(DAILY, f"b AS (SELECT {_c} AS c, {_s} AS s FROM daily)", "x AS (SELECT symbol, ts, CASE WHEN volume BETWEEN c - 3 * s AND c + 3 * s THEN volume END AS v FROM daily, b)", f"f AS (SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, {_e} AS volume_scaled FROM x)",
        body=pick(["volume_scaled"], 6, keys=("symbol", "day"), ts=None, source="f")), ["volume_scaled"], 6, lambda s, d, m=_m: L.scaled(T.daily_bars(s, d).select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day"), "volume"), "volume", m), ("symbol", "day"))
simple("scale_returns", with_(ASSET, "f AS (SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, (rank() OVER (ORDER BY ret) + (count(*) OVER (PARTITION BY ret) - 1) / 2.0) / count(*) OVER () AS ret_scaled FROM asset)", body=pick(["ret_scaled"], 6, keys=("symbol", "day"), ts=None, source="f")),
    ["ret_scaled"], 6, lambda s, d: L.scaled(T.asset_returns(s, d).select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ret"), "ret", "returns"), ("symbol", "day"))

PPC = {"volume": "volume", "volume_lag_1": lag("volume"), "volume_rolling_mean_5": roll("avg", "volume", 5), "volume_diff": f"volume - {lag('volume')}"}
NXT = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("preprocess", with_(DAILY, "raw AS (SELECT symbol, ts, " + ", ".join(f"{e} AS {'v_' + c}" for c, e in PPC.items()) + " FROM daily)",
    "fl AS (SELECT symbol, ts, " + ", ".join(f"coalesce(last_value(v_{c} IGNORE NULLS) OVER {U()}, first_value(v_{c} IGNORE NULLS) OVER {NXT}) AS f_{c}" for c in PPC) + " FROM raw)",
    "fin AS (SELECT symbol, ts, " + ", ".join(f"(f_{c} - avg(f_{c}) OVER ()) / stddev_pop(f_{c}) OVER () AS {c}" for c in PPC) + " FROM fl)", body=pick(list(PPC), 5, source="fin")))
def preprocess(spark, sf_dir):
    return result(L.preprocess(T.daily_bars(spark, sf_dir).select("symbol", "ts", "volume"), ["volume"]), list(PPC), 5)


# ---- folds ---------------------------------------------------------------------------------------------------------------
NB = "nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM asset)"
FOLD_OUT = "SELECT symbol, fold, side, count(*) AS rows, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM ({}) GROUP BY ALL"


def fold_query(name, sql, make):
    @query(name, sql)
    def run(spark, sf_dir):
        return make(T.asset_returns(spark, sf_dir)).groupBy("symbol", "fold", "side").agg(
            F.count(F.lit(1)).alias("rows"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


def wf_sql(train):
    return with_(ASSET, NB, body=FOLD_OUT.format(f"""SELECT symbol, ts, f AS fold, CASE WHEN i >= 200 + f * 50 + 5 AND i < 200 + f * 50 + 55 THEN 'test' WHEN {train} THEN 'train' END AS side FROM nb, range(0, 30) t(f) WHERE 200 + f * 50 + 55 <= n""") .replace("GROUP BY ALL", "WHERE side IS NOT NULL GROUP BY ALL"))


fold_query("folds_walk_forward", wf_sql("i < 200 + f * 50 AND i >= f * 50"), lambda d: L.walk_forward_folds(d, 200, 50, 5))
fold_query("folds_expanding", wf_sql("i < 200 + f * 50"), lambda d: L.walk_forward_folds(d, 200, 50, 5, expanding=True))
fold_query("folds_time_series", with_(ASSET, NB, body=FOLD_OUT.format("SELECT symbol, ts, f AS fold, CASE WHEN i >= (f + 1) * (n // 6) AND i < (f + 2) * (n // 6) THEN 'test' WHEN i < (f + 1) * (n // 6) - 3 THEN 'train' END AS side FROM nb, range(0, 5) t(f)").replace("GROUP BY ALL", "WHERE side IS NOT NULL GROUP BY ALL")),
           lambda d: L.time_series_folds(d, 5, 3))
fold_query("folds_purged", with_(ASSET, "sp AS (SELECT *, epoch_us(min(ts) OVER (PARTITION BY symbol)) AS a, epoch_us(max(ts) OVER (PARTITION BY symbol)) AS z, epoch_us(ts) AS t FROM asset)",
    body=FOLD_OUT.format("SELECT symbol, ts, f AS fold, CASE WHEN t >= a + (f + 1) * ((z - a) / 6) AND t < a + (f + 1) * ((z - a) / 6) + (z - a) / 6 THEN 'test' WHEN t < a + (f + 1) * ((z - a) / 6) - 10 * 86400000000.0 THEN 'train' END AS side FROM sp, range(0, 5) r(f)").replace("GROUP BY ALL", "WHERE side IS NOT NULL GROUP BY ALL")),
    lambda d: L.purged_folds(d, 5, 10))
fold_query("folds_blocking", with_(ASSET, NB, body=FOLD_OUT.format("SELECT symbol, ts, f AS fold, CASE WHEN i >= (f + 1) * (n // 6) AND i < least((f + 1) * (n // 6) + 40, n) THEN 'test' WHEN i < (f + 1) * (n // 6) - 10 AND i % 50 < 40 THEN 'train' END AS side FROM nb, range(0, 5) t(f)").replace("GROUP BY ALL", "WHERE side IS NOT NULL GROUP BY ALL")),
           lambda d: L.blocking_folds(d, 5, 40, 10))

CVQ = """fo AS (SELECT fe.*, f AS fold, CASE WHEN i >= (f + 1) * (n // 5) AND i < (f + 2) * (n // 5) THEN 'test' WHEN i < (f + 1) * (n // 5) THEN 'train' END AS side FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM fe) fe, range(0, 4) t(f)),
ft AS (SELECT symbol, fold, avg(ret) AS m, avg(l1) AS m1, avg(m5) AS m2, var_pop(l1) AS a, covar_pop(l1, m5) AS b, var_pop(m5) AS c, covar_pop(l1, ret) AS p, covar_pop(m5, ret) AS q FROM fo WHERE side = 'train' GROUP BY 1, 2),
pr AS (SELECT fo.symbol, fo.fold, ret AS y, m + (c * p - b * q) / (a * c - b * b) * (l1 - m1) + (a * q - b * p) / (a * c - b * b) * (m5 - m2) AS e FROM fo JOIN ft ON ft.symbol = fo.symbol AND ft.fold = fo.fold AND side = 'test'),
cv AS (SELECT symbol, fold, count(*) AS n, avg(pow(y - e, 2)) AS mse, avg(abs(y - e)) AS mae, sqrt(avg(pow(y - e, 2))) AS rmse, 1 - avg(pow(y - e, 2)) / nullif(var_pop(y), 0) AS r2 FROM pr GROUP BY 1, 2)"""
CV = ["mse", "mae", "rmse", "r2"]
simple("cross_validation", with_(*FQ, CVQ, body=pick(CV, 5, keys=("symbol", "fold", "n"), ts=None, source="cv")), CV, 5, lambda s, d: L.cross_validate(L.time_series_folds(features(s, d), 4), ["l1", "m5"], "ret"), ("symbol", "fold", "n"))
PENALTIES = [0.0, 0.1, *L.random_parameters(0.01, 1.0, 2)]
simple("grid_search", with_(*FQ, CVQ.split("\nft AS")[0].rstrip(","), "g AS (SELECT unnest([" + ", ".join(f"{a!r}::DOUBLE" for a in PENALTIES) + "]) AS alpha)",
    "ft AS (SELECT alpha, symbol, fold, avg(ret) AS m, avg(l1) AS m1, avg(m5) AS m2, var_pop(l1) + alpha / count(*) AS a, covar_pop(l1, m5) AS b, var_pop(m5) + alpha / count(*) AS c, covar_pop(l1, ret) AS p, covar_pop(m5, ret) AS q FROM fo, g WHERE side = 'train' GROUP BY 1, 2, 3)",
    "pr AS (SELECT alpha, fo.symbol, fo.fold, ret AS y, m + (c * p - b * q) / (a * c - b * b) * (l1 - m1) + (a * q - b * p) / (a * c - b * b) * (m5 - m2) AS e FROM fo JOIN ft ON ft.symbol = fo.symbol AND ft.fold = fo.fold AND side = 'test')",
    "f AS (SELECT alpha, avg(mse) AS mse FROM (SELECT alpha, avg(pow(y - e, 2)) AS mse FROM pr GROUP BY alpha, symbol, fold) GROUP BY 1)", body=pick(["alpha", "mse"], 8, keys=(), ts=None, source="f")),
    ["alpha", "mse"], 8, lambda s, d: L.grid_search(L.time_series_folds(features(s, d), 4), ["l1", "m5"], "ret", PENALTIES), ())


# ---- models: trained on the rows before 1999, scored on the rest -----------------------------------------------------------
def scores_of(spark, sf_dir, kind, **p):
    d = features(spark, sf_dir).select("symbol", "ts", "l1", "m5", F.col("ret").alias("y_true"))
    if kind in L.TREES:
        d = checkpointed(d)
    pred = L.fit_predict(d.where(F.year("ts") < 1999), d.where(F.year("ts") >= 1999), ["l1", "m5"], "y_true", kind, **p)
    return L.regression_scores(pred)


def model_sql(reg):
    return with_(*FQ, f"ft AS (SELECT avg(ret) AS m, avg(l1) AS m1, avg(m5) AS m2, var_pop(l1) + {reg} AS a, covar_pop(l1, m5) AS b, var_pop(m5) + {reg} AS c, covar_pop(l1, ret) AS p, covar_pop(m5, ret) AS q FROM fe WHERE year(ts) < 1999)",
                 "pr AS (SELECT ret AS y, m + (c * p - b * q) / (a * c - b * b) * (l1 - m1) + (a * q - b * p) / (a * c - b * b) * (m5 - m2) AS e FROM fe, ft WHERE year(ts) >= 1999)",
                 "f AS (SELECT count(*) AS n, avg(pow(y - e, 2)) AS mse, avg(abs(y - e)) AS mae, sqrt(avg(pow(y - e, 2))) AS rmse, 1 - avg(pow(y - e, 2)) / var_pop(y) AS r2 FROM pr)", body=pick(CV, 6, keys=("n",), ts=None, source="f"))


simple("model_linear", model_sql("0"), CV, 6, lambda s, d: scores_of(s, d, "linear"), ("n",))
simple("model_ridge", model_sql("20.0 / count(*)"), CV, 6, lambda s, d: scores_of(s, d, "ridge", alpha=20.0), ("n",))
LASSO = 0.001       # MLlib's penalty of the absolute slopes
simple("model_lasso", with_(*FQ, f"ft AS (SELECT avg(ret) AS m, avg(l1) AS m1, avg(m5) AS m2, var_pop(l1) AS a, covar_pop(l1, m5) AS b, var_pop(m5) AS c, covar_pop(l1, ret) AS p, covar_pop(m5, ret) AS q, {LASSO} AS pen FROM fe WHERE year(ts) < 1999)",
    """pt AS (SELECT *, CASE WHEN s = 0 THEN 0 WHEN t = 0 THEN (p - s * pen) / a ELSE (c * (p - s * pen) - b * (q - t * pen)) / (a * c - b * b) END AS x,
  CASE WHEN t = 0 THEN 0 WHEN s = 0 THEN (q - t * pen) / c ELSE (a * (q - t * pen) - b * (p - s * pen)) / (a * c - b * b) END AS z FROM ft, (VALUES (-1), (0), (1)) o(s), (VALUES (-1), (0), (1)) r(t))""",
    "sl AS (SELECT any_value(m) AS m, any_value(m1) AS m1, any_value(m2) AS m2, arg_min(x, obj) AS x, arg_min(z, obj) AS z FROM (SELECT *, (a * x * x + 2 * b * x * z + c * z * z) / 2 - p * x - q * z + pen * (abs(x) + abs(z)) AS obj FROM pt))",
    "pr AS (SELECT ret AS y, m + x * (l1 - m1) + z * (m5 - m2) AS e FROM fe, sl WHERE year(ts) >= 1999)",
    "f AS (SELECT count(*) AS n, avg(pow(y - e, 2)) AS mse, avg(abs(y - e)) AS mae, sqrt(avg(pow(y - e, 2))) AS rmse, 1 - avg(pow(y - e, 2)) / var_pop(y) AS r2 FROM pr)", body=pick(CV, 6, keys=("n",), ts=None, source="f")),
    CV, 6, lambda s, d: scores_of(s, d, "lasso"), ("n",))
for _k in ("random_forest", "gradient_boosting"):
    simple(f"model_{_k}", None, CV, 6, lambda s, d, k=_k: scores_of(s, d, k), ("n",))

# ---- ensembles --------------------------------------------------------------------------------------------------------------
LONG = "lg AS (SELECT symbol, ts, 'l1' AS model, ret AS y_true, l1 AS y_pred FROM fe UNION ALL SELECT symbol, ts, 'm5', ret, m5 FROM fe UNION ALL SELECT symbol, ts, 'm20', ret, m20 FROM fe)"


def predictions(spark, sf_dir):
    return features(spark, sf_dir).select("symbol", "ts", F.col("ret").alias("y_true"), F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("y_pred")) for m in ("l1", "m5", "m20")])))


MW = "mw AS (SELECT model, x / sum(x) OVER () AS w FROM (SELECT model, 1 / (avg(pow(y_pred - y_true, 2)) + 1e-8) AS x FROM lg GROUP BY 1))"
EN = ["y_true", "mean", "weighted", "median", "vote"]


@query("ensemble_predictions", with_(*FQ, LONG, MW, "f AS (SELECT symbol, ts, any_value(y_true) AS y_true, avg(y_pred) AS mean, sum(w * y_pred) / sum(w) AS weighted, median(y_pred) AS median, CASE WHEN count(*) FILTER (y_pred < 0) > 1 THEN -1 WHEN count(*) FILTER (y_pred > 0) > 1 THEN 1 WHEN count(*) FILTER (y_pred = 0) > 1 THEN 0 ELSE -1 END AS vote FROM lg JOIN mw USING (model) GROUP BY 1, 2)",
    body=pick(EN, 5, source="f")))
def ensemble_predictions(spark, sf_dir):
    return result(L.ensemble_predictions(predictions(spark, sf_dir), ["symbol", "ts"]), EN, 5)


THREE = ("l1", "m5", "m20")
DET = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"


def cramer(k):
    """Slope k of three regressors from the columns c11..c33 and y1..y3."""
    cells = [f"c{min(i, j)}{max(i, j)}" for i in (1, 2, 3) for j in (1, 2, 3)]
    swapped = [f"y{i}" if j == k else f"c{min(i, j)}{max(i, j)}" for i in (1, 2, 3) for j in (1, 2, 3)]
    return DET.format(*swapped) + " / " + DET.format(*cells)


@query("stacked_predictions", with_(*FQ, "fd AS (SELECT *, (symbol + date_diff('day', TIMESTAMP '1970-01-01', ts)) % 5 AS fold FROM fe)",
    "mo AS MATERIALIZED (SELECT f, avg(ret) AS my, " + ", ".join([f"avg({x}) AS m{i}, covar_pop({x}, ret) AS y{i}" for i, x in enumerate(THREE, 1)]
        + [f"covar_pop({x}, {y}) AS c{i}{j}" for i, x in enumerate(THREE, 1) for j, y in enumerate(THREE, 1) if i <= j]) + " FROM fd, range(0, 5) t(f) WHERE fold <> f GROUP BY 1)",
    f"sl AS MATERIALIZED (SELECT *, {cramer(1)} AS b1, {cramer(2)} AS b2, {cramer(3)} AS b3 FROM mo)",
    "f AS MATERIALIZED (SELECT symbol, ts, ret AS y_true, my + " + " + ".join(f"b{i} * ({x} - m{i})" for i, x in enumerate(THREE, 1)) + " AS stacked FROM fd JOIN sl ON f = fold)", body=pick(["y_true", "stacked"], 5, source="f")))
def stacked_predictions(spark, sf_dir):
    fold = (F.col("symbol") + F.datediff("ts", F.lit("1970-01-01").cast("date"))) % 5
    return result(L.stacked_predictions(predictions(spark, sf_dir), ["symbol", "ts"], list(THREE), fold=fold), ["y_true", "stacked"], 5)


PI = ["mean", "sd", "p_low", "p_high", "low_68", "high_68", "low_95", "high_95", "low_99", "high_99"]


@query("prediction_intervals", with_(*FQ, LONG, "g AS (SELECT symbol, ts, avg(y_pred) AS mean, stddev_pop(y_pred) AS sd, quantile_cont(y_pred, 0.025) AS p_low, quantile_cont(y_pred, 0.975) AS p_high FROM lg GROUP BY 1, 2)",
    "f AS (SELECT *, " + ", ".join(f"mean - {z} * sd AS low_{n}, mean + {z} * sd AS high_{n}" for n, z in ((68, 1.0), (95, 1.96), (99, 2.576))) + " FROM g)", body=pick(PI, 5, source="f")))
def prediction_intervals(spark, sf_dir):
    return result(L.prediction_intervals(predictions(spark, sf_dir), ["symbol", "ts"]), PI, 5)


RI = "ri AS (SELECT lg.*, y_pred - 1.96 * s AS low, y_pred + 1.96 * s AS high FROM lg JOIN (SELECT model, stddev_pop(y_true - y_pred) AS s FROM lg GROUP BY 1) USING (model))"
IQ = ["coverage", "width", "interval_score"]
simple("interval_quality", with_(*FQ, LONG, RI, "f AS (SELECT model, avg(CASE WHEN y_true BETWEEN low AND high THEN 1.0 ELSE 0.0 END) AS coverage, avg(high - low) AS width, avg(high - low + CASE WHEN y_true < low THEN 40 * (low - y_true) ELSE 0 END + CASE WHEN y_true > high THEN 40 * (y_true - high) ELSE 0 END) AS interval_score FROM ri GROUP BY 1)",
    body=pick(IQ, 6, keys=("model",), ts=None, source="f")), IQ, 6, lambda s, d: L.interval_quality(L.residual_intervals(predictions(s, d))), ("model",))

# ---- prediction metrics -----------------------------------------------------------------------------------------------------
DA = ["accuracy", "up_accuracy", "down_accuracy"]
ONE = "o AS (SELECT symbol, ts, ret AS y_true, l1 AS y_pred FROM fe)"


def one(spark, sf_dir):
    return features(spark, sf_dir).select("symbol", "ts", F.col("ret").alias("y_true"), F.col("l1").alias("y_pred"))


DIRS = {"returns": f"SELECT symbol, sign(y_true - lag(y_true) OVER {O()}) AS a, sign(y_pred - lag(y_pred) OVER {O()}) AS b FROM o", "levels": "SELECT symbol, sign(y_true) AS a, sign(y_pred) AS b FROM o",
        "changes": "SELECT symbol, sign(y_true - avg(y_true) OVER (PARTITION BY symbol)) AS a, sign(y_pred - avg(y_pred) OVER (PARTITION BY symbol)) AS b FROM o"}
for _d, _q in DIRS.items():
    simple(f"directional_accuracy_{_d}", with_(*FQ, ONE, f"s AS (SELECT * FROM ({_q}) WHERE a IS NOT NULL AND b IS NOT NULL)", "f AS (SELECT symbol, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS accuracy, coalesce(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) FILTER (a > 0), 0) AS up_accuracy, coalesce(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) FILTER (a < 0), 0) AS down_accuracy FROM s GROUP BY 1)",
        body=pick(DA, 6, keys=("symbol", "n"), ts=None, source="f")), DA, 6, lambda s, d, m=_d: L.directional_accuracy(one(s, d), m), ("symbol", "n"))
PMV = ["total_return", "annualized_return", "volatility", "sharpe", "max_drawdown", "calmar", "win_rate", "profit_factor", "costs"]
simple("profit_metrics", with_(*FQ, ONE, steps("o", [("sg", "sign(y_pred)"), ("fee", f"abs(sg - {lag('sg')}) * 0.001"), ("net", "sg * y_true - fee"), ("g", f"product(1 + coalesce(net, 0)) OVER {U()}"), ("pk", f"max(CASE WHEN net IS NOT NULL THEN g END) OVER {U()}"), ("dd", "CASE WHEN net IS NOT NULL THEN g / pk - 1 END")]),
    """g2 AS (SELECT symbol, count(*) AS n, product(1 + coalesce(net, 0)) AS gr, stddev_samp(net) * sqrt(252) AS volatility, min(dd) AS max_drawdown, count(*) FILTER (net > 0) AS winning, count(*) FILTER (sg <> 0) AS trades, coalesce(sum(net) FILTER (net > 0), 0) AS gp, coalesce(abs(sum(net) FILTER (net < 0)), 0) AS gl, sum(fee) AS costs FROM final GROUP BY 1)""",
    "f AS (SELECT *, gr - 1 AS total_return, pow(gr, 252.0 / n) - 1 AS annualized_return, (pow(gr, 252.0 / n) - 1 - 0.02) / volatility AS sharpe, (pow(gr, 252.0 / n) - 1) / nullif(abs(max_drawdown), 0) AS calmar, winning / trades AS win_rate, gp / nullif(gl, 0) AS profit_factor FROM g2)",
    body=pick(PMV, 4, keys=("symbol", "trades", "winning"), ts=None, source="f")), PMV, 4, lambda s, d: L.profit_metrics(one(s, d)), ("symbol", "trades", "winning"))
RAV = ["mean_return", "std_return", "sortino", "var_95", "var_99", "cvar_95", "cvar_99", "skewness", "kurtosis"]
simple("risk_adjusted_metrics", with_(*FQ, ONE, "s AS (SELECT symbol, sign(y_pred) * y_true AS r FROM o)", "q AS (SELECT symbol, quantile_cont(r, 0.05) AS a, quantile_cont(r, 0.01) AS b, avg(r) AS m FROM s GROUP BY 1)",
    """f AS (SELECT symbol, avg(r) AS mean_return, stddev_samp(r) AS std_return, coalesce((avg(r) - 0.02 / 252) / nullif(stddev_samp(r) FILTER (r < 0), 0), 0) AS sortino, any_value(a) AS var_95, any_value(b) AS var_99, avg(r) FILTER (r <= a) AS cvar_95, avg(r) FILTER (r <= b) AS cvar_99,
  sum(pow(r - m, 3)) / count(*) / pow(var_pop(r), 1.5) AS skewness, sum(pow(r - m, 4)) / count(*) / pow(var_pop(r), 2) - 3 AS kurtosis FROM s JOIN q USING (symbol) GROUP BY symbol)""", body=pick(RAV, 5, ts=None, source="f")), RAV, 5, lambda s, d: L.risk_adjusted_metrics(one(s, d)))
PQ = ["mse", "mae", "rmse", "correlation", "rank_correlation", "bias", "theil_u"]
simple("prediction_quality", with_(*FQ, LONG, "r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY y_true) + (count(*) OVER (PARTITION BY model, y_true) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY model ORDER BY y_pred) + (count(*) OVER (PARTITION BY model, y_pred) - 1) / 2.0 AS rp FROM lg)",
    "f AS (SELECT model, count(*) AS n, avg(pow(y_pred - y_true, 2)) AS mse, avg(abs(y_pred - y_true)) AS mae, sqrt(avg(pow(y_pred - y_true, 2))) AS rmse, corr(y_true, y_pred) AS correlation, corr(ry, rp) AS rank_correlation, avg(y_pred - y_true) AS bias, sqrt(avg(pow(y_pred - y_true, 2))) / (sqrt(avg(y_true * y_true)) + sqrt(avg(y_pred * y_pred))) AS theil_u FROM r GROUP BY 1)",
    body=pick(PQ, 5, keys=("model", "n"), ts=None, source="f")), PQ, 5, lambda s, d: L.prediction_quality(predictions(s, d)), ("model", "n"))

# ---- drift: lines before 1999 against later ones ------------------------------------------------------------------------------
SM = "sm AS (SELECT feature, side, x FROM (SELECT 'quantity' AS feature, l_quantity AS x, l_shipdate FROM lineitem UNION ALL SELECT 'discount', l_discount, l_shipdate FROM lineitem UNION ALL SELECT 'target', l_extendedprice * CASE WHEN year(l_shipdate) < 1999 THEN 1 ELSE 1.1 END, l_shipdate FROM lineitem), LATERAL (SELECT CASE WHEN year(l_shipdate) < 1999 THEN 'baseline' ELSE 'current' END AS side))"


def samples(spark, sf_dir):
    y = F.year("l_shipdate")
    li = T.table(spark, sf_dir, "lineitem").select(F.when(y < 1999, "baseline").otherwise("current").alias("side"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
                                                   (F.col("l_extendedprice") * F.when(y < 1999, 1.0).otherwise(1.1)).alias("target"))
    return li.select("side", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in ("quantity", "discount", "target")])))


KSQ = ("nn AS (SELECT feature, count(*) FILTER (side = 'baseline') AS na, count(*) FILTER (side = 'current') AS nb FROM sm GROUP BY 1)",
       "dx AS (SELECT feature, x, sum(count(*) FILTER (side = 'baseline')) OVER w AS ca, sum(count(*) FILTER (side = 'current')) OVER w AS cb FROM sm GROUP BY feature, x WINDOW w AS (PARTITION BY feature ORDER BY x))",
       "ks AS (SELECT feature, max(abs(ca / na - cb / nb)) AS statistic, any_value(sqrt(na * nb / (na + nb))) AS k FROM dx JOIN nn USING (feature) GROUP BY 1)",
       "kp AS (SELECT feature, statistic, CASE WHEN k * statistic < 0.2 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 51), lambda j: CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * pow(k * statistic, 2)))), 0), 1) END AS p_value FROM ks)")
simple("ks_test", with_(SM, *KSQ, "f AS (SELECT *, p_value < 0.05 AS drift FROM kp)", body=pick(["statistic", "p_value"], 6, keys=("feature", "drift"), ts=None, source="f")), ["statistic", "p_value"], 6, lambda s, d: D.ks_test(samples(s, d)), ("feature", "drift"))
simple("mann_whitney", with_(SM, "r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rk FROM sm)", "ti AS (SELECT feature, sum(t * t * t - t)::DOUBLE AS ti FROM (SELECT feature, count(*)::DOUBLE AS t FROM sm GROUP BY feature, x) GROUP BY 1)",
    "u AS (SELECT feature, count(*) FILTER (side = 'baseline')::DOUBLE AS n, count(*) FILTER (side = 'current')::DOUBLE AS m, sum(rk) FILTER (side = 'baseline') AS s FROM r GROUP BY 1)",
    "v AS (SELECT feature, s - n * (n + 1) / 2 AS statistic, n * m AS nm, sqrt(n * m / 12 * (n + m + 1 - ti / ((n + m) * (n + m - 1)))) AS sd FROM u JOIN ti USING (feature))", f"f AS (SELECT feature, statistic, z0 AS z, 1 - 2 * statistic / nm AS effect, least({NORMAL_TAIL}, 1) AS p_value FROM (SELECT *, (greatest(statistic, nm - statistic) - nm / 2 - 0.5) / sd AS z0, greatest((greatest(statistic, nm - statistic) - nm / 2 - 0.5) / sd, 0) AS z FROM v))",
    body=pick(["statistic", "z", "effect", "p_value"], {"statistic": 1, "z": 4, "effect": 6, "p_value": 4}, keys=KF, ts=None, source="f")), ["statistic", "z", "effect", "p_value"], {"statistic": 1, "z": 4, "effect": 6, "p_value": 4}, lambda s, d: D.mann_whitney(samples(s, d)), KF)
simple("chi_square_drift", with_(SM, "eg AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM sm GROUP BY 1)", "bn AS (SELECT feature, least(CAST(floor((x - lo) / (hi - lo) * 10) AS BIGINT), 9) AS bin, count(*) FILTER (side = 'baseline') AS a, count(*) FILTER (side = 'current') AS b FROM sm JOIN eg USING (feature) GROUP BY 1, 2)",
    "al AS (SELECT eg.feature, coalesce(a, 0) + 1 AS a, coalesce(b, 0) + 1 AS b FROM eg CROSS JOIN range(0, 10) t(k) LEFT JOIN bn ON bn.feature = eg.feature AND bin = k)", "f AS (SELECT feature, sum(pow(b - e, 2) / e) AS statistic, CAST(9 AS BIGINT) AS dof FROM (SELECT *, a * sum(b) OVER (PARTITION BY feature) / sum(a) OVER (PARTITION BY feature) AS e FROM al) GROUP BY 1)",
    body=pick(["statistic"], 4, keys=("feature", "dof"), ts=None, source="f")), ["statistic"], 4, lambda s, d: D.chi_square(samples(s, d)), ("feature", "dof"))


def changes(spark, sf_dir):
    p = predictions(spark, sf_dir)
    long = lambda d: L.regression_scores(d, ["model"]).select("model", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mse", "mae")])))
    return D.performance_drift(long(p.where(F.year("ts") >= 1999)), long(p.where(F.year("ts") < 1999)), threshold=0.01)


CH = ("mm AS (SELECT model, year(ts) >= 1999 AS cur, avg(pow(y_true - y_pred, 2)) AS mse, avg(abs(y_true - y_pred)) AS mae FROM lg GROUP BY 1, 2)", "ml AS (SELECT model, cur, 'mse' AS metric, mse AS value FROM mm UNION ALL SELECT model, cur, 'mae', mae FROM mm)",
      "ch AS (SELECT model, metric, c.value, b.value AS baseline, (c.value - b.value) / abs(b.value) AS change FROM ml c JOIN ml b USING (model, metric) WHERE c.cur AND NOT b.cur)", "cs AS (SELECT *, abs(change) > 0.01 AS drift, CASE WHEN abs(change) > 0.3 THEN 'high' WHEN abs(change) > 0.15 THEN 'medium' ELSE 'low' END AS severity FROM ch)")
simple("performance_drift", with_(*FQ, LONG, *CH, body=pick(["value", "baseline", "change"], 6, keys=("model", "metric", "drift", "severity"), ts=None, source="cs")), ["value", "baseline", "change"], 6, changes, ("model", "metric", "drift", "severity"))
simple("drift_alerts", with_(*FQ, LONG, *CH, SM, *KSQ, "f AS (SELECT CASE WHEN feature = 'target' THEN 'target' ELSE 'feature' END AS kind, feature AS entity, CASE WHEN p_value < 0.001 THEN 'high' WHEN p_value < 0.01 THEN 'medium' ELSE 'low' END AS severity, p_value AS value FROM kp WHERE p_value < 0.05 UNION ALL SELECT 'performance', model || '.' || metric, severity, abs(change) FROM cs WHERE drift)",
    body=pick(["value"], 5, keys=("kind", "entity", "severity"), ts=None, source="f")), ["value"], 5, lambda s, d: D.drift_alerts(samples(s, d), changes(s, d)), ("kind", "entity", "severity"))


# ---- experiments: test = return flag, arm by order parity, score = discount ---------------------------------------------------------
def scores(spark, sf_dir):
    return T.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("test"), F.when(F.col("l_orderkey") % 2 == 0, "A").otherwise("B").alias("arm"),
                                                     (F.col("l_extendedprice") / 1000 + F.when(F.col("l_orderkey") % 2 == 0, 2.0).otherwise(0.0)).alias("score"), "l_orderkey", "l_linenumber", "l_partkey")


AB = ("sc AS (SELECT l_returnflag AS test, l_orderkey % 2 = 0 AS a, l_extendedprice / 1000 + CASE WHEN l_orderkey % 2 = 0 THEN 2 ELSE 0 END AS score FROM lineitem)",
      "mo AS (SELECT test, count(*) FILTER (a) AS n_a, count(*) FILTER (NOT a) AS n_b, avg(score) FILTER (a) - avg(score) FILTER (NOT a) AS difference, sqrt(((count(*) FILTER (a) - 1) * var_samp(score) FILTER (a) + (count(*) FILTER (NOT a) - 1) * var_samp(score) FILTER (NOT a)) / (count(*) - 2)) AS pooled FROM sc GROUP BY 1)")
simple("ab_test", with_(*AB, "st AS (SELECT *, difference / (pooled * sqrt(1 / n_a + 1 / n_b)) AS statistic, difference / pooled AS effect, (n_a + n_b - 2)::DOUBLE AS d FROM mo)",
    f"f AS (SELECT *, CASE WHEN {student('statistic', 'd')} < 0.05 AND abs(effect) >= 0.01 AND least(n_a, n_b) >= 30 THEN CASE WHEN difference > 0 THEN 'A' ELSE 'B' END END AS winner FROM st)", body=pick(["difference", "statistic", "effect"], 4, keys=("test", "n_a", "n_b", "winner"), ts=None, source="f")),
    ["difference", "statistic", "effect"], 4, lambda s, d: D.ab_test(scores(s, d), minimum_effect=0.01), ("test", "n_a", "n_b", "winner"))
# critical value by its expansion in 1/dof, exact to 1e-9 from a thousand rows on
CRIT = "(z + (z**3 + z) / (4 * d) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * d**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * d**3))"
simple("ab_test_intervals", with_(*AB, "w AS (SELECT test, difference, pooled * sqrt(1 / n_a + 1 / n_b) AS se, (n_a + n_b - 2)::DOUBLE AS d, difference / (pooled * sqrt(1 / n_a + 1 / n_b)) AS st, 1.959963984540054::DOUBLE AS z FROM mo)",
    f"f AS (SELECT test, difference, {student('st', 'd')} AS p_value, difference - {CRIT} * se AS low, difference + {CRIT} * se AS high FROM w)", body=pick(["difference", "p_value", "low", "high"], 6, keys=("test",), ts=None, source="f")), ["difference", "p_value", "low", "high"], 6, lambda s, d: D.ab_test(scores(s, d)), ("test",))
simple("ab_bootstrap", None, ["difference", "low", "high"], 5, lambda s, d: D.bootstrap_difference(scores(s, d), ["l_orderkey", "l_linenumber", "l_partkey"]), ("test",))


@query("sample_size", "SELECT l_suppkey AS test, max(CAST(ceil(2 * pow((1.959963984540054 + 0.8416212335729143) / e, 2)) AS BIGINT)) AS rows_per_arm FROM (SELECT l_suppkey, 0.1 + avg(round(l_discount * 100)) OVER (PARTITION BY l_suppkey) / 100 AS e FROM lineitem) GROUP BY 1")
def sample_size(spark, sf_dir):
    e = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("test")).agg((0.1 + F.avg(F.round(F.col("l_discount") * 100)) / 100).alias("_e"))
    return e.select("test", D.sample_size(F.col("_e")).alias("rows_per_arm"))


# ---- spread of predictions ----------------------------------------------------------------------------------------------
ROW_KEY = 100_003       # a row's key: symbol * ROW_KEY + days since 1970
SPREAD = ["mean", "sd", "low", "middle", "high"]


def keyed_features(spark, sf_dir):
    return features(spark, sf_dir).withColumn("key", F.col("symbol") * ROW_KEY + F.unix_date(F.col("ts").cast("date")))


@query("bootstrap_intervals", with_(
    *FQ, f"ke AS MATERIALIZED (SELECT symbol, ts, ret, l1, m5, CAST(symbol * {ROW_KEY} + date_diff('day', TIMESTAMP '1970-01-01', ts) AS BIGINT) AS key FROM fe)", integer_draws("ke", "key", 100, 42),
    """su AS MATERIALIZED (SELECT rep, sum(w) AS n, sum(w * l1) / sum(w) AS m1, sum(w * m5) / sum(w) AS m2, sum(w * ret) / sum(w) AS my, sum(w * l1 * l1) AS q11, sum(w * l1 * m5) AS q12, sum(w * m5 * m5) AS q22,
  sum(w * l1 * ret) AS q1, sum(w * m5 * ret) AS q2 FROM dw GROUP BY rep)""",
    "ce AS (SELECT rep, m1, m2, my, q11 / n - m1 * m1 AS a, q12 / n - m1 * m2 AS b, q22 / n - m2 * m2 AS c, q1 / n - m1 * my AS p, q2 / n - m2 * my AS q FROM su)",
    "mo AS MATERIALIZED (SELECT rep, (c * p - b * q) / (a * c - b * b) AS b1, (a * q - b * p) / (a * c - b * b) AS b2, my - (c * p - b * q) / (a * c - b * b) * m1 - (a * q - b * p) / (a * c - b * b) * m2 AS b0 FROM ce)",
    "pr AS (SELECT symbol, ts, b0 + b1 * l1 + b2 * m5 AS y FROM ke, mo)",
    "f AS (SELECT symbol, ts, avg(y) AS mean, stddev_pop(y) AS sd, quantile_cont(y, 0.025) AS low, quantile_cont(y, 0.5) AS middle, quantile_cont(y, 0.975) AS high, count(*) AS n_models FROM pr GROUP BY symbol, ts)",
    body=pick(SPREAD, 7, keys=("symbol", "n_models"), source="f")))
def bootstrap_intervals(spark, sf_dir):
    """Intervals of every asset day from 100 replicates of one linear model."""
    d = keyed_features(spark, sf_dir)
    return result(UC.bootstrap_intervals(d, d, ["l1", "m5"], "ret", "key"), SPREAD, 7, keys=("symbol", "n_models"))


simple("stability_selection", with_(
    *FQ, f"ke AS MATERIALIZED (SELECT ret AS y, {', '.join(FEAT)}, CAST(symbol * {ROW_KEY} + date_diff('day', TIMESTAMP '1970-01-01', ts) AS BIGINT) AS key FROM fe)", integer_draws("ke", "key", 100, 42),
    "su AS MATERIALIZED (SELECT rep, sum(w) AS n, sum(w * y) / sum(w) AS my, sum(w * y * y) / sum(w) AS yy, " + ", ".join(f"sum(w * {c}) / sum(w) AS m{i}, sum(w * {c} * {c}) / sum(w) AS q{i}, sum(w * {c} * y) / sum(w) AS p{i}" for i, c in enumerate(FEAT)) + " FROM dw GROUP BY rep)",
    "r AS (" + " UNION ALL ".join(f"SELECT rep, '{c}' AS feature, pow(p{i} - m{i} * my, 2) / ((q{i} - m{i} * m{i}) * (yy - my * my)) AS r2 FROM su" for i, c in enumerate(FEAT)) + ")",
    "f AS (SELECT feature, count(*) / 100.0::DOUBLE AS frequency FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY r2 DESC, feature DESC) AS k FROM r) WHERE k <= 2 GROUP BY 1)",
    body=pick(["frequency"], 4, keys=KF, ts=None, source="f")), ["frequency"], 4, lambda s, d: SL.stability_selection(keyed_features(s, d), FEAT, "ret", ["key"], 2, draw=SL.integer_weights), KF)


@query("forest_intervals")
def forest_intervals(spark, sf_dir):
    """Spread over the trees of a forest trained on the rows before 1999, for the rows after."""
    from pyspark.ml.feature import VectorAssembler
    d = features(spark, sf_dir).select("symbol", "ts", "l1", "m5", F.col("ret").alias("y_true"))
    train = VectorAssembler(inputCols=["l1", "m5"], outputCol="_x").transform(d.where(F.year("ts") < 1999))
    model = L.regressor("random_forest", "_x", "y_true").fit(train)
    out = ["mean", "sd", "low_68", "high_68", "low_95", "high_95", "low_99", "high_99"]
    return result(UC.forest_intervals(model, d.where(F.year("ts") >= 1999), ["l1", "m5"]), out, 6, keys=("symbol", "n_trees"))


# ---- search over kinds and parameters --------------------------------------------------------------------------------------
GRID = {"linear": {}, "ridge": {"alpha": [0.1, 10.0, 1000.0]}, "lasso": {"alpha": [0.00001, 0.0001, 0.001]}, "elastic_net": {"alpha": [0.0001, 0.001], "l1_ratio": [0.3, 0.7]},
        "tree": {"depth": [1, 2, 3], "min_rows": [20, 500], "bins": [8]}}
#: Half a million candidates, of which 25 are drawn.
WIDE_GRID = {"ridge": {"alpha": [k / 10 for k in range(1, 100001)]}, "lasso": {"alpha": [k / 10 ** 8 for k in range(1, 100001)]},
             "elastic_net": {"alpha": [k / 10 ** 7 for k in range(1, 10001)], "l1_ratio": [k / 100 for k in range(1, 21)]},
             "tree": {"depth": [1, 2], "min_rows": list(range(10, 20010)), "bins": [4, 8, 12]}}
SEARCHED = {"all": SE.candidates(GRID), "sampled": SE.candidates(WIDE_GRID, 25, seed=11)}


def candidate_rows(todo, kinds, values):
    rows = ", ".join("(" + ", ".join([str(c.number), *values(c)]) + ")" for c in todo if c.kind in kinds)
    return rows


def search_sql(todo):
    """Moments for the linear kinds (two regressors: the least of the objective over the points where one or both slopes are zero or of known sign), levels for the trees."""
    penalty = lambda c: [f"{v!r}::DOUBLE" for v in (
        c["alpha"] if c.kind == "lasso" else c["alpha"] * c["l1_ratio"] if c.kind == "elastic_net" else 0.0, c["alpha"] * (1 - c["l1_ratio"]) if c.kind == "elastic_net" else 0.0, c["alpha"] if c.kind == "ridge" else 0.0)]
    linear = candidate_rows(todo, ("linear", "ridge", "lasso", "elastic_net"), penalty)
    trees = [c for c in todo if c.kind == "tree"]
    kinds = sorted({(c["min_rows"], c["bins"]) for c in trees})
    deepest = max(c["depth"] for c in trees)
    names = ", ".join(f"({c.number}, '{c.kind}', '{c.text}')" for c in todo)
    out = [CVQ.split("\nft AS")[0].rstrip(","), "nr AS MATERIALIZED (SELECT fold, side, ret AS y, l1 AS u, m5 AS v FROM fo WHERE side IS NOT NULL)",
           """mo AS (SELECT fold, side, count(*) AS n, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, var_pop(y) AS yy, var_pop(u) AS uu, covar_pop(u, v) AS uv, var_pop(v) AS vv, covar_pop(u, y) AS uy, covar_pop(v, y) AS vy FROM nr GROUP BY 1, 2)""",
           f"lc(candidate, l1, l2, summed) AS (VALUES {linear})",
           """cf AS (SELECT candidate, t.fold, l1, uu + l2 + summed / n AS a, uv AS b, vv + l2 + summed / n AS c, uy AS p, vy AS q FROM lc, mo t WHERE side = 'train'),
pt AS (SELECT *, CASE WHEN s = 0 THEN 0 WHEN t = 0 THEN (p - s * l1) / a ELSE (c * (p - s * l1) - b * (q - t * l1)) / (a * c - b * b) END AS x,
  CASE WHEN t = 0 THEN 0 WHEN s = 0 THEN (q - t * l1) / c ELSE (a * (q - t * l1) - b * (p - s * l1)) / (a * c - b * b) END AS z FROM cf, (VALUES (-1), (0), (1)) o(s), (VALUES (-1), (0), (1)) r(t)),
sl AS (SELECT candidate, fold, arg_min(x, obj) AS x, arg_min(z, obj) AS z FROM (SELECT *, (a * x * x + 2 * b * x * z + c * z * z) / 2 - p * x - q * z + l1 * (abs(x) + abs(z)) AS obj FROM pt) GROUP BY 1, 2),
ls AS (SELECT candidate, sl.fold, e.yy - 2 * (x * e.uy + z * e.vy) + x * x * e.uu + 2 * x * z * e.uv + z * z * e.vv + pow(t.my - e.my + x * (e.mu - t.mu) + z * (e.mv - t.mv), 2) AS mse
  FROM sl JOIN mo t ON t.fold = sl.fold AND t.side = 'train' JOIN mo e ON e.fold = sl.fold AND e.side = 'test')""",
           f"tv(variant, min_rows, bins) AS (VALUES {', '.join(f'({i}, {m}, {b})' for i, (m, b) in enumerate(kinds))})",
           "eg AS (SELECT min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM nr)",
           """n0 AS MATERIALIZED (SELECT variant, fold, side = 'train' AS train, y, [CAST(least(floor((u - u0) / (u1 - u0) * bins), bins - 1) AS BIGINT), CAST(least(floor((v - v0) / (v1 - v0) * bins), bins - 1) AS BIGINT)] AS cell, CAST(1 AS BIGINT) AS node FROM nr, eg, tv)"""]
    for k in range(deepest + 1):
        out.append(f"""e{k} AS MATERIALIZED (SELECT variant, fold, node, feature, cell[feature + 1] AS bin, count(*) FILTER (train) AS n, coalesce(sum(y) FILTER (train), 0) AS s, count(*) FILTER (NOT train) AS tn,
  coalesce(sum(y) FILTER (NOT train), 0) AS ts, coalesce(sum(y * y) FILTER (NOT train), 0) AS tq FROM n{k}, (VALUES (0), (1)) f(feature) GROUP BY 1, 2, 3, 4, 5),
r{k} AS (SELECT variant, fold, {k} AS depth, sum(tq - 2 * s / n * ts + s / n * s / n * tn) / sum(tn) AS mse FROM (SELECT variant, fold, node, sum(n) AS n, sum(s) AS s, sum(tn) AS tn, sum(ts) AS ts, sum(tq) AS tq FROM e{k} WHERE feature = 0 GROUP BY 1, 2, 3) GROUP BY 1, 2)""")
        if k < deepest:
            out.append(f"""g{k} AS (SELECT *, round(sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n, 12) AS gain FROM (SELECT e.variant, fold, node, feature, bin, min_rows, sum(n) OVER u AS nl, sum(s) OVER u AS sl, sum(n) OVER w AS n, sum(s) OVER w AS s FROM e{k} e JOIN tv USING (variant)
  WINDOW w AS (PARTITION BY e.variant, fold, node, feature), u AS (PARTITION BY e.variant, fold, node, feature ORDER BY bin)) WHERE nl >= min_rows AND n - nl >= min_rows AND nl > 0 AND n > nl),
b{k} AS (SELECT * FROM g{k} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY variant, fold, node ORDER BY gain DESC, feature, bin) = 1),
n{k + 1} AS MATERIALIZED (SELECT r.variant, r.fold, train, y, cell, CASE WHEN b.feature IS NULL THEN r.node ELSE 2 * r.node + CAST(cell[b.feature + 1] > b.bin AS BIGINT) END AS node FROM n{k} r LEFT JOIN b{k} b ON b.variant = r.variant AND b.fold = r.fold AND b.node = r.node)""")
    out += [f"tc(candidate, variant, depth) AS (VALUES {', '.join(f'({c.number}, {kinds.index((c['min_rows'], c['bins']))}, {c['depth']})' for c in trees)})",
            "al AS (SELECT candidate, fold, mse FROM ls UNION ALL SELECT candidate, fold, mse FROM tc JOIN (" + " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(deepest + 1)) + ") USING (variant, depth))",
            f"nm(candidate, kind, parameters) AS (VALUES {names})",
            "f AS (SELECT candidate, kind, parameters, avg(mse) * 1e4 AS mse, stddev_pop(mse) * 1e4 AS deviation, count(*) AS folds FROM al JOIN nm USING (candidate) GROUP BY 1, 2, 3)"]
    return with_(*FQ, *out, body=pick(["mse", "deviation"], 7, keys=("candidate", "kind", "parameters", "folds"), ts=None, source="f"))


def search_query(name, todo):
    """Errors in units of 1e-4; one line of models over all symbols in four time folds."""
    @query(name, search_sql(todo))
    def run(spark, sf_dir):
        found = SE.model_search(L.time_series_folds(features(spark, sf_dir), 4), ["l1", "m5"], "ret", todo)
        return result(found.withColumns({"mse": F.col("mse") * 1e4, "deviation": F.col("deviation") * 1e4}), ["mse", "deviation"], 7, keys=("candidate", "kind", "parameters", "folds"), ts=None)


search_query("model_search", SEARCHED["all"])
search_query("model_search_sampled", SEARCHED["sampled"])
