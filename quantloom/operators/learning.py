"""Scaling, folds, models, ensembles and prediction metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.functions.scalar import TRADING_DAYS, corr_of, div
from quantloom.operators.metrics import least_squares, or_zero
from quantloom.operators.ranks import average_ranks, cumulative_counts, exact_quantiles
from quantloom.operators.series import ROW, Series
from quantloom.session import checkpointed

# ---- scaling -------------------------------------------------------------------------------------------------------


def scaled(df: DataFrame, column: str, method: str, threshold: float = 3.0, remove_outliers=True) -> DataFrame:
    """`<column>_scaled`: standard, robust, minmax or returns (rank percent).

    Bounds are mean +- threshold deviations (median +- threshold mean-absolute-deviation medians for robust); values
    outside become null and the scaler statistics come from the values inside.  All statistics are one row.  The robust form
    reads its three statistics (one row each) while the plan is built, from the column stored once, so that the plan itself is one pass.
    """
    x = F.col(column)
    if method == "returns":
        c = cumulative_counts(df.where(x.isNotNull()), [], column, {"_k": F.count(F.lit(1))})
        n = c.agg(F.sum("_k").alias("_n"))
        pct = c.join(F.broadcast(n), F.lit(True)).select(column, ((F.col("_k_below") + (F.col("_k") + 1) / 2) / F.col("_n")).alias(f"{column}_scaled"))
        return df.join(pct, column, "left").select(*df.columns, f"{column}_scaled")
    if method == "robust":
        return robust_scaled(df, column, threshold, remove_outliers)
    else:
        stats = df.agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    d = df.join(F.broadcast(stats), F.lit(True))
    inside = (x >= F.col("_m") - threshold * F.col("_s")) & (x <= F.col("_m") + threshold * F.col("_s"))
    v = F.when(inside, x) if remove_outliers else x
    d = d.withColumn("_v", v)
    if method == "standard":
        fit, out = d.agg(F.avg("_v").alias("_a"), F.stddev_pop("_v").alias("_b")), lambda: div(F.col("_v") - F.col("_a"), "_b")
    elif method == "minmax":
        fit, out = d.agg(F.min("_v").alias("_a"), (F.max("_v") - F.min("_v")).alias("_b")), lambda: div(F.col("_v") - F.col("_a"), "_b")
    else:
        raise ValueError(f"unknown scaling method {method}")
    return d.join(F.broadcast(fit), F.lit(True)).select(*df.columns, out().alias(f"{column}_scaled"))


def robust_scaled(df: DataFrame, column: str, threshold: float, remove_outliers: bool) -> DataFrame:
    x, null = F.col(column), F.lit(None).cast("double")
    stored = checkpointed(df.where(x.isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_k")))      # equal values are one row

    def quantiles(rows, value, probs):
        row = exact_quantiles(rows, [], value, probs, weight="_k").first()
        return [null if row is None or v is None else F.lit(float(v)) for v in (row or probs)]
    (middle,) = quantiles(stored, column, [0.5])
    (spread,) = quantiles(stored.select(F.abs(x - middle).alias("_d"), "_k"), "_d", [0.5])
    inside = (x >= middle - threshold * spread) & (x <= middle + threshold * spread)
    low, mid, high = quantiles(stored.where(inside) if remove_outliers else stored, column, [0.25, 0.5, 0.75])
    v = F.when(inside, x) if remove_outliers else x
    return df.select("*", div(v - mid, high - low).alias(f"{column}_scaled"))


def preprocess(df: DataFrame, columns, method="standard", lags=(1,), windows=(5,), keys=("symbol",), ts="ts") -> DataFrame:
    """Lag, rolling and change features, forward then backward fill, then scaling of every feature."""
    from quantloom.operators.clean import _fill, backward, forward
    from quantloom.operators.rolling import lag_rolling_diff_features
    d = lag_rolling_diff_features(df, list(columns), lags, windows, keys, ts)
    made = [c for c in d.columns if c not in (*keys, ts)]
    d = _fill(d, made, lambda s, x: F.coalesce(forward(s, x), backward(s, x)), keys, ts)
    return scale_columns(d.select(*keys, ts, *made), made, method)


def scale_columns(df: DataFrame, columns, method="standard") -> DataFrame:
    """Standard or min-max scaling of many columns with one aggregate over the table."""
    pairs = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, lambda c: F.max(c) - F.min(c))}
    if method not in pairs:
        raise ValueError(f"unknown scaling method {method}")
    a, b = pairs[method]
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("a", a), ("b", b))])      # one row
    scaled_columns = {c: div(F.col(c) - F.col(f"_a_{c}"), f"_b_{c}") for c in columns}
    return df.join(F.broadcast(stats), F.lit(True)).withColumns(scaled_columns).select(*df.columns)


# ---- folds: each row once per fold and side that holds it ------------------------------------------------------------
def _numbered(df: DataFrame, keys, ts) -> DataFrame:
    s = Series(df, list(keys), ts)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return s.frame({"_i": s.row - 1, "_n": n})


def _sides(df: DataFrame, folds: Column, train, test) -> DataFrame:
    """`folds` lists the fold ids; train(f) and test(f) say whether a row belongs to a side of fold f."""
    every = F.transform(folds, lambda f: F.struct(f.cast("long").alias("fold"), F.when(test(f), "test").when(train(f), "train").alias("side")))
    return df.select("*", F.inline(F.filter(every, lambda s: s["side"].isNotNull()))).drop("_i", "_n")


def walk_forward_folds(df: DataFrame, train_size: int, test_size: int, gap: int = 0, expanding=False, keys=("symbol",), ts="ts") -> DataFrame:
    """Test blocks of `test_size` rows after `gap` rows; training rows before it, the last `train_size` or all."""
    d = _numbered(df, keys, ts)
    i, n = F.col("_i"), F.col("_n")
    count = F.floor((n - train_size - gap - test_size) / test_size) + 1
    start = lambda f: train_size + f * test_size
    folds = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))
    train = lambda f: (i < start(f)) & (F.lit(expanding) | (i >= start(f) - train_size))
    return _sides(d, folds, train, lambda f: (i >= start(f) + gap) & (i < start(f) + gap + test_size))


def time_series_folds(df: DataFrame, splits: int, gap: int = 0, test_size: int | None = None, keys=("symbol",), ts="ts") -> DataFrame:
    d = _numbered(df, keys, ts)
    i, step = F.col("_i"), F.floor(F.col("_n") / (splits + 1))
    size = step if test_size is None else F.lit(test_size)
    start = lambda f: (f + 1) * step
    ok = lambda f: start(f) - gap > 0
    folds = F.array(*[F.lit(f) for f in range(splits)])
    return _sides(d, folds, lambda f: ok(f) & (i < start(f) - gap), lambda f: ok(f) & (i >= start(f)) & (i < start(f) + size))


def purged_folds(df: DataFrame, splits: int, purge_days: float, keys=("symbol",), ts="ts") -> DataFrame:
    """Equal time slices; training rows end `purge_days` before the test slice.  Bounds come from one row per key."""
    span = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_z"))
    d = df.join(span, list(keys))
    t = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = (t("_z") - t("_a")) / (splits + 1)
    start = lambda f: t("_a") + (f + 1) * width
    folds = F.array(*[F.lit(f) for f in range(splits)])
    out = _sides(d, folds, lambda f: t(ts) < start(f) - purge_days * 86_400_000_000, lambda f: (t(ts) >= start(f)) & (t(ts) < start(f) + width))
    return out.drop("_a", "_z")


def blocking_folds(df: DataFrame, splits: int, block: int, gap: int, keys=("symbol",), ts="ts") -> DataFrame:
    """Training rows alternate between blocks and gaps before the test block."""
    d = _numbered(df, keys, ts)
    i, n = F.col("_i"), F.col("_n")
    start = lambda f: (f + 1) * F.floor(n / (splits + 1))
    ok = lambda f: start(f) - gap > 0
    folds = F.array(*[F.lit(f) for f in range(splits)])
    return _sides(d, folds, lambda f: ok(f) & (i < start(f) - gap) & (i % (block + gap) < block),
                  lambda f: ok(f) & (i >= start(f)) & (i < F.least(start(f) + block, n)))


# ---- models -----------------------------------------------------------------------------------------------------------
#: Kinds that read their rows many times: store them first.
TREES = ("random_forest", "gradient_boosting")


def regressor(kind: str, features: str, label: str, **p):
    """An MLlib estimator by name."""
    from pyspark.ml import regression as R
    common = dict(featuresCol=features, labelCol=label)
    make = {
        "linear": lambda: R.LinearRegression(solver="normal", **common, **p),
        "ridge": lambda: R.LinearRegression(solver="normal", standardization=False, elasticNetParam=0.0, **common, **p),
        "lasso": lambda: R.LinearRegression(standardization=False, elasticNetParam=1.0, **common, **{"regParam": 0.001, **p}),
        "random_forest": lambda: R.RandomForestRegressor(seed=42, **common, **{"numTrees": 20, **p}),
        "gradient_boosting": lambda: R.GBTRegressor(seed=42, **common, **{"maxIter": 20, **p}),
    }
    if kind not in make:
        raise ValueError(f"unknown regressor {kind}")
    return make[kind]()


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], label: str, kind: str, **p) -> DataFrame:
    """Predictions (`y_pred`) for the test rows; training is distributed by MLlib."""
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")
    if kind == "ridge":
        # penalty alpha of the summed squares; MLlib divides by the rows and works on the scaled label
        n, sd = train.dropna(subset=[*features, label]).agg(F.count(F.lit(1)), F.stddev_pop(label)).first()
        p["regParam"] = p.pop("alpha", 1.0) / n * sd
    model = regressor(kind, "_x", label, **p).fit(va.transform(train.dropna(subset=[*features, label])))
    return model.transform(va.transform(test)).withColumnRenamed("prediction", "y_pred").drop("_x")


def regression_scores(pred: DataFrame, keys=(), y="y_true", p="y_pred") -> DataFrame:
    e = F.col(p) - F.col(y)
    a = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("_v"))
    return a.select(*keys, "n", "mse", "mae", F.sqrt("mse").alias("rmse"), (1 - div("mse", "_v")).alias("r2"))


def cross_validate(folds: DataFrame, features: list[str], y: str, keys=("symbol",), ridge=0.0) -> DataFrame:
    """Test scores of a linear model per (keys, fold): every fold of every key is fitted by one aggregate."""
    k = [*keys, "fold"]
    fit = least_squares(folds.where("side = 'train'"), y, features, k, ridge=ridge).select(*k, "alpha", *[f"beta_{x}" for x in features])
    test = folds.where("side = 'test'").join(fit, k).dropna(subset=[y, *features, "alpha"])
    pred = F.col("alpha")
    for x in features:
        pred = pred + F.col(f"beta_{x}") * F.col(x)
    return regression_scores(test.select(*k, F.col(y).alias("y_true"), pred.alias("y_pred")), k)


def grid_search(folds: DataFrame, features, y, alphas, keys=("symbol",)) -> DataFrame:
    """Mean test error per ridge penalty; the smallest one is best."""
    out = None
    for a in alphas:
        s = cross_validate(folds, features, y, keys, ridge=a).agg(F.avg("mse").alias("mse")).select(F.lit(float(a)).alias("alpha"), "mse")
        out = s if out is None else out.unionByName(s)
    return out


def random_parameters(low: float, high: float, n: int, seed=42) -> list[float]:
    """Reproducible log-uniform sample of a parameter."""
    import random
    r = random.Random(seed)
    return [math.exp(r.uniform(math.log(low), math.log(high))) for _ in range(n)]


# ---- ensembles over a long prediction table (row keys, model, y_true, y_pred) -------------------------------------------
def model_weights(pred: DataFrame) -> DataFrame:
    """1 / (mse + 1e-8) per model, rescaled; one row per model."""
    e = F.col("y_pred") - F.col("y_true")
    m = pred.groupBy("model").agg((1 / (F.avg(e * e) + 1e-8)).alias("_w"))
    return m.select("model", (F.col("_w") / F.sum("_w").over(Window.partitionBy(F.lit(0)))).alias("w"))


def ensemble_predictions(pred: DataFrame, keys, weights: DataFrame | None = None) -> DataFrame:
    """Mean, weighted mean, median and sign vote per row; a row holds one value per model."""
    w = model_weights(pred) if weights is None else weights
    d = pred.join(F.broadcast(w), "model")           # one row per model
    p, vote = F.col("y_pred"), F.signum("y_pred")
    return d.groupBy(*keys).agg(F.first("y_true").alias("y_true"), F.avg(p).alias("mean"), div(F.sum(p * F.col("w")), F.sum("w")).alias("weighted"),
                                F.percentile(p, F.lit(0.5)).alias("median"), F.mode(vote, deterministic=True).alias("vote"))


def stacked_predictions(pred: DataFrame, keys, models: list[str], folds: int = 5, fold: Column | None = None) -> DataFrame:
    """Out-of-fold linear combination of the models: fold of a row = `fold` (0 to folds - 1) or a hash of its key; one fit per fold."""
    wide = pred.groupBy(*keys).agg(F.first("y_true").alias("y_true"), *[F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(m) for m in models]).dropna()
    wide = wide.withColumn("_fold", (F.pmod(F.xxhash64(*keys), F.lit(folds)) if fold is None else fold).cast("long"))
    others = wide.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("_fold"))).alias("_for"))
    fit = least_squares(others, "y_true", models, ["_for"]).select(F.col("_for").cast("long").alias("_fold"), "alpha", *[f"beta_{m}" for m in models])
    value = F.col("alpha")
    for m in models:
        value = value + F.col(f"beta_{m}") * F.col(m)
    return wide.join(F.broadcast(fit), "_fold").select(*keys, "y_true", value.alias("stacked"))     # one row per fold


# Standard normal half widths.
Z_LEVELS = {0.68: 1.0, 0.95: 1.96, 0.99: 2.576}


def prediction_intervals(pred: DataFrame, keys) -> DataFrame:
    """Spread of the models per row: percentile interval, population deviation and normal intervals."""
    p = F.percentile("y_pred", F.array(F.lit(.025), F.lit(.975)))
    a = pred.groupBy(*keys).agg(F.first("y_true").alias("y_true"), F.avg("y_pred").alias("mean"), F.stddev_pop("y_pred").alias("sd"), p.alias("_p"))
    z = [c for lv, k in Z_LEVELS.items() for c in ((F.col("mean") - k * F.col("sd")).alias(f"low_{int(lv * 100)}"), (F.col("mean") + k * F.col("sd")).alias(f"high_{int(lv * 100)}"))]
    return a.select(*keys, "y_true", "mean", "sd", F.col("_p")[0].alias("p_low"), F.col("_p")[1].alias("p_high"), *z)


def residual_intervals(pred: DataFrame, keys=("model",), z=1.96) -> DataFrame:
    """Interval of +- z residual deviations around each prediction."""
    r = pred.groupBy(*keys).agg(F.stddev_pop(F.col("y_true") - F.col("y_pred")).alias("_s"))
    j = pred.join(r, list(keys))
    return j.withColumns({"low": F.col("y_pred") - z * F.col("_s"), "high": F.col("y_pred") + z * F.col("_s")}).drop("_s")


# ---- prediction metrics -----------------------------------------------------------------------------------------------------
def directional_accuracy(pred: DataFrame, method: str = "returns", keys=("symbol",), ts="ts") -> DataFrame:
    """Sign agreement of changes, levels or deviations from the mean, in total and for rises and falls."""
    y, p = F.col("y_true"), F.col("y_pred")
    if method == "returns":
        s = Series(pred, list(keys), ts)
        d = s.frame({"a": F.signum(s.diff(y)), "b": F.signum(s.diff(p))}, keep=list(keys)).dropna()
    elif method == "levels":
        d = pred.select(*keys, F.signum(y).alias("a"), F.signum(p).alias("b"))
    elif method == "changes":
        # added up in the order of time: the last bit of a mean that a value equals must not depend on the order in which rows arrive
        whole = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        d = pred.select(*keys, F.signum(y - F.avg(y).over(whole)).alias("a"), F.signum(p - F.avg(p).over(whole)).alias("b"))
    else:
        raise ValueError(f"unknown method {method}")
    hit = F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), or_zero(F.avg(F.when(F.col("a") > 0, hit))).alias("up_accuracy"),
                                or_zero(F.avg(F.when(F.col("a") < 0, hit))).alias("down_accuracy"))


def profit_metrics(pred: DataFrame, keys=("symbol",), ts="ts", cost=0.001, rf=0.02) -> DataFrame:
    """Returns of following the sign of the prediction, less cost per change of position; the first row is null."""
    s = Series(pred.select(*keys, ts, "y_true", "y_pred"), list(keys), ts)
    sig = s.let(F.signum("y_pred"))
    fee = s.let(F.abs(s.diff(sig)) * cost)
    net = s.let(sig * F.col("y_true") - fee)
    growth = s.let(s.running_product(s.let(1 + F.coalesce(net, F.lit(0.0)))))
    dd = F.when(net.isNotNull(), growth / s.running_max(s.let(F.when(net.isNotNull(), growth))) - 1)
    d = s.frame({"net": net, "fee": fee, "sig": sig, "dd": dd}, keep=list(keys))
    x = F.col("net")
    a = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.product(1 + F.coalesce(x, F.lit(0.0))).alias("_g"), F.stddev_samp(x).alias("_s"), F.min("dd").alias("max_drawdown"),
                             F.count_if(x > 0).alias("winning"), F.count_if(F.col("sig") != 0).alias("trades"), or_zero(F.sum(F.when(x > 0, x))).alias("gross_profit"),
                             or_zero(F.abs(F.sum(F.when(x < 0, x)))).alias("gross_loss"), F.sum("fee").alias("costs"))
    ann = F.when(F.col("_g") > 0, F.pow("_g", TRADING_DAYS / F.col("n")) - 1)
    vol = F.col("_s") * math.sqrt(TRADING_DAYS)
    return a.select(*keys, (F.col("_g") - 1).alias("total_return"), ann.alias("annualized_return"), vol.alias("volatility"), or_zero(div(ann - rf, vol)).alias("sharpe"), "max_drawdown",
                    div(ann, F.abs("max_drawdown")).alias("calmar"), or_zero(div(F.col("winning"), F.col("trades"))).alias("win_rate"), div("gross_profit", "gross_loss").alias("profit_factor"),
                    "trades", "winning", "costs")


def risk_adjusted_metrics(pred: DataFrame, keys=("symbol",), rf=0.02) -> DataFrame:
    r = F.signum("y_pred") * F.col("y_true")
    whole = Window.partitionBy(*keys)
    d = pred.withColumn("r", r).withColumn("_q", F.percentile("r", F.array(F.lit(.05), F.lit(.01))).over(whole))
    down = F.stddev_samp(F.when(F.col("r") < 0, F.col("r")))
    tail = lambda i: F.avg(F.when(F.col("r") <= F.col("_q")[i], F.col("r")))
    return d.groupBy(*keys).agg(F.avg("r").alias("mean_return"), F.stddev_samp("r").alias("std_return"), or_zero(div(F.avg("r") - rf / 252, down)).alias("sortino"),
                                F.first(F.col("_q")[0]).alias("var_95"), F.first(F.col("_q")[1]).alias("var_99"), tail(0).alias("cvar_95"), tail(1).alias("cvar_99"),
                                F.skewness("r").alias("skewness"), F.kurtosis("r").alias("kurtosis"))


def prediction_quality(pred: DataFrame, keys=("model",)) -> DataFrame:
    """Errors, correlations, bias and Theil's U.  Ranks come from running counts, not from a sort of the whole key."""
    k = list(keys)
    y, p = F.col("y_true"), F.col("y_pred")
    e = p - y
    a = pred.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), corr_of(y, p).alias("correlation"), F.avg(e).alias("bias"),
                             (F.sqrt(F.avg(y * y)) + F.sqrt(F.avg(p * p))).alias("_d"))
    one = {"_k": F.count(F.lit(1))}
    ry = average_ranks(pred, k, "y_true", one).select(*k, "y_true", F.col("rank").alias("_ry"))
    rp = average_ranks(pred, k, "y_pred", one).select(*k, "y_pred", F.col("rank").alias("_rp"))
    pairs = pred.groupBy(*k, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("_c"))
    r = pairs.join(ry, [*k, "y_true"]).join(rp, [*k, "y_pred"])
    c, u, v = F.col("_c"), F.col("_ry"), F.col("_rp")
    s = r.groupBy(*k).agg(F.sum(c).alias("_n"), F.sum(c * u).alias("_u"), F.sum(c * v).alias("_v"), F.sum(c * u * u).alias("_uu"), F.sum(c * v * v).alias("_vv"), F.sum(c * u * v).alias("_uv"))
    n = F.col("_n")
    cov = F.col("_uv") / n - F.col("_u") / n * F.col("_v") / n
    spread = F.sqrt((F.col("_uu") / n - (F.col("_u") / n) ** 2) * (F.col("_vv") / n - (F.col("_v") / n) ** 2))
    s = s.select(*k, div(cov, spread).alias("rank_correlation"))
    return a.join(s, k).select(*k, "n", "mse", "mae", F.sqrt("mse").alias("rmse"), "correlation", "rank_correlation", "bias", div(F.sqrt("mse"), "_d").alias("theil_u"))


def interval_quality(rows: DataFrame, keys=("model",), alpha=0.05) -> DataFrame:
    """Coverage, mean width and interval score of (y_true, low, high)."""
    y, lo, hi = F.col("y_true"), F.col("low"), F.col("high")
    score = (hi - lo) + F.when(y < lo, 2 / alpha * (lo - y)).otherwise(0.0) + F.when(y > hi, 2 / alpha * (y - hi)).otherwise(0.0)
    return rows.groupBy(*keys).agg(F.avg(F.when((y >= lo) & (y <= hi), 1.0).otherwise(0.0)).alias("coverage"), F.avg(hi - lo).alias("width"), F.avg(score).alias("interval_score"))
