"""Configurable rolling features, look-ahead probes and rolling analytics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quantloom.functions.linear import dot, solve_symmetric
from quantloom.functions.scalar import corr_of, TRADING_DAYS, div
from quantloom.operators.indicators.momentum import strength_index
from quantloom.operators.indicators.statistical import unbiased_kurt, unbiased_skew
from quantloom.operators.series import Series

YEAR = math.sqrt(TRADING_DAYS)


def sorted_window(s: Series, n: int, x: Column) -> Column:
    return s.let(F.array_sort(s.let(s.window_array(n, x))))


def quantile_at(values: Column, n: int, q: float) -> Column:
    """Linear interpolation between the neighbours in a sorted array of n values."""
    pos = q * (n - 1)
    low, part = int(math.floor(pos)), pos - math.floor(pos)
    a, b = F.get(values, F.lit(low)), F.get(values, F.lit(min(low + 1, n - 1)))
    return a + (b - a) * part


def _full(s: Series, n: int, x: Column, value: Column) -> Column:
    return F.when(F.count(x).over(s.last_rows(n)) == n, value)


def rolling_rank(s: Series, n: int, x: Column) -> Column:
    """Position of the current value in its window as a share, ties averaged."""
    values = s.let(s.window_array(n, x))
    below, upto = F.size(F.filter(values, lambda v: v < x)), F.size(F.filter(values, lambda v: v <= x))
    return F.when(values.isNotNull(), (below + upto + 1) / (2.0 * n))


def rolling_zscore(s: Series, n: int, x: Column) -> Column:
    mean, sd = s.roll(F.avg, n, x), s.roll(F.stddev_samp, n, x)
    return F.when(sd > 0, (x - mean) / sd).when(sd == 0, 0.0)


# Growing-start forms: the window may be shorter at the start of the series, from two rows on.
def rolling_momentum(s: Series, n: int, x: Column) -> Column:
    first = F.first(x).over(s.last_rows(n))
    return F.when(s.row >= min(n, 2), F.coalesce(div(x, first) - 1, F.lit(0.0)))


def _window_changes(s: Series, n: int, x: Column):
    change = s.let(s.pct(x))
    w = s.order.rowsBetween(-(n - 2), 0)          # a window of n rows holds n-1 changes
    return F.avg(change).over(w), F.stddev_samp(change).over(w)


def rolling_volatility(s: Series, n: int, x: Column) -> Column:
    return F.when(s.row >= 3, _window_changes(s, n, x)[1] * YEAR)


def rolling_sharpe(s: Series, n: int, x: Column) -> Column:
    mean, sd = _window_changes(s, n, x)
    return F.when(s.row >= 3, F.when(sd > 0, mean / sd * YEAR).otherwise(0.0)).when(s.row == 2, 0.0)


def rolling_rsi(s: Series, n: int, x: Column, period: int = 14) -> Column:
    if n < period + 1:
        return F.lit(None).cast("double")
    d = s.let(s.diff(x))
    gain = s.let(s.roll(F.avg, period, s.let(F.when(d > 0, d).otherwise(F.lit(0.0)))))
    loss = s.let(s.roll(F.avg, period, s.let(F.when(d < 0, -d).otherwise(F.lit(0.0)))))
    return F.when(s.row >= period + 1, strength_index(gain, loss))


OPERATIONS = {
    "mean": lambda s, n, x: s.roll(F.avg, n, x),
    "std": lambda s, n, x: s.roll(F.stddev_samp, n, x),
    "min": lambda s, n, x: s.roll(F.min, n, x),
    "max": lambda s, n, x: s.roll(F.max, n, x),
    "sum": lambda s, n, x: s.roll(F.sum, n, x),
    "median": lambda s, n, x: quantile_at(sorted_window(s, n, x), n, 0.5),
    "skew": lambda s, n, x: _full(s, n, x, unbiased_skew(x, s.last_rows(n), n)),
    "kurt": lambda s, n, x: _full(s, n, x, unbiased_kurt(x, s.last_rows(n), n)),
    "rank": rolling_rank,
    "zscore": rolling_zscore,
    "rsi": rolling_rsi,
    "momentum": rolling_momentum,
    "volatility": rolling_volatility,
    "sharpe": rolling_sharpe,
}


def rolling_columns(s: Series, columns, windows, operations, quantiles=(0.25, 0.75)) -> dict[str, Column]:
    """`{col}_rolling_{window}_{op}` for every combination; quantiles add their percent to the name."""
    out = {}
    for c in columns:
        x = F.col(c)
        for n in windows:
            for op in operations:
                if op == "quantile":
                    values = sorted_window(s, n, x)
                    for q in quantiles:
                        out[f"{c}_rolling_{n}_quantile_{int(q * 100)}"] = quantile_at(values, n, q)
                elif op in OPERATIONS:
                    out[f"{c}_rolling_{n}_{op}"] = OPERATIONS[op](s, n, x)
                else:
                    raise ValueError(f"unsupported rolling operation: {op}")
    return out


#: Operations that a task works out for all rows of a batch at once.  Spark's frames add up every window anew, row by row: some 6 microseconds a value for all of them.
MOMENTS = ("mean", "std", "min", "max", "sum", "skew", "kurt")


def window_moments(x: np.ndarray, known: np.ndarray, n: int, operations, weights=None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(value, whether there is one) of every operation for each window of n values of x, one that holds an unknown value has none.

    As in SQL, a window of equal values has no skewness and kurtosis, and NaN is above all numbers.  `weights` names further operations by the weights of their sums, oldest first.
    """
    v = np.lib.stride_tricks.sliding_window_view(x, n)
    full = np.lib.stride_tricks.sliding_window_view(known, n).all(axis=1)
    with np.errstate(all="ignore"):
        total = v.sum(axis=1)
        make = {"mean": lambda: (total / n, full), "sum": lambda: (total, full)}
        make |= {op: lambda w=w: (v @ w, full) for op, w in (weights or {}).items()}
        if set(operations) - set(make):
            low, high = np.fmin.reduce(v, axis=1), v.max(axis=1)
            d = v - np.where(low == high, low, total / n)[:, None]          # equal values have no deviation to the last bit
            d2 = d * d
            m2 = d2.sum(axis=1)
            varies = full & (m2 != 0)
            make |= {
                "min": lambda: (low, full), "max": lambda: (high, full),
                "std": lambda: (np.sqrt(m2 / max(n - 1, 1)), full & (n > 1)),
                "skew": lambda: (math.sqrt(n) * (d2 * d).sum(axis=1) / np.sqrt(m2 ** 3) * (math.sqrt(n * (n - 1)) / (n - 2)), varies),
                "kurt": lambda: (((n * (d2 * d2).sum(axis=1) / m2 ** 2 - 3) * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3))), varies),
            }
        return {op: make[op]() for op in operations}


def with_moments(s: Series, out: dict[str, Column], wanted, weights=None, keep=None) -> DataFrame:
    """The frame of `s` with a further column `{col}_rolling_{window}_{op}` for each (col, window, op) of `wanted`; the columns are doubles.

    Rows lie by key and time behind the series' windows; a batch brings the last rows of the one before along.
    """
    df = s.frame(out | {"_row": s.row}, keep).sortWithinPartitions(*s.keys, "_row")
    kept = [c for c in df.columns if c != "_row"]
    steps: dict[tuple[str, int], list[str]] = {}
    for c, n, op in wanted:
        steps.setdefault((c, n), []).append(op)
    names = [f"{c}_rolling_{n}_{op}" for (c, n), ops in steps.items() for op in ops]
    schema = ", ".join([f"`{c}` {t}" for c, t in df.dtypes if c != "_row"] + [f"`{name}` double" for name in names])
    columns, back = list(dict.fromkeys(c for c, _ in steps)), max(n for _, n in steps) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = {c: (np.full(back, np.nan), np.zeros(back, bool)) for c in columns}
        for b in batches:
            at = b.column(b.schema.get_field_index("_row")).to_numpy(zero_copy_only=False)
            long, more = {}, []
            for c in columns:
                values = b.column(b.schema.get_field_index(c))
                x = np.concatenate([before[c][0], values.fill_null(np.nan).to_numpy(zero_copy_only=False)])
                known = np.concatenate([before[c][1], values.is_valid().to_numpy(zero_copy_only=False)])
                before[c] = x[len(x) - back:], known[len(x) - back:]
                long[c] = x, known
            for (c, n), ops in steps.items():
                x, known = long[c]
                for value, has in window_moments(x[back - n + 1:], known[back - n + 1:], n, ops, weights).values():
                    more.append(pa.array(value, pa.float64(), mask=~(has & (at >= n))))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in kept] + more, names=kept + names)
    return df.mapInArrow(run, schema)


def rolling_features(df: DataFrame, columns, windows=(20, 50, 200), operations=("mean", "std"), quantiles=(.25, .75),
                     keys=("symbol",), ts="ts") -> DataFrame:
    s = Series(df, keys, ts)
    types = dict(df.dtypes)
    batched = [op for op in dict.fromkeys(operations) if op in MOMENTS] if all(types[c] == "double" for c in columns) else []
    out = rolling_columns(s, columns, windows, [op for op in operations if op not in batched], quantiles)
    if not batched or not windows:
        return s.frame(out)
    names = [n for c in columns for w in windows for op in operations for n in ([f"{c}_rolling_{w}_{op}"] if op != "quantile" else [f"{c}_rolling_{w}_quantile_{int(q * 100)}" for q in quantiles])]
    wanted = [(c, n, op) for c in dict.fromkeys(columns) for n in dict.fromkeys(windows) for op in batched]
    return with_moments(s, out, wanted).select(*df.columns, *dict.fromkeys(names))


def valid_rolling(df: DataFrame, value: str, window: int, operation: str, keys=("symbol",), ts="ts") -> DataFrame:
    """Rolling value for rows with a full window only (rows before are left out)."""
    s = Series(df.select(*keys, ts, value), keys, ts)
    return s.frame({operation: OPERATIONS[operation](s, window, F.col(value))}, keep=[*keys, ts]).dropna(
        subset=[operation])


# ---- fixed feature sets -------------------------------------------------------------------------------------------

def base_feature_set(df: DataFrame) -> DataFrame:
    """Moving average, momentum, RSI, bands, MACD, volatility and multi-horizon returns of each symbol."""
    from quantloom.operators.indicators.momentum import macd_lines, rsi_of
    s = Series(df.select("symbol", "ts", "close"))
    mean, sd = s.let(s.roll(F.avg, 20, s.close)), s.let(s.roll(F.stddev_samp, 20, s.close))
    line, signal, _ = macd_lines(s, 12, 26, 9)
    out = {"ma_20": mean, "momentum": s.pct(s.close, 10), "rsi": rsi_of(s, 14), "bb_upper": mean + 2 * sd,
           "bb_lower": mean - 2 * sd, "macd": line, "macd_signal": signal,
           "volatility": s.roll(F.stddev_samp, 20, s.let(s.pct(s.close)))}
    out |= {f"return_{k}d": s.pct(s.close, k) for k in (1, 5, 10, 20)}
    return s.frame(out, keep=["symbol", "ts"])


def learning_feature_set(df: DataFrame) -> DataFrame:
    """Price, return, momentum, averages, volatility and a zero-safe RSI; rows with any missing value are left out."""
    s = Series(df.select("symbol", "ts", "close"))
    c = s.close
    d = s.let(s.diff(c))
    gain = s.let(s.roll(F.avg, 14, s.let(F.when(d > 0, d).otherwise(0.0))))
    loss = s.let(s.roll(F.avg, 14, s.let(F.when(d < 0, -d).otherwise(0.0))))
    out = {"price": c, "returns": s.pct(c), "momentum_5": s.pct(c, 5), "momentum_20": s.pct(c, 20),
           "sma_5": s.roll(F.avg, 5, c), "sma_20": s.roll(F.avg, 20, c),
           "volatility": s.roll(F.stddev_samp, 20, s.let(s.pct(c))), "rsi": 100 - 100 / (1 + gain / (loss + 1e-10))}
    return s.frame(out, keep=["symbol", "ts"]).dropna()


def lag_rolling_diff_features(df: DataFrame, columns, lags=(1, 5, 10), windows=(5, 20), keys=("symbol",), ts="ts",
                              differences=True) -> DataFrame:
    s = Series(df, keys, ts)
    out = {}
    for c in columns:
        x = F.col(c)
        out |= {f"{c}_lag_{k}": s.lag(x, k) for k in lags}
        for n in windows:
            out[f"{c}_rolling_mean_{n}"] = s.roll(F.avg, n, x)
            out[f"{c}_rolling_std_{n}"] = s.roll(F.stddev_samp, n, x)
        if differences:
            out[f"{c}_diff"], out[f"{c}_pct_change"] = s.diff(x), s.pct(x)
    return s.frame(out)


def sequences(df: DataFrame, features, target: str, length: int = 60, keys=("symbol",), ts="ts") -> DataFrame:
    """The `length` feature vectors before each row, oldest first, and the target of the row itself."""
    s = Series(df, keys, ts)
    vector = F.array(*[F.col(c).cast("double") for c in features])
    past = F.collect_list(vector).over(s.order.rowsBetween(-length, -1))
    return s.frame({"sequence": past, "target": F.col(target)}, keep=[*keys, ts]).where(F.size("sequence") == length)


def cross_sectional_strength(bars: DataFrame) -> DataFrame:
    """Close over the mean close of all symbols of the timestamp.

    The means are one row per timestamp, aggregated with map-side combine and joined back.
    """
    level = bars.groupBy("ts").agg(F.avg("close").alias("_level"))
    return bars.select("symbol", "ts", "close").join(level, "ts").select(
        "symbol", "ts", div("close", "_level").alias("relative_strength"))


def sector_rolling_momentum(bars: DataFrame, metadata: DataFrame, period: int = 20) -> DataFrame:
    """Mean over `period` timestamps of the average one-row change of the sector members."""
    s = Series(bars.select("symbol", "ts", "close"))
    change = s.frame({"change": s.pct(s.close)}, keep=["symbol", "ts"])
    per = (change.join(metadata.select("symbol", "sector"), "symbol").where("change is not null")
           .groupBy("sector", "ts").agg(F.avg("change").alias("change")))
    s = Series(per, ["sector"])
    return s.frame({"sector_momentum": s.roll(F.avg, period, F.col("change"))}, keep=["sector", "ts"])


# ---- look-ahead probes ----------------------------------------------------------------------------------------------

def stability_probe(df: DataFrame, feature: str, keys=("symbol",), ts="ts") -> DataFrame:
    """All rows whose last 21 values of the feature do not move at all although more than five are present."""
    s = Series(df.select(*keys, ts, feature), keys, ts)
    w = s.order.rowsBetween(-20, 0)
    probe = s.frame({"flat": (F.stddev_samp(feature).over(w) == 0) & (F.count(feature).over(w) > 5)}, keep=[*keys, ts])
    return probe.where("flat").select(*keys, ts)


def correlation_probe(df: DataFrame, features, data, keys=("symbol",), ts="ts", same=0.99, lagged=0.95) -> DataFrame:
    """Correlation of each feature with each data column and with the data one row before, with flags."""
    s = Series(df, keys, ts)
    wide = s.frame({f"_lag_{c}": s.lag(c) for c in data})
    aggs = []
    for f in features:
        for c in data:
            aggs += [corr_of(f, c).alias(f"{f}|{c}|same"), corr_of(f, f"_lag_{c}").alias(f"{f}|{c}|lagged")]
    flat = wide.groupBy(*keys).agg(*aggs)
    names = [c for c in flat.columns if "|" in c]
    long = flat.select(*keys, F.explode(F.array(*[
        F.struct(*[F.lit(v).alias(k) for k, v in zip(("feature", "data", "kind"), n.split("|"))],
                 F.col(f"`{n}`").alias("corr")) for n in names])).alias("r")).select(*keys, "r.*")
    limit = F.when(F.col("kind") == "same", same).otherwise(lagged)
    return long.withColumn("suspicious", F.coalesce(F.abs("corr") > limit, F.lit(False)))


def extreme_change_probe(df: DataFrame, feature: str, keys=("symbol",), ts="ts", share=0.05) -> DataFrame:
    """Share of changes outside their 1% and 99% quantiles."""
    s = Series(df.select(*keys, ts, feature), keys, ts)
    change = s.frame({"change": s.pct(F.col(feature))}, keep=list(keys)).where("change is not null")
    bounds = change.groupBy(*keys).agg(F.percentile("change", F.array(F.lit(.01), F.lit(.99))).alias("_b"))
    out = change.join(bounds, list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("change") < F.col("_b")[0]) | (F.col("change") > F.col("_b")[1])).alias("extreme"))
    return out.where("n >= 10").withColumn("share", F.col("extreme") / F.col("n")).withColumn(
        "suspicious", F.col("share") > share)


# Words that mark a target column and words that mark a safe one.
TARGET_WORDS = ("return", "target", "label", "y")
SAFE_WORDS = ("lag", "shift", "prev", "past")


def target_name_probe(columns: DataFrame, name: str = "name") -> DataFrame:
    """Column names that look like a target and not like a lagged value."""
    low = F.lower(F.col(name))
    return columns.where(low.rlike("|".join(TARGET_WORDS)) & ~low.rlike("|".join(SAFE_WORDS)))


# ---- rolling analytics --------------------------------------------------------------------------------------------

def annualized_growth(product: Column, n) -> Column:
    return F.when(product > 0, F.pow(product, TRADING_DAYS / n) - 1)


def rolling_comparison(returns: DataFrame, window: int = 252, keys=("symbol",), ts="ts") -> DataFrame:
    """(keys, ts, ret, bench) against the `window` rows before each row; keys need two windows of rows."""
    s = Series(returns.dropna(subset=["ret", "bench"]), keys, ts)
    w = s.order.rowsBetween(-window, -1)
    p, b = F.col("ret"), F.col("bench")
    ex = s.let(p - b)
    whole = s.order.rowsBetween(-(2 ** 31) + 1, 2 ** 31 - 2)
    mp, mb = s.let(F.avg(p).over(w)), s.let(F.avg(b).over(w))
    cov, vp, vb = (s.let(c.over(w)) for c in (F.covar_samp(p, b), F.var_samp(p), F.var_samp(b)))
    sd, mean = F.sqrt(F.greatest(vp + vb - 2 * cov, F.lit(0.0))), mp - mb      # moments of the excess
    beta = s.let(F.coalesce(div(cov, vb), F.lit(0.0)))
    corr = s.let(div(cov, F.sqrt(vp * vb)))
    out = {"portfolio_return": annualized_growth(F.product(1 + p).over(w), window),
           "benchmark_return": annualized_growth(F.product(1 + b).over(w), window),
           "excess_return": annualized_growth(F.product(1 + ex).over(w), window),
           "tracking_error": sd * YEAR, "information_ratio": F.coalesce(div(mean, sd) * YEAR, F.lit(0.0)),
           "hit_ratio": F.avg(F.when(ex > 0, 1.0).otherwise(0.0)).over(w), "beta": beta,
           "alpha": (mp - beta * mb) * TRADING_DAYS, "correlation": corr,
           "r_squared": corr * corr, "_rows": F.count(F.lit(1)).over(whole), "_at": s.row}
    df = s.frame(out, keep=[*keys, ts])
    return df.where((F.col("_rows") >= 2 * window) & (F.col("_at") > window)).drop("_rows", "_at")


def rolling_factor_attribution(returns: DataFrame, factors: list[str], window: int = 252, keys=("symbol",),
                               ts="ts") -> DataFrame:
    """Least squares of ret on the factor columns over the `window` rows before each row.

    Rolling means of the products give the normal equations, which are solved per row by column expressions.
    Returns are small numbers around zero, so differences of running sums keep their precision.
    """
    s = Series(returns.dropna(subset=["ret", *factors]), keys, ts)
    y, f = F.col("ret"), [F.col(c) for c in factors]
    k = len(f)

    def mean(x):
        """Mean over the rows before this one, from two running sums: constant work per row for any window."""
        total = s.let(s.running_sum(s.let(x)))
        return s.let((s.lag(total) - F.coalesce(s.lag(total, window + 1), F.lit(0.0))) / window)
    means, my = [mean(x) for x in f], mean(y)
    cov = [[None] * k for _ in range(k)]
    for i in range(k):
        for j in range(i, k):
            cov[i][j] = cov[j][i] = s.let(mean(f[i] * f[j]) - means[i] * means[j])
    rhs = [s.let(mean(x * y) - m * my) for x, m in zip(f, means)]
    beta = solve_symmetric(s.let, cov, rhs)
    r2 = div(dot(beta, rhs), mean(y * y) - my * my)
    alpha = my - dot(beta, means)
    out = {"alpha": alpha, "r_squared": s.let(r2)}
    out |= {f"beta_{c}": b for c, b in zip(factors, beta)}
    out |= {f"contribution_{c}": b * m for c, b, m in zip(factors, beta, means)}
    return s.frame({**out, "_at": s.row}, keep=[*keys, ts]).where(F.col("_at") > window).drop("_at")


def rolling_model_performance(pred: DataFrame, window: int = 100, keys=("model",), ts="ts") -> DataFrame:
    """Mean squared and absolute error and correlation over the last `window` predictions."""
    s = Series(pred, keys, ts)
    e = s.let(F.col("y_true") - F.col("y_pred"))
    out = {"mse": s.roll(F.avg, window, s.let(e * e)), "mae": s.roll(F.avg, window, s.let(F.abs(e))),
           "corr": s.roll_corr(window, "y_true", "y_pred")}
    return s.frame(out, keep=[*keys, ts]).dropna(subset=["mse"])


def rolling_sharpe_series(returns: DataFrame, window: int = 252, keys=("symbol",), ts="ts", rf=0.0) -> DataFrame:
    s = Series(returns, keys, ts)
    x = F.col("ret") - rf / TRADING_DAYS
    mean, sd = s.roll(F.avg, window, s.let(x)), s.roll(F.stddev_samp, window, s.let(x))
    return s.frame({"sharpe": F.coalesce(div(mean, sd) * YEAR, F.when(sd == 0, 0.0))}, keep=[*keys, ts]).dropna()


def sharpe_consistency_probe(returns: DataFrame, window: int = 252, level: float = 3.0, keys=("symbol",)) -> DataFrame:
    """Share of rolling Sharpe ratios above `level`; suspicious above one half."""
    sharpe = rolling_sharpe_series(returns, window, keys)
    return sharpe.groupBy(*keys).agg(F.avg(F.when(F.col("sharpe") > level, 1.0).otherwise(0.0)).alias("share")) \
        .withColumn("suspicious", F.col("share") > 0.5)


def signal_stability(signals: DataFrame, window: int = 10, keys=("strategy",), ts="ts") -> DataFrame:
    """1 - (population deviation / mean) of the mean |strength| of the `window` signals before each signal."""
    s = Series(signals, keys, ts)
    past = s.order.rowsBetween(-window, -1)
    means = s.frame({"m": F.avg(F.abs("strength")).over(past), "_at": s.row}, keep=list(keys)).where(
        F.col("_at") > window)
    return means.groupBy(*keys).agg((1 - div(F.stddev_pop("m"), F.avg("m"))).alias("stability"))
