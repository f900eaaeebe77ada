"""Filling of missing values and trimming of outliers in ordered series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.functions.scalar import div
from quantloom.operators.series import ROW, Series
from quantloom.session import checkpointed

FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


def require_rows_and_columns(df: DataFrame, needed) -> DataFrame:
    """Fails while the plan is built for a missing column; an empty frame is an error as well."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if df.isEmpty():
        raise ValueError("empty frame")
    return df


def column_report(df: DataFrame, needed) -> DataFrame:
    """(column, present, filled): whether each needed column exists and how many rows fill it; an empty frame fills none.  One aggregate."""
    here = [c for c in needed if c in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(here)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(c in here).alias("present"), (F.col(f"_n{here.index(c)}") if c in here else F.lit(0).cast("long")).alias("filled")) for c in needed]
    return one.select(F.inline(F.array(*rows)))


def forward(s: Series, x, limit: int | None = None) -> Column:
    return F.last(x, ignorenulls=True).over(s.order.rowsBetween(FIRST if limit is None else -limit, 0))


def backward(s: Series, x, limit: int | None = None) -> Column:
    return F.first(x, ignorenulls=True).over(s.order.rowsBetween(0, LAST if limit is None else limit))


def _fill(df: DataFrame, columns, f, keys, ts) -> DataFrame:
    s = Series(df, keys, ts)
    filled = {c: f(s, F.col(c)) for c in columns}
    others = [c for c in df.columns if c not in filled]
    return s.frame(filled, keep=others).select(*df.columns)


def forward_fill(df, columns, limit=None, keys=("symbol",), ts="ts"):
    return _fill(df, columns, lambda s, x: forward(s, x, limit), keys, ts)


def backward_fill(df, columns, limit=None, keys=("symbol",), ts="ts"):
    return _fill(df, columns, lambda s, x: backward(s, x, limit), keys, ts)


def _neighbours(s: Series, x: Column):
    """Nearest rows with a value on both sides, each with the one beyond it: (row, x, row2, x2)."""
    here = F.when(x.isNotNull(), F.struct(F.col(ROW).alias("row"), x.alias("x")))
    older = s.let(F.last(here, True).over(s.order.rowsBetween(FIRST, -1)))
    newer = s.let(F.first(here, True).over(s.order.rowsBetween(1, LAST)))

    def with_beyond(beyond):
        return F.when(x.isNotNull(), F.struct(F.col(ROW).alias("row"), x.alias("x"), beyond["row"].alias("row2"),
                                              beyond["x"].alias("x2")))
    left = s.let(F.last(s.let(with_beyond(older)), True).over(s.order.rowsBetween(FIRST, 0)))
    right = s.let(F.first(s.let(with_beyond(newer)), True).over(s.order.rowsBetween(0, LAST)))
    return left, right


def linear(s: Series, x: Column) -> Column:
    """Equal-spacing line between the neighbours; the last value goes on, a leading gap stays."""
    left, right = _neighbours(s, x)
    between = left["x"] + (right["x"] - left["x"]) * div(s.row - left["row"], right["row"] - left["row"])
    return F.coalesce(x, F.when(right.isNull(), left["x"]).otherwise(between))


def polynomial(s: Series, x: Column, order: int = 2) -> Column:
    """Local polynomial through the nearest values: two before and one after (order 2) or two after (order 3).

    Gaps at the ends, and those with too few neighbours, stay.
    """
    left, right = _neighbours(s, x)
    points = [(left["row2"], left["x2"]), (left["row"], left["x"]), (right["row"], right["x"])]
    if order == 3:
        points.append((right["row2"], right["x2"]))
    total = F.lit(0.0)
    for i, (ri, xi) in enumerate(points):
        term = xi
        for j, (rj, _) in enumerate(points):
            if i != j:
                term = term * div(s.row - rj, ri - rj)
        total = total + term
    return F.coalesce(x, total)


def linear_interpolation(df, columns, keys=("symbol",), ts="ts"):
    return _fill(df, columns, linear, keys, ts)


def polynomial_interpolation(df, columns, order=2, keys=("symbol",), ts="ts"):
    return _fill(df, columns, lambda s, x: polynomial(s, x, order), keys, ts)


def fill_with_statistic(df: DataFrame, columns, statistic: str, keys=("symbol",)) -> DataFrame:
    """Mean, median or mode of each key into its nulls (ties of the mode: the smallest value)."""
    f = {"mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5)),
         "mode": lambda c: F.mode(c, deterministic=True)}[statistic]
    stats = df.groupBy(*keys).agg(*[f(c).alias(f"_{c}") for c in columns])
    joined = df.join(stats, list(keys))
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def seasonal_fill(df, columns, period=252, keys=("symbol",), ts="ts"):
    """Mean of the values one to four periods earlier, then forward fill."""
    def fill(s, x):
        past = F.array_compact(F.array(*[s.lag(x, k * period) for k in range(1, 5)]))
        past = s.let(past)
        mean = F.aggregate(past, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(past), F.lit(0))
        return forward(s, s.let(F.coalesce(x, mean)))
    return _fill(df, columns, fill, keys, ts)


def decayed_fill(df, columns, rate=0.95, keys=("symbol",), ts="ts"):
    """Last value times rate^(rows since it)."""
    def fill(s, x):
        last = s.let(F.last(F.when(x.isNotNull(), F.struct(F.col(ROW).alias("row"), x.alias("x"))), True)
                     .over(s.order.rowsBetween(FIRST, 0)))
        return last["x"] * F.pow(F.lit(rate), s.row - last["row"])
    return _fill(df, columns, fill, keys, ts)


def nearest_rows_fill(df: DataFrame, columns, k: int = 5, key="symbol", ts="ts") -> DataFrame:
    """Mean of the k rows of the same symbol that are nearest in the other columns and hold the missing value.

    Distance ignores missing coordinates and scales the rest up.  A symbol is one group, bounded by the calendar;
    its rows with a gap are compared in slices, so memory stays small.
    """
    columns = list(columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts).reset_index(drop=True)
        x = pdf[columns].to_numpy(dtype=float)
        known, out = ~np.isnan(x), x.copy()
        zero = np.where(known, x, 0.0)
        rows = np.flatnonzero(~known.all(axis=1))
        for part in np.array_split(rows, max(1, len(rows) // 256)):
            both = known[part][:, None, :] & known[None, :, :]
            sq = ((zero[part][:, None, :] - zero[None, :, :]) ** 2 * both).sum(axis=2)
            shared = both.sum(axis=2)
            dist = np.where(shared > 0, sq * len(columns) / np.maximum(shared, 1), np.inf)
            for c in range(len(columns)):
                for i, r in enumerate(part):
                    if known[r, c]:
                        continue
                    d = np.where(known[:, c], dist[i], np.inf)
                    best = np.argsort(d, kind="stable")[:k]
                    best = best[np.isfinite(d[best])]
                    if len(best):
                        out[r, c] = x[best, c].mean()
        pdf[columns] = out
        return pdf
    filled = df.groupBy(key).applyInPandas(run, df.schema)
    return filled.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in columns else c for c in df.columns])


def pattern_grams(df: DataFrame, columns: list[str], means: list[float]) -> DataFrame:
    """(pattern, gram): for each pattern of gaps the products of (1, values around the means) summed over its rows, gaps as zeros, row by row in one array.

    `pattern` has bit k set where column k is missing.  One pass, combined map-side: as many rows as there are patterns, at most 2^columns.
    """
    z = [F.lit(1.0)] + [F.coalesce(F.col(c).cast("double") - m, F.lit(0.0)) for c, m in zip(columns, means)]
    pattern = F.lit(0).cast("long")
    for k, c in enumerate(columns):
        pattern = pattern + F.when(F.col(c).isNull(), 1 << k).otherwise(0)
    d = len(z)
    rows = df.select(pattern.alias("pattern"), *[e.alias(f"_z{i}") for i, e in enumerate(z)])
    sums = rows.groupBy("pattern").agg(*[F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"_g{i}_{j}") for i in range(d) for j in range(i, d)])
    return sums.select("pattern", F.array(*[f"_g{min(i, j)}_{max(i, j)}" for i in range(d) for j in range(d)]).alias("gram"))


def completion(pattern: int, d: int, steps: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """What a row of the pattern is after the steps, as a matrix on its known (1, values): a step sets column k, if missing, to its coefficients times the row."""
    a = np.eye(d + 1)
    for k in range(d):
        if pattern >> k & 1:
            a[k + 1] = 0                                    # the start: the column's mean, around which values are taken
    for k, coefficients in steps:
        if pattern >> k & 1:
            a[k + 1] = coefficients @ a
    return a


def regression_fill(df: DataFrame, columns, rounds: int = 10, ridge: float = 1e-3, tolerance: float = 0.0) -> DataFrame:
    """Round-robin imputation: starting from column means, each column's gaps are predicted by a linear fit on the others as they stand, over the rows that have it.

    A fit takes (C + ridge diag C) b = q of the others' covariances C, so units don't matter.  As every fill is linear, a row's filled columns are a fixed matrix of its known ones
    for each pattern of gaps.  So the rows are read once for the products of each pattern and once to be filled; what the rounds work on are these products, and the result is that of
    fitting row by row, column after column.  A round that moves no coefficient by more than `tolerance` ends the rounds.  A column without any value stays null and helps nowhere; a
    row without any value gets what the means lead to.  Up to 12 columns the products (4,096 patterns at most) are worked on by the driver, beyond by a job for each fit.
    """
    columns = list(columns)
    found = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{k}") for k, c in enumerate(columns)]).first()       # one row
    columns = [c for k, c in enumerate(columns) if found[k] is not None]
    means = [m for m in found if m is not None]
    d = len(columns)
    if d < 2:
        return df.fillna(dict(zip(columns, means)))
    table = checkpointed(pattern_grams(df, columns, means))
    local = [(r.pattern, np.array(r.gram).reshape(d + 1, d + 1)) for r in table.collect()] if d <= 12 else None

    def total(rows, k, steps):
        g = np.zeros((d + 1, d + 1))
        for pattern, gram in rows:
            if not pattern >> k & 1:
                a = completion(pattern, d, steps)
                g += a @ gram @ a.T
        return g

    def gram_of(k, steps):
        """Products of the completed rows that have column k."""
        if local is not None:
            return total(local, k, steps)

        def run(frames):
            for f in frames:
                yield pd.DataFrame({"at": np.arange((d + 1) ** 2), "v": total(((p, np.array(g).reshape(d + 1, d + 1)) for p, g in zip(f["pattern"], f["gram"])), k, steps).ravel()})
        sums = table.mapInPandas(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()      # (columns + 1)^2 numbers
        g = np.zeros((d + 1) ** 2)
        g[sums["at"]] = sums["v"]
        return g.reshape(d + 1, d + 1)

    steps, before = [], None
    for _ in range(rounds):
        now = []
        for k in range(d):
            g = gram_of(k, steps)
            others = [i for i in range(1, d + 1) if i != k + 1]
            n, mean = g[0, 0], g[0] / g[0, 0]
            cov = g / n - np.outer(mean, mean)
            c, q = cov[np.ix_(others, others)], cov[others, k + 1]
            slopes = np.linalg.lstsq(c + ridge * np.diag(np.diag(c)), q, rcond=1e-12)[0]
            coefficients = np.zeros(d + 1)
            coefficients[others] = slopes
            coefficients[0] = mean[k + 1] - mean[others] @ slopes
            steps.append((k, coefficients))
            now.append(coefficients)
        if before is not None and np.abs(np.array(now) - np.array(before)).max() <= tolerance:
            break
        before = now

    def compose(frames):
        for f in frames:
            yield pd.DataFrame({"pattern": f["pattern"], "fill": [completion(p, d, steps)[1:].tolist() for p in f["pattern"]]})
    fills = table.select("pattern").mapInPandas(compose, "pattern long, fill array<array<double>>").withColumnRenamed("pattern", "_pattern")
    pattern = F.lit(0).cast("long")
    for k, c in enumerate(columns):
        pattern = pattern + F.when(F.col(c).isNull(), 1 << k).otherwise(0)
    known = F.array(F.lit(1.0), *[F.coalesce(F.col(c).cast("double") - m, F.lit(0.0)) for c, m in zip(columns, means)])
    out = df.withColumns({"_gaps": pattern, "_known": known}).join(fills, F.col("_gaps") == F.col("_pattern"))
    value = lambda k: F.aggregate(F.zip_with(F.get("fill", k), "_known", lambda u, v: u * v), F.lit(means[k]), lambda s, v: s + v)
    filled = {c: F.when(F.col(c).isNull(), value(k).cast(df.schema[c].dataType)).otherwise(F.col(c)) for k, c in enumerate(columns)}
    return out.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def quantile_trim(df: DataFrame, columns, low=0.01, high=0.99, keys=("symbol",)) -> DataFrame:
    """Keep rows inside the quantiles, one column after the other: later bounds see earlier cuts."""
    for c in columns:
        bounds = df.groupBy(*keys).agg(F.percentile(c, F.array(F.lit(low), F.lit(high))).alias("_b"))
        df = df.join(bounds, list(keys)).where(F.col(c).between(F.col("_b")[0], F.col("_b")[1])).drop("_b")
    return df


def clean_prices(df: DataFrame, columns, keys=("symbol",), ts="ts") -> DataFrame:
    """Fill forward, then backward, trim outliers column by column, drop what is still missing."""
    filled = _fill(df, columns, lambda s, x: F.coalesce(forward(s, x), backward(s, x)), keys, ts)
    return quantile_trim(filled, columns, keys=keys).dropna()


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """First row per key in the given order, found with a map-side aggregate of whole rows."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def repair_bars(df: DataFrame, order, prices=("open", "high", "low", "close"), keys=("symbol", "ts")) -> DataFrame:
    """Keep-first on (symbol, ts), negative prices to null, prices filled forward, volume zero-filled."""
    once = keep_first(df, list(keys), list(order))
    once = once.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in prices}).fillna(0, ["volume"])
    return _fill(once, list(prices), forward, (keys[0],), keys[1])
