"""Second moments of all pairs of assets that a portfolio holds.

A portfolio's assets are dealt over tiles of some hundred, a task lays two tiles out as days x assets and gets the sums of all their pairs from matrix products.  An asset's days
travel once for each tile of its portfolio and no row per pair and day is ever made, so the shuffle is the returns times the tiles; only the cells themselves are quadratic in the
assets.  A task holds two tiles and `DAYS` days of them, whatever the size of the portfolio.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

TILE, DAYS = 512, 1024
NARROW = 1e-4           # share of the sum of squares below which a variance is worked out again around the pair's own mean


def day_lists(returns: DataFrame, value: str = "ret") -> DataFrame:
    """(symbol, days, values): the non-null values of a symbol, days numbered over all symbols.  A list is as long as the calendar."""
    r = returns.where(F.col(value).isNotNull())
    calendar = r.select("ts").distinct().withColumn("_d", F.row_number().over(Window.orderBy("ts")) - 1)       # one row a day
    lists = r.join(calendar, "ts").groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("_d", F.col(value).cast("double").alias("_v")))).alias("_l"))
    return lists.select("symbol", F.col("_l._d").alias("days"), F.col("_l._v").alias("values"))


def dense(days: list, values: list, first: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of values, of their squares and counts, n days x assets from the day `first` on."""
    x, q, m = (np.zeros((n, len(days))) for _ in range(3))
    for k, (d, v) in enumerate(zip(days, values)):
        a, b = np.searchsorted(d, (first, first + n))
        at, v = d[a:b] - first, v[a:b]
        np.add.at(x[:, k], at, v)
        np.add.at(q[:, k], at, v * v)
        np.add.at(m[:, k], at, 1.0)
    return x, q, m


def common(da, xa, db, xb):
    """The values of two assets on the days that both have."""
    j = pd.DataFrame({"d": da, "x": xa}).merge(pd.DataFrame({"d": db, "y": xb}), on="d")
    return j["x"].to_numpy(), j["y"].to_numpy()


def plain_cells(a, b, weights) -> dict[str, np.ndarray]:
    """n, sample covariance and correlation of the assets of two tiles, each (days, values)."""
    centred = [[v - v.mean() for v in t[1]] for t in (a, b)]
    n, sx, sy, sxx, syy, sxy = (np.zeros((len(a[0]), len(b[0]))) for _ in range(6))
    for first in range(0, 1 + max(d[-1] for d in [*a[0], *b[0]]), DAYS):
        x, xx, mx = dense(a[0], centred[0], first, DAYS)
        y, yy, my = dense(b[0], centred[1], first, DAYS)
        for total, left, right in ((n, mx, my), (sx, x, my), (sy, mx, y), (sxx, xx, my), (syy, mx, yy), (sxy, x, y)):
            total += left.T @ right
    with np.errstate(divide="ignore", invalid="ignore"):
        c, vx, vy = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
    for i, j in zip(*np.nonzero((n > 1) & ((vx <= NARROW * sxx) | (vy <= NARROW * syy)))):
        x, y = common(a[0][i], centred[0][i], b[0][j], centred[1][j])
        # equal values vary by nothing, also where their mean is rounded
        x, y = (np.zeros(len(v)) if v.min() == v.max() else v - v.mean() for v in (x, y))
        c[i, j], vx[i, j], vy[i, j] = (x * y).sum(), (x * x).sum(), (y * y).sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        return {"n": n, "cov": np.where(n > 1, c / (n - 1), np.nan), "corr": np.where((n > 1) & (vx > 0) & (vy > 0), c / np.sqrt(vx * vy), np.nan)}


def weighted_cells(a, b, weights) -> dict[str, np.ndarray]:
    """n and sum(w x y) / sum(w) of the assets of two tiles; weights is (days, w)."""
    n, sw, sxy = (np.zeros((len(a[0]), len(b[0]))) for _ in range(3))
    for first in range(0, 1 + max(d[-1] for d in [*a[0], *b[0]]), DAYS):
        w, _, _ = dense([weights[0]], [weights[1]], first, DAYS)
        x, _, mx = dense(*a, first, DAYS)
        y, _, my = dense(*b, first, DAYS)
        for total, left, right in ((n, mx, my), (sw, mx, w * my), (sxy, x, w * y)):
            total += left.T @ right
    with np.errstate(divide="ignore", invalid="ignore"):
        return {"n": n, "cov": sxy / sw}


def held_cells(lists: DataFrame, weights: DataFrame, cells, names: list[str], portfolio: str = "portfolio", day_weights: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """(portfolio, i, j, n, *names) with i <= j: the cells of each portfolio's matrix that have a common day.

    `lists` are the assets' days and values, `day_weights` (portfolio, days, values) those of a portfolio.  Repeated holdings count once.
    """
    held = weights.select(F.col(portfolio).alias("_p"), "symbol").distinct().join(lists.select("symbol"), "symbol")
    sizes = held.groupBy("_p").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_tiles"), F.min("symbol").alias("_any"))
    placed = held.join(sizes, "_p").withColumn("_t", F.pmod(F.xxhash64("symbol"), "_tiles").cast("int")).join(lists, "symbol")

    def rows(df: DataFrame, side: int, a: Column, b: Column, symbol: Column) -> DataFrame:
        return df.select("_p", a.alias("_a"), b.alias("_b"), F.lit(side).alias("_side"), symbol.alias("symbol"), "days", "values")
    own, last = F.col("_t"), F.col("_tiles") - 1
    left = placed.withColumn("_o", F.explode(F.sequence(own, last)))
    right = placed.where("_t > 0").withColumn("_o", F.explode(F.sequence(F.lit(0), own - 1)))
    both = rows(left, 0, own, F.col("_o"), F.col("symbol")).unionByName(rows(right, 1, F.col("_o"), own, F.col("symbol")))
    if day_weights is not None:
        grid = day_weights.withColumnRenamed(portfolio, "_p").join(sizes, "_p").withColumn("_t", F.explode(F.sequence(F.lit(0), last)))
        grid = grid.withColumn("_o", F.explode(F.sequence(own, last)))
        both = both.unionByName(rows(grid, 2, own, F.col("_o"), F.col("_any")))           # some symbol: a null would turn whole numbers into floats

    def run(key, pdf):
        sides = []
        for s in range(3):
            part = pdf[pdf["_side"] == s]
            sides.append((part["symbol"].to_numpy(), [np.asarray(d) for d in part["days"]], [np.asarray(v) for v in part["values"]]))
        (si, *a), (sj, *b), (_, *w) = sides
        same = key[1] == key[2]
        if same:
            sj, b = si, a
        out = pd.DataFrame(columns=["_p", "i", "j", "n", *names])
        if len(si) and len(sj):
            found = cells(a, b, (w[0][0], w[1][0]) if w[0] else None)
            at = np.nonzero((found["n"] > 0) & ((si[:, None] <= sj[None, :]) if same else True))
            i, j = si[at[0]], sj[at[1]]
            swap = i > j
            out = pd.DataFrame({"_p": key[0], "i": np.where(swap, j, i), "j": np.where(swap, i, j), "n": found["n"][at].round().astype(np.int64), **{c: found[c][at] for c in names}})
        return out
    kinds = {c: both.schema[c].dataType.simpleString() for c in ("_p", "symbol")}
    schema = f"_p {kinds['_p']}, i {kinds['symbol']}, j {kinds['symbol']}, n long, " + ", ".join(f"{c} double" for c in names)
    return both.groupBy("_p", "_a", "_b").applyInPandas(run, schema).withColumnRenamed("_p", portfolio)


def held_covariance(returns: DataFrame, weights: DataFrame, portfolio: str = "portfolio", tile: int = TILE) -> DataFrame:
    """(portfolio, i, j, n, cov, corr) of all pairs i <= j of a portfolio's assets over the days that both have."""
    return held_cells(day_lists(returns), weights, plain_cells, ["cov", "corr"], portfolio, tile=tile)


def one_portfolio_each(weights: DataFrame, portfolio: str = "portfolio") -> bool:
    return weights.select(portfolio, "symbol").distinct().groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()


def held_asset_covariance(returns: DataFrame, weights: DataFrame, portfolio: str = "portfolio", tile: int = TILE) -> DataFrame:
    """(i, j, n, cov, corr) of the pairs that some portfolio holds, each once."""
    out = held_covariance(returns, weights, portfolio, tile).drop(portfolio)
    return out if one_portfolio_each(weights, portfolio) else out.dropDuplicates(["i", "j"])


def held_shrunk_covariance(returns: DataFrame, weights: DataFrame, share=0.1, portfolio: str = "portfolio", tile: int = TILE) -> DataFrame:
    """(portfolio, i, j, cov): (1-share) S + share (mean variance of its assets) I."""
    own = returns.where(F.col("ret").isNotNull()).groupBy("symbol").agg(F.var_samp("ret").alias("_v"))
    mean = weights.select(portfolio, "symbol").distinct().join(own, "symbol").groupBy(portfolio).agg(F.avg("_v").alias("_t"))
    c = held_covariance(returns, weights, portfolio, tile).join(F.broadcast(mean), portfolio)              # one row per portfolio
    s = (1 - share) * F.col("cov") + F.when(F.col("i") == F.col("j"), share * F.col("_t")).otherwise(0.0)
    return c.select(portfolio, "i", "j", s.alias("cov"))


def around_middle(lists: DataFrame) -> DataFrame:
    """`lists` with the values around their lower median.  The median is the variable of an outer transform: as a column it would be put into the inner one and a list sorted once for each value."""
    middle = F.element_at(F.sort_array("values"), F.ceil(F.size("values") / 2).cast("int"))
    return lists.select("symbol", "days", F.element_at(F.transform(F.array(middle), lambda m: F.transform("values", lambda v: v - m)), 1).alias("values"))


def held_robust_covariance(lists: DataFrame, weights: DataFrame, threshold: float, portfolio: str = "portfolio", tile: int = TILE) -> DataFrame:
    """(portfolio, i, j, n, cov) as `metrics.robust_asset_covariance` states it; `lists` (symbol, days, values) are read three times."""
    x = around_middle(lists)
    held = weights.select(portfolio, "symbol").distinct()
    rows = held.join(x, "symbol").select(portfolio, F.inline(F.arrays_zip("days", "values"))).toDF(portfolio, "_d", "_x")
    norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")))
    days = rows.groupBy(portfolio, "_d").agg(F.when(norm > threshold, threshold / norm).otherwise(1.0).alias("_w"))
    days = days.groupBy(portfolio).agg(F.sort_array(F.collect_list(F.struct("_d", "_w"))).alias("_l")).select(portfolio, F.col("_l._d").alias("days"), F.col("_l._w").alias("values"))
    return held_cells(x, weights, weighted_cells, ["cov"], portfolio, days, tile)
