"""Mutual information of two continuous columns from nearest-neighbour distances (Kraskov's first estimator), for tables of any size.

Points of a feature are (x, y) in units of their deviations; distances are the larger of the two differences.  Equal points are one row with a count.

1. The plane is cut into strips of x and cells of y within a strip, by approximate quantiles.  Any cut gives the same result; it only has to share out the work.
2. Each point finds its k nearest within its cell, by a sweep over the cell in the order of y.  That distance, or the one to a bounded sample of the points if it is less, is an
   upper bound.  The square around the point that has it as half side is closed: cells that it meets, mostly none, return their points inside it, and the k nearest of all are exact.
3. How many points lie nearer in x (or y) alone are differences of running counts: bounds and values meet in strips of x (or y), and a strip with many bounds is dealt out
   to several tasks, each with the strip's values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.functions.stats import digamma
from quantloom.session import checkpointed

CELL, SAMPLE, SHARE = 8192, 512, 100_000        # points of a cell, points of the sample, bounds of a task: they share out work and change no result


def place_in(edges: Column, v: Column) -> Column:
    """How many of the sorted edges are below v, by halving."""
    low_high = F.struct(F.lit(0).alias("low"), F.size(edges).alias("high"))

    def halve(s, _):
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = (s["low"] < s["high"]) & (F.get(edges, middle) < v)
        return F.struct(F.when(below, middle + 1).otherwise(s["low"]).alias("low"), F.when((s["low"] < s["high"]) & ~below, middle).otherwise(s["high"]).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(16)), low_high, halve)["low"]          # up to 65,536 edges


def edges_of(df: DataFrame, by: list[str], v: str, pieces: int, name: str) -> DataFrame:
    """(by, name): the approximate quantiles that cut v into `pieces`; a hot value may stand twice, which only leaves a piece empty."""
    if pieces == 1:
        return df.select(*by).distinct().withColumn(name, F.array().cast("array<double>"))
    return df.groupBy(*by).agg(F.array_distinct(F.percentile_approx(v, [i / pieces for i in range(1, pieces)], 10 * pieces)).alias(name))


def by_finer_axis(f: pd.DataFrame) -> tuple[pd.DataFrame, str, str]:
    """The rows in the order of the axis with more different values, that axis and the other: a value that many points share would make a sweep along it long."""
    u, v = ("x", "y") if f["x"].nunique() > f["y"].nunique() else ("y", "x")
    return f.sort_values(u, kind="stable"), u, v


def _insert(best: np.ndarray, at: np.ndarray, d: np.ndarray, m: np.ndarray) -> None:
    """Puts distances d, each m times, among the sorted k best of the rows `at`."""
    k = best.shape[1]
    for t in range(k):
        use = (m > t) & (d < best[at, -1])
        if not use.any():
            return
        rows = at[use]
        best[rows] = np.sort(np.column_stack((best[rows], d[use])), axis=1)[:, :k]


def sweep(y: np.ndarray, x: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distances of each point to the others, m - 1 of which are its own copies; points are sorted by y.  A point stops when what follows is further in y than its k-th."""
    n = len(x)
    best = np.full((n, k), np.inf)
    best[np.arange(k)[None, :] < (m - 1)[:, None]] = 0.0
    for side in (1, -1):
        active, o = np.arange(n), 0
        while len(active):
            o += 1
            other = active + side * o
            inside = (other >= 0) & (other < n)
            active, other = active[inside], other[inside]
            dy = np.abs(y[other] - y[active])
            near = dy < best[active, -1]
            active, other, dy = active[near], other[near], dy[near]
            _insert(best, active, np.maximum(dy, np.abs(x[other] - x[active])), m[other])
    return best


def within(py: np.ndarray, px: np.ndarray, pm: np.ndarray, qy: np.ndarray, qx: np.ndarray, r: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distances below r of each query to the points, which are sorted by y."""
    best = np.repeat(r[:, None], k, axis=1)
    first, last = np.searchsorted(py, qy - r, "left"), np.searchsorted(py, qy + r, "right")
    active, o = np.arange(len(qx)), 0
    while True:
        active = active[first[active] + o < last[active]]
        if not len(active):
            return best
        p = first[active] + o
        _insert(best, active, np.maximum(np.abs(px[p] - qx[active]), np.abs(py[p] - qy[active])), pm[p])
        o += 1


def kth_distances(points: DataFrame, k: int) -> DataFrame:
    """(feature, x, y, m, r): the distance of each point to its k-th nearest other; points are (feature, x, y, m), all different."""
    points = checkpointed(points)
    most = points.groupBy("feature").count().agg(F.max("count").alias("n")).first().n or 0          # one number, which only shares out work
    pieces = min(max(1, math.ceil(math.sqrt(most / CELL))), 4096)
    strips = edges_of(points, ["feature"], "x", pieces, "_xe")
    placed = points.join(strips, "feature").withColumn("strip", place_in(F.col("_xe"), F.col("x"))).drop("_xe")
    ys = checkpointed(edges_of(placed, ["feature", "strip"], "y", pieces, "_ye"))
    placed = placed.join(ys, ["feature", "strip"]).withColumn("cell", place_in(F.col("_ye"), F.col("y"))).drop("_ye")
    some = points.where(F.pmod(F.xxhash64("x", "y"), F.lit(max(1, most // SAMPLE))) == 0)                    # about SAMPLE points
    first = F.row_number().over(Window.partitionBy("feature").orderBy(F.xxhash64("y", "x"), "x", "y"))
    sample = some.select("feature", "x", "y", first.alias("_n")).where(F.col("_n") <= SAMPLE).groupBy("feature").agg(F.collect_list(F.struct("x", "y")).alias("_s"))
    kind = points.schema["feature"].dataType.simpleString()
    head = f"feature {kind}, strip int, cell int, x double, y double, m long"

    def own(f: pd.DataFrame) -> pd.DataFrame:
        f, u, v = by_finer_axis(f)
        best = sweep(f[u].to_numpy(), f[v].to_numpy(), f["m"].to_numpy(), k)
        return f[["feature", "strip", "cell", "x", "y", "m"]].assign(best=list(best))

    inner = checkpointed(placed.groupBy("feature", "strip", "cell").applyInPandas(own, head + ", best array<double>"))

    def bounded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            r = np.array(f["best"].tolist()).reshape(len(f), k)[:, -1] if len(f) else np.empty(0)
            for feature, g in f.groupby("feature", sort=False):
                at = f.index.get_indexer(g.index)
                s = g["_s"].iloc[0]
                if s is not None and len(s):
                    sx, sy = (np.array([p[c] for p in s], float) for c in ("x", "y"))
                    d = np.maximum(np.abs(g["x"].to_numpy()[:, None] - sx), np.abs(g["y"].to_numpy()[:, None] - sy))
                    d[d == 0] = np.inf                                    # the point itself
                    order = np.sort(d, axis=1)
                    if order.shape[1] >= k:
                        r[at] = np.minimum(r[at], np.nextafter(order[:, k - 1], np.inf))
            yield f.drop(columns="_s").assign(r=r)

    asked = inner.join(sample, "feature", "left").mapInPandas(bounded, head + ", best array<double>, r double")
    asked = checkpointed(asked)
    wide = asked.where("r > 0").join(strips, "feature").select("feature", F.col("strip").alias("_strip"), F.col("cell").alias("_cell"), "x", "y", "r", F.explode(F.sequence(
        place_in(F.col("_xe"), F.col("x") - F.col("r")), place_in(F.col("_xe"), F.col("x") + F.col("r")))).alias("strip"))
    wide = wide.join(ys, ["feature", "strip"]).withColumn("cell", F.explode(F.sequence(place_in(F.col("_ye"), F.col("y") - F.col("r")), place_in(F.col("_ye"), F.col("y") + F.col("r")))))
    others = wide.where("strip <> _strip OR cell <> _cell").select("feature", "strip", "cell", "x", "y", "r")

    def answer(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame(columns=["feature", "x", "y", "more"])
        p, u, v = by_finer_axis(p)
        best = within(p[u].to_numpy(), p[v].to_numpy(), p["m"].to_numpy(), q[u].to_numpy(), q[v].to_numpy(), q["r"].to_numpy(), k)
        return q[["feature", "x", "y"]].assign(more=list(best))

    keys = ["feature", "strip", "cell"]
    found = others.groupBy(*keys).cogroup(inner.select(*keys, "x", "y", "m").groupBy(*keys)).applyInPandas(answer, f"feature {kind}, x double, y double, more array<double>")
    more = found.groupBy("feature", "x", "y").agg(F.flatten(F.collect_list("more")).alias("more"))           # k for each cell that the square meets
    every = F.array_sort(F.concat("best", F.coalesce("more", F.array().cast("array<double>"))))
    return asked.join(more, ["feature", "x", "y"], "left").select("feature", "x", "y", "m", F.get(every, k - 1).alias("r"))


def counts_within(points: DataFrame, v: str, pieces: int) -> DataFrame:
    """(feature, x, y, n): how many rows other than the point's own lie within r in `v` alone: nearer than r (by more than rounding, 1e-10 of it), or equal where r is 0."""
    values = points.groupBy("feature", F.col(v).alias("v")).agg(F.sum("m").alias("c"))
    edges = edges_of(values, ["feature"], "v", pieces, "_e")
    zero, r = F.col("r") == 0, F.col("r") * (1 - 1e-10)
    bounds = points.select("feature", "x", "y", F.explode(F.array(
        F.struct(F.lit(-1).alias("sign"), F.when(zero, F.col(v)).otherwise(F.col(v) - r).alias("v"), F.when(zero, -1).otherwise(1).alias("after")),
        F.struct(F.lit(1).alias("sign"), F.when(zero, F.col(v)).otherwise(F.col(v) + r).alias("v"), F.when(zero, 1).otherwise(-1).alias("after")))).alias("b")).select("feature", "x", "y", "b.*")
    put = lambda d: d.join(edges, "feature").withColumn("strip", place_in(F.col("_e"), F.col("v"))).drop("_e")
    values, bounds = checkpointed(put(values)), checkpointed(put(bounds))
    tasks = bounds.groupBy("feature", "strip").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("tasks"))
    dealt = bounds.join(tasks, ["feature", "strip"]).withColumn("task", F.pmod(F.xxhash64("x", "y"), F.col("tasks")).cast("int")).drop("tasks")
    copies = values.join(tasks, ["feature", "strip"]).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    none = F.lit(None).cast("double")
    rows = dealt.select("feature", "strip", "task", "v", "after", "sign", "x", "y", F.lit(0).cast("long").alias("c")).unionByName(
        copies.select("feature", "strip", "task", "v", F.lit(0).alias("after"), F.lit(0).alias("sign"), none.alias("x"), none.alias("y"), "c"))
    upto = Window.partitionBy("feature", "strip", "task").orderBy("v", "after").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("feature").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)            # a row for each strip
    held = values.groupBy("feature", "strip").agg(F.sum("c").alias("c"))
    every = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("_e"))).alias("strip")).join(held, ["feature", "strip"], "left")
    every = every.select("feature", "strip", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    seen = rows.withColumn("seen", F.sum("c").over(upto)).where("sign <> 0").join(every, ["feature", "strip"])
    return seen.groupBy("feature", "x", "y").agg((F.sum(F.col("sign") * (F.col("seen") + F.col("base"))) - 1).alias("n"))


def neighbour_information(df: DataFrame, features: list[str], target: str, k: int = 3) -> DataFrame:
    """(feature, mi, n): mutual information in nats of each feature with the target, 0 at least, from the k-th nearest neighbours.

    Rows with a null in any of the columns are left out.  Columns are taken in units of their population deviation; a constant column tells nothing.  Ties need no noise: a point
    that has k copies has distance 0, and counts the rows with an equal value.  With k rows or fewer mi is null.
    """
    rows = df.dropna(subset=[*features, target]).select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, target])])
    scales = rows.agg(F.count(F.lit(1)).alias("_rows"), *[f(c).alias(f"_{n}_{c}") for c in rows.columns for n, f in (("s", F.stddev_pop), ("m", F.avg))])
    unit = lambda c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0)
    long = rows.join(F.broadcast(scales), F.lit(True)).select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), unit(c).alias("x"), unit(target).alias("y")) for c in features])))     # one row
    points = checkpointed(long.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("m")))
    r = checkpointed(kth_distances(points, k).where("r IS NOT NULL AND r < double('inf')"))
    pieces = min(max(1, (r.groupBy("feature").count().agg(F.max("count").alias("n")).first().n or 0) // SHARE + 1), 4096)
    nx, ny = (counts_within(r, v, pieces).withColumnRenamed("n", f"n{v}") for v in ("x", "y"))
    d = r.join(nx, ["feature", "x", "y"]).join(ny, ["feature", "x", "y"])
    n = F.sum("m")
    mean = F.sum(F.col("m") * (digamma(F.col("nx") + 1) + digamma(F.col("ny") + 1))) / n
    known = d.groupBy("feature").agg(F.greatest(F.lit(0.0), digamma(n.cast("double")) + digamma_of(k) - mean).alias("mi"), n.alias("n"))
    names = points.groupBy("feature").agg(F.sum("m").alias("rows"))
    return names.join(known, "feature", "left").select("feature", "mi", F.col("rows").alias("n"))


def digamma_of(k: int) -> float:
    return -0.5772156649015329 + sum(1 / i for i in range(1, k))
