"""Feature selection, reduction and importance.  Statistics are one aggregate over the feature columns; what is left
to do on the driver has the size of the column list."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from quantloom.functions.scalar import corr_of, div
from quantloom.operators.metrics import column_moments
from quantloom.session import checkpointed


def explode_columns(row: DataFrame, columns: list[str], value: str) -> DataFrame:
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias(value)) for c in columns])))


def f_scores(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, f): F statistic of a simple regression over complete rows."""
    rows = df.dropna(subset=[*features, target])
    one = rows.agg(*[((F.count(F.lit(1)) - 2) * div(corr_of(c, target) ** 2, 1 - corr_of(c, target) ** 2)).alias(c) for c in features])
    return explode_columns(one, features, "f")


def top_features(scores: DataFrame, score: str, k: int) -> DataFrame:
    return scores.orderBy(F.desc(score), "feature").limit(k)


def variances(df: DataFrame, features: list[str]) -> DataFrame:
    return explode_columns(df.agg(*[F.var_samp(c).alias(c) for c in features]), features, "variance")


def variance_filter(df: DataFrame, features: list[str], k: int, threshold=0.01) -> DataFrame:
    return top_features(variances(df, features).where(F.col("variance") > threshold), "variance", k)


def correlation_filter(df: DataFrame, features: list[str], threshold=0.95) -> DataFrame:
    """Features without an earlier one that they correlate with beyond the threshold."""
    corr = column_moments(df, features)[1]
    order = F.create_map(*[x for i, c in enumerate(features) for x in (F.lit(c), F.lit(i))])
    bad = corr.where((order[F.col("i")] < order[F.col("j")]) & (F.abs("corr") > threshold)).select(F.col("j").alias("feature")).distinct()
    every = corr.select(F.col("i").alias("feature")).distinct()
    return every.join(bad, "feature", "left_anti")


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information in nats of equal-width bins of feature and target (a binned estimate).

    Contingency counts are aggregated map-side: at most bins x bins rows per feature.
    """
    rows = df.dropna(subset=[*features, target])
    edges = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in [*features, target] for n, f in (("lo", F.min), ("hi", F.max))])
    slot = lambda c: F.least(F.coalesce(F.floor(div(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) * bins), F.lit(0)), F.lit(bins - 1))
    b = rows.join(F.broadcast(edges), F.lit(True)).select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), slot(c).alias("x")) for c in features])), slot(target).alias("y"))
    n = b.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    nx, ny, nn = (n.groupBy(*k).agg(F.sum("n").alias(a)) for k, a in ((["feature", "x"], "nx"), (["feature", "y"], "ny"), (["feature"], "total")))
    j = n.join(nx, ["feature", "x"]).join(ny, ["feature", "y"]).join(nn, "feature")
    p = F.col("n") / F.col("total")
    return j.groupBy("feature").agg(F.sum(p * F.ln(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))).alias("mi"))


def poisson_weights(row_keys: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) draws, one row per key and one column per replicate, from a 64-bit mix of key, replicate and seed.

    A draw depends on nothing else, so a retried task or another partitioning draws the same.  Thresholds end where the tail is below 2^-53.
    """
    with np.errstate(over="ignore"):
        z = row_keys.astype(np.uint64)[:, None] + (replicates.astype(np.uint64) * np.uint64(2) + np.uint64(2 * seed + 1))[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    u = (z >> np.uint64(11)) * 2.0 ** -53
    steps = np.cumsum(np.exp(-1.0) / np.array([float(math.factorial(k)) for k in range(20)]))
    return np.searchsorted(steps, u, side="right").astype(float)


def integer_weights(row_keys: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) draws like `poisson_weights`, from products modulo the prime 2^31 - 1 that stay within 63 bits, so that SQL can state them."""
    p = 2147483647
    a = np.mod(row_keys.astype(np.int64), p)[:, None]
    r = replicates.astype(np.int64)[None, :]
    x = (a * 48271 + r * 69621 + seed) % p
    for add in (r * 40692, a, r):
        x = x * x % p
        x = (x + add) % p * 16807 % p
    return np.searchsorted(POISSON_STEPS, x, side="right").astype(float)


#: Numbers below which fall 1, 2, ... of 2^31 - 1 equally likely draws of a Poisson(1) variable; they end where the tail is below one draw.
POISSON_STEPS = np.array([int(2147483647 * sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1))) for k in range(12)], np.int64)


def bootstrap_sums(rows: DataFrame, key: list[str], group: list[str], values: list[str], replicates: int, seed: int, draw=poisson_weights) -> DataFrame:
    """(group, rep, n, one weighted sum per value) of Poisson bootstraps, without a row per replicate.
    `draw` makes the weights from the hashed key; `integer_weights` takes a key of one whole-number column as it is.

    A task adds up weights x values of its rows for all replicates (one matrix product per group and batch) and puts out its sums only:
    partitions x groups x replicates rows meet in the shuffle, whatever the number of rows.
    """
    d = rows.select((F.col(key[0]).cast("long") if draw is integer_weights else F.xxhash64(*key)).alias("_key"), *group, *[F.col(v).cast("double").alias(v) for v in values])
    types = dict(d.dtypes)
    schema = ", ".join([*[f"`{g}` {types[g]}" for g in group], "rep int", "n double", *[f"`{v}` double" for v in values]])
    chunk = np.array_split(np.arange(1, replicates + 1), max(1, replicates // 50))

    def run(batches):
        total = {}
        for b in batches:
            for name, g in (b.groupby(group, sort=False, dropna=False) if group else [((), b)]):
                x = np.column_stack([np.ones(len(g)), g[values].to_numpy(float)])
                part = np.vstack([draw(g["_key"].to_numpy(), c, seed).T @ x for c in chunk])
                total[name] = total[name] + part if name in total else part
        for name, m in total.items():
            out = pd.DataFrame(m, columns=["n", *values])
            out.insert(0, "rep", np.arange(1, replicates + 1, dtype=np.int32))
            for at, g in enumerate(group):
                out.insert(at, g, name[at])
            yield out
    sums = d.mapInPandas(run, schema)
    return sums.groupBy(*group, "rep").agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in values])


def stability_selection(df: DataFrame, features: list[str], target: str, key, k: int, replicates: int = 100, seed=42, draw=poisson_weights) -> DataFrame:
    """How often each feature is among the k best by weighted correlation over Poisson bootstraps; `draw` as in `bootstrap_sums`."""
    y = F.col(target)
    products = {"_y": y, "_yy": y * y}
    for c in features:
        products |= {f"_x_{c}": F.col(c), f"_xx_{c}": F.col(c) ** 2, f"_xy_{c}": F.col(c) * y}
    rows = df.dropna(subset=[*features, target]).select(*key, *[v.alias(n) for n, v in products.items()])
    a = bootstrap_sums(rows, list(key), [], list(products), replicates, seed, draw)
    n = F.col("n")
    r2 = {}
    for c in features:
        cov = F.col(f"_xy_{c}") / n - F.col(f"_x_{c}") / n * F.col("_y") / n
        vx, vy = F.col(f"_xx_{c}") / n - (F.col(f"_x_{c}") / n) ** 2, F.col("_yy") / n - (F.col("_y") / n) ** 2
        r2[c] = F.coalesce(div(cov * cov, vx * vy), F.lit(0.0))
    ranked = F.slice(F.sort_array(F.array(*[F.struct(v.alias("r2"), F.lit(c).alias("feature")) for c, v in r2.items()]), asc=False), 1, k)
    return a.select(F.explode(ranked).alias("s")).groupBy("s.feature").agg((F.count(F.lit(1)) / replicates).alias("frequency"))


def _vector(df, features, out="_x"):
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="skip").transform(df)


def forest_importance(df: DataFrame, features: list[str], target: str, trees=100, depth=5, seed=42) -> DataFrame:
    """(feature, importance).  The rows are stored once: a forest reads its input for the size, for the splits and for the trees."""
    return _forest_importance(checkpointed(df.select(*features, target)), features, target, trees, depth, seed)


def _forest_importance(df: DataFrame, features: list[str], target: str, trees=100, depth=5, seed=42) -> DataFrame:
    from pyspark.ml.regression import RandomForestRegressor
    data = _vector(df.dropna(subset=[*features, target]), features)
    model = RandomForestRegressor(featuresCol="_x", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed).fit(data)
    rows = [(c, float(v)) for c, v in zip(features, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def correlation_importance(df: DataFrame, features: list[str], target: str) -> DataFrame:
    one = df.dropna(subset=[*features, target]).agg(*[F.abs(corr_of(c, target)).alias(c) for c in features])
    return explode_columns(one, features, "importance")


def recursive_elimination(df: DataFrame, features: list[str], target: str, k: int, trees=50, **forest) -> list[str]:
    """Drop the least important feature until k are left: one distributed forest per step, all from rows that are stored once."""
    left = list(features)
    if len(left) > k:
        df = checkpointed(df.select(*features, target))
    while len(left) > k:
        scores = {r.feature: r.importance for r in _forest_importance(df, left, target, trees, **forest).collect()}
        left.remove(min(left, key=lambda c: (scores[c], c)))
    return left


def principal_components(df: DataFrame, features: list[str], k: int, key=()) -> DataFrame:
    """Mean-filled, standardised by the sample deviation, projected; signs follow the largest loading."""
    filled = Imputer(inputCols=features, outputCols=features).fit(df).transform(df)
    vec = _vector(filled, features)
    scaled = StandardScaler(inputCol="_x", outputCol="_s", withMean=True).fit(vec).transform(vec)
    model = PCA(k=k, inputCol="_s", outputCol="_p").fit(scaled)
    pc = model.pc.toArray()
    sign = [1.0 if pc[np.abs(pc[:, i]).argmax(), i] > 0 else -1.0 for i in range(k)]
    from pyspark.ml.functions import vector_to_array
    a = vector_to_array("_p")
    return model.transform(scaled).select(*key, *[(a[i] * sign[i]).alias(f"pc_{i + 1}") for i in range(k)])


def factor_analysis(df: DataFrame, features: list[str], k: int, rounds=500) -> DataFrame:
    """(feature, factor, loading, uniqueness): covariance on Spark, EM on the features x features matrix."""
    rows = column_moments(df, features)[1].collect()
    at = {c: i for i, c in enumerate(features)}
    s = np.zeros((len(features), len(features)))
    for r in rows:
        s[at[r.i], at[r.j]] = r.corr
    values, vectors = np.linalg.eigh(s)
    load = vectors[:, -k:] * np.sqrt(np.maximum(values[-k:], 1e-6))
    psi = np.maximum(np.diag(s) - (load ** 2).sum(axis=1), 1e-3)
    for _ in range(rounds):
        scaled = load / psi[:, None]
        g = np.linalg.inv(np.eye(k) + load.T @ scaled)
        beta = g @ scaled.T
        ez = np.eye(k) - beta @ load + beta @ s @ beta.T
        load = s @ beta.T @ np.linalg.inv(ez)
        psi = np.maximum(np.diag(s - load @ beta @ s), 1e-6)
    out = [(c, j + 1, float(load[i, j]), float(psi[i])) for i, c in enumerate(features) for j in range(k)]
    return df.sparkSession.createDataFrame(out, "feature string, factor int, loading double, uniqueness double")
