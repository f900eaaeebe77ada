"""Spread of predictions: over bootstrap replicates of a linear model, and over the trees of a forest.

Neither fits or scores a model per replicate.  A bootstrap is one pass: tasks add up weights x products for all replicates, the replicates' normal equations
are solved by column expressions, and a row meets all models of its group as one array.  A forest is a table of nodes; a row meets it as one array of trees and
is walked down all of them by higher-order functions.  What is held per row has the length of the replicates or trees, never a row for each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quantloom.functions.linear import dot, solve_symmetric
from quantloom.functions.scalar import div
from quantloom.operators.learning import Z_LEVELS
from quantloom.operators.selection import bootstrap_sums, integer_weights
from quantloom.operators.series import Layers
from quantloom.session import shared_base


def array_quantile(values: Column, share: float) -> Column:
    """Interpolated quantile of a sorted array without nulls; null for an empty one."""
    at = (F.size(values) - 1) * share
    low = F.floor(at).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (at - low)


def array_mean(values: Column) -> Column:
    return div(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), F.size(values).cast("double"))


def array_deviation(values: Column, mean: Column) -> Column:
    """Population deviation of an array around its mean."""
    return F.sqrt(div(F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)), F.size(values).cast("double")))


def bootstrap_models(train: DataFrame, features: list[str], y: str, key: str, group=(), replicates: int = 100, seed: int = 42) -> DataFrame:
    """(group, models): for each group the array of (rep, alpha, betas) of its replicates' least-squares fits.

    `key` is a whole number that names a row; draws depend on it, the replicate and the seed only.  Rows with a null feature or target are left out.  Products are taken
    around the group's means, so large offsets cost no digits.  A replicate without a unique fit is left out.
    """
    group, names = list(group), [*features, y]
    rows = train.dropna(subset=[key, *names]).select(key, *group, *[F.col(c).cast("double").alias(c) for c in names])
    if group:
        means = rows.groupBy(*group).agg(*[F.avg(c).alias(f"_m_{c}") for c in names])
        rows = rows.join(means, group)
    else:
        one = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in names])
        rows = rows.join(F.broadcast(one), F.lit(True))                    # one row
    around = {c: F.col(c) - F.col(f"_m_{c}") for c in names}
    k = len(features)
    products = {f"s_{i}": around[c] for i, c in enumerate(features)} | {"s_y": around[y]}
    products |= {f"p_{i}_{j}": around[features[i]] * around[features[j]] for i in range(k) for j in range(i, k)}
    products |= {f"q_{i}": around[c] * around[y] for i, c in enumerate(features)}
    offsets = [f"_m_{c}" for c in names]
    sums = bootstrap_sums(rows.select(key, *group, *offsets, *[e.alias(n) for n, e in products.items()]), [key], [*group, *offsets], list(products), replicates, seed, integer_weights)
    ly, n = Layers(sums), F.col("n")
    mean = [F.col(f"s_{i}") / n for i in range(k)]
    cov = [[ly.let(F.col(f"p_{min(i, j)}_{max(i, j)}") / n - mean[i] * mean[j]) for j in range(k)] for i in range(k)]
    rhs = [ly.let(F.col(f"q_{i}") / n - mean[i] * F.col("s_y") / n) for i in range(k)]
    beta = solve_symmetric(ly.let, cov, rhs)
    alpha = F.col("s_y") / n + F.col(f"_m_{y}") - dot(beta, [m + F.col(f"_m_{c}") for m, c in zip(mean, features)])
    fits = ly.frame({"alpha": alpha, **{f"beta_{i}": b for i, b in enumerate(beta)}}, keep=[*group, "rep"]).where("alpha IS NOT NULL AND NOT isnan(alpha)")
    model = F.struct("rep", "alpha", F.array(*[f"beta_{i}" for i in range(k)]).alias("betas"))
    return fits.groupBy(*group).agg(F.array_sort(F.collect_list(model)).alias("models"))               # as many entries as replicates


def bootstrap_intervals(train: DataFrame, rows: DataFrame, features: list[str], y: str, key: str, group=(), replicates: int = 100, level: float = 0.95, seed: int = 42) -> DataFrame:
    """All columns of `rows` and, over the bootstrap replicates' predictions: mean, sd (population), low, middle, high and n_models.

    low and high are the interpolated percentiles that leave (1 - level) / 2 on either side, middle is the median.  A row of a group without a model, or with a null feature,
    has nulls and n_models 0.
    """
    if not 0 < level < 1:
        raise ValueError("level must be between 0 and 1")
    models = bootstrap_models(train, features, y, key, group, replicates, seed)
    d = rows.join(models, list(group), "left") if group else rows.join(F.broadcast(models), F.lit(True), "left")           # one row of `replicates` entries
    value = lambda m: m["alpha"] + dot([F.get(m["betas"], i) for i in range(len(features))], [F.col(c) for c in features])
    known = F.lit(True)
    for c in features:
        known = known & F.col(c).isNotNull()
    d = d.withColumn("_p", F.sort_array(F.when(known, F.transform("models", value)).otherwise(F.array().cast("array<double>"))))       # array_sort compares by an interpreted lambda
    d = d.withColumn("_p", F.coalesce("_p", F.array().cast("array<double>"))).withColumn("_mean", array_mean(F.col("_p")))
    p, half = F.col("_p"), (1 - level) / 2
    return d.select(*rows.columns, F.col("_mean").alias("mean"), array_deviation(p, F.col("_mean")).alias("sd"), array_quantile(p, half).alias("low"),
                    array_quantile(p, 0.5).alias("middle"), array_quantile(p, 1 - half).alias("high"), F.size(p).alias("n_models"))


NODE = "struct<id:int,feature:int,threshold:double,left:int,right:int,value:double>"


def forest_table(model, spark: SparkSession | None = None) -> DataFrame:
    """(tree, nodes): the trees of a fitted forest of regression trees as sorted arrays of (id, feature, threshold, left, right, value); a leaf has left -1.

    The model is written to the shared folder in its public format and read back as a table, so nothing of it passes the driver.
    """
    spark = spark or SparkSession.builder.getOrCreate()
    folder = f"{shared_base(spark)}/forest-{uuid.uuid4().hex}"
    model.write().overwrite().save(folder)
    n, split = "nodeData", "nodeData.split"
    rows = spark.read.parquet(f"{folder}/data").select(
        F.col("treeID").alias("tree"), F.struct(F.col(f"{n}.id").cast("int").alias("id"), F.col(f"{split}.featureIndex").cast("int").alias("feature"),
                                                F.get(F.col(f"{split}.leftCategoriesOrThreshold"), 0).cast("double").alias("threshold"), F.col(f"{n}.leftChild").cast("int").alias("left"),
                                                F.col(f"{n}.rightChild").cast("int").alias("right"), F.col(f"{n}.prediction").cast("double").alias("value")).cast(NODE).alias("node"))
    return rows.groupBy("tree").agg(F.array_sort(F.collect_list("node")).alias("nodes"))


def tree_outputs(rows: DataFrame, trees: DataFrame, features: list[str], depth: int, out: str = "outputs") -> DataFrame:
    """All columns of `rows` and the array `out` of the trees' values, in the order of `tree`.  Trees split continuous features at `<= threshold`; node ids count from 0.

    The trees are one array on every row, as large as the forest: trees x nodes.  A null feature gives null.
    """
    one = trees.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "nodes"))), lambda t: t["nodes"]).alias("_forest"))
    x = F.array(*[F.col(c).cast("double") for c in features])
    step = lambda nodes, at: F.when(F.get(nodes, at)["left"] < 0, at).when(
        F.get(F.col("_x"), F.get(nodes, at)["feature"]) <= F.get(nodes, at)["threshold"], F.get(nodes, at)["left"]).otherwise(F.get(nodes, at)["right"])
    walk = lambda nodes: F.get(nodes, F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), F.lit(0), lambda at, _: step(nodes, at)))["value"]
    known = F.forall("_x", lambda v: v.isNotNull())
    d = rows.withColumn("_x", x).join(F.broadcast(one), F.lit(True), "left")                              # one row
    return d.select(*rows.columns, F.when(known, F.transform("_forest", walk)).alias(out))


def forest_intervals(model, rows: DataFrame, features: list[str]) -> DataFrame:
    """All columns of `rows` and, over the trees of a fitted forest: mean, sd (population), n_trees, and mean -+ z x sd at the levels .68, .95 and .99.

    mean is the forest's own prediction.  Raises ValueError for a model that is no mean of its trees.
    """
    if not hasattr(model, "trees") or any(w != 1.0 for w in model.treeWeights):
        raise ValueError("a forest that averages its trees is needed")
    d = tree_outputs(rows, forest_table(model, rows.sparkSession), features, max(t.depth for t in model.trees), "_t").withColumn("_mean", array_mean(F.col("_t")))
    d = d.withColumn("_sd", array_deviation(F.col("_t"), F.col("_mean")))
    ends = [c for lv, z in Z_LEVELS.items() for c in ((F.col("_mean") - z * F.col("_sd")).alias(f"low_{int(lv * 100)}"), (F.col("_mean") + z * F.col("_sd")).alias(f"high_{int(lv * 100)}"))]
    return d.select(*rows.columns, F.col("_mean").alias("mean"), F.col("_sd").alias("sd"), F.size("_t").alias("n_trees"), *ends)
