"""Spread of predictions over bootstrap replicates and trees, against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

from quantloom.operators import uncertainty as UC
from quantloom.operators.selection import POISSON_STEPS, integer_weights


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    d = pd.DataFrame({"key": np.arange(400) * 11 - 900, "g": np.arange(400) % 3, "a": rng.normal(size=400) + 1e6, "b": rng.normal(size=400)})
    d["y"] = 2 + 0.5 * (d.a - 1e6) - d.b * (1 + d.g) + rng.normal(size=400) * 0.1
    return d


def brute(train, rows, replicates, seed, level):
    reps = np.arange(1, replicates + 1)
    w = integer_weights(train.key.to_numpy(), reps, seed)
    x = np.column_stack([np.ones(len(train)), train.a - 1e6, train.b])
    p = []
    for r in range(replicates):
        beta = np.linalg.lstsq(x * np.sqrt(w[:, r])[:, None], train.y * np.sqrt(w[:, r]), rcond=None)[0]
        p.append(beta[0] + beta[1] * (rows.a - 1e6) + beta[2] * rows.b)
    p = np.array(p)
    return p.mean(axis=0), p.std(axis=0), *np.percentile(p, [50 * (1 - level), 50, 50 * (1 + level)], axis=0)


@pytest.mark.parametrize("group", [(), ("g",)])
def test_bootstrap_as_by_refitting(spark, rows, group):
    df = spark.createDataFrame(rows).repartition(5)
    train = df.where("b > -1.5")
    got = UC.bootstrap_intervals(train, df, ["a", "b"], "y", "key", group, replicates=60, level=0.9, seed=5).toPandas().sort_values("key")
    assert len(got) == len(rows) and set(got.n_models) == {60}
    for _, part in (rows.groupby("g") if group else [(0, rows)]):
        mine = got[got.key.isin(part.key)]
        for name, want in zip(("mean", "sd", "low", "middle", "high"), brute(part[part.b > -1.5], part, 60, 5, 0.9)):
            assert np.allclose(mine[name], want, rtol=0, atol=1e-7), name


def test_draws_do_not_depend_on_partitions(spark, rows):
    df = spark.createDataFrame(rows)
    a, b = (UC.bootstrap_models(df.repartition(n), ["a", "b"], "y", "key", replicates=7).first().models for n in (1, 6))
    assert np.allclose([m.alpha for m in a], [m.alpha for m in b], rtol=1e-9)
    w = integer_weights(np.arange(30000) * 13 - 77, np.arange(1, 41), 9)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and w.max() >= 7 and len(POISSON_STEPS) == 12
    share = [(w == k).mean() for k in range(4)]
    assert np.allclose(share, np.exp(-1) / np.array([1, 1, 2, 6]), atol=0.004)
    assert np.abs(np.corrcoef(w.T) - np.eye(40)).max() < 0.03


def test_bootstrap_on_odd_rows(spark):
    schema = "key long, g int, a double, b double, y double"
    df = spark.createDataFrame([(i, 0, float(i), float(i * i % 7), float(i)) for i in range(30)] + [(100 + i, 1, 1.0, 2.0, 3.0) for i in range(9)] +
                               [(200, 0, None, 1.0, 1.0), (201, 0, 1.0, 1.0, None), (202, None, 1.0, 1.0, 1.0), (3, 0, 3.0, 2.0, 3.0)], schema)
    got = {(r.key, r.g): r for r in UC.bootstrap_intervals(df, df, ["a", "b"], "y", "key", ["g"], replicates=20).collect()}
    assert got[5, 0].n_models == 20 and abs(got[5, 0].mean - 5) < 1e-9 and got[201, 0].n_models == 20
    assert got[200, 0].n_models == 0 and got[200, 0].mean is None                        # no feature
    assert got[100, 1].n_models == 0 and got[202, None].low is None                      # no unique fit, no group
    assert UC.bootstrap_intervals(df.limit(0), df, ["a"], "y", "key").where("n_models > 0").count() == 0
    with pytest.raises(ValueError):
        UC.bootstrap_intervals(df, df, ["a"], "y", "key", level=1.0)


def test_forest_spread(spark, rows):
    df = spark.createDataFrame(rows).repartition(4)
    va = VectorAssembler(inputCols=["a", "b"], outputCol="x")
    model = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=9, maxDepth=4, seed=1).fit(va.transform(df))
    got = UC.forest_intervals(model, df, ["a", "b"]).toPandas().sort_values("key")
    own = model.transform(va.transform(df)).toPandas().sort_values("key")
    assert np.allclose(got["mean"], own.prediction, rtol=0, atol=1e-12) and set(got.n_trees) == {9}
    by_tree = np.array([t.transform(va.transform(df)).toPandas().sort_values("key").prediction for t in model.trees])
    assert np.allclose(got["sd"], by_tree.std(axis=0), atol=1e-12)
    assert np.allclose(got.high_95 - got["mean"], 1.96 * got["sd"]) and np.allclose(got["mean"] - got.low_99, 2.576 * got["sd"])
    outputs = UC.tree_outputs(df, UC.forest_table(model), ["a", "b"], 4).toPandas().sort_values("key").outputs
    assert np.allclose(np.array(outputs.tolist()).T, by_tree)
    plan = UC.forest_intervals(model, df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_forest_on_odd_rows(spark, rows):
    df = spark.createDataFrame(rows)
    va = VectorAssembler(inputCols=["a", "b"], outputCol="x")
    stump = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=3, maxDepth=0, seed=1).fit(va.transform(df))        # leaves only
    one = spark.createDataFrame([(1, None, 2.0), (2, 1.0, 1e9)], "key long, a double, b double")
    got = {r.key: r for r in UC.forest_intervals(stump, one, ["a", "b"]).collect()}
    assert got[1]["mean"] is None and abs(got[2]["mean"] - rows.y.mean()) < 0.5
    with pytest.raises(ValueError):
        UC.forest_intervals(GBTRegressor(featuresCol="x", labelCol="y", maxIter=2).fit(va.transform(df)), one, ["a", "b"])
