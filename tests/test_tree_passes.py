"""Tree models work out their rows once, whatever their number of passes."""

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import selection as SL
from quantloom.plans import learning as P

FEATURES = ["l1", "l2", "m5", "m20"]


@pytest.fixture()
def counted(spark):
    """300 rows and the accumulator of how many rows were worked out."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    pdf = pd.DataFrame(x, columns=FEATURES).assign(symbol=1, ts=pd.date_range("1998-09-01", periods=300), ret=x[:, 0] * 3 + x[:, 2])
    made = spark.sparkContext.accumulator(0)

    def run(frames):
        for f in frames:
            made.add(len(f))
            yield f
    df = spark.createDataFrame(pdf).repartition(2)
    return df.mapInPandas(run, df.schema), made


def test_forest_reads_its_rows_once(counted):
    df, made = counted
    scores = {r.feature: r.importance for r in SL.forest_importance(df, FEATURES, "ret", 4, 2).collect()}
    assert max(scores, key=scores.get) == "l1" and made.value == 300


def test_elimination_reads_its_rows_once(counted):
    df, made = counted
    assert sorted(SL.recursive_elimination(df, FEATURES, "ret", 2, 4)) == ["l1", "m5"] and made.value == 300


@pytest.mark.parametrize("kind, p", [("gradient_boosting", {"maxIter": 2}), ("random_forest", {"numTrees": 2})])
def test_models_read_their_rows_once(spark, counted, monkeypatch, kind, p):
    df, made = counted
    monkeypatch.setattr(P, "features", lambda spark, sf_dir: df)
    r = P.scores_of(spark, "", kind, **p).first()
    assert r.n == 178 and r.r2 > 0.3 and made.value == 300
