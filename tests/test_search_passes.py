"""Trees of a search read the rows once: rows of equal bins are added up before the levels."""

from pyspark.sql import functions as F

from quantloom.operators import search as SE


def test_rows_of_equal_bins_are_added_up_once(spark, monkeypatch):
    rows = [(f, side, float(i % 7), float(i % 5), float(i % 11)) for f in (0, 1) for i in range(600) for side in ("train" if i % 3 else "test",)]
    folds = spark.createDataFrame(rows, "fold int, side string, u double, v double, y double")
    kept, store = [], SE.checkpointed

    def record(df):
        out = store(df)
        kept.append(out)
        return out
    monkeypatch.setattr(SE, "checkpointed", record)
    todo = SE.candidates({"tree": {"depth": [1, 2], "min_rows": [20], "bins": [4]}})
    assert SE.tree_scores(folds, ["u", "v"], "y", todo).count() == 4
    base = [d for d in kept if "at" in d.columns]
    assert len(base) == 1
    assert base[0].count() <= 2 * 2 * 4 ** 2 and base[0].agg(F.sum("n")).first()[0] == len(rows)
