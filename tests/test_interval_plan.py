"""Predictions of a row are sorted natively, without an interpreted comparison of each pair."""

from quantloom.operators import uncertainty as UC


def test_predictions_are_sorted_natively(spark, capsys):
    d = spark.createDataFrame([(i, float(i % 7), float(i % 5 + i % 7)) for i in range(200)], "key long, x double, y double")
    out = UC.bootstrap_intervals(d, d, ["x"], "y", "key", replicates=10)
    out.explain(mode="extended")
    text = capsys.readouterr().out
    assert "sort_array(" in text and "array_sort(CASE" not in text and "array_sort(transform" not in text
    assert out.where("low <= middle AND middle <= high AND n_models = 10").count() == 200
