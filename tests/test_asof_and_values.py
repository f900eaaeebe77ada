"""As-of joins and daily values against plain loops."""

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import backtest as BT, joins as J


def nearest_of(times, values, t, direction):
    """The value at the time that the direction asks for; of values at one time the largest."""
    rows = sorted(zip(times, values))
    back = [r for r in rows if r[0] <= t]
    fwd = [r for r in rows if r[0] >= t]
    b = max(back) if back else None
    f = (lambda first: max(r for r in fwd if r[0] == first))(fwd[0][0]) if fwd else None
    if direction == "backward" or (direction == "nearest" and f is None):
        return b
    if direction == "forward" or b is None:
        return f
    return f if f[0] - t <= t - b[0] else b


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("bucket", ["month", "day"])
def test_asof_as_by_a_loop(spark, direction, bucket):
    """A symbol with a third of all rows, times that several rows share on either side, empty buckets, symbols on one side only, rows without a key or time."""
    rng = np.random.default_rng(3)
    base = pd.Timestamp("2020-01-01")
    times = lambda n, span: [base + pd.Timedelta(hours=int(h)) for h in rng.integers(0, span, n)]
    left = pd.DataFrame({"id": range(600), "symbol": [1] * 200 + list(rng.integers(2, 9, 400)), "ts": times(600, 4000)})
    right = pd.DataFrame({"symbol": [1] * 150 + list(rng.integers(2, 8, 100)) + [99] * 5, "ts": times(255, 3000), "v": rng.integers(0, 40, 255).astype(float)})
    df = spark.createDataFrame(left).union(spark.createDataFrame([(1000, None, base.to_pydatetime()), (1001, 1, None), (0, 1, left.ts[0].to_pydatetime())], "id long, symbol long, ts timestamp")).repartition(4)
    marks = spark.createDataFrame(right).union(spark.createDataFrame([(None, base.to_pydatetime(), 5.0), (1, None, 6.0)], "symbol long, ts timestamp, v double")).repartition(3)
    got = J.asof_join(df, marks, ["symbol"], "ts", ["v"], direction, bucket)
    assert got.columns == ["id", "symbol", "ts", "matched_ts", "v"]
    rows = got.toPandas()
    assert len(rows) == 603 and sorted(rows.id)[:2] == [0, 0] and rows[rows.id >= 1000].v.isna().all()
    by = {k: g for k, g in right.groupby("symbol")}
    for r in rows[rows.id < 1000].itertuples():
        g = by.get(r.symbol)
        want = None if g is None else nearest_of(g.ts, g.v, r.ts, direction)
        assert (pd.isna(r.v) and want is None) or (r.matched_ts, r.v) == want, r


def test_asof_reads_each_side_twice(spark, tmp_path):
    spark.createDataFrame([(1, pd.Timestamp("2020-01-01").to_pydatetime(), 1.0)], "symbol long, ts timestamp, v double").write.parquet(str(tmp_path / "a"))
    d = spark.read.parquet(str(tmp_path / "a"))
    plan = J.asof_join(d.select("symbol", "ts"), d, ["symbol"], "ts", ["v"], "nearest")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 4
    with pytest.raises(ValueError):
        J.asof_join(d, d, ["symbol"], "ts", ["v"], "sideways")


def test_daily_values_as_by_a_loop(spark):
    rng = np.random.default_rng(9)
    day = lambda k: pd.Timestamp("2021-03-01") + pd.Timedelta(days=int(k))
    fills = pd.DataFrame({"portfolio": rng.integers(0, 3, 80), "symbol": rng.integers(0, 6, 80), "ts": [day(k) for k in rng.integers(0, 60, 80)], "qty": rng.integers(-50, 90, 80).astype(float),
                          "price": rng.integers(10, 20, 80).astype(float), "cost": [None if k % 9 == 0 else 1.5 for k in range(80)]})
    prices = pd.DataFrame([(s, day(k), float(rng.integers(10, 20))) for s in range(5) for k in sorted(rng.choice(80, 30, replace=False))], columns=["symbol", "ts", "close"])      # symbol 5 has no price
    got = BT.daily_values(spark.createDataFrame(fills).repartition(3), spark.createDataFrame(prices), 1000.0).toPandas().sort_values(["portfolio", "ts"])
    want = []
    for p, f in fills.groupby("portfolio"):
        for k in range((f.ts.max() - f.ts.min()).days + 1):
            t = f.ts.min() + pd.Timedelta(days=k)
            done = f[f.ts <= t]
            cash = 1000.0 - (done.qty * done.price + done.cost.fillna(0)).sum()
            held = 0.0
            for s, g in done.groupby("symbol"):
                known = prices[(prices.symbol == s) & (prices.ts <= t) & (prices.ts >= g.ts.min())]
                if len(known):
                    held += g.qty.sum() * known.sort_values("ts").close.iloc[-1]
            want.append((p, t, held, cash, cash + held))
    want = pd.DataFrame(want, columns=["portfolio", "ts", "holdings", "cash", "total"])
    assert got.columns.tolist() == want.columns.tolist() and len(got) == len(want)
    np.testing.assert_allclose(got[["holdings", "cash", "total"]].to_numpy(), want[["holdings", "cash", "total"]].to_numpy(), rtol=0, atol=1e-6)
    assert (got.ts.to_numpy() == want.ts.to_numpy()).all()
