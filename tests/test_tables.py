from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import accounting as A, backtest as BT, clean as C, joins as J, learning as L, metrics as M, risk as RK, rolling as R, selection as SL, signals as SG
from quantloom.sources import datasets as DS, files
from quantloom.streaming import bars as SB, monitor as SM


def test_actions_do_not_commute(spark):
    ts = pd.date_range("2020-01-01", periods=6)
    bars = spark.createDataFrame(pd.DataFrame({"symbol": 1, "ts": ts, "close": 100.0, "volume": 10.0})).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    acts = spark.createDataFrame([(1, "SPLIT", ts[2].to_pydatetime(), 2.0, None), (1, "DIVIDEND", ts[4].to_pydatetime(), None, 3.0)], "symbol long, action_type string, ex_date timestamp_ntz, split_ratio double, amount double")
    got = J.adjust_for_actions(bars, acts, prices=["close"]).orderBy("ts").toPandas()
    assert list(got["close"]) == [48.5, 48.5, 48.5, 97.0, 97.0, 100.0] and list(got["volume"]) == [20, 20, 20, 10, 10, 10]
    after = J.adjust_for_actions(bars, acts, inclusive=False, prices=["close"]).orderBy("ts").toPandas()
    assert list(after["close"]) == [48.5, 48.5, 97.0, 97.0, 100.0, 100.0]


def test_asof_ties_go_forward(spark):
    right = spark.createDataFrame([(1, datetime(2020, 1, 30), 1.0), (1, datetime(2020, 2, 3), 2.0)], "symbol long, ts timestamp, v double")
    left = spark.createDataFrame([(1, datetime(2020, 2, 1)), (1, datetime(2020, 1, 31)), (1, datetime(2020, 6, 1)), (2, datetime(2020, 6, 1))], "symbol long, ts timestamp")
    get = lambda d: [r.v for r in J.asof_join(left, right, ["symbol"], "ts", ["v"], d).orderBy("symbol", "ts").collect()]
    assert get("nearest") == [1.0, 2.0, 2.0, None] and get("backward") == [1.0, 1.0, 2.0, None] and get("forward") == [2.0, 2.0, None, None]


def test_average_cost_forms(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for k in (1, 2):
        held = cost = 0.0
        for i in range(60):
            q = float(rng.integers(1, 9)) if held <= 0 or rng.random() < .6 else -min(held, float(rng.integers(1, 9)))
            p = float(rng.uniform(5, 15))
            rows.append((k, i, q, p))
            new = held + q
            neutral = want.get((k, i - 1, "n"), (0.0, 0.0))
            c = neutral[1] if q < 0 else ((neutral[0] * neutral[1] + q * p) / (neutral[0] + q))
            want[(k, i, "n")] = (neutral[0] + q, c)
            cost = None if new == 0 else (q * p + (held * cost if held else 0.0)) / new
            want[(k, i)] = cost
            held = new
    df = spark.createDataFrame(rows, "k long, t long, qty double, price double")
    for blocked in ({}, {"block_rows": 16, "chunk": F.floor(F.col("t") / 10)}):
        for r in A.average_cost(df, ("k",), "t", **blocked).collect():
            w = want[(r.k, r.t)]
            assert (r.avg_cost is None) == (w is None) and (w is None or abs(r.avg_cost - w) < 1e-9)
    for r in A.average_cost(df, ("k",), "t", sell_neutral=True).collect():
        held, cost = want[(r.k, r.t, "n")]
        if held:
            assert abs(r.avg_cost - cost) < 1e-6


def test_limit_order_beyond_the_next_month(spark):
    days = pd.date_range("2020-01-01", periods=200)
    price = np.where(days == "2020-05-20", 50.0, np.where(days == "2020-04-02", 120.0, 100.0))
    bars = spark.createDataFrame(pd.DataFrame({"symbol": 1, "ts": days, "close": price}))
    orders = spark.createDataFrame([(1, 1, "LIMIT", "BUY", 60.0, None), (2, 1, "STOP_LIMIT", "BUY", 130.0, 110.0), (3, 1, "LIMIT", "SELL", 500.0, None), (4, 1, "MARKET", "BUY", None, None)],
                                   "order_id long, symbol long, order_type string, side string, price double, stop_price double").withColumn("ts", F.lit("2020-01-15").cast("timestamp"))
    got = {r.order_id: (str(r.fill_ts)[:10], r.fill_price) for r in BT.first_executions(orders, bars).collect()}
    assert got == {1: ("2020-05-20", 50.0), 2: ("2020-04-02", 120.0), 4: ("2020-01-16", 100.0)}


def test_fills_and_gaps(spark):
    x = [None, 1.0, None, None, 4.0, None]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "symbol long, ts long, x double")
    col = lambda d: [r.x for r in d.orderBy("ts").collect()]
    assert col(C.linear_interpolation(df, ["x"])) == [None, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert col(C.forward_fill(df, ["x"], 1)) == [None, 1.0, 1.0, None, 4.0, 4.0]
    assert col(C.backward_fill(df, ["x"])) == [1.0, 1.0, 4.0, 4.0, 4.0, None]
    with pytest.raises(ValueError):
        C.require_rows_and_columns(df, ["y"])
    with pytest.raises(ValueError):
        C.require_rows_and_columns(df.limit(0), ["x"])


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5)], "k long, s string, v double")
    files.write_parquet(df, f"{tmp_path}/p", "gzip", ["s"])
    assert files.read_parquet(spark, f"{tmp_path}/p", ["k"], [("s", "==", "b"), ("v", ">=", 2.0)]).collect()[0].k == 2
    plan = files.read_parquet(spark, f"{tmp_path}/p", ["k"], [("v", ">", 2.0)])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,2.0)" in plan
    with pytest.raises(ValueError):
        files.write_parquet(df.limit(0), f"{tmp_path}/e")
    with pytest.raises(ValueError):
        files.predicate([("k", "~", 1)])
    store = DS.VersionStore(spark, f"{tmp_path}/store")
    assert [store.write("d", df, "u", "CREATE", "2024-01-01"), store.write("d", df, "u", "UPDATE", "2024-01-02")] == [1, 2]
    v = store.list("d", 1).collect()[0]
    assert v.version_number == 2 and v.parent_id == "d_v1" and store.audit().count() == 2 and store.read("d", 1).count() == 2


def test_alert_states_against_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 20)), datetime(2024, 1, 1) + timedelta(minutes=i), i, str(rng.choice(["open", "ack", "clear"]))) for i in range(400)]
    want = {}
    for a, _, _, act in rows:
        want[a] = SM.next_state(want.get(a, "none"), act)
    df = spark.createDataFrame(rows, "alert long, ts timestamp, seq long, action string")
    assert {r.alert: r.state for r in SM.alert_states_batch(df).collect()} == want


def test_online_weights_against_a_loop():
    rng = np.random.default_rng(2)
    errors = rng.exponential(1, (250, 3))
    w = np.full(3, 1 / 3)
    for i in range(len(errors)):
        new = 1 / (errors[max(0, i - 99):i + 1].mean(0) + 1e-8)
        new = np.maximum(new / new.sum(), .01)
        w = .9 * w + .1 * new / new.sum()
    np.testing.assert_allclose(SM.adapt([1 / 3] * 3, errors), w, rtol=1e-9)
    half = SM.adapt([1 / 3] * 3, errors[:120])              # a restart with the last hundred errors goes on alike
    np.testing.assert_allclose(SM.adapt(half, errors[20:], before=100), w, rtol=1e-9)


def test_limits_of_one_portfolio(spark):
    m = spark.createDataFrame([("a", "x", 5.0), ("b", "x", 5.0)], "portfolio string, limit_type string, value double").withColumn("ts", F.lit(None).cast("timestamp"))
    limits = spark.createDataFrame([("a", "x", 4.0, "low", True), (None, "x", 6.0, "high", True), (None, "x", 1.0, "all", True), (None, "x", 1.0, "off", False)],
                                   "portfolio string, limit_type string, threshold double, severity string, enabled boolean")
    assert sorted((r.portfolio, r.severity) for r in SM.limit_breaches(m, limits).collect()) == [("a", "all"), ("a", "low"), ("b", "all")]


def test_bootstrap_sums_against_the_draws(spark):
    pdf = pd.DataFrame({"id": np.arange(3000), "g": np.arange(3000) % 2, "v": np.random.default_rng(1).normal(0, 1, 3000)})
    df = spark.createDataFrame(pdf)
    got = SL.bootstrap_sums(df.repartition(5), ["id"], ["g"], ["v"], 120, 7).toPandas().set_index(["g", "rep"])
    keys = df.select("id", F.xxhash64("id").alias("k")).toPandas().sort_values("id").k.to_numpy()
    w = SL.poisson_weights(keys, np.arange(1, 121), 7)
    assert abs(w.mean() - 1) < .01 and abs(w.var() - 1) < .02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < .06
    for g in (0, 1):
        mine = (pdf.g == g).to_numpy()
        np.testing.assert_allclose(got.loc[g].sort_index()["n"], w[mine].sum(0))
        np.testing.assert_allclose(got.loc[g].sort_index()["v"], w[mine].T @ pdf.v[mine], atol=1e-9)


def test_covariance_of_held_pairs(spark):
    rng = np.random.default_rng(3)
    wide = pd.DataFrame(rng.normal(0, 1, (60, 4)), columns=[1, 2, 3, 4], index=pd.date_range("2020-01-01", periods=60))
    wide.loc[wide.index[5], 2] = np.nan
    long = wide.rename_axis("ts").reset_index().melt("ts", var_name="symbol", value_name="ret").dropna().astype({"symbol": int})
    weights = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3), ("q", 3)], "portfolio string, symbol long")
    pairs = M.held_pairs(weights)
    cov = M.asset_covariance(spark.createDataFrame(long), pairs)
    want = wide.cov()
    got = {(r.i, r.j): r for r in cov.collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 2), (3, 3)} and got[1, 2].n == 59
    for (i, j), r in got.items():
        assert r["cov"] == pytest.approx(want.loc[i, j])
    shrunk = {(r.i, r.j): r["cov"] for r in M.shrunk_asset_covariance(cov, pairs).where("portfolio = 'p'").collect()}
    mean = (want.loc[1, 1] + want.loc[2, 2]) / 2
    assert shrunk[1, 1] == pytest.approx(.9 * want.loc[1, 1] + .1 * mean) and shrunk[1, 2] == pytest.approx(.9 * want.loc[1, 2])


def test_robust_covariance_over_assets(spark):
    """The whole matrix where no day is missing, gaps counted by portfolio otherwise."""
    rng = np.random.default_rng(8)
    x = rng.standard_t(2, (60, 4)) * [1, 2, .5, 1]
    long = [(k, d, float(x[d, k])) for k in range(4) for d in range(60)]
    weights = spark.createDataFrame([("p", 0, .2), ("p", 1, .3), ("p", 2, .5), ("p", 2, .5), ("q", 3, 1.0)], "portfolio string, symbol int, w double")
    df = spark.createDataFrame(long + [(0, 99, None), (7, 1, 5.0)], "symbol int, ts int, ret double").repartition(4)
    got = {(r.portfolio, r.i, r.j): r for r in M.robust_asset_covariance(df, weights).collect()}
    assert sorted(got) == [("p", i, j) for i in range(3) for j in range(i, 3)] + [("q", 3, 3)]
    for name, held in (("p", [0, 1, 2]), ("q", [3])):
        c = x[:, held] - np.sort(x[:, held], axis=0)[29]                          # the lower median of 60
        w = np.minimum(1, 2 / np.linalg.norm(c, axis=1))
        want = (c * w[:, None]).T @ c / w.sum()
        for a, i in enumerate(held):
            for b, j in enumerate(held[a:], a):
                assert got[name, i, j]["cov"] == pytest.approx(want[a, b]) and got[name, i, j].n == 60
    gaps = {(r.i, r.j): r for r in M.robust_asset_covariance(df.where("NOT (symbol = 1 AND ts >= 40)"), weights, spark.createDataFrame([("p", 0, 1), ("p", 0, 1)], "portfolio string, i int, j int")).collect()}
    c0, c1 = x[:, 0] - np.sort(x[:, 0])[29], x[:40, 1] - np.sort(x[:40, 1])[19]
    c2 = x[:, 2] - np.sort(x[:, 2])[29]
    w = np.minimum(1, 2 / np.sqrt(c0[:40] ** 2 + c1 ** 2 + c2[:40] ** 2))
    assert list(gaps) == [(0, 1)] and gaps[0, 1].n == 40 and gaps[0, 1]["cov"] == pytest.approx((w * c0[:40] * c1).sum() / w.sum())
    assert M.robust_asset_covariance(df.limit(0), weights).collect() == []


def test_student_var_has_a_normal_limit(spark):
    flat = np.tile([-1.0, 1.0], 60)                          # negative excess kurtosis
    wild = np.random.default_rng(5).standard_t(5, 250)
    rows = pd.concat([pd.DataFrame({"symbol": k, "ts": pd.date_range("2020-01-01", periods=len(v)), "ret": v}) for k, v in ((1, flat), (2, wild))])
    df = spark.createDataFrame(rows)
    s, n = ({r.symbol: r for r in f(df).collect()} for f in (RK.student_var, RK.normal_var))
    assert s[1].dof is None and s[1].var_95 == pytest.approx(n[1].var_95) and s[1].cvar_99 == pytest.approx(n[1].cvar_99)
    assert s[2].dof > 4 and s[2].cvar_99 > n[2].cvar_99
    q = spark.createDataFrame([(4.5,), (999.0,), (1001.0,), (1e9,), (None,)], "d double").select(RK.student_quantile(.05, F.col("d")).alias("q")).collect()
    assert q[0].q < q[1].q < q[2].q < q[3].q <= q[4].q + 1e-9 and q[4].q == pytest.approx(-1.6448536269514722)


def test_needed_columns(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "a long, b double")
    assert list(map(tuple, C.column_report(df, ["a", "b", "c"]).collect())) == [("a", True, 2), ("b", True, 1), ("c", False, 0)]
    assert list(map(tuple, C.column_report(df.limit(0), ["a"]).collect())) == [("a", True, 0)]


def test_robust_scaling_with_ties_and_nulls(spark):
    v = [1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 5.0, None, 900.0]
    got = sorted(((r.v, r.v_scaled) for r in L.scaled(spark.createDataFrame([(x,) for x in v], "v double"), "v", "robust").collect()), key=str)
    x = pd.Series(v)
    mad = (x - x.median()).abs().median()
    kept = x.where((x - x.median()).abs() <= 3 * mad)
    want = (kept - kept.median()) / (kept.quantile(.75) - kept.quantile(.25))
    assert [b for _, b in got] == pytest.approx([b for _, b in sorted(zip(v, [None if pd.isna(w) else w for w in want]), key=str)])
    assert L.scaled(spark.createDataFrame([], "v double"), "v", "robust").count() == 0


def test_names_that_leak(spark):
    df = spark.createDataFrame([("future_return",), ("return_lag_1",), ("close",)], "name string")
    assert [r.name for r in R.target_name_probe(df).collect()] == ["future_return"]


def test_folds_never_train_on_the_test_rows(spark):
    df = spark.createDataFrame(pd.DataFrame({"symbol": 1, "ts": pd.date_range("2020-01-01", periods=100)}))
    for f in (L.walk_forward_folds(df, 40, 10, 2), L.time_series_folds(df, 4, 2), L.purged_folds(df, 4, 3), L.blocking_folds(df, 4, 10, 3)):
        p = f.toPandas()
        assert set(p.side) == {"train", "test"}
        for _, g in p.groupby("fold"):
            assert g[g.side == "train"].ts.max() < g[g.side == "test"].ts.min()


def test_walk_forward_range_comes_from_the_rows(spark):
    days = pd.date_range("2020-01-01", periods=600)
    rows = spark.createDataFrame(pd.DataFrame({"symbol": 1, "ts": days})).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    keys = ["window", "side", "ts"]
    own = J.walk_forward_rows(rows).select(*keys).collect()
    named = J.walk_forward_rows(rows, "2020-01-01", "2021-08-22").select(*keys).collect()
    assert sorted(own) == sorted(named) and {r.window for r in own} == set(range(5))
    assert J.walk_forward_rows(rows.limit(0)).count() == 0
    assert J.walk_forward_rows(rows.where("ts < '2020-03-01'")).count() == 0


def test_confidence_rule_inside_a_strategy(spark):
    start = datetime(2020, 1, 1)

    def signals(name, n, confidence):
        return [(name, 1, start + timedelta(days=i), "BUY" if i % 2 else "SELL", (-1) ** i * i / 20, confidence(i)) for i in range(n)]
    rows = signals("follows", 12, lambda i: i / 20) + signals("against", 12, lambda i: 1 - i / 20) + signals("flat", 12, lambda i: 0.5) + signals("few", 9, lambda i: 1 - i / 20)
    df = spark.createDataFrame(rows, "strategy string, symbol long, ts timestamp, signal_type string, strength double, confidence double")
    got = {r.strategy: (r.value, r.passed) for r in SG.validate_signals(df, df).where("rule = 'confidence_correlation'").collect()}
    assert got["follows"] == (pytest.approx(1), True) and got["against"] == (pytest.approx(-1), False)
    assert got["flat"] == (None, False) and got["few"] == (None, True)


def test_newest_state_of_each_window(spark):
    rows = spark.createDataFrame([("a", 1, 2.0, 0, 0), ("a", 1, 5.0, 1, 1), ("a", 2, 7.0, 0, 0), ("b", 1, None, 1, 1)], "symbol string, ts int, close double, batch long, b int")
    assert sorted(map(tuple, SB.newest(rows, ["symbol", "ts"]).collect()), key=str) == [("a", 1, 5.0), ("a", 2, 7.0), ("b", 1, None)]


def test_orders_that_never_execute_make_no_rows(spark):
    """Orders of a hot symbol meet its bars in slots; an order whose band is never met is a row of no join."""
    days = pd.date_range("2020-01-01", periods=900)
    bars = spark.createDataFrame(pd.DataFrame({"symbol": 1, "ts": days, "close": np.where(np.arange(900) % 2 == 0, 10.0, 30.0)}))
    n = 3 * BT.SLOT
    orders = spark.range(n).select(F.col("id").alias("order_id"), F.lit(1).cast("long").alias("symbol"), F.lit("STOP_LIMIT").alias("order_type"), F.lit("BUY").alias("side"), F.lit(days[0]).alias("ts"),
                                   F.when(F.col("id") % 1000 == 0, 30.0).otherwise(25.0).alias("price"), F.lit(15.0).alias("stop_price"))
    out = BT.first_executions(orders, bars)
    assert {(r.order_id % 1000, str(r.fill_ts)[:10], r.fill_price) for r in out.collect()} == {(0, "2020-01-02", 30.0)} and out.count() == n // 1000
    assert "CoGroup" in out._jdf.queryExecution().optimizedPlan().toString()                 # was a join on (symbol, month) with 30 rows for each of these orders
