"""Model search against plain numpy fits of every candidate."""

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import search as S

GRID = {"linear": {}, "ridge": {"alpha": [0.5, 20.0]}, "lasso": {"alpha": [0.01, 0.2, 5.0]}, "elastic_net": {"alpha": [0.1], "l1_ratio": [0.2, 0.9]}, "tree": {"depth": [0, 1, 3], "min_rows": [1, 15], "bins": [8]}}
X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def folds():
    rng = np.random.default_rng(2)
    out = []
    for f in range(3):
        n = 90 + 40 * f
        d = pd.DataFrame({"fold": f, "side": np.where(np.arange(n) < n * 2 // 3, "train", "test"), "a": rng.normal(size=n) + 50, "b": rng.normal(size=n), "c": rng.normal(size=n)})
        d["c"] += d.b
        d["y"] = 3 + d.a - 0.7 * d.b + (d.c > 0.5) + rng.normal(size=n) * 0.3
        out.append(d)
    return pd.concat(out, ignore_index=True)


def fit_linear(c, x, y):
    n, mean, my = len(x), x.mean(axis=0), y.mean()
    z, t = x - mean, y - my
    l1 = c["alpha"] if c.kind == "lasso" else c["alpha"] * c["l1_ratio"] if c.kind == "elastic_net" else 0.0
    l2 = c["alpha"] / n if c.kind == "ridge" else c["alpha"] * (1 - c["l1_ratio"]) if c.kind == "elastic_net" else 0.0
    b = np.zeros(x.shape[1])
    cov, q = z.T @ z / n, z.T @ t / n
    for _ in range(20000):
        old = b.copy()
        for j in range(len(b)):
            v = q[j] - cov[j] @ b + cov[j, j] * b[j]
            b[j] = np.sign(v) * max(abs(v) - l1, 0) / (cov[j, j] + l2)
        if np.abs(b - old).max() < 1e-14:
            break
    return lambda x: my + (x - mean) @ b


def fit_tree(depth, least, at, y):
    def grow(rows, level):
        best, total = None, y[rows].sum() ** 2 / len(rows)
        for f in range(at.shape[1]) if level < depth else ():
            for e in np.unique(at[rows, f]):
                left, right = rows[at[rows, f] <= e], rows[at[rows, f] > e]
                if len(left) >= least and len(right) >= max(least, 1):
                    gain = round(y[left].sum() ** 2 / len(left) + y[right].sum() ** 2 / len(right) - total, 12)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, e, left, right)
        if best is None:
            return lambda r: y[rows].mean()
        lo, hi = grow(best[3], level + 1), grow(best[4], level + 1)
        return lambda r, f=best[1], e=best[2]: lo(r) if r[f] <= e else hi(r)
    return grow(np.arange(len(y)), 0)


def brute(d, todo):
    lo, hi = d[X].min().to_numpy(), d[X].max().to_numpy()
    out = {}
    for c in todo:
        errors = []
        for _, g in d.groupby("fold"):
            tr, te = g[g.side == "train"], g[g.side == "test"]
            if c.kind == "tree":
                cut = lambda p: np.minimum(np.floor((p[X].to_numpy() - lo) / (hi - lo) * c["bins"]), c["bins"] - 1).astype(int)
                model = fit_tree(c["depth"], c["min_rows"], cut(tr), tr.y.to_numpy())
                pred = np.array([model(r) for r in cut(te)])
            else:
                pred = fit_linear(c, tr[X].to_numpy(), tr.y.to_numpy())(te[X].to_numpy())
            errors.append(((te.y.to_numpy() - pred) ** 2).mean())
        out[c.number] = (np.mean(errors), np.std(errors))
    return out


def test_search_as_by_fitting_each(spark, folds):
    todo = S.candidates(GRID)
    got = {r.candidate: r for r in S.model_search(spark.createDataFrame(folds).repartition(4), X, "y", todo).collect()}
    want = brute(folds, todo)
    assert set(got) == set(want) == set(range(S.grid_size(GRID)))
    for k, (mse, sd) in want.items():
        assert abs(got[k].mse - mse) < 1e-8 and abs(got[k].deviation - sd) < 1e-8 and got[k].folds == 3, (got[k], mse)
    placed = sorted(got.values(), key=lambda r: r.place)
    assert [r.place for r in placed] == list(range(1, len(todo) + 1)) and all(b.mse - a.mse > -1e-11 for a, b in zip(placed, placed[1:]))


def test_sampled_is_part_of_the_grid(spark, folds):
    some = S.candidates(GRID, 5, seed=3)
    assert len({c.number for c in some}) == 5 and some == S.candidates(GRID, 5, seed=3) and set(some) <= set(S.candidates(GRID))
    assert S.candidates(GRID, 1000) == S.candidates(GRID)
    df = spark.createDataFrame(folds)
    whole = {r.candidate: round(r.mse, 9) for r in S.model_search(df, X, "y", S.candidates(GRID)).collect()}
    assert {r.candidate: round(r.mse, 9) for r in S.model_search(df, X, "y", some).collect()} == {c.number: whole[c.number] for c in some}


def test_numbers_of_a_grid_that_is_never_listed():
    wide = {"linear": {}, "elastic_net": {"alpha": range(1, 10 ** 7), "l1_ratio": [k / 10 ** 6 for k in range(1000)]}}
    assert S.grid_size(wide) == 1 + (10 ** 7 - 1) * 1000
    assert S.decode(wide, 0).kind == "linear" and S.decode(wide, 1 + 4 * 1000 + 7).parameters == (("alpha", 5), ("l1_ratio", 7e-6))
    assert len({c.number for c in S.candidates(wide, 50)}) == 50
    with pytest.raises(IndexError):
        S.decode(wide, S.grid_size(wide))
    with pytest.raises(ValueError):
        S.candidates({"ridge": {"depth": [1]}})


def test_search_on_odd_rows(spark, folds):
    df = spark.createDataFrame(folds)
    flat = df.selectExpr("fold", "side", "a", "0.0D AS b", "a AS c", "y").unionByName(spark.createDataFrame([(0, "train", None, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0, 1.0), (9, "train", 1.0, 1.0, 1.0, 1.0)],
                                                                                                            "fold long, side string, a double, b double, c double, y double"))
    got = {r.kind: r.folds for r in S.model_search(flat, X, "y", S.candidates({"linear": {}, "ridge": {"alpha": [1.0]}, "lasso": {"alpha": [0.1]}, "tree": {"depth": [2]}})).collect()}
    assert got == {"ridge": 3, "lasso": 3, "tree": 3}                       # equal columns have no unique least-squares fit; a fold without test rows scores nothing
    assert S.model_search(df.limit(0), X, "y", S.candidates(GRID)).collect() == []
