"""Nearest-neighbour mutual information against all pairs."""

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import neighbours as NB


def psi(x):
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    for _ in range(8):
        out -= 1 / x
        x = x + 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4) - 1 / (252 * x ** 6)


def all_pairs(x, y, k=3):
    unit = lambda v: (v - v.mean()) / v.std() if v.std() > 0 else np.zeros(len(v))
    x, y = unit(x), unit(y)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, axis=1)[:, k - 1]
    near = lambda a: np.array([((row < q * (1 - 1e-10)) if q > 0 else row == 0).sum() - 1 for row, q in zip(a, r)])
    nx, ny = near(dx), near(dy)
    return max(0.0, psi(len(x)) + psi(k) - np.mean(psi(nx + 1) + psi(ny + 1)))


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    n = 1500
    d = pd.DataFrame({"smooth": rng.normal(size=n), "noise": rng.exponential(size=n) * 1e6 + 1e7, "flat": 3.0})
    d["y"] = d.smooth ** 2 + rng.normal(size=n) * .3
    d["ties"] = np.round(d.smooth * 2) / 2                            # few values
    d["hot"] = np.where(np.arange(n) % 3 == 0, 0.0, d.smooth)          # one value on a third of the rows
    d["copies"] = np.where(np.arange(n) % 2 == 0, np.round(d.y, 1), d.smooth)
    return d


FEATURES = ["smooth", "noise", "ties", "hot", "copies"]


@pytest.mark.parametrize("cell,share,sample", [(8192, 100_000, 512), (40, 60, 20), (300, 10_000, 1)])
def test_information_as_by_all_pairs(spark, table, monkeypatch, cell, share, sample):
    """However the plane is cut."""
    for name, v in (("CELL", cell), ("SHARE", share), ("SAMPLE", sample)):
        monkeypatch.setattr(NB, name, v)
    df = spark.createDataFrame(table).repartition(5)
    got = {r.feature: r for r in NB.neighbour_information(df, FEATURES, "y").collect()}
    for c in FEATURES:
        assert got[c].n == len(table) and got[c].mi == pytest.approx(all_pairs(table[c].to_numpy(), table.y.to_numpy()), abs=1e-9), c
    assert got["smooth"].mi > 0.4 > got["noise"].mi + 0.3


def test_hot_target_and_copies(spark, table, monkeypatch):
    monkeypatch.setattr(NB, "CELL", 50)
    monkeypatch.setattr(NB, "SHARE", 100)
    d = table.assign(y=np.where(np.arange(len(table)) % 3 == 1, 1.0, np.round(table.y, 1)))
    d = pd.concat([d, d.iloc[:300], d.iloc[:300], d.iloc[:300]])        # rows with three copies
    got = {r.feature: r.mi for r in NB.neighbour_information(spark.createDataFrame(d), ["ties", "hot"], "y", k=2).collect()}
    for c in got:
        assert got[c] == pytest.approx(all_pairs(d[c].to_numpy(), d.y.to_numpy(), 2), abs=1e-9)


def test_information_of_few_and_odd_rows(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 1.0), (None, 5.0, 3.0), (4.0, 5.0, None)], "a double, b double, y double")
    assert {r.feature: (r.mi, r.n) for r in NB.neighbour_information(df, ["a", "b"], "y").collect()} == {"a": (None, 2), "b": (None, 2)}
    flat = spark.createDataFrame([(float(i % 7), 5.0, float(i)) for i in range(40)], "a double, b double, y double")
    got = {r.feature: r.mi for r in NB.neighbour_information(flat, ["a", "b"], "y").collect()}
    assert got["b"] == pytest.approx(0.0, abs=1e-12) and got["a"] >= 0
    assert NB.neighbour_information(df.limit(0), ["a"], "y").collect() == []
