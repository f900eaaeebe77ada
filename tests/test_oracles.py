"""Every registered query against its SQL twin, or for rows where there is none.

A query of these sizes is mostly planning, so several run side by side in one session.
"""

from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from harness import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = list(entry.queries())


@pytest.fixture(scope="module")
def results(spark):
    con, queries, twins = duck(SF), entry.queries(), entry.oracle_sql()

    def run(name):
        try:
            return compare(spark, con.cursor(), SF, name, queries[name], twins.get(name))
        except Exception as e:  # noqa: BLE001 - reported by the test of that name
            return f"{type(e).__name__}: {str(e)[:600]}"
    with ThreadPoolExecutor(8) as pool:
        return dict(zip(NAMES, pool.map(run, NAMES)))


@pytest.mark.parametrize("name", NAMES)
def test_query(results, name):
    assert results[name] is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["symbol", "day", "rsi"]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
