"""Every query that has an equivalent in SQL gives the same rows on the smallest tables."""

import pytest
from oracle import same, tables

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
CORE = {k: r for m in entry.CORE for r in [__import__("importlib").import_module(m).R] for k in r.queries}


@pytest.fixture(scope="module")
def duck():
    return tables(D)


@pytest.mark.parametrize("name", [k for k, r in CORE.items() if k in r.sql])
def test_same_as_sql(spark, duck, name):
    same(CORE[name].queries[name](spark, D), duck, CORE[name].sql[name])


@pytest.mark.parametrize("name", [k for k, r in CORE.items() if k not in r.sql])
def test_runs(spark, name):
    assert CORE[name].queries[name](spark, D).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
