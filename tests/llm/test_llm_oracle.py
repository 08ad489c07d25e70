import pytest
from oracle import same, tables

from readloom.llm.queries import R

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return tables(D)


@pytest.mark.parametrize("name", list(R.sql))
def test_same_as_sql(spark, duck, name):
    same(R.queries[name](spark, D), duck, R.sql[name])


@pytest.mark.parametrize("name", [k for k in R.queries if k not in R.sql])
def test_runs(spark, name):
    R.queries[name](spark, D).count()
