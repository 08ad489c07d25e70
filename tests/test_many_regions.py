"""The semi join with more regions than may be broadcast: right rows from brute force and from SQL, and no broadcast."""

import random

import pytest
from oracle import same, tables

import __spark_entry__ as entry
from readloom.operators import joins as J


def broadcasts(df) -> bool:
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_rows_of_every_length(spark, monkeypatch, few):
    monkeypatch.setattr(J, "FEW_ENTRIES", few)
    random.seed(4)
    length = lambda: random.choice([-3, 0, 1, 2, 50, 1 << 14, (1 << 14) + 1, 1 << 18, (1 << 18) + 1, 1 << 22])
    rows = [(i, i % 3, s, s + length()) for i in range(1500) for s in [random.randrange(-50_000, 2_000_000)]]
    regions = [(random.randrange(3), s, s + random.choice([-1, 0, 1, 7, 300, 20_000, 300_000])) for _ in range(90) for s in [random.randrange(2_000_000)]]
    a = spark.createDataFrame([*rows, (-1, 1, None, 5), (-2, None, 5, 9)], "id int, tid int, pos int, `end` int")
    b = spark.createDataFrame([*regions, (1, None, 5), (None, 5, 9)], "tid int, start int, stop int")
    want = sorted(i for i, t, s, e in rows if any(t == u and s < y and x < max(e, s + 1) for u, x, y in regions if x < y))
    got = J.overlap_semi(a, b)
    assert sorted(r["id"] for r in got.collect()) == want and 0 < len(want) < len(rows)
    assert broadcasts(got) == bool(few)


def many_regions(spark, d: str) -> str:
    t = "/root/testdata/sf0.001"
    spark.sql("select id as p_partkey, cast(1 + id % 7 as int) as p_size from range(40000)").coalesce(1).write.parquet(f"{d}/part.parquet")
    for name in ("lineitem", "orders"):
        spark.read.parquet(f"{t}/{name}.parquet").write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("name", ["view_regions", "mpileup_region_reads", "region_overlap_semi", "variant_view"])
def test_query_with_many_regions(spark, tmp_path, name):
    d = many_regions(spark, str(tmp_path))
    df = entry.queries()[name](spark, d)
    assert not broadcasts(df)
    same(df, tables(d), entry.oracle_sql()[name])
