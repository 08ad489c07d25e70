"""Defined results at the edges: empty tables, nulls, repeated rows."""

import pytest
from pyspark.sql import functions as F

from readloom.functions import cigar as C
from readloom.operators import aggregates as A
from readloom.operators import filters as X
from readloom.operators import joins as J
from readloom.operators import order as O

SCHEMA = "ord bigint, qname string, flag int, tid int, pos int, mapq int, cigar string, mtid int, mpos int, isize int, rg string, lib string, sum_qual int"


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(none):
    assert tuple(A.qc_basic_stats(none).first()) == (0, 0, 0, 0)
    h = A.map_error_histogram(none).collect()
    assert len(h) == 12 and all(tuple(r)[1:] == (0, 0, 0, 0) for r in h)
    assert [tuple(r)[1:] for r in A.flagstat(none).collect()] == [(0,) * 11] * 2
    for x in (A.coverage(none), A.pileup_counts(none), A.pileup(none, []), O.rmdup_paired(none), O.rmdup_single(none), J.fix_mates(none), X.subsample(none, 0.5)):
        assert x.count() == 0
    assert tuple(A.coverage_summary(A.coverage_runs(none)).first()) == (0, 0, 0.0)
    assert X.filter_alignments(none, "reference", min_quality=3).count() == 0


def test_cigar_shapes(spark):
    rows = [(None,), ("*",), ("",), ("5M",), ("2S3M1I2M2D1M3H",), ("3N4M",), ("1000000M",)]
    x = spark.createDataFrame(rows, "c string").select(
        "c", C.query_len("c").alias("q"), C.end_pos(F.lit(10), "c").alias("e"), F.expr("1").alias("k"), C.ref_blocks(F.lit(10), F.col("c"), keep="MDN=X").alias("b")
    )
    got = {r["c"]: (r["q"], r["e"], r["b"] and [(b["beg"], b["end"], b["op"], b["qbeg"]) for b in r["b"]]) for r in x.collect()}
    assert got[None][0] is None
    assert got["*"] == (0, 10, []) and got[""] == (0, 10, [])
    assert got["5M"] == (5, 15, [(10, 15, "M", 0)])
    assert got["2S3M1I2M2D1M3H"] == (9, 18, [(10, 13, "M", 2), (13, 15, "M", 6), (15, 17, "D", 8), (17, 18, "M", 8)])
    assert got["3N4M"] == (4, 17, [(10, 13, "N", 0), (13, 17, "M", 0)])
    assert got["1000000M"][1] == 1000010


def read(ord_, name, flag, pos, cigar="10M", mtid=0, isize=0, q=1):
    return (ord_, name, flag, 0, pos, 30, cigar, mtid, 0, isize, None, "l", q)


def test_paired_duplicates(spark):
    rows = [
        read(1, "a", 3, 100, isize=50, q=5), read(2, "b", 3, 100, isize=50, q=9), read(3, "c", 3, 100, isize=50, q=9),  # b wins, the earlier of equals
        read(4, "a", 3, 140, isize=-50), read(5, "b", 3, 140, isize=-50), read(6, "c", 3, 140, isize=-50),  # tails go with their heads
        read(7, "d", 0, 100), read(8, "e", 3, 100, mtid=1, isize=50), read(9, "f", 3 | 8, 100, isize=50),  # kept: single, across contigs, mate unmapped
    ]
    got = sorted(r["ord"] for r in O.rmdup_paired(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [2, 5, 7, 8, 9]


def test_single_duplicates(spark):
    rows = [read(1, "a", 0, 100, q=1), read(2, "b", 0, 100, q=3), read(3, "c", 16, 95, "15M", q=1), read(4, "d", 16, 100, "10M", q=1), read(5, "e", 4, 100), read(6, "f", 1, 100)]
    x = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r["ord"] for r in O.rmdup_single(x).collect()) == [2, 3, 5, 6]
    assert sorted(r["ord"] for r in O.rmdup_single(x, force_single=True).collect()) == [2, 3, 5]


def test_pileup_positions(spark):
    x = spark.createDataFrame([read(1, "a", 0, 5, "1S2M1I1M2D1M"), read(2, "b", 0, 16382, "4M")], SCHEMA)
    got = {(r["ord"], r["pos"]): (r["qpos"], r["is_del"], r["indel"], r["is_head"], r["is_tail"]) for r in A.pileup(x, ["ord"]).collect()}
    assert got[1, 5] == (1, False, 0, True, False) and got[1, 6] == (2, False, 1, False, False)
    assert got[1, 7] == (4, False, -2, False, False) and got[1, 8] == (5, True, 0, False, False) and got[1, 10] == (5, False, 0, False, True)
    assert [got[2, p][0] for p in range(16382, 16386)] == [0, 1, 2, 3]  # across the border of a bin
    spread = A.pileup(x, ["ord"], spread=3)
    assert sorted(map(str, spread.collect())) == sorted(map(str, A.pileup(x, ["ord"]).collect()))


def test_sixteen_bit_depth(spark):
    x = spark.range(65540).selectExpr("0 as tid", "7 as pos", "'1M' as cigar")
    assert [tuple(r) for r in A.coverage(x).collect()] == [(1, 8, 65540)]
    assert [tuple(r) for r in A.coverage(x, "reference").collect()] == [(1, 8, 4)]


def test_mates(spark):
    rows = [read(1, "a", 1, 100), read(2, "a", 17, 200), read(3, "a", 1 | 2, 50), read(4, "b", 0, 9), read(5, "c", 1, 10), read(6, "c", 1 | 4, 10)]
    got = {r["ord"]: (r["mtid"], r["mpos"], r["isize"], r["flag"]) for r in J.fix_mates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == (0, 200, 110, 1 | 32) and got[2] == (0, 100, -110, 17)
    assert got[3] == (-1, -1, 0, 1 | 8) and got[4] == (-1, -1, 0, 0)
    assert got[5] == (0, 10, 0, 1 | 8) and got[6] == (0, 10, 0, 5)
