import random

import numpy as np
from pyspark.sql import functions as F

from readloom.operators.intervals import disjoint, reduce_lists, stretches_and_gaps
from readloom.operators.skew import heavy_keys, keyed_totals

SCHEMA = "k string, s bigint, e bigint, kind int, seg_start int"


def brute(rows):
    by = {}
    for k, s, e, *_ in rows:
        if s is not None and e is not None and s < e:
            by.setdefault(k, []).append((s, e))
    out = []
    for k, ivs in by.items():
        done = []
        for s, e in sorted(ivs):
            if done and s <= done[-1][1]:
                done[-1][1] = max(done[-1][1], e)
            else:
                done.append([s, e])
        out += [(k, "covered", s, e) for s, e in done]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(done, done[1:])]
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, stretches_and_gaps(df, ["k"], "s", "e", **options).collect()), key=str)


def test_small_cases(spark):
    rows = [
        ("a", 0, 10, 1, 1), ("a", 10, 20, 1, 1), ("a", 12, 14, 1, 1), ("a", 30, 31, 1, 1),  # touch, nest, gap
        ("a", 30, 31, 1, 1), ("b", 5, 5, 1, 1), ("b", 9, 7, 1, 1), ("c", None, 4, 1, 1), ("c", 4, None, 1, 1),  # repeated, empty, null
        (None, 1, 2, 1, 1), (None, 3, 4, 1, 1), ("d", -20, -3, 1, 1), ("d", -3, 40, 1, 1),
    ]
    for width in (4, 16, 1 << 20):
        assert run(spark, rows, width=width) == brute(rows)


def test_stretch_over_many_bins(spark):
    rows = [("a", 0, 1000, 1, 1), ("a", 1000, 1001, 1, 1), ("a", 1008, 1016, 1, 1), ("a", 1016, 1024, 1, 1), ("a", 2000, 2001, 1, 1)]
    assert run(spark, rows, width=8) == brute(rows)


def test_random_against_brute_force(spark):
    rng = random.Random(7)
    # one key holds most rows
    rows = [(rng.choice("aaaaaab"), s := rng.randrange(5000), s + rng.randrange(0, 40), 0, 0) for _ in range(6000)]
    for width, buffer, fan_in in ((64, 500, 64), (1024, 1 << 18, 2), (100, 50, 2), (None, 1000, 2)):
        assert run(spark, rows, width=width, buffer_rows=buffer, fan_in=fan_in) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_instants_over_years(spark):
    """Microseconds over thirty years, from seconds to months long, and the ends of the 64-bit range."""
    rng = random.Random(3)
    day = 86_400_000_000
    rows = [(rng.choice("aab"), s := rng.randrange(30 * 365 * day), s + rng.choice([10**6, day, 60 * day]), 0, 0) for _ in range(2000)]
    assert run(spark, rows) == brute(rows)
    rows += [("c", -(2**63), -(2**63) + 5, 0, 0), ("c", 2**63 - 9, 2**63 - 1, 0, 0), ("c", 0, 7, 0, 0)]
    assert run(spark, rows) == brute(rows)


def test_a_hot_bin_from_a_thousand_tasks(spark):
    rng = random.Random(5)
    rows = [("a", s := rng.randrange(20_000), s + rng.randrange(1, 4), 0, 0) for _ in range(20_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, stretches_and_gaps(df, ["k"], "s", "e", width=1 << 20).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute(rows)


def test_linear_merges():
    rng = np.random.default_rng(4)
    for _ in range(50):
        k = int(rng.integers(1, 9))
        group = np.sort(np.unique(rng.integers(0, 3, k), return_inverse=True)[1])
        lists = []
        for _ in range(k):
            x = np.sort(rng.choice(100, 2 * int(rng.integers(0, 12)), replace=False))
            lists.append((x[::2], x[1::2]))
        offsets = np.cumsum([0] + [len(a) for a, _ in lists])
        s, e = (np.concatenate([x[i] for x in lists]).astype(np.int64) for i in (0, 1))
        g, at, s, e = reduce_lists(group, offsets, s, e, 100)
        assert g.tolist() == sorted(set(group.tolist()))
        for i, which in enumerate(g):
            want = brute([("x", int(a), int(b)) for (p, q), h in zip(lists, group) if h == which for a, b in zip(p, q)])
            assert [("x", "covered", int(a), int(b)) for a, b in zip(s[at[i] : at[i + 1]], e[at[i] : at[i + 1]])] == sorted([r for r in want if r[1] == "covered"], key=lambda r: r[2])


def test_disjoint_by_rank_where_coordinates_are_far_apart():
    rng = np.random.default_rng(6)
    code = rng.integers(0, 40, 500)
    s = rng.integers(-(2**61), 2**61, 500)
    e = s + rng.integers(1, 2**58, 500)
    at, ends = disjoint(code, s, e)
    got = sorted((int(code[a]), "covered", int(s[a]), int(b)) for a, b in zip(at, ends))
    assert got == sorted(r for r in brute(list(zip(code.tolist(), s.tolist(), e.tolist()))) if r[1] == "covered")


def test_heavy_keys(spark):
    rows = [(1, 0)] * 60 + [(2, 0)] * 20 + [(3, 0)] * 20 + [(None, 0)] * 50
    df = spark.createDataFrame(rows, "k int, n_rows int")
    got = {r["k"]: r["n_rows"] for r in heavy_keys(df, "k", 0.2).collect()}
    assert got == {1: 60, 2: 20, 3: 20}  # nulls count nowhere, a tie at the bound stays
    assert heavy_keys(df.where("k > 9"), "k", 0.1).count() == 0


def test_keyed_totals(spark):
    rows = [("a", 1, 5), ("a", 1, None), ("a", 2, 7), (None, 3, 1), ("b", None, None), ("b", None, None)]
    df = spark.createDataFrame(rows, "k string, p int, v int").withColumn("extra", F.lit(1))
    got = {r["k"]: tuple(r)[1:] for r in keyed_totals(df, ["k"], {"s": "v"}, ("d", "p"), {"p": ("lo", "hi")}).collect()}
    assert got == {"a": (3, 2, 12, 1, 2), None: (1, 1, 1, 3, 3), "b": (2, 0, 0, None, None)}
    plain = {r["k"]: tuple(r)[1:] for r in keyed_totals(df, ["k"], {"s": "v"}, None, {"p": ("lo", "hi")}).collect()}
    assert plain == {"a": (3, 12, 1, 2), None: (1, 1, 3, 3), "b": (2, 0, None, None)}
    assert keyed_totals(df.limit(0), ["k"], {"s": "v"}, ("d", "p")).count() == 0
