import random

import numpy as np
from pyspark.sql import functions as F

from readloom.functions.keys import read_key
from readloom.llm.perfect import SealedSet
from readloom.llm.seen import error_rates, seal_keys, seen_before

SCHEMA = "n bigint, key string, ord int, h string"


def brute(rows, known=()):
    out = []
    for n, k, *_ in rows:
        if k is not None:
            at = float("inf") if n is None else n
            out.append((n, k in known or any(k2 == k and n2 is not None and n2 < at for n2, k2, *_ in rows)))
    return sorted(out, key=str)


def run(spark, rows, known=None, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    k = None if known is None else spark.createDataFrame([(x,) for x in known], "key string")
    out = seen_before(df, F.col("key"), "n", k, F.col("key"), **options)
    return sorted(((r["n"], r["seen"]) for r in out.collect()), key=str)


def test_cases(spark):
    rows = [
        (5, "a", 0, "x"), (3, "a", 0, "x"), (9, "a", 0, "x"), (1, None, 0, "x"), (2, "", 0, "x"), (4, "", 0, "x"),
        (7, "t", 0, "x"), (7, "t", 0, "x"), (8, "t", 0, "x"), (None, "z", 0, "x"), (None, "z", 0, "x"), (None, "a", 0, "x"), (6, "known", 0, "x"),
    ]
    assert run(spark, rows, ["known", "known", None]) == brute(rows, {"known"})
    assert run(spark, []) == []
    assert run(spark, [], ["a"]) == []


def test_small_batches_and_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(900)}", 0, None) for i in rng.sample(range(10**6), 4000)]
    known = [f"k{i}" for i in range(0, 900, 7)]
    for size in (4, 64, 1 << 16):
        assert run(spark, rows, known, batch_keys=size, max_batch=4 * size) == brute(rows, set(known))


def test_sealed_set():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 20000, dtype=np.uint64)
    f = rng.integers(0, 2**32, 20000, dtype=np.uint32)
    s = SealedSet(h, f)
    assert s.contains(h, f).all() and len(s.fingerprints) == 20000
    other = rng.integers(0, 2**64, 200000, dtype=np.uint64)
    assert not s.contains(other, rng.integers(0, 2**32, 200000, dtype=np.uint32)).any()
    small = SealedSet(h, (f & 0xFF).astype(np.uint8))
    rate = small.contains(other, rng.integers(0, 256, 200000).astype(np.uint8)).mean()
    assert rate < 2 / 256  # at most one slot is compared
    assert s.nbytes() < 20000 * 6
    twice = SealedSet(np.array([7, 7, 9], np.uint64), np.array([1, 2, 3], np.uint32))
    assert twice.contains(np.array([7, 7, 9, 7], np.uint64), np.array([1, 2, 3, 3], np.uint32)).tolist() == [True, True, True, False]
    assert not SealedSet(h[:0], f[:0]).contains(h[:5], f[:5]).any()


def test_error_rates_find_wrong_answers(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "n bigint, key string")
    right = seen_before(df, F.col("key"), "n")
    assert tuple(error_rates(right, df, F.col("key"), "n").first()) == (3, 1, 0, 0, 0.0)
    wrong = right.withColumn("seen", ~F.col("seen"))
    assert tuple(error_rates(wrong, df, F.col("key"), "n").first())[:4] == (3, 2, 2, 1)


def test_read_key(spark):
    ids = [None, "", "  ", "*", " * ", "a/1", " a/2 ", "a/3", "/1", "A", "a /1", "a/1/2"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id string").select(read_key("id")).collect()]
    assert got == [None, None, None, None, None, "a", "a", "a/3", None, "A", "a", "a/1"]


def test_store_of_earlier_days(spark, tmp_path):
    rng = random.Random(12)
    day = lambda n, start: [(start + i, f"k{rng.randrange(1500)}", 0, None) for i in range(n)]
    one, two, three = day(900, 0), day(900, 1000), day(900, 2000)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name, rows in (("one", one), ("two", [*two, (1, None, 0, None)])):
        seal_keys(frame(rows), F.col("key"), buckets=16, batch_keys=50).write.parquet(str(tmp_path / name))
    store = spark.read.parquet(str(tmp_path / "one"), str(tmp_path / "two"))
    extra = spark.createDataFrame([("k7",)], "key string")
    got = sorted(((r["n"], r["seen"]) for r in seen_before(frame(three), F.col("key"), "n", extra, F.col("key"), store, batch_keys=40).collect()), key=str)
    assert got == brute(three, {k for _, k, *_ in one + two} | {"k7"})
    empty = spark.read.schema(store.schema).parquet(str(tmp_path / "one")).limit(0)
    got = sorted(((r["n"], r["seen"]) for r in seen_before(frame(three), F.col("key"), "n", store=empty).collect()), key=str)
    assert got == brute(three)


def test_sealed_set_survives_writing():
    rng = np.random.default_rng(3)
    h, f = rng.integers(0, 2**64, 3000, dtype=np.uint64), rng.integers(0, 2**32, 3000, dtype=np.uint32)
    h[1] = h[0]
    s = SealedSet.from_bytes(SealedSet(h, f).to_bytes())
    assert s.contains(h, f).all() and s.size == 3000
    assert not s.contains(h + np.uint64(1), rng.integers(0, 2**32, 3000, dtype=np.uint32)).any()
