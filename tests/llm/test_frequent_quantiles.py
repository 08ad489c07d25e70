import math
import random
from collections import Counter

from pyspark.sql import functions as F

from readloom.llm.frequent import lossy_counts, most_frequent
from readloom.llm.quantiles import merge, percentiles, sketch


def test_intervals_hold(spark):
    rng = random.Random(3)
    items = ["hot"] * 3000 + [f"i{int(rng.paretovariate(0.7))}" for _ in range(9000)] + [None] * 50
    rng.shuffle(items)
    df = spark.createDataFrame([(i, "x", 1) for i in items], "item string, n string, buckets int").repartition(4)
    truth = Counter(i for i in items if i is not None)
    rows = lossy_counts(df, F.col("item"), width=100).collect()
    kept = {r["item"]: (r["at_least"], r["at_most"]) for r in rows}
    assert all(lo <= truth[i] <= hi for i, (lo, hi) in kept.items())
    assert len(kept) < len(truth)  # something was dropped
    bound = len(items) / 100 + 4
    assert all(n <= bound for i, n in truth.items() if i not in kept)
    best = most_frequent(df, F.col("item"), 5, width=100).collect()
    nth = sorted(truth.values())[-5]
    assert {r["item"]: r["n_rows"] for r in best} == {i: n for i, n in truth.items() if n >= nth}
    assert all(r["complete"] for r in best)
    rough = most_frequent(df, F.col("item"), 1, width=100, exact=False).collect()
    assert [r["item"] for r in rough] == [truth.most_common(1)[0][0]] and rough[0]["n_rows"] is None


def test_wider_buckets_for_a_flat_column(spark):
    df = spark.createDataFrame([(f"i{k % 500}",) for k in range(4000)] + [("top",)] * 12, "item string").repartition(2)
    got = most_frequent(df, F.col("item"), 1, width=50).collect()
    assert [(r["item"], r["n_rows"], r["complete"]) for r in got] == [("top", 12, True)]
    # memory for fewer rows than it takes: the answer says that it may be incomplete
    few = most_frequent(df, F.col("item"), 1, width=50, max_width=60).collect()
    assert not any(r["complete"] for r in few) and all(r["at_least"] <= r["n_rows"] <= r["at_most"] for r in few)


def test_few_items_and_ties(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,), ("",)], "item string").repartition(2)
    top = lambda k, **o: {r["item"]: r["n_rows"] for r in most_frequent(df, F.col("item"), k, **o).collect()}
    assert top(1, width=2) == {"b": 2}
    # ties at the last place stay, also of items that no task kept
    assert top(2, width=2) == top(9) == {"a": 1, "b": 2, "c": 1, "": 1}
    assert all(r["at_least"] <= r["n_rows"] <= r["at_most"] for r in most_frequent(df, F.col("item"), 9).collect())
    assert most_frequent(df.limit(0), F.col("item"), 2).count() == 0
    assert most_frequent(df.limit(0), F.col("item"), 2, exact=False).count() == 0


PS = {"lo": 0.0, "p10": 0.1, "mid": 0.5, "p99": 0.99, "hi": 1.0}


def near(got, want, error):
    return got == 0 if want == 0 else abs(got - want) <= error * abs(want) + 1e-12


def test_error_bound_and_merging(spark):
    rng = random.Random(11)
    rows = []
    for g in ("a", "b", None):
        for day in range(3):
            rows += [(g, day, rng.choice([rng.lognormvariate(3, 4), -rng.expovariate(0.01), 0.0, float(rng.randrange(-5, 300))]), 1, 2) for _ in range(700)]
    rows += [("a", 0, None, 0, 0), ("a", 0, float("nan"), 0, 0), ("a", 1, float("inf"), 0, 0), ("c", 0, 42.0, 0, 0)]
    df = spark.createDataFrame(rows, "g string, day int, v double, sgn int, bucket int")
    for error in (0.01, 0.05):
        whole = merge(sketch(df, ["g", "day"], "v", error), ["g"])
        direct = sketch(df, ["g"], "v", error)
        got = {r["g"]: r for r in percentiles(whole, ["g"], PS, error).collect()}
        again = {r["g"]: r for r in percentiles(direct, ["g"], PS, error).collect()}
        assert got == again
        for g in ("a", "b", "c", None):
            values = sorted(v for h, _, v, *_ in rows if h == g and v is not None and math.isfinite(v))
            assert got[g]["n_values"] == len(values)
            for name, p in PS.items():
                assert near(got[g][name], values[math.floor(p * (len(values) - 1))], error), (g, name)


def test_no_values(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert percentiles(sketch(df, ["g"], "v"), ["g"], PS).count() == 0
