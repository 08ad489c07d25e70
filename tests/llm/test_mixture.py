import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm.mixture import TOKENIZER, cut, encoding, mix, permuted, place_of, running_starts, shard_counts, slot_key, slot_tokens, slot_totals, split, wanted_tokens


def test_permutations():
    for n in (1, 2, 3, 17, 64, 1000, 4097):
        for key in (0, 5, 10**12):
            got = permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(got.tolist()) == list(range(n))
            assert all(place_of(int(x), n, key) == k for k, x in enumerate(got[:20]))
    a, b = (permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k)) for k in (1, 2))
    assert (a != b).mean() > 0.9


def test_cut():
    rng = np.random.default_rng(2)
    for at in (0, 1, 63, 64, 1000):
        sizes = rng.integers(0, 40, 60)
        pieces, edges, doc, first = cut(at, sizes, 64)
        assert pieces[0] == 0 and pieces[-1] == sizes.sum() and all((at + p) % 64 == 0 for p in pieces[1:-1])
        owner = np.repeat(np.arange(60), sizes)
        assert np.array_equal(np.repeat(doc, np.diff(edges)), owner)
        assert np.array_equal(edges[first], pieces)


def test_wanted():
    assert wanted_tokens(np.array([1.0]), np.array([10.0])).tolist() == [10]
    assert wanted_tokens(np.array([0.5, 0.5]), np.array([1000.0, 1e9])).tolist() == [1000, 1000]
    assert wanted_tokens(np.array([0.5, 0.5]), np.array([1000.0, 1e9]), 3000).tolist() == [1000, 2000]
    assert wanted_tokens(np.array([0.5, 0.5]), np.array([1000.0, 1e9]), 500).tolist() == [250, 250]
    assert wanted_tokens(np.array([0.5, 0.5]), np.array([1000.0, 0.0])).tolist() == [1000, 0]
    assert wanted_tokens(np.array([0.0]), np.array([0.0])).tolist() == [0]
    assert wanted_tokens(np.array([0.5, 0.5]), np.array([10.0, 20.0]), 1e9).tolist() == [10, 20]


def test_slot_totals():
    tokens, repeats = np.array([100_010, 250, 0, 63]), np.array([1, 4, 2, 3])
    for wanted in ([4000.0, 700.0, 0.0, 189.0], [100_010.0, 1000.0, 5.0, 64.0], [99.0, 333.0, 0.0, 0.0]):
        n = slot_totals(np.array(wanted), tokens, repeats, 100, 9)
        for s, (w, t, r) in enumerate(zip(wanted, tokens.tolist(), repeats.tolist())):
            blocks = -(-t // 100)
            assert 0 <= n[s] <= blocks * r
            if t:
                order = np.concatenate([permuted(np.arange(blocks), np.full(blocks, blocks), np.full(blocks, slot_key(9, s, u))) for u in range(r)])
                size = np.where(order == blocks - 1, t - (blocks - 1) * 100, 100).cumsum()
                used = lambda k: size[k - 1] if k else 0  # noqa: B023, E731
                assert used(n[s]) == slot_tokens(int(n[s]), s, t, 100, 9)
                assert abs(used(n[s]) - w) == min(abs(used(k) - w) for k in range(blocks * r + 1))


@pytest.mark.parametrize("shards", [1, 2, 7, 64])
def test_shard_counts(shards):
    totals = np.array([500, 0, 37, 3])
    size = -(-540 // shards)
    all_ = list(shard_counts(0, 10**9, totals, size, 5))
    assert sum(c for _, c, _ in all_).tolist() == totals.tolist()
    running = np.zeros(4, np.int64)
    for k, (shard, counts, before) in enumerate(all_):
        assert shard == k and before.tolist() == running.tolist() and counts.sum() == min(size, 540 - k * size)
        running += counts
        one = list(shard_counts(k, k + 1, totals, size, 5))
        assert one[0][1].tolist() == counts.tolist() and one[0][2].tolist() == before.tolist()


def test_split_of_huge_counts():
    counts = np.array([10**12, 3 * 10**12, 5])
    left = split(counts, 10**12, np.random.default_rng(1))
    assert left.sum() == 10**12 and (left >= 0).all() and (left <= counts).all()
    assert abs(left[0] / 10**12 - 0.25) < 1e-4


def test_running_starts(spark):
    rng = random.Random(4)
    rows = [(k, o, rng.randrange(9)) for k in range(3) for o in rng.sample(range(500), 120)]
    got = {(r[0], r[1]): r[2] for r in running_starts(spark.createDataFrame(rows, "k int, o bigint, v int"), "k", "o", "v", 16).collect()}
    assert got == {(k, o): sum(v for a, b, v in rows if a == k and b < o) for k, o, _ in rows}


def corpus(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        s = rng.choice(["big"] * 6 + ["mid", "mid", "tiny"])
        name = rng.choice([s, s.upper(), f" {s} "])
        rows.append((i, " ".join(f"word{rng.randrange(99)}" for _ in range(rng.randrange(5, 60))), name, 1, "x"))
    rows += [(1000, None, "big", 1, "x"), (1001, "", "mid", 1, "x"), (1002, "text", None, 1, "x"), (1003, "text", "other", 1, "x"), (1004, "same text", "big", 1, "x"), (1004, "same text", "big", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, use int, tokens string").repartition(3)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 4), ("gone", 0.0, 3)], "source string, target_share double, max_repeats int")
    return rows, docs, targets


def test_mixture(spark):
    rows, docs, targets = corpus(spark)
    mixture, shares = mix(docs, targets, block_tokens=16, shard_blocks=100)
    got = mixture.collect()
    enc = encoding(TOKENIZER)
    size = {}
    for i, t, s, *_ in rows:
        if t and s and s.strip().lower() in ("big", "mid", "tiny"):
            size.setdefault(s.strip().lower(), []).append((i, len(enc.encode_ordinary(t))))
    by = {r["source"]: r for r in shares.collect()}
    assert set(by) == {"big", "mid", "tiny", "gone"}
    total = sum(r["n_tokens"] for r in got)
    for s, cap, share in (("big", 1, 0.5), ("mid", 2, 0.3), ("tiny", 4, 0.2)):
        mine = [r for r in got if r["source"] == s]
        uses = {}
        for r in mine:
            assert len(r["tokens"]) == r["n_tokens"] == sum(r["doc_tokens"]) and len(r["doc_ids"]) == len(r["doc_tokens"])
            uses[r["block"]] = uses.get(r["block"], 0) + 1
            assert r["use"] < cap
        assert max(uses.values()) <= cap
        assert by[s]["tokens_there"] == sum(n for _, n in size[s])
        assert by[s]["tokens_used"] == sum(r["n_tokens"] for r in mine)
        assert by[s]["actual_share"] == pytest.approx(by[s]["tokens_used"] / total)
        assert abs(by[s]["tokens_used"] - share * total) <= 16
        tokens_of = {}
        for r in mine:  # no document is used more often than its source may be
            for i, n in zip(r["doc_ids"], r["doc_tokens"]):
                tokens_of[i] = tokens_of.get(i, 0) + n
        own = {}
        for i, n in size[s]:
            own[i] = own.get(i, 0) + n
        assert all(n <= cap * own[i] for i, n in tokens_of.items())
    assert by["gone"]["tokens_used"] == 0
    places = {}
    for r in got:
        places.setdefault(r["shard"], []).append(r["place"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert all(len(p) == 100 for s, p in places.items() if s != max(places))


def test_tokens_are_the_texts(spark):
    _, docs, targets = corpus(spark)
    one = docs.where("doc_id = 5")
    t = one.first()
    target = spark.createDataFrame([(t["source"].strip().lower(), 1.0, 1)], "source string, target_share double, max_repeats int")
    got = sorted(mix(one, target, block_tokens=8)[0].collect(), key=lambda r: r["block"])
    assert encoding(TOKENIZER).decode([x for r in got for x in r["tokens"]]) == t["text"]
    assert {i for r in got for i in r["doc_ids"]} == {5}


def test_nothing_to_mix(spark):
    _, docs, targets = corpus(spark)
    mixture, shares = mix(docs.limit(0), targets)
    assert mixture.count() == 0 and [r["tokens_used"] for r in shares.collect()] == [0] * 4
    few, _ = mix(docs, targets, block_tokens=16, total_tokens=800)
    assert abs(sum(r["n_tokens"] for r in few.collect()) - 800) <= 48
    twice = targets.withColumn("target_share", F.lit(None).cast("double"))
    assert mix(docs, twice)[0].count() == 0


def test_same_blocks_whatever_the_layout(spark):
    _, docs, targets = corpus(spark)
    rows = lambda n: sorted(map(str, mix(docs.repartition(n), targets, block_tokens=16, shard_blocks=50)[0].collect()))
    one = rows(1)
    assert one == rows(4) == rows(64)


def test_all_of_what_is_feasible_is_used(spark):
    _, docs, targets = corpus(spark)
    by = {r["source"]: r for r in mix(docs, targets, block_tokens=16)[1].collect()}
    most = min(by[s]["tokens_there"] * cap / share for s, cap, share in (("big", 1, 0.5), ("mid", 2, 0.3), ("tiny", 4, 0.2)))
    used = sum(r["tokens_used"] for r in by.values())
    assert 0.98 * most <= used <= 1.02 * most


def test_capped_sources_fall_short(spark):
    _, docs, targets = corpus(spark)
    there = {r["source"]: r["tokens_there"] for r in mix(docs, targets, block_tokens=16)[1].collect()}
    caps = {"big": there["big"], "mid": 2 * there["mid"], "tiny": 4 * there["tiny"]}
    by = {r["source"]: r for r in mix(docs, targets, block_tokens=16, total_tokens=10**9)[1].collect()}
    assert {s: by[s]["tokens_used"] for s in caps} == caps


def test_a_source_in_one_long_text(spark):
    text = " ".join(f"w{i}" for i in range(30_000))
    docs = spark.createDataFrame([(1, text, "a"), (None, "short text", "a"), (None, "other", "a")], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = mix(docs, targets, block_tokens=64)[0].collect()
    enc = encoding(TOKENIZER)
    assert sum(r["n_tokens"] for r in got) == sum(len(enc.encode_ordinary(t)) for t in (text, "short text", "other"))
    assert sum(r["n_tokens"] < 64 for r in got) <= 1
