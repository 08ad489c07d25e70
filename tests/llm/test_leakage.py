import random

import numpy as np
import pytest
import regex

from readloom.llm.leakage import BitTable, Piece, edit_distances, edited, find_leaks, leak_recall, plan_walks, whole_matches

WORDS = [f"w{i}" for i in range(400)] + ["the", "of"] * 40


def words(t):
    return regex.findall(r"[\p{L}\p{N}]+", t.lower()) if t else []


def brute(docs, items, n=12):
    grams = lambda t: {tuple(w[i : i + n]) for w in [words(t)] for i in range(len(w) - n + 1)}
    return sorted({(d, i) for d, t, *_ in docs for i, u, *_ in items if grams(t) & grams(u)})


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def make(seed=2):
    rng = random.Random(seed)
    items = [(i, text(rng, rng.randrange(15, 60))) for i in range(30)]
    docs = []
    for d in range(120):
        t = text(rng, rng.randrange(0, 120)).split()
        if d % 3 == 0:
            w = rng.choice(items)[1].split()
            k = rng.choice([11, 12, 13, len(w)])
            a = rng.randrange(0, max(1, len(w) - k + 1))
            at = rng.randrange(0, len(t) + 1)
            t[at:at] = w[a : a + k]
        docs.append((d, (" , ".join(t)).upper() if d % 2 else "\n".join(t)))
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, 0, "x") for r in docs], "doc_id bigint, text string, item_id int, words string").repartition(3)
    return d, spark.createDataFrame(items, "item_id bigint, text string")


def exact(df):
    return sorted(tuple(r) for r in df.where("edits = 0").select("doc_id", "item_id").collect())


def test_shared_passages(spark):
    docs, items = make()
    docs += [(900, None), (901, ""), (902, "..."), (903, items[0][1]), (903, items[0][1])]
    items += [(50, items[0][1]), (51, "too short"), (52, None), (50, items[0][1])]
    d, i = frames(spark, docs, [x for x in items])
    want = brute([x for x in docs], [x for x in items])
    assert exact(find_leaks(d, i)) == want and len(want) > 20
    assert exact(find_leaks(d, i, table_bytes=256)) == want  # a table that is all but full passes everything on
    assert exact(find_leaks(d, i, max_edits=0)) == want


def test_empty_sides(spark):
    docs, items = make()
    d, i = frames(spark, docs, items)
    assert find_leaks(d.limit(0), i).count() == 0
    assert find_leaks(d, i.limit(0)).count() == 0


def test_very_long_text(spark):
    rng = random.Random(1)
    items = [(1, text(rng, 30))]
    long = text(rng, 60_000) + " " + items[0][1] + " " + text(rng, 60_000)
    d, i = frames(spark, [(1, long), (2, text(rng, 50))], items)
    got = find_leaks(d, i).collect()
    assert [(r["doc_id"], r["edits"], r["first_word"]) for r in got if r["edits"] == 0] == [(1, 0, 60_000)]


def test_recall_of_edited_passages(spark):
    """A passage of exactly 12 words with one word changed, deleted or inserted is found with the recall asked for."""
    rng = random.Random(4)
    items = [(i, " ".join(f"u{i}x{k}" for k in range(12))) for i in range(300)]
    docs = []
    for i, t in items:
        w, k = t.split(), rng.randrange(1, 11)
        w[k : k + 1] = (["changed"], [], ["new", w[k]])[i % 3]
        docs.append((i, text(rng, 20) + " " + " ".join(w) + " " + text(rng, 20)))
    d, i = frames(spark, docs, items)
    found = find_leaks(d, i, max_edits=1, recall=0.95).where("edits = 1 and doc_id = item_id").count()
    assert found >= 0.95 * len(items)


def test_edit_distance():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 4, (200, 7)), rng.integers(0, 4, (200, 7))

    def slow(a, b):
        if not len(a) or not len(b):
            return len(a) + len(b)
        return min(slow(a[1:], b) + 1, slow(a, b[1:]) + 1, slow(a[1:], b[1:]) + (a[0] != b[0])) if a[0] != b[0] else slow(a[1:], b[1:])

    want = [slow(list(a[:5]), list(b[:5])) for a, b in zip(x, y)]
    assert edit_distances(x[:, :5], y[:, :5]).tolist() == want


def test_more_walks_for_more_recall():
    p = np.random.default_rng(1).integers(1, 2**63, (500, 12), dtype=np.uint64)
    assert len(plan_walks(p, 6, 0, 0.95)) == 1
    assert len(plan_walks(p, 6, 1, 0.99)) >= len(plan_walks(p, 6, 1, 0.8)) >= 1
    assert len(plan_walks(p, 6, 2, 0.95)) >= len(plan_walks(p, 6, 1, 0.95))


def test_exact_pieces_where_walks_do_not_reach():
    p = np.random.default_rng(1).integers(1, 2**63, (500, 12), dtype=np.uint64)
    pieces = plan_walks(p, 6, 4, 0.99)
    assert all(isinstance(x, Piece) for x in pieces) and len(pieces) == 5
    assert [x.at for x in pieces] == np.cumsum([0] + [x.length for x in pieces])[:-1].tolist() and sum(x.length for x in pieces) == 12


@pytest.mark.parametrize("edits", [2, 3, 4])
def test_recall_with_more_edits(spark, edits):
    rng = random.Random(edits)
    items = [(i, " ".join(f"u{i}x{k}" for k in range(12))) for i in range(200)]
    docs = []
    for i, t in items:
        w = t.split()
        for e in range(edits):
            k = rng.randrange(1, len(w) - 1)
            w[k : k + 1] = (["changed"], [], [f"new{e}", w[k]])[rng.randrange(3)]
        docs.append((i, text(rng, 20) + " " + " ".join(w) + " " + text(rng, 20)))
    d, i = frames(spark, docs, items)
    found = find_leaks(d, i, max_edits=edits, whole_edits=None).where("doc_id = item_id").count()
    assert found >= 0.95 * len(items)


def nearest(item, doc, k):
    """Least edits of the whole item against any stretch of the document, or None beyond k."""
    previous = [0] * (len(doc) + 1)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(doc, 1):
            row.append(min(previous[j] + 1, row[-1] + 1, previous[j - 1] + (a != b)))
        previous = row
    return min(previous) if min(previous) <= k else None


def test_whole_items_with_edits_all_over(spark):
    rng = random.Random(7)
    items = [(i, " ".join(f"u{i}x{k}" if k % 3 else rng.choice(WORDS) for k in range(rng.randrange(12, 90)))) for i in range(60)]
    docs = []
    for i, t in items * 2:
        w = t.split()
        for k in sorted(rng.sample(range(1, len(w) - 1), rng.randrange(0, len(w) // 10 + 1)), reverse=True):
            w[k : k + 1] = (["changed"], [], ["new", w[k]])[rng.randrange(3)]
        docs.append((len(docs), text(rng, rng.randrange(0, 30)) + " " + " ".join(w) + " " + text(rng, rng.randrange(0, 30))))
    docs.append((len(docs), text(rng, 300)))
    d, i = frames(spark, docs, items)
    got = {(r["doc_id"], r["item_id"]): r for r in find_leaks(d, i).where("whole_edits is not null").collect()}
    want = {(a, b): n for a, t in docs for b, u in items for n in [nearest(words(u), words(t), len(words(u)) // 10)] if n is not None}
    assert len(want) >= 120 and all(got[p]["whole_edits"] == want[p] for p in got)
    assert len(got) >= 0.97 * len(want)
    far_apart = [r for r in got.values() if r["edits"] is None]
    assert all(r["last_word"] >= r["first_word"] and r["n_passages"] == 0 for r in far_apart)


def test_whole_matches_against_brute_force():
    rng = np.random.default_rng(5)
    for n, k in ((12, 1), (20, 2), (33, 3)):
        items = rng.integers(0, 9, (80, n)).astype(np.uint64)
        docs = np.stack([np.concatenate([rng.integers(0, 9, 10).astype(np.uint64), edited(x[None], int(rng.integers(0, k + 2)), "mixed", int(x[0]))[0], rng.integers(0, 9, 10).astype(np.uint64)]) for x in items])
        m = docs.shape[1]
        lo = np.arange(80) * m
        d, start, size = whole_matches(docs.ravel(), lo, lo + m, lo + 10, items, k)
        for r in range(80):
            stretches = [docs[r, a : a + w] for a in range(10 - k, 10 + k + 1) for w in range(n - k, n + k + 1) if a + w <= m]
            best = min(int(edit_distances(items[r][None], y[None])[0]) for y in stretches)
            assert d[r] == (best if best <= k else -1)
            if d[r] >= 0:
                a = start[r] - lo[r]
                assert edit_distances(items[r][None], docs[r, a : a + size[r]][None])[0] == d[r]


def test_bit_table(spark):
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    table = BitTable.build(spark.createDataFrame([(int(x),) for x in h], "h bigint").repartition(3), 5000, 1 << 20)
    assert len(table.contains(h.view(np.uint64))) == 5000
    other = np.random.default_rng(2).integers(0, 2**63, 100_000).astype(np.uint64)
    assert len(table.contains(other)) < 200


def test_measured_recall(spark):
    _, items = make()
    rows = leak_recall(frames(spark, [(1, "x")], items)[1], recall=0.9).collect()
    assert {r["edit"] for r in rows} == {"changed", "left out", "put in", "mixed"} and all(r["recall"] >= 0.9 for r in rows)
    assert leak_recall(frames(spark, [(1, "x")], items)[1].limit(0)).count() == 0


def test_a_passage_many_documents_have(spark):
    """One signature in a third of all documents."""
    rng = random.Random(3)
    items = [(1, text(rng, 14)), (2, text(rng, 20))]
    docs = [(i, text(rng, 15) + (" " + items[0][1] if i % 3 == 0 else "")) for i in range(600)]
    d, i = frames(spark, docs, items)
    assert exact(find_leaks(d, i)) == [(k, 1) for k in range(0, 600, 3)]
