import random

import pytest

from readloom.llm.leakage import find_leaks


@pytest.mark.parametrize("kind", ["left out", "put in"])
@pytest.mark.parametrize("table_bytes", [1 << 23, 256])
def test_copies_with_one_word_more_or_less(spark, kind, table_bytes):
    """Copied runs of 12 words with a word left out or put in near the middle, at the edge of a text and inside."""
    rng = random.Random(8)
    items = [(i, " ".join(f"u{i}x{k}" for k in range(12))) for i in range(200)]
    docs = []
    for i, t in items:
        w, k = t.split(), rng.randrange(3, 9)
        w[k : k + 1] = [] if kind == "left out" else ["new", w[k]]
        around = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(20 * (i % 2))) for _ in "ab"]
        docs.append((i, f"{around[0]} {' '.join(w)} {around[1]}"))
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = find_leaks(d, i, table_bytes=table_bytes).where("doc_id = item_id and edits = 1").collect()
    assert len(got) >= 0.95 * len(items)
    assert {(r["first_word"] - 20 * (r["doc_id"] % 2), r["last_word"] - r["first_word"] + 1) for r in got} == {(0, 11 if kind == "left out" else 13)}
