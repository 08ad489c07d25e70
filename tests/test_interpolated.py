from collections import Counter

from readloom.operators import aggregates as A

READS = [
    ("far", 3 | 64, 0, 10, "50M"), ("far", 3 | 128 | 16, 0, 9000, "20M5D30M"),  # a proper pair over more than 2,000 bases
    ("near", 3 | 64, 0, 100, "50M"), ("near", 3 | 128, 0, 120, "10S40M"),
    ("loose", 1 | 64, 0, 200, "50M"), ("loose", 1 | 128, 0, 800, "50M"),  # not proper: only their own bases
    ("half", 3 | 64, 0, 300, "50M"), ("half", 1 | 128, 0, 5000, "50M"),
    ("apart", 3 | 64, 0, 400, "50M"), ("apart", 3 | 128, 1, 700, "50M"),
    ("many", 3 | 64, 1, 0, "50M"), ("many", 3 | 64, 1, 3000, "50M"), ("many", 3 | 128, 1, 100, "50M"), ("many", 3 | 128, 1, 3100, "50M"), ("many", 3 | 128, 1, 6000, "50M"),
    ("single", 0, 1, 20, "25M100N25M"),
    ("off", 3 | 4 | 64, 0, 10, "50M"), ("none", 0, -1, 10, "50M"),
]
SPANS = [(0, 10, 9055), (0, 100, 160), (0, 200, 250), (0, 800, 850), (0, 300, 350), (0, 5000, 5050), (0, 400, 450), (1, 700, 750), (1, 0, 150), (1, 3000, 3150), (1, 6000, 6050), (1, 20, 170)]


def test_every_read_counts_and_proper_pairs_are_filled(spark):
    x = spark.createDataFrame(READS, "qname string, flag int, tid int, pos int, cigar string")
    got = Counter()
    for r in A.depth_runs(A.interpolated_blocks(x), "tid", bin_width=1000).collect():
        got.update({(r["tid"], p): r["depth"] for p in range(r["beg"], r["end"])})
    assert got == Counter((t, p) for t, b, e in SPANS for p in range(b, e))
