import random

import numpy as np

from readloom.operators.phase import best_haplotype, phased, pieces


def simulate(seed, sites, n, errors, chrom=0, offset=0):
    rng = random.Random(seed)
    hap = [rng.randrange(2) for _ in range(sites)]
    hap = [h ^ hap[0] for h in hap]
    rows, side = [], {}
    for r in range(n):
        a = rng.randrange(0, sites - 2)
        b = min(sites, a + rng.randrange(2, 14))
        s = rng.randrange(2)
        side[f"r{chrom}_{r}"] = (s, b - a)
        for i in range(a, b):
            rows.append((chrom, offset + i * 50, f"r{chrom}_{r}", hap[i] ^ s ^ int(rng.random() < errors)))
    return hap, rows, side


def test_haplotypes_are_found(spark):
    one, rows1, side1 = simulate(1, 40, 300, 0.03)
    two, rows2, side2 = simulate(2, 25, 200, 0.03, chrom=1, offset=7)
    extra = [(0, 10**6, "alone", 1), (0, 5, None, 1), (1, None, "x", 0), (1, 9, "y", 2)]
    df = spark.createDataFrame(rows1 + rows2 + extra, "tid int, pos int, read string, allele int").repartition(3)
    got = phased(df).collect()
    for chrom, offset, hap in ((0, 0, one), (1, 7, two)):
        sites = {r["pos"]: r["haplotype"] for r in got if r["kind"] == "site" and r["tid"] == chrom}
        assert [sites[offset + i * 50] for i in range(len(hap))] == hap
        assert {r["block"] for r in got if r["tid"] == chrom} == {offset}
    reads = {r["read"]: r["haplotype"] for r in got if r["kind"] == "read"}
    long = {k: v for k, v in {**side1, **side2}.items() if v[1] >= 4}
    assert sum(reads[k] == s for k, (s, _) in long.items()) >= 0.97 * len(long) and "alone" not in reads


def test_blocks_that_no_read_joins(spark):
    rows = [(0, 1, "a", 0), (0, 2, "a", 1), (0, 2, "b", 1), (0, 3, "b", 1), (0, 4, "c", 0), (0, 5, "c", 0)]
    got = phased(spark.createDataFrame(rows, "tid int, pos int, read string, allele int")).where("kind = 'site'").collect()
    assert sorted((r["block"], r["pos"], r["haplotype"]) for r in got) == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (4, 4, 0), (4, 5, 0)]


def test_against_all_haplotypes():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = 9
        reads = []
        for _ in range(12):
            s = np.sort(rng.choice(n, int(rng.integers(2, 5)), replace=False))
            reads += pieces(s, rng.integers(0, 2, len(s)), 9)
        fit = lambda h: sum(max(w := (sum((h >> t) & 1 != (b >> (t - f)) & 1 for t in range(f, n) if (m >> (t - f)) & 1)), m.bit_count() - w) for f, m, b in reads)  # noqa: B023, E731
        best = best_haplotype(n, reads, 9)
        short = best_haplotype(n, [p for p in reads if p[1].bit_length() <= 5], 5)
        assert fit(int((best.astype(int) << np.arange(n)).sum())) == max(fit(h) for h in range(1 << n))
        assert short[0] == 0 and len(short) == n


def test_pieces_share_a_call():
    got = pieces(np.array([0, 3, 9, 10, 30]), np.array([1, 0, 1, 1, 0]), 8)
    assert got == [(0, 0b1001, 0b0001), (3, 0b11000001, 0b11000000)]
