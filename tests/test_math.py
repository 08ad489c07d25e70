import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.functions import hashes as H
from readloom.functions import seq as S
from readloom.functions.flags import letters
from readloom.operators import joins as J
from readloom.operators import order as O
from readloom.operators import realign as Z
from readloom.operators import calling as K
from readloom.operators import variants as V

M = 0xFFFFFFFF


def test_special_functions():
    assert V.gamma_q(0.5, 2.0) == pytest.approx(math.erfc(math.sqrt(2.0)), rel=1e-12)
    assert V.gamma_q(1, 3.7) == pytest.approx(math.exp(-3.7))
    assert V.chi2_p(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert V.beta_i(1, 1, 0.3) == pytest.approx(0.3)
    assert V.beta_i(2, 3, 0.4) == pytest.approx(sum(math.comb(4, k) * 0.4**k * 0.6 ** (4 - k) for k in (2, 3, 4)))
    assert V.beta_i(2, 3, 0) == 0 and V.beta_i(2, 3, 1) == 1


def test_fisher_and_t():
    def slow(a, b, c, d):
        r, k, n = a + b, a + c, a + b + c + d
        p = {x: math.comb(r, x) * math.comb(n - r, k - x) / math.comb(n, k) for x in range(max(0, r + k - n), min(r, k) + 1)}
        return sum(v for v in p.values() if v <= p[a] * (1 + 1e-9))

    for t in ((3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 5, 0), (7, 7, 7, 7)):
        assert V.fisher_exact(*t) == pytest.approx(slow(*t))
    assert V.t_test(5, 15, 55, 5, 40, 330) == 1
    assert 0 < V.t_test(5, 40, 330, 5, 15, 55) < 0.001


def test_em_against_plain_loops():
    rng = np.random.default_rng(4)
    pl = rng.integers(0, 60, (6, 30))
    f = V.em_frequency(pl, rounds=400, tolerance=1e-12)
    for site, want in zip(pl, f):
        g = 10 ** (-site.reshape(-1, 3) / 10)
        like = lambda p: sum(math.log(x[0] * (1 - p) ** 2 + x[1] * 2 * p * (1 - p) + x[2] * p * p) for x in g)  # noqa: E731, B023
        assert like(want) >= max(like(k / 200) for k in range(1, 200)) - 1e-6
    assert np.allclose(V.em_genotypes(pl).sum(1), 1)
    assert ((V.hwe_p(pl) >= 0) & (V.hwe_p(pl) <= 1)).all()


def test_allele_count_posterior():
    rng = np.random.default_rng(5)
    pl = rng.integers(0, 40, (3, 9))
    got = V.allele_count_posterior(pl, 0.01)
    for site, post in zip(pl, got):
        g = 10 ** (-site.reshape(3, 3) / 10)
        like = np.zeros(7)
        for combo in product(range(3), repeat=3):
            k = sum(combo)
            like[k] += np.prod([g[i, c] * (1, 2, 1)[c] for i, c in enumerate(combo)]) / math.comb(6, k)
        prior = np.array([1 - sum(0.01 / k for k in range(1, 7))] + [0.01 / k for k in range(1, 7)])
        assert np.allclose(post, like * prior / (like * prior).sum())


def test_linkage():
    sure = lambda genotypes: np.array([[0 if g == k else 200 for k in range(3)] for g in genotypes]).ravel()
    a = [0, 0, 2, 2, 1, 0, 2, 1] * 4
    assert K.haplotype_r2_rows(sure(a)[None], sure(a)[None])[0] == pytest.approx(1, abs=1e-6)
    b = [0, 2, 0, 2] * 8
    assert K.haplotype_r2_rows(sure([0, 0, 2, 2] * 8)[None], sure(b)[None])[0] == pytest.approx(0, abs=1e-6)


def test_alignment_scores():
    def slow(a, b, s=(1, -3, -5, -2)):
        match, mis, op, ext = s
        low = -(10**9)
        n, m = len(a), len(b)
        h = [[low] * (m + 1) for _ in range(n + 1)]
        e = [[low] * (m + 1) for _ in range(n + 1)]
        f = [[low] * (m + 1) for _ in range(n + 1)]
        h[0][0] = 0
        for i in range(n + 1):
            for j in range(m + 1):
                if i:
                    e[i][j] = max(h[i - 1][j] + op + ext, e[i - 1][j] + ext)
                if j:
                    f[i][j] = max(h[i][j - 1] + op + ext, f[i][j - 1] + ext)
                d = h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mis) if i and j else low
                if i or j:
                    h[i][j] = max(d, e[i][j], f[i][j])
        return h[n][m]

    rng = random.Random(3)
    for _ in range(150):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 12))) for _ in "ab")
        score, cigar = Z.global_align(a, b)
        assert score == slow(a, b), (a, b)
        got, i, j = 0, 0, 0
        for n, op in ((int(x), y) for x, y in __import__("re").findall(r"(\d+)([MID])", cigar)):
            if op == "M":
                got += sum(1 if a[i + k] == b[j + k] else -3 for k in range(n))
                i, j = i + n, j + n
            else:
                got -= 5 + 2 * n
                i, j = (i + n, j) if op == "I" else (i, j + n)
        assert (got, i, j) == (score, len(a), len(b)), (a, b, cigar)


def test_nm_md():
    ref = "ACGTACGTACGT"
    assert Z.nm_md(0, "4M", "ACGT", ref) == (0, "4")
    assert Z.nm_md(0, "4M", "AGGT", ref) == (1, "1C2")
    assert Z.nm_md(0, "2M2D2M", "ACAC", ref) == (2, "2^GT2")
    assert Z.nm_md(0, "1S2M1I2M", "TACTGT", ref) == (1, "4")
    assert Z.nm_md(0, "2M4N2M", "ACGT", ref) == (0, "4")


def test_path():
    rng = np.random.default_rng(2)
    for _ in range(30):
        s = rng.normal(size=8)
        got = Z.two_state_path(s, 0.7)
        value = lambda p: sum(x for x, k in zip(s, p) if k) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert value(got) == pytest.approx(max(map(value, product((0, 1), repeat=8))))


def test_hashes(spark):
    names = ["", "a", "read/1", "ERR016352.12652484", "~" * 40]

    def rs(s):
        h, a = 0, 63689
        for c in s:
            h, a = (h * a + ord(c)) & M, a * 378551 & M
        return h

    def fold(s, h, f):
        for i, c in enumerate(s):
            h = f(h, ord(c), i) & M
        return h

    def elf(h, c, i):
        h = ((h << 4) + c) & M
        x = h & 0xF0000000
        return (h ^ (x >> 24)) & ~x

    want = {
        "rs": rs, "x31": lambda s: fold(s, 0, lambda h, c, i: h * 31 + c), "djb": lambda s: fold(s, 5381, lambda h, c, i: h * 33 + c),
        "js": lambda s: fold(s, 1315423911, lambda h, c, i: h ^ (((h << 5) + c + (h >> 2)) & M)), "fnv": lambda s: fold(s, 0, lambda h, c, i: (h * 0x811C9DC5 & M) ^ c),
        "dek": lambda s: fold(s, len(s), lambda h, c, i: ((h << 5) & M) ^ (h >> 27) ^ c), "bp": lambda s: fold(s, 0, lambda h, c, i: (h << 7) ^ c), "elf": lambda s: fold(s, 0, elf),
        "ap": lambda s: fold(s, 0xAAAAAAAA, lambda h, c, i: h ^ ((h << 7) ^ c * (h >> 3)) if i % 2 == 0 else h ^ ~((h << 11) + (c ^ (h >> 5)))),
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for k, f in want.items():
        got = {r[0]: r[1] for r in df.select("n", getattr(H, k)("n")).collect()}
        assert got == {n: f(n) for n in names}, k


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGTNacgtR",)], "s string")
    one = lambda c: df.select(c).first()[0]
    assert one(S.reverse_complement("s")) == "YacgtNACGT"
    assert one(S.combine(F.lit("ACGTA"), F.lit("CCTTN"))) == "MCKTN"
    assert one(S.combine(F.lit("MRA"), F.lit("AGC"), "and")) == "AGN"
    assert one(S.mask_intervals("s", F.array(F.struct(F.lit(2).alias("beg"), F.lit(4).alias("end"))), "")) == "ACgtNacgtR"
    assert one(S.subsequence("s", F.lit(8), F.lit(99))) == "tR"
    assert one(S.wrap(F.lit("ABCDEF"), 3)) == "ABC\nDEF"
    assert one(S.mutate("s", F.lit(99), F.lit("T"))) == "ACGTNacgtR"
    assert one(S.random_base(F.lit("R"), F.lit("x"))) in "AG" and one(S.random_base(F.lit("N"), F.lit("x"))) == "N"
    assert one(letters(F.lit(163))) == "pPR2"


def test_natural_order(spark):
    names = ["r10", "r9", "r010", "a2b10", "a2b9", "a10b1", "r", "b", "r9x", "10", "9"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(O.natural_key("n"), "n").collect()]
    assert got == ["9", "10", "a2b9", "a2b10", "a10b1", "b", "r", "r9", "r9x", "r010", "r10"]


def test_ranks_are_a_total_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.col("id"))
    got = O.ranked(df, [F.col("v").desc(), F.col("id").asc()]).collect()
    assert all(r["rank"] == 5000 - r["v"] for r in got)
    assert O.ranked(df.limit(0), [F.col("v").asc()]).count() == 0


def test_interval_joins_against_loops(spark):
    rng = random.Random(9)
    left = [(i, rng.randrange(3), s := rng.randrange(200000), s + rng.choice([0, 1, 50, 40000, 300000])) for i in range(120)]
    right = [(i, rng.randrange(3), s := rng.randrange(200000), s + rng.choice([1, 30, 20000, 500000])) for i in range(80)]
    a = spark.createDataFrame([*left, *left[:5], (999, None, 1, 2)], "id int, tid int, pos int, end int")
    b = spark.createDataFrame([*right, (999, None, 1, 2)], "r int, tid int, start int, stop int")
    hit = lambda l, r: l[1] == r[1] and l[2] < r[3] and r[2] < l[3] and l[2] < l[3]
    got = sorted(map(tuple, J.interval_join(a, b).select("id", "r").collect()))
    assert got == sorted((l[0], r[0]) for l in [*left, *left[:5]] for r in right if hit(l, r))
    one = lambda l: (*l[:3], max(l[3], l[2] + 1))
    semi = sorted(r["id"] for r in J.overlap_semi(a, b).collect())
    assert semi == sorted(l[0] for l in [*left, *left[:5]] if any(hit(one(l), r) for r in right))
