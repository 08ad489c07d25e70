import numpy as np

from readloom.operators import baq as B
from readloom.operators import edits as E
from readloom.operators.realign import nm_md


def slow(ref, query, error):
    """The model without a band and without scaling, cell by cell: posterior of matches and insertions."""
    lq, lr = len(query), len(ref)
    end = 1 / (2 * lq + 2)
    o, x = B.OPEN, B.EXTEND
    emit = lambda i, k: 1.0 if ref[k] > 3 or query[i] > 3 else (1 - error[i] if ref[k] == query[i] else error[i] * B.WRONG)
    f, b = np.zeros((lq, lr, 3)), np.zeros((lq, lr, 3))
    for i in range(lq):
        for k in range(lr):
            if i == 0:
                f[i, k] = emit(0, k) * (1 - o) / lr, B.INSERTED * o / lr, 0
                continue
            before = f[i - 1, k - 1] if k else np.zeros(3)
            f[i, k, 0] = emit(i, k) * ((1 - 2 * o) * (1 - end) * before[0] + (1 - x) * (1 - end) * before[1] + (1 - x) * before[2])
            f[i, k, 1] = B.INSERTED * (o * (1 - end) * f[i - 1, k, 0] + x * (1 - end) * f[i - 1, k, 1])
            f[i, k, 2] = (o * (1 - end) * f[i, k - 1, 0] + x * f[i, k - 1, 2]) if k else 0
    for i in range(lq - 1, -1, -1):
        for k in range(lr - 1, -1, -1):
            if i == lq - 1:
                b[i, k] = end, end, 0
                continue
            e = emit(i + 1, k + 1) * b[i + 1, k + 1, 0] if k + 1 < lr else 0
            d = b[i, k + 1, 2] if k + 1 < lr else 0
            ins = B.INSERTED * b[i + 1, k, 1]
            b[i, k] = e * (1 - 2 * o) * (1 - end) + ins * o * (1 - end) + d * o * (1 - end), e * (1 - x) * (1 - end) + ins * x * (1 - end), e * (1 - x) + d * x if i else 0
    z = (f * b)[:, :, :2]
    return z / z.sum((1, 2), keepdims=True)


def test_posterior_against_the_whole_table():
    rng = np.random.default_rng(3)
    for lq, lr in ((12, 12), (9, 14), (15, 11)):
        ref = rng.integers(0, 5, (6, lr)).astype(np.int8)
        query = np.stack([np.resize(r, lq) for r in ref])
        query[rng.random(query.shape) < 0.15] = 2
        error = 10.0 ** (-rng.integers(3, 40, query.shape) / 10)
        place, insertion, phred = B.posterior(ref, query, error, 50)
        for r in range(6):
            z = slow(ref[r], query[r], error[r])
            for i in range(lq):
                got = z[i, place[r, i], int(insertion[r, i])]
                assert abs(got - z[i].max()) < 1e-9
                if got < 0.999999:
                    assert abs(phred[r, i] - np.floor(-4.343 * np.log(1 - got) + 0.499)) <= 1


def test_quality_falls_beside_an_indel(spark):
    ref = "ACGTTGCAAGGCTTAACCGGATCGATTACAGGATCCATGCAAGT"
    read = ref[5:20] + ref[22:40]  # two bases are missing, but aligned without a gap
    rows = [("a", 5, f"{len(read)}M", read, [30] * len(read), ref, 0), ("b", 5, "30M", ref[5:35], [30] * 30, ref, 0), ("c", 5, "10M50N10M", ref[5:25], [30] * 20, ref, 0), ("d", 5, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "qname string, pos int, cigar string, seq string, quals array<int>, ref_seq string, ref_beg int")
    got = {r["qname"]: r for r in B.base_alignment_quality(df).withColumn("tag", B.quality_tag()).collect()}
    assert min(got["b"]["baq"]) >= 20 and got["b"]["baq"][10:20] == [30] * 10
    assert sum(got["a"]["baq"][-10:]) < 100 < sum(got["a"]["baq"][:10])
    assert got["c"]["baq"] == [30] * 20 and got["d"]["baq"] is None
    assert got["b"]["tag"][15] == "@"
    more = {r["qname"]: r["baq"] for r in B.base_alignment_quality(df, extended=True).collect()}
    assert all(x >= y for x, y in zip(more["a"], got["a"]["baq"]))


def test_tags_against_one_read_at_a_time(spark):
    rng = np.random.default_rng(5)
    ref = "".join(rng.choice(list("ACGT"), 200))
    rows = []
    for i in range(120):
        pos = int(rng.integers(10, 80))
        seq = list(ref[pos : pos + 40])
        for k in rng.integers(0, 40, 3):
            seq[k] = "ACGTN="[rng.integers(0, 6)]
        s = "".join(seq)
        cigar, s = [("40M", s), ("10M3D30M", s[:10] + ref[pos + 13 : pos + 43]), ("15M2I25M", s[:15] + "GG" + s[15:40]), ("5S35M", "NNNNN" + s[:35]), ("12M20N8=3X5M", s[:12] + ref[pos + 32 : pos + 48])][i % 5]
        rows.append((i, pos, cigar, s, ref, 0, [int(q) for q in rng.integers(2, 41, len(s))]))
    rows += [(900, 5, "*", "ACGT", ref, 0, [30] * 4), (901, 5, "4M", None, ref, 0, None), (902, 190, "40M", "A" * 40, ref, 0, [30] * 40)]
    df = spark.createDataFrame(rows, "id int, pos int, cigar string, seq string, ref_seq string, ref_beg int, quals array<int>").repartition(3)
    got = {r["id"]: r for r in E.calmd(df).collect()}
    for i, pos, cigar, s, *_ in rows[:120]:
        assert (got[i]["nm"], got[i]["md"]) == nm_md(pos, cigar, s, ref), (cigar, s)
    assert got[900]["md"] is None and got[901]["nm"] is None and len(got) == 123
    for mode, twice in (("intended", 0), ("reference", 1)):
        caps = {r["id"]: r["cap"] for r in E.capped_quality(df, mode=mode).collect()}
        for i, pos, cigar, s, _, _, quals in rows[:120]:
            assert caps[i] == slow_cap(pos, cigar, s, ref, quals, twice), (mode, cigar)


def slow_cap(pos, cigar, seq, ref, quals, twice):
    import math
    import re

    x, y, mm, w, n, clip = pos, 0, 0, 0, 0, 0
    for k, op in ((int(a), b) for a, b in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        if op in "M=X":
            for j in range(k):
                a, b, q = seq[y + j], ref[x + j], quals[y + j]
                if a != "N" and b != "N" and q >= 13:
                    n += 1
                    if a not in ("=", b):
                        mm, w = mm + 1, w + min(q, 33)
            n += k * twice
            x, y = x + k, y + k
        elif op == "S":
            clip += sum(quals[y : y + k])
            y += k
        elif op == "I":
            y += k
        elif op in "DN":
            x += k
    t = w - 4.343 * math.log(math.prod(n / (i + 1) for i in range(mm))) + clip / 5
    return -1 if t > 40 else int(math.sqrt((40 - max(t, 0)) / 40) * 40 + 0.499)


def slow_tracts(seq, least, penalty):
    """Base by base, as the rule is stated."""
    out, k = [], 0
    while k < len(seq):
        if seq[k] != "N":
            k += 1
            continue
        score = best = 0
        e = k
        for i in range(k, len(seq)):
            score += 1 if seq[i] == "N" else -penalty
            if score < 0:
                break
            if score > best:
                best, e = score, i
        score = best = 0
        b = e
        for i in range(e, -1, -1):
            score += 1 if seq[i] == "N" else -penalty
            if score < 0:
                break
            if score > best:
                best, b = score, i
        if e + 1 - b >= least:
            out.append((b, e + 1))
        k = e + 1
    return out


def test_gap_tracts():
    rng = np.random.default_rng(9)
    for _ in range(300):
        seq = "".join(("N" if rng.random() < 0.6 else "A") * int(rng.integers(1, 9)) for _ in range(30))
        for least, penalty in ((5, 2), (12, 1), (20, 3)):
            assert E.gap_tracts(seq, least, penalty) == slow_tracts(seq, least, penalty), seq


def test_cut_at_gaps(spark):
    df = spark.createDataFrame([(1, "ACGT" + "N" * 12 + "A" + "N" * 12 + "GG"), (2, "ACGT"), (3, None), (4, ""), (5, "N" * 30)], "id bigint, seq string")
    cut = lambda **o: sorted(map(tuple, E.cut_at_gaps(df, "id", least=20, **o).collect()))
    assert cut() == [(1, 0, 4), (1, 29, 31), (2, 0, 4)] and cut(gaps=True) == [(1, 4, 29), (5, 0, 30)]


def test_consensus_in_chunks(spark):
    rows = [("c1", 2, "A", "5"), ("c1", 2, "A", "4"), ("c1", 9, "R", "9"), ("c1", 10, "G", "8"), ("c2", 0, "t", "1"), ("c1", 35, "C", "2")]
    called = spark.createDataFrame(rows, "chrom string, pos int, base string, qual string")
    indels = spark.createDataFrame([("c1", 12, 2)], "chrom string, pos int, length int")
    got = sorted(map(tuple, E.consensus(called, indels, near=2, width=10).collect()))
    assert got == [("c1", 0, "nnAnnnnnnR", "!!5!!!!!!9"), ("c1", 1, "g", "8"), ("c1", 3, "nnnnnC", "!!!!!2"), ("c2", 0, "t", "1")]
    assert E.consensus(called.limit(0)).count() == 0


def test_indel_alleles(spark):
    cases = {"+AC/*": ("N", "NAC"), "-AC/*": ("NAC", "N"), "*/*": None, "+A/+A": ("N", "NA"), "+A/+CC": ("N", "NA,NCC"), "-A/-ACG": ("NACG", "NNN,N"), "-ACG/-A": ("NACG", "NNN,N"), "+T/-AC": ("NAC", "NTNN,N")}
    df = spark.createDataFrame([(k,) for k in cases], "g string")
    from pyspark.sql import functions as F

    got = {r["g"]: tuple(r["x"]) if r["x"] else None for r in df.select("g", E.indel_alleles(F.col("g")).alias("x")).collect()}
    assert got == cases


def test_levels_and_caps(spark):
    from readloom.operators.aggregates import capped_reads
    from readloom.operators.index import display_levels, out_of_order

    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 3)), b := int(rng.integers(0, 300)), b + int(rng.integers(1, 60))) for i in range(400)]
    df = spark.createDataFrame(rows, "ord bigint, tid int, beg int, end int").repartition(3)
    level = {r["ord"]: r["level"] for r in display_levels(df, "ord").collect()}
    kept = {r["ord"] for r in capped_reads(df.withColumnRenamed("beg", "pos"), 5, "ord").collect()}
    want_levels, want_kept = {}, set()
    for tid in range(3):
        placed, held = [], []
        for i, _, b, e in sorted((r for r in rows if r[1] == tid), key=lambda r: (r[2], r[0])):
            taken = {want_levels[j] for j, x in placed if x > b}
            want_levels[i] = next(k for k in range(1, 999) if k not in taken)
            placed.append((i, e))
            if sum(x > b for x in held) < 5:
                want_kept.add(i)
                held.append(e)
    assert level == want_levels and kept == want_kept
    places = [(r[0], -1 if r[0] % 9 == 0 else r[1], r[2]) for r in rows]
    order = spark.createDataFrame(places, "ord bigint, tid int, pos int").repartition(3)
    key = [((t < 0), t, p) for _, t, p in sorted(places)]
    assert out_of_order(order, "ord").first()[0] == sum(b < a for a, b in zip(key, key[1:]))
    assert out_of_order(order.limit(0), "ord").first()[0] == 0


def test_linkage_helpers(spark):
    from readloom.operators import calling as K

    rng = np.random.default_rng(8)
    rows = [(i, i % 3, i * 7, [int(v) for v in rng.integers(0, 60, 12)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, g int, pos int, pl array<int>").repartition(4)
    got = {(r["id"], r["previous"]): r["r2"] for r in K.adjacent_ld(df, "id", "g", "pos", width=50).collect()}
    assert set(got) == {(i, i - 3) for i in range(3, 60)}
    pairs = {(r["id"], r["other"]): r["r2"] for r in K.pairwise_ld(df, "id", "g", "pos", 50).collect()}
    assert set(pairs) == {(a, b) for a in range(60) for b in range(a) if a % 3 == b % 3 and (a - b) * 7 <= 50}
    listed = {(r["a"], r["b"]): r["r2"] for r in K.listed_ld(spark.createDataFrame([(9, 6), (5, 2), (1, 999)], "a bigint, b bigint"), df, "id").collect()}
    assert set(listed) == {(9, 6), (5, 2)}
    for k, v in listed.items():
        assert abs(v - got[k]) < 1e-9 and abs(v - pairs[k]) < 1e-9 and 0 <= v <= 1 + 1e-9
