"""Variant records and genotype likelihoods.

PL arrays hold three numbers a sample (hom ref, het, hom alt), 0 for the most likely. What is an
expression stays one; the iterative estimates are vectorised over the sites of an Arrow batch.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.joins import overlap_semi


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_indel(ref: Column | str, alt: Column | str) -> Column:
    """Whether any allele is longer than one base; ``X`` and ``.`` are no allele."""
    alts = F.filter(F.split(_c(alt), ","), lambda a: ~a.isin("X", "."))
    return (F.length(_c(ref)) > 1) | F.exists(alts, lambda a: F.length(a) > 1)


def is_transition(ref: Column | str, alt: Column | str) -> Column:
    return F.concat(F.upper(_c(ref)), F.upper(_c(alt))).isin("AG", "GA", "CT", "TC")


def variant_filter(df: DataFrame, variants_only: bool = True, no_indels: bool = False, acgt_only: bool = True, min_quality: float | None = None,
    min_covered: float | None = None, covered: Column | None = None, regions: DataFrame | None = None,
) -> DataFrame:
    """The view filters: variants only, no indels, plain reference bases, a least quality, a least share ``covered`` of samples with data, and
    the overlap with a list of regions (tid, start, stop)."""
    x = df
    if variants_only:
        x = x.where(~F.col("alt").isin("X", "."))
    if no_indels:
        x = x.where(~is_indel("ref", "alt"))
    if acgt_only:
        x = x.where(F.col("ref").rlike("^[ACGTacgt]+$"))
    if min_quality is not None:
        x = x.where(F.col("qual") >= min_quality)
    if min_covered is not None:
        x = x.where(covered >= min_covered)
    if regions is not None:
        x = overlap_semi(x.withColumn("__end", F.col("pos") + F.length("ref")), regions, "tid", "pos", "__end").drop("__end")
    return x


def samples_of(pl: Column | str) -> Column:
    """array<array<int>>: three numbers a sample."""
    p = _c(pl)
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / 3).cast("int") - 1), lambda i: F.slice(p, i * 3 + 1, F.lit(3)))


def call_genotypes(pl: Column | str, max_quality: int = 99) -> Column:
    """array<struct<gt, gq>>: the genotype of least PL (the first on a tie) and the gap to the next one."""

    def one(s: Column) -> Column:
        ordered = F.array_sort(s)
        gt = F.array_position(s, ordered[0]).cast("int") - 1
        return F.struct(gt.alias("gt"), F.least(ordered[1] - ordered[0], F.lit(max_quality)).alias("gq"))

    return F.transform(samples_of(pl), one)


def allele_counts(calls: Column | str) -> tuple[Column, Column]:
    """(AC, AN) of called genotypes."""
    c = _c(calls)
    return F.aggregate(c, F.lit(0), lambda a, g: a + g["gt"]), F.size(c) * 2


def covered_samples(pl: Column | str) -> Column:
    return F.size(F.filter(samples_of(pl), lambda s: F.exists(s, lambda v: v > 0)))


def max_genotype_quality(calls: Column | str) -> Column:
    return F.array_max(F.transform(_c(calls), lambda g: g["gq"]))


def least_gap(pl: Column | str) -> Column:
    """The smallest gap between the two best genotypes of any sample."""
    return F.array_min(F.transform(samples_of(pl), lambda s: F.array_sort(s)[1] - F.array_sort(s)[0]))


def pair_call(pl: Column | str, a: int = 0, b: int = 1) -> Column:
    """How much worse the best equal genotypes of two samples are than their best ones."""
    s = samples_of(pl)
    x, y = F.get(s, a), F.get(s, b)
    return F.array_min(F.zip_with(x, y, lambda p, q: p + q)) - F.array_min(x) - F.array_min(y)


def likelihood_to_phred(gl: Column | str) -> Column:
    """log10 likelihoods to PL: rounded, from 0 to 255."""
    return F.transform(_c(gl), lambda g: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.lit(-10.0) * g + 0.499))).cast("int"))


def ten_genotypes(pl3: Column, ref: Column, alt: Column, missing: int = 255) -> Column:
    """PL of the ten unordered base pairs AA, AC, AG, AT, CC, CG, CT, GG, GT, TT from three."""
    pairs = [a + b for i, a in enumerate("ACGT") for b in "ACGT"[i:]]
    lo, hi = F.least(ref, alt), F.greatest(ref, alt)
    one = lambda p: (
        F.when(F.concat(ref, ref) == p, F.get(pl3, 0)).when(F.concat(lo, hi) == p, F.get(pl3, 1)).when(F.concat(alt, alt) == p, F.get(pl3, 2)).otherwise(missing)
    )
    return F.array(*[one(F.lit(p)) for p in pairs])


def strata(df: DataFrame) -> DataFrame:
    """Variants, transitions and known ones at least as good as each quality: one row a quality.

    Counted per quality first, so the running sums go over the distinct qualities."""
    n = lambda c: F.sum(c.cast("bigint"))
    each = df.groupBy("qual").agg(F.count(F.lit(1)).alias("__n"), n(is_transition("ref", "alt")).alias("__ts"), n(F.col("known")).alias("__k"))
    w = Window.orderBy(F.desc("qual")).rowsBetween(Window.unboundedPreceding, 0)
    x = each.select("qual", *[F.sum(f"__{c}").over(w).alias(o) for c, o in (("n", "n_variants"), ("ts", "n_transitions"), ("k", "n_known"))])
    tv = F.col("n_variants") - F.col("n_transitions")
    return x.withColumn("ts_tv", F.when(tv > 0, F.round(F.col("n_transitions") / tv, 6)))


def near_filter(df: DataFrame, snp_gap: int = 3, indel_gap: int = 10, min_depth: int = 2, max_depth: int = 10_000_000) -> DataFrame:
    """Depth bounds; SNPs within ``snp_gap`` of an indel and indels with a better one within
    ``indel_gap`` go (of equal ones the first stays). The frames are ranges of positions, so the rule does
    not depend on arrival order."""
    x = df.where(F.col("dp").between(min_depth, max_depth)).withColumn("__indel", is_indel("ref", "alt"))
    # bins with a margin as wide as the frames reach: a contig is many tasks
    margin, width = max(snp_gap, indel_gap), 1 << 16
    own = F.floor(F.col("pos") / width)
    ends = F.sequence(F.floor((F.col("pos") - margin) / width), F.floor((F.col("pos") + margin) / width))
    x = x.withColumn("__own", own).withColumn("__bin", F.explode(ends))
    near = Window.partitionBy("tid", "__bin").orderBy("pos").rangeBetween(-snp_gap, snp_gap)
    wide = Window.partitionBy("tid", "__bin").orderBy("pos").rangeBetween(-indel_gap, indel_gap)
    rank = F.when(F.col("__indel"), F.struct(F.col("qual"), -F.col("vid")))
    x = x.withColumn("__near", F.max(F.col("__indel").cast("int")).over(near)).withColumn("__best", F.max(rank).over(wide))
    keep = F.when(F.col("__indel"), F.col("__best") == F.struct(F.col("qual"), -F.col("vid"))).otherwise(F.col("__near") == 0)
    return x.where(keep & (F.col("__bin") == F.col("__own"))).drop("__indel", "__near", "__best", "__own", "__bin")


# --- estimates over a batch of sites ------------------------------------------------------------


def likelihood_matrix(pl: np.ndarray) -> np.ndarray:
    """(sites, samples, 3) likelihoods of PL rows."""
    return 10.0 ** (-np.asarray(pl, float).reshape(len(pl), -1, 3) / 10)


def em_frequency(pl: np.ndarray, rounds: int = 50, tolerance: float = 1e-6) -> np.ndarray:
    """Frequency of the alternative allele under Hardy-Weinberg proportions."""
    g = likelihood_matrix(pl)
    f = np.full(len(g), 0.5)
    for _ in range(rounds):
        prior = np.stack([(1 - f) ** 2, 2 * f * (1 - f), f**2], 1)[:, None, :]
        post = g * prior
        post /= np.maximum(post.sum(2, keepdims=True), 1e-300)
        new = ((post[:, :, 1] + 2 * post[:, :, 2]).sum(1) / (2 * g.shape[1])).clip(1e-12, 1 - 1e-12)
        done = np.abs(new - f).max(initial=0) < tolerance
        f = new
        if done:
            break
    return f


def em_genotypes(pl: np.ndarray, rounds: int = 50) -> np.ndarray:
    """(sites, 3) genotype frequencies without the Hardy-Weinberg assumption."""
    g = likelihood_matrix(pl)
    q = np.full((len(g), 3), 1 / 3)
    for _ in range(rounds):
        post = g * q[:, None, :]
        post /= np.maximum(post.sum(2, keepdims=True), 1e-300)
        q = post.mean(1)
    return q


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * lead
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * lead


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    lead = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return lead * h


def chi2_p(x: float, df: int) -> float:
    return gamma_q(df / 2, x / 2)


def hwe_p(pl: np.ndarray) -> np.ndarray:
    """P value of the likelihood ratio of free genotype frequencies against Hardy-Weinberg ones."""
    g, f, q = likelihood_matrix(pl), em_frequency(pl), em_genotypes(pl)
    hw = np.stack([(1 - f) ** 2, 2 * f * (1 - f), f**2], 1)
    free = np.log(np.maximum((g * q[:, None, :]).sum(2), 1e-300)).sum(1)
    bound = np.log(np.maximum((g * hw[:, None, :]).sum(2), 1e-300)).sum(1)
    return np.array([chi2_p(max(0.0, 2 * (a - b)), 1) for a, b in zip(free, bound)])


def allele_count_prior(m: int, kind: str = "full", theta: float = 1e-3) -> np.ndarray:
    """Prior of 0..m alternative alleles: ``full`` is the neutral one, ``cond2`` that of a site known to vary in
    another sample of two, ``flat`` equal for all counts."""
    k = np.arange(m + 1)
    if kind == "flat":
        return np.full(m + 1, 1 / (m + 1))
    if kind == "cond2":
        p = 2.0 * (m + 1 - k) / ((m + 1) * (m + 2))
        return p / p.sum()
    p = np.concatenate([[0.0], theta / np.maximum(k[1:], 1)])
    p[0] = 1 - p.sum()
    return p


def allele_count_posterior(pl: np.ndarray, theta: float = 1e-3, prior: str = "full", ploidy: int = 2) -> np.ndarray:
    """(sites, ploidy * n + 1) posterior of the number of alternative alleles.

    The likelihood of each count is built sample by sample; rows are scaled on the way. Of a haploid sample only the two
    homozygous numbers count.
    """
    g = likelihood_matrix(pl)
    sites, n, _ = g.shape
    z = np.ones((sites, 1))
    kinds = ((0, 1), (1, 2), (2, 1)) if ploidy == 2 else ((0, 1), (2, 1))
    for i in range(n):
        size = z.shape[1]
        new = np.zeros((sites, size + ploidy))
        for step, (k, ways) in enumerate(kinds):
            new[:, step : step + size] += ways * g[:, i, k : k + 1] * z
        z = new / np.maximum(new.max(1, keepdims=True), 1e-300)
    m = ploidy * n
    z = z / np.array([math.comb(m, k) for k in range(m + 1)], float)
    post = z * allele_count_prior(m, prior, theta)
    return post / np.maximum(post.sum(1, keepdims=True), 1e-300)


def group_frequencies(pl: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Allele frequencies of the first samples and of the others, and the p values of the likelihood ratios of
    two frequencies against one (1 degree of freedom) and of two sets of genotype frequencies against one (2)."""
    parts = [pl[:, : 3 * first], pl[:, 3 * first :]]

    def fit(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.log(np.maximum((likelihood_matrix(x) * q[:, None, :]).sum(2), 1e-300)).sum(1)

    hw = lambda f: np.stack([(1 - f) ** 2, 2 * f * (1 - f), f**2], 1)
    f1, f2 = (em_frequency(x) for x in parts)
    one = 2 * (fit(parts[0], hw(f1)) + fit(parts[1], hw(f2)) - fit(pl, hw(em_frequency(pl))))
    two = 2 * (sum(fit(x, em_genotypes(x)) for x in parts) - fit(pl, em_genotypes(pl)))
    p = lambda v, df: np.array([chi2_p(max(0.0, x), df) for x in v])
    return f1, f2, p(one, 1), p(two, 2), em_genotypes(pl)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p value of a 2 x 2 table."""
    n, r, k = a + b + c + d, a + b, a + c
    logs = lambda x: math.lgamma(r + 1) - math.lgamma(x + 1) - math.lgamma(r - x + 1) + math.lgamma(n - r + 1) - math.lgamma(k - x + 1) - math.lgamma(n - r - k + x + 1)
    base = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = [math.exp(logs(x) - base) for x in range(max(0, r + k - n), min(r, k) + 1)]
    own = math.exp(logs(a) - base)
    return min(1.0, sum(x for x in p if x <= own * (1 + 1e-9)))


def t_test(n1: int, s1: float, q1: float, n2: int, s2: float, q2: float) -> float:
    """One-sided p value that the first mean is not below the second, from counts, sums and sums of
    squares; 1 where it is not or can't be told."""
    if n1 < 2 or n2 < 2:
        return 1.0
    m1, m2 = s1 / n1, s2 / n2
    if m1 <= m2:
        return 1.0
    v = (q1 - n1 * m1 * m1 + q2 - n2 * m2 * m2) / (n1 + n2 - 2)
    if v <= 0:
        return 0.0
    t, k = (m1 - m2) / math.sqrt(v * (1 / n1 + 1 / n2)), n1 + n2 - 2
    return 0.5 * beta_i(k / 2, 0.5, k / (k + t * t))


def site_estimates(df: DataFrame, key: str, pl: str = "pl", prior: str = "full", ploidy: int = 2) -> DataFrame:
    """(key, af, hwe_p, p_variant): allele frequency, Hardy-Weinberg p value and the posterior that the
    site varies. All rows of a batch have the same number of samples."""

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            x = np.stack(f[pl].to_numpy())
            yield pd.DataFrame({key: f[key], "af": em_frequency(x), "hwe_p": hwe_p(x), "p_variant": 1 - allele_count_posterior(x, prior=prior, ploidy=ploidy)[:, 0]})

    return df.select(key, pl).mapInPandas(run, f"{key} bigint, af double, hwe_p double, p_variant double")


def group_estimates(df: DataFrame, key: str, first: int, pl: str = "pl") -> DataFrame:
    """(key, af_first, af_others, p_1df, p_2df, g_ref, g_het, g_alt): see ``group_frequencies``."""

    def run(frames):
        for f in frames:
            if len(f):
                a, b, p1, p2, g = group_frequencies(np.stack(f[pl].to_numpy()), first)
                yield pd.DataFrame({key: f[key], "af_first": a, "af_others": b, "p_1df": p1, "p_2df": p2, "g_ref": g[:, 0], "g_het": g[:, 1], "g_alt": g[:, 2]})

    return df.select(key, pl).mapInPandas(run, f"{key} bigint, af_first double, af_others double, p_1df double, p_2df double, g_ref double, g_het double, g_alt double")


def base_likelihoods(pile: DataFrame, keys: list[str]) -> DataFrame:
    """PL of the three genotypes of each site from base calls, as sums over independent errors.

    ``pile`` has ``is_ref`` and ``base_q``. Sums of logarithms are algebraic, so a deep site costs one
    state a task.
    """
    e = F.pow(F.lit(10.0), -F.col("base_q") / 10.0)
    hit, miss = F.log10(F.greatest(1 - e, F.lit(1e-10))), F.log10(e / 3)
    het = F.log10((1 - e) / 2 + e / 6)
    x = pile.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("depth"), F.sum(F.when(F.col("is_ref"), hit).otherwise(miss)).alias("__0"), F.sum(het).alias("__1"), F.sum(F.when(F.col("is_ref"), miss).otherwise(hit)).alias("__2")
    )
    best = F.greatest("__0", "__1", "__2")
    return x.select(*keys, "depth", *[F.least(F.lit(255), F.floor(F.lit(-10) * (F.col(f"__{i}") - best) + 0.499)).cast("int").alias(f"pl_{n}") for i, n in enumerate(("ref", "het", "alt"))])


def site_annotations(pile: DataFrame, keys: list[str]) -> DataFrame:
    """Strand counts and sums of base quality, mapping quality and distance to the read's end with their
    squares, for reference and other bases: sixteen conditional sums in one partial aggregate."""
    out = []
    for name, mine in (("ref", F.col("is_ref")), ("alt", ~F.col("is_ref"))):
        for strand, on in (("fwd", ~F.col("reverse")), ("rev", F.col("reverse"))):
            out.append(F.sum((mine & on).cast("bigint")).alias(f"n_{name}_{strand}"))
        for c in ("base_q", "mapq", "tail"):
            v = F.when(mine, F.col(c).cast("bigint")).otherwise(0)
            out += [F.sum(v).alias(f"{c}_{name}"), F.sum(v * v).alias(f"{c}2_{name}")]
    return pile.groupBy(*keys).agg(F.count(F.lit(1)).alias("depth"), *out)


def trio_gap(pl: Column | str, child: int = 0, mother: int = 1, father: int = 2) -> Column:
    """How much worse the best genotypes of a trio are that can be inherited than the best ones at all."""
    s = samples_of(pl)
    c, m, f = (F.get(s, i) for i in (child, mother, father))
    gametes = {0: (0,), 1: (0, 1), 2: (1,)}
    ok = sorted({(x + y, a, b) for a in gametes for b in gametes for x in gametes[a] for y in gametes[b]})
    best = F.array_min(F.array(*[F.get(c, k) + F.get(m, a) + F.get(f, b) for k, a, b in ok]))
    return best - F.array_min(c) - F.array_min(m) - F.array_min(f)


def group_contrast(calls: Column | str, first: int) -> Column:
    """Chi-square of alternative alleles in the first samples against the others; null without variation."""
    c = _c(calls)
    alt = lambda part: F.aggregate(part, F.lit(0), lambda a, g: a + g["gt"])
    rest = F.size(c) - first
    a, b = alt(F.slice(c, 1, first)).cast("double"), alt(F.slice(c, F.lit(first + 1), rest)).cast("double")
    n1, n2 = F.lit(2.0 * first), 2.0 * rest
    p, q, n = a + b, n1 + n2 - a - b, n1 + n2
    return F.when((p > 0) & (q > 0), n * (a * (n2 - b) - b * (n1 - a)) ** 2 / (n1 * n2 * p * q))


def permuted_samples(pl: Column | str, seed: Column) -> Column:
    """The samples in the order of a digest of seed and place: a permutation that comes out the same each time, on any engine."""
    places = F.zip_with(samples_of(pl), F.sequence(F.lit(0), F.size(samples_of(pl)) - 1), lambda s, i: F.struct(F.md5(F.concat(seed.cast("string"), F.lit(":"), i.cast("string"))).alias("h"), s.alias("s")))
    return F.transform(F.array_sort(places), lambda x: x["s"])


def reorder_likelihoods(pl: Column | str, alleles: Column | int) -> Column:
    """Likelihoods written row by row (0/0, 0/1, 0/2, ..., 1/1, ...) in the order 0/0, 0/1, 1/1, 0/2, ...; one sample."""
    p, n = _c(pl), alleles if isinstance(alleles, Column) else F.lit(alleles)
    old = lambda x, y: (x * n - (x * (x - 1) / 2).cast("int") + y - x).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda y: F.transform(F.sequence(F.lit(0), y), lambda x: F.get(p, old(x, y)))))


def field_first(fields: Column | str, values: Column | str, name: str) -> tuple[Column, Column]:
    """FORMAT and one sample's values with the named field in front; as they are where it is missing."""
    f, v = F.split(_c(fields), ":"), F.split(_c(values), ":")
    at = F.array_position(f, name).cast("int")
    front = lambda a: F.array_join(F.concat(F.slice(a, at, F.lit(1)), F.slice(a, F.lit(1), at - 1), F.slice(a, at + 1, F.size(a))), ":")
    return F.when(at > 0, front(f)).otherwise(_c(fields)), F.when(at > 0, front(v)).otherwise(_c(values))


def without_info(info: Column | str, *names: str) -> Column:
    """An INFO text without the named entries, ``.`` where none is left."""
    kept = F.filter(F.split(_c(info), ";"), lambda e: ~F.split(e, "=")[0].isin(*names))
    return F.when(F.size(kept) > 0, F.array_join(kept, ";")).otherwise(".")


def true_place_errors(df: DataFrame, gap: int = 5) -> DataFrame:
    """(decile, n_reads, n_wrong) of mapped reads whose name ``contig_place_...`` holds the true 1-based place: wrong ones at least as
    confident as each tenth of the mapping quality. The running sums go over the deciles, of which there are few."""
    name = r"^(.*?)_([0-9]+)_[0-9]+(_.*)?$"
    there = (F.regexp_extract("qname", name, 1) == F.col("rname")) & (F.abs(F.expr(f"try_cast(nullif(regexp_extract(qname, '{name}', 2), '') as bigint)") - (F.col("pos") + 1)) <= gap)
    x = df.select(F.floor(F.col("mapq") / 10).cast("int").alias("decile"), (~F.coalesce(there, F.lit(False))).cast("bigint").alias("__w"))
    x = x.groupBy("decile").agg(F.count(F.lit(1)).alias("__n"), F.sum("__w").alias("__w"))
    w = Window.orderBy(F.desc("decile")).rowsBetween(Window.unboundedPreceding, 0)
    return x.select("decile", F.sum("__n").over(w).alias("n_reads"), F.sum("__w").over(w).alias("n_wrong"))


def indel_candidates(blocks: DataFrame, least: int = 1) -> DataFrame:
    """(tid, pos, indel, n_reads): the kinds of indel that follow a position and their support."""
    x = blocks.where("after <> 0").groupBy("tid", (F.col("end") - 1).alias("pos"), F.col("after").alias("indel")).agg(F.count(F.lit(1)).alias("n_reads"))
    return x.where(F.col("n_reads") >= least)


def format_vcf(df: DataFrame) -> DataFrame:
    """Lines (value) of records (chrom, pos 0-based, ref, alt, qual, info map), INFO by name."""
    entry = lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), entry), ";")
    qual = F.coalesce(F.col("qual").cast("string"), F.lit("."))
    return df.select(
        F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), F.lit("."), "ref", F.when(F.col("alt") == "X", ".").otherwise(F.col("alt")), qual, F.lit("."), F.when(info == "", ".").otherwise(info)).alias("value")
    )
