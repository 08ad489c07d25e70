"""Genotype likelihoods with dependent errors, calls with a prior, tests of a site, and linkage between sites.

A pile has one row per read and position: the site's keys, ``base`` (A, C, G, T or anything else), ``ref_base``,
``base_q``, ``mapq``, ``reverse``, ``qpos``, ``qlen``, and ``ord``, the number of the read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.variants import fisher_exact, likelihood_matrix, t_test

BASES = "ACGT"
#: fixed values of the established error model: dependence of errors, its floor, the deepest site
DEPENDENCE, FLOOR, DEEPEST = 0.17, 0.03, 255
#: -10 log10 of e, as the error model rounds it
PHRED = 4.343


@lru_cache(maxsize=512)
def _error_table(n: int) -> np.ndarray:
    """For qualities 0..63 and c = 0..n - 1: phred of at least c + 1 errors among n, given at least c of them."""
    e = 10.0 ** (-np.arange(64)[:, None] / 10)
    e[0] = 1 - 1e-12
    k = np.arange(n + 1)
    ways = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in k])
    logs = ways + k * np.log(e) + (n - k) * np.log1p(-e)
    tail = np.logaddexp.accumulate(logs[:, ::-1], axis=1)[:, ::-1]
    return -10 / math.log(10) * (tail[:, 1:] - tail[:, :-1])


def _next_error(q: str, n: str, c: str) -> Column:
    @F.pandas_udf("double")
    def look_up(q: pd.Series, n: pd.Series, c: pd.Series) -> pd.Series:
        out = np.zeros(len(q))
        qa, na, ca = q.to_numpy(), n.to_numpy(), c.to_numpy()
        for depth in np.unique(na):
            mine = na == depth
            out[mine] = _error_table(int(depth))[qa[mine], ca[mine]]
        return pd.Series(out)

    return look_up(q, n, c)


def dependent_likelihoods(pile: DataFrame, keys: list[str], min_base_quality: int = 13, cap: int = 60) -> DataFrame:
    """(keys, depth, alleles, pl): likelihoods of all genotypes of a site under the dependent error model.

    A base counts with the lesser of its own quality and the read's mapping quality, from 4 to 63. The
    c-th base of a kind in falling order of quality counts as the next error after c of them, and the w-th of its strand
    less and less. ``alleles`` holds the reference base and every other base seen, by falling sum of qualities, ``pl``
    the genotypes in the order 0/0, 0/1, 1/1, 0/2, ..., 0 for the best, at most 255. Of a site deeper than 255 reads
    as many are drawn by hash, as the model's table ends there. Ranks are windows over the placement of
    the pile, so nothing is shuffled again; sums per site are native.
    """
    q = F.least(F.col("base_q"), F.least(F.col("mapq"), F.lit(cap)), F.lit(63))
    x = pile.where(F.col("base_q") >= min_base_quality).withColumn("__q", F.greatest(q, F.lit(4)))
    x = x.withColumn("__b", F.instr(F.lit(BASES), F.upper("base")) - 1).where("__b >= 0")
    site = Window.partitionBy(*keys)
    x = x.withColumn("__pick", F.row_number().over(site.orderBy(F.xxhash64("ord"), "ord"))).where(F.col("__pick") <= DEEPEST)
    x = x.withColumn("__n", F.count(F.lit(1)).over(site).cast("int"))
    # of equal qualities on a strand both ranks count in the same order
    falling = [F.desc("__q"), F.desc("reverse"), F.col("ord")]
    x = x.withColumn("__c", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*falling)) - 1)
    x = x.withColumn("__w", F.row_number().over(Window.partitionBy(*keys, "__b", "reverse").orderBy(F.desc("__q"), "ord")) - 1)
    weight = F.pow(F.lit(1 - DEPENDENCE), F.col("__w")) * (1 - FLOOR) + FLOOR
    x = x.withColumn("__s", weight * _next_error("__q", "__n", "__c"))
    own = lambda b, c: F.sum(F.when(F.col("__b") == b, c))
    sums = [F.coalesce(f, F.lit(0.0)).alias(f"__{n}{b}") for b in range(4) for n, f in (("s", own(b, F.col("__s"))), ("k", own(b, F.lit(1.0))), ("t", own(b, F.col("__q").cast("double"))))]
    x = x.groupBy(*keys).agg(F.first("ref_base").alias("__ref"), F.count(F.lit(1)).alias("depth"), *sums)
    log_factorial = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(2 * DEEPEST + 1)])
    of = lambda c: F.element_at(log_factorial, c.cast("int") + 1)
    every = F.col("__s0") + F.col("__s1") + F.col("__s2") + F.col("__s3")
    cells = []
    for i in range(4):
        for j in range(4):
            a, b = min(i, j), max(i, j)
            if i == j:
                cells.append(every - F.col(f"__s{i}"))
            else:
                n, k = F.col(f"__k{a}") + F.col(f"__k{b}"), F.col(f"__k{b}")
                het = of(n) - of(k) - of(n - k) - n * math.log(2)
                cells.append(every - F.col(f"__s{a}") - F.col(f"__s{b}") - PHRED * het)
    x = x.withColumn("__m", F.transform(F.array(*cells), lambda v: F.greatest(v, F.lit(0.0))))
    ref = F.instr(F.lit(BASES), F.upper("__ref")) - 1
    order = F.array_sort(F.filter(F.array(*[F.struct((-F.col(f"__t{b}")).alias("t"), F.lit(b).alias("b")) for b in range(4)]), lambda e: (e["t"] < 0) & (e["b"] != F.col("__r"))))
    x = x.withColumn("__r", ref).withColumn("__al", F.concat(F.array(F.col("__r")), F.transform(order, lambda e: e["b"])))
    at = lambda a, b: F.get("__m", F.get("__al", a) * 4 + F.get("__al", b))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("__al") - 1), lambda k: F.transform(F.sequence(F.lit(0), k), lambda j: at(j, k))))
    x = x.withColumn("__g", pairs).withColumn("__least", F.array_min("__g"))
    pl = F.transform("__g", lambda v: F.least(F.lit(255), F.floor(v - F.col("__least") + 0.499)).cast("int"))
    alleles = F.array_join(F.transform("__al", lambda b: F.substring(F.lit(BASES), b + 1, F.lit(1))), "")
    return x.where("__r >= 0").select(*keys, "depth", alleles.alias("alleles"), pl.alias("pl"))


def prior_calls(pl: Column | str, frequency: Column, max_quality: int = 99) -> Column:
    """array<struct<gt, gq>>: the most probable genotype of each sample under Hardy-Weinberg proportions of the
    alternative allele's frequency, and how sure it is."""
    p = F.col(pl) if isinstance(pl, str) else pl
    samples = F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / 3).cast("int") - 1), lambda i: F.slice(p, i * 3 + 1, F.lit(3)))
    priors = F.array((1 - frequency) * (1 - frequency), 2 * frequency * (1 - frequency), frequency * frequency)

    def one(s: Column) -> Column:
        g = F.zip_with(s, priors, lambda v, f: F.pow(F.lit(10.0), v / -10.0) * f)
        total = F.aggregate(g, F.lit(0.0), lambda a, v: a + v)
        best = F.array_max(g)
        wrong = F.greatest(1 - best / total, F.lit(1e-12))
        return F.struct((F.array_position(g, best) - 1).cast("int").alias("gt"), F.least(F.lit(max_quality), F.floor(F.lit(-PHRED) * F.log(wrong) + 0.499)).cast("int").alias("gq"))

    return F.transform(samples, one)


def site_tests(annotations: DataFrame) -> DataFrame:
    """The columns of ``site_annotations`` with four p values and the root mean square of the mapping quality: strand bias
    (Fisher), and whether base quality, mapping quality and distance to the read's end are lower for the alternative."""

    @F.pandas_udf("p_strand double, p_base_q double, p_mapq double, p_tail double")
    def tests(frame: pd.DataFrame) -> pd.DataFrame:
        seen: dict[tuple, float] = {}  # tables repeat: most sites are shallow
        rows = []
        for r in frame.itertuples(index=False):
            table = r[:4]
            if table not in seen:
                seen[table] = fisher_exact(*map(int, table))
            n_ref, n_alt = r[0] + r[1], r[2] + r[3]
            rows.append((seen[table], *[t_test(n_ref, *r[4 + 4 * i : 6 + 4 * i], n_alt, *r[6 + 4 * i : 8 + 4 * i]) for i in range(3)]))
        return pd.DataFrame(rows, columns=["p_strand", "p_base_q", "p_mapq", "p_tail"])

    names = ["n_ref_fwd", "n_ref_rev", "n_alt_fwd", "n_alt_rev"]
    names += [f"{c}{s}_{k}" for c in ("base_q", "mapq", "tail") for k in ("ref", "alt") for s in ("", "2")]
    x = annotations.withColumn("__p", tests(F.struct(*names)))
    rms = F.sqrt((F.col("mapq2_ref") + F.col("mapq2_alt")) / F.greatest(F.col("depth"), F.lit(1)))
    return x.select(*annotations.columns, *[F.col(f"__p.{c}").alias(c) for c in ("p_strand", "p_base_q", "p_mapq", "p_tail")], F.floor(rms + 0.499).cast("int").alias("rms_mapq"))


def distance_bias(pile: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_alt, mean_distance, vdb): how likely the mean distance between the places of the alternative base on
    its reads is, by the established approximations for 2, 3, 4 and more reads; 1 below two.

    The mean over all pairs comes from the places in order: the i-th of n counts 2i - n - 1 times.
    """
    x = pile.where(~F.col("is_ref")).withColumn("__at", F.col("qpos") - F.col("clip"))
    x = x.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy("__at")))
    x = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_alt"), F.sum(F.col("__i") * F.col("__at")).alias("__w"), F.sum("__at").alias("__s"), F.floor(F.sum("qlen") / F.count(F.lit(1))).alias("__l"))
    n = F.col("n_alt")
    pairs = n * (n - 1) / 2
    x = x.withColumn("mean_distance", F.when(n > 1, (2 * F.col("__w") - (n + 1) * F.col("__s")) / pairs).otherwise(0.0))
    d, length = F.floor("mean_distance").cast("double"), F.col("__l").cast("double")
    mu = length / 2.9
    sigma2 = F.pow(length / 1.9 / (F.least(n, F.lit(5)) + 1), F.lit(2.0))
    norm = 1.125 * F.sqrt(6.28 * sigma2)
    two = F.when(d == 0, 1 / length).otherwise((length - d) * 2 / length / length)
    three = F.when(d > 2 * mu, 0.0).otherwise(F.sin(d * 3.14 / 2 / mu) / (4 * mu / 3.14))
    more = F.exp(-(d - mu) * (d - mu) / F.when(d < mu, 2.0).otherwise(3.125) / sigma2) / norm
    vdb = F.when(n < 2, 1.0).when(n == 2, two).when(n == 3, three).otherwise(more)
    return x.select(*keys, "n_alt", "mean_distance", vdb.alias("vdb"))


# --- linkage ------------------------------------------------------------------------------------


def haplotype_r2_rows(a: np.ndarray, b: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Squared correlation of pairs of sites from their PL rows (pairs, 3 a sample), by EM over four haplotypes."""
    x, y = likelihood_matrix(a).transpose(2, 0, 1), likelihood_matrix(b).transpose(2, 0, 1)
    states = [(i, j, k, h) for i in (0, 1) for j in (0, 1) for k in (0, 1) for h in (0, 1)]
    weight = {s: x[s[0] + s[2]] * y[s[1] + s[3]] for s in states}
    f = np.full((2, 2, x.shape[1]), 0.25)
    for _ in range(rounds):
        joint = {s: f[s[0], s[1]][:, None] * f[s[2], s[3]][:, None] * w for s, w in weight.items()}
        total = np.maximum(sum(joint.values()), 1e-300)
        new = np.zeros_like(f)
        for s, v in joint.items():
            share = (v / total).sum(1)
            new[s[0], s[1]] += share
            new[s[2], s[3]] += share
        f = new / new.sum((0, 1))
    p, q = f[1].sum(0), f[:, 1].sum(0)
    d = f[1, 1] - p * q
    v = p * (1 - p) * q * (1 - q)
    return np.where(v > 1e-12, d * d / np.maximum(v, 1e-300), 0.0)


def _with_r2(pairs: DataFrame, columns: list[str], a: str, b: str) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*columns).schema)

    def run(frames):
        for f in frames:
            out = []
            for k in range(0, len(f), 1024):
                part = f.iloc[k : k + 1024]
                out.append(haplotype_r2_rows(np.stack(part[a].to_numpy()), np.stack(part[b].to_numpy())))
            yield f[columns].assign(r2=np.concatenate(out) if out else np.zeros(0))

    return pairs.select(*columns, a, b).mapInPandas(run, f"{schema}, r2 double")


def previous_in_order(df: DataFrame, group: str, order: str, columns: list[str], width: int) -> DataFrame:
    """Each row with ``columns`` of the row before it in its group as ``prev_<column>``, without one task a group:
    windows by bins of ``order`` of this width, and the last row of every bin handed on to the next one that has rows."""
    x = df.withColumn("__bin", F.floor(F.col(order) / width))
    w = Window.partitionBy(group, "__bin").orderBy(order)
    before = F.struct(*columns)
    x = x.withColumn("__p", F.lag(before).over(w))
    last = x.groupBy(group, "__bin").agg(F.max_by(before, order).alias("__last"))
    last = last.withColumn("__handed", F.lag("__last").over(Window.partitionBy(group).orderBy("__bin"))).drop("__last")
    x = x.join(last.withColumnsRenamed({group: "__g", "__bin": "__b"}), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__bin") == F.col("__b")), "left")
    p = F.coalesce("__p", "__handed")
    return x.select(*df.columns, *[p.getField(c).alias(f"prev_{c}") for c in columns])


def adjacent_ld(df: DataFrame, key: str, group: str, order: str, pl: str = "pl", width: int = 1 << 16) -> DataFrame:
    """(key, previous, r2) of each site and the one before it in its group; ``order`` is unique in a group."""
    x = previous_in_order(df.select(*dict.fromkeys([key, group, order, pl])), group, order, list(dict.fromkeys([key, pl])), width)
    x = x.where(F.col(f"prev_{key}").isNotNull()).withColumnRenamed(f"prev_{key}", "previous")
    return _with_r2(x, [key, "previous"], f"prev_{pl}", pl)


def pairwise_ld(df: DataFrame, key: str, group: str, order: str, reach: int, pl: str = "pl") -> DataFrame:
    """(key, other, r2) of every two sites of a group at most ``reach`` apart in ``order``, the later one first.

    Sites are joined by (group, bin) with bins of ``reach``, each looked up in its own and the bin before, so a group is as many keys as it is wide.
    """
    x = df.select(*dict.fromkeys([key, group, order, pl]))
    b = F.floor(F.col(order) / reach)
    a = x.withColumn("__bin", F.explode(F.array(b, b - 1)))
    e = x.select(F.col(key).alias("other"), F.col(group).alias("__g"), F.col(order).alias("__o"), F.col(pl).alias("__pl"), b.alias("__b"))
    pairs = a.join(e, (F.col(group) == F.col("__g")) & (F.col("__bin") == F.col("__b")))
    return _with_r2(pairs.where((F.col("__o") < F.col(order)) & (F.col(order) - F.col("__o") <= reach)), [key, "other"], pl, "__pl")


def listed_ld(pairs: DataFrame, df: DataFrame, key: str, pl: str = "pl") -> DataFrame:
    """(a, b, r2) of the listed pairs of sites; pairs with a site that isn't there are left out."""
    x = df.select(F.col(key).alias("a"), F.col(pl).alias("__pa"))
    y = df.select(F.col(key).alias("b"), F.col(pl).alias("__pb"))
    return _with_r2(pairs.select("a", "b").join(x, "a").join(y, "b"), ["a", "b"], "__pa", "__pb")
