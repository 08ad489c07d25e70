"""Queries over genotype likelihoods, calls, site tests and linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators import aggregates as A
from readloom.operators import calling as K
from readloom.operators import phase as P
from readloom.operators import piles as B
from readloom.operators import variants as V
from readloom.plans.derive import likelihoods
from readloom.plans.registry import Registry
from readloom.plans.variant_queries import _ANNOTATED, _BASE, _CALLS, _REF, PILE, PL, _S, base_pile, bases_of, pile_blocks
from readloom.session import table

R = Registry()

_SITE = ["tid", "bin", "pos"]
_TAIL = "ln(list_sum(list_transform(range({0}, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(e) + (n - k) * ln(1 - e)))))"
_BY_BASE = lambda v: "[" + ", ".join(f"coalesce(sum({v}) filter (b = '{b}'), 0)" for b in "ACGT") + "]"
_HET = "lgamma(k[a] + k[b] + 1) - lgamma(k[a] + 1) - lgamma(k[b] + 1) - (k[a] + k[b]) * ln(2)".replace("[a]", "[al[i]]").replace("[b]", "[al[j]]")


@R.add(
    "genotype_likelihoods",
    f"""with {_ANNOTATED},
    gl_o as (select tid, pos, {_BASE} as b, {_REF} as r, cast(greatest(4, least(base_q, mapq, 60, 63)) as int) as q, reverse, ord from x where base_q >= 13),
    m as (select *, count(*) over (partition by tid, pos) as n, row_number() over (partition by tid, pos, b order by q desc, reverse desc, ord) - 1 as c,
      row_number() over (partition by tid, pos, b, reverse order by q desc, ord) - 1 as w from gl_o),
    d as (select *, pow(10.0::double, -q / 10.0::double) as e from (select distinct q, n, c from m)),
    t as (select q, n, c, -10 / ln(10) * ({_TAIL.format('c + 1')} - {_TAIL.format('c')}) as err from d),
    s as (select tid, pos, any_value(r) as r, count(*) as depth, {_BY_BASE('(pow(0.83, w) * 0.97 + 0.03) * err')} as s, {_BY_BASE('1')} as k, {_BY_BASE('q')} as t from m join t using (q, n, c) group by tid, pos),
    l as (select *, list_prepend(instr('ACGT', r), list_transform(list_sort(list_filter([{{'t': -t[1], 'b': 1}}, {{'t': -t[2], 'b': 2}}, {{'t': -t[3], 'b': 3}}, {{'t': -t[4], 'b': 4}}], lambda z: z.t < 0 and z.b <> instr('ACGT', r))), lambda z: z.b)) as al from s),
    g as (select *, flatten(list_transform(range(1, len(al) + 1), lambda j: list_transform(range(1, j + 1), lambda i:
      greatest(0, list_sum(s) - s[al[i]] - case when i = j then 0 else s[al[j]] + 4.343 * ({_HET}) end)))) as g from l)
    select tid, pos, depth, array_to_string(list_transform(al, lambda z: substr('ACGT', z, 1)), '') as alleles,
      array_to_string(list_transform(g, lambda v: cast(cast(least(255, floor(v - list_min(g) + 0.499)) as int) as varchar)), ',') as pl from g""",
)
def genotype_likelihoods(spark: SparkSession, d: str) -> DataFrame:
    """Likelihoods of all genotypes under the dependent error model, alleles by their sum of qualities."""
    return B.dependent_likelihoods(pile_blocks(spark, d), bases_of)


_LIK = "pow(10.0::double, -{0} / 10.0::double)"


@R.add(
    "genotype_prior_calls",
    f"""with {PL}, {_CALLS}, f as (select vec_id, pl, (list_sum(list_transform(g, lambda x: x.gt)) + 1.0::double) / (len(g) * 2 + 2.0::double) as f, unnest(range(0, len(g))) as i from c),
    h as (select vec_id, i, [{_LIK.format('pl[i * 3 + 1]')} * (1 - f) * (1 - f), {_LIK.format('pl[i * 3 + 2]')} * (2 * f * (1 - f)), {_LIK.format('pl[i * 3 + 3]')} * (f * f)] as g from f)
    select vec_id, cast(i + 1 as int) as sample, cast(list_position(g, list_max(g)) - 1 as int) as gt,
      cast(least(99, floor(-4.343 * ln(greatest(1 - list_max(g) / list_sum(g), 1e-12)) + 0.499)) as int) as gq from h""",
)
def genotype_prior_calls(spark: SparkSession, d: str) -> DataFrame:
    """The most probable genotype of each sample with the site's allele frequency as prior, and its quality."""
    x = likelihoods(spark, d).withColumn("calls", V.call_genotypes("pl"))
    ac, an = V.allele_counts("calls")
    x = x.withColumn("f", (ac + F.lit(1.0)) / (an + F.lit(2.0)))
    x = x.select("vec_id", F.posexplode(K.prior_calls("pl", F.col("f"))).alias("i", "c"))
    return x.select("vec_id", (F.col("i") + 1).alias("sample"), F.col("c.gt").alias("gt"), F.col("c.gq").alias("gq"))


_LF = "lgamma({0} + 1)"
_P_OF = "exp({r} + {s} + {k} + {t} - {n} - lgamma({x} + 1) - lgamma(r - {x} + 1) - lgamma(k - {x} + 1) - lgamma(n - r - k + {x} + 1))".format(
    r="lgamma(r + 1)", s="lgamma(n - r + 1)", k="lgamma(k + 1)", t="lgamma(n - k + 1)", n="lgamma(n + 1)", x="{0}"
)


@R.add(
    "site_strand_bias",
    f"""with {_ANNOTATED}, a as (select tid, pos, count(*) filter (is_ref and not reverse) as a, count(*) filter (is_ref and reverse) as b, count(*) filter (not is_ref and not reverse) as c, count(*) filter (not is_ref and reverse) as d,
      cast(floor(sqrt(sum(mapq * mapq) / count(*)) + 0.499) as int) as rms_mapq from x group by tid, pos),
    q as (select *, a + b as r, a + c as k, a + b + c + d as n from a),
    p as (select *, list_transform(range(greatest(0, r + k - n), least(r, k) + 1), lambda z: {_P_OF.format('z')}) as ps, {_P_OF.format('a')} as own from q)
    select tid, pos, a as n_ref_fwd, b as n_ref_rev, c as n_alt_fwd, d as n_alt_rev, rms_mapq, round(least(1.0, list_sum(list_filter(ps, lambda z: z <= own * (1 + 1e-9)))), 6) as p_strand from p""",
)
def site_strand_bias(spark: SparkSession, d: str) -> DataFrame:
    """Exact test of strand against allele, and the root mean square of the mapping quality."""
    x = B.site_tests(pile_blocks(spark, d), bases_of, ["p_strand"], ["n_ref_fwd", "n_ref_rev", "n_alt_fwd", "n_alt_rev"])
    return x.select("tid", "pos", "n_ref_fwd", "n_ref_rev", "n_alt_fwd", "n_alt_rev", "rms_mapq", F.round("p_strand", 6).alias("p_strand"))


@R.add("site_tests")
def site_tests(spark: SparkSession, d: str) -> DataFrame:
    """The four p values of a site: strand, base quality, mapping quality, distance to the read's end."""
    return B.site_tests(pile_blocks(spark, d), bases_of)


_VDB = """case when n < 2 then 1.0 when n = 2 then case when d = 0 then 1 / l else (l - d) * 2 / l / l end
  when n = 3 then case when d > 2 * (l / 2.9) then 0.0 else sin(d * 3.14 / 2 / (l / 2.9)) / (4 * (l / 2.9) / 3.14) end
  else exp(-(d - l / 2.9) * (d - l / 2.9) / case when d < l / 2.9 then 2.0 else 3.125 end / pow(l / 1.9 / (least(n, 5) + 1), 2)) / (1.125 * sqrt(6.28 * pow(l / 1.9 / (least(n, 5) + 1), 2))) end"""


@R.add(
    "distance_bias",
    f"""with {_ANNOTATED}, y as (select ord, op, tid, pos, qpos - case when cigar = '10S40M' then 10 else 0 end as at, qlen from x where not is_ref),
    p as (select a.tid, a.pos, avg(abs(a.at - b.at)) as m from y a join y b on a.tid = b.tid and a.pos = b.pos and a.ord < b.ord group by all),
    s as (select tid, pos, count(*) as n, cast(floor(sum(qlen) / count(*)) as double) as l from y group by all),
    j as (select s.*, coalesce(m, 0) as m, cast(floor(coalesce(m, 0)) as double) as d from s left join p using (tid, pos))
    select tid, pos, n as n_alt, round(m, 6) as mean_distance, round({_VDB}, 6) as vdb from j""",
)
def distance_bias(spark: SparkSession, d: str) -> DataFrame:
    """Variant distance bias."""
    x = base_pile(spark, d).where("not is_del").withColumn("clip", F.coalesce(F.expr("try_cast(nullif(regexp_extract(cigar, '^([0-9]+)S', 1), '') as int)"), F.lit(0)))
    return K.distance_bias(x, _SITE).select("tid", "pos", "n_alt", F.round("mean_distance", 6).alias("mean_distance"), F.round("vdb", 6).alias("vdb"))


@R.add(
    "depth_by_quality",
    f"""with {PILE} select tid, pos, count(*) filter (op not in ('D', 'N') and {"cast((qpos * 7 + mapq) % 41 as int)"} >= 20 and file = 0) as depth_0,
      count(*) filter (op not in ('D', 'N') and {"cast((qpos * 7 + mapq) % 41 as int)"} >= 20 and file = 1) as depth_1 from (select pile.*, aln.file from pile join aln using (ord)) where mapq >= 10 group by tid, pos""",
)
def depth_by_quality(spark: SparkSession, d: str) -> DataFrame:
    """Depth of each file from bases and mappings of enough quality; positions that a read only spans are there with 0."""
    return A.depth_of_bases(base_pile(spark, d), [0, 1], _SITE, min_base_quality=20, min_quality=10).drop("bin")


@R.add("pairwise_ld")
def pairwise_ld(spark: SparkSession, d: str) -> DataFrame:
    """Squared correlation of every two sites of a label at most 40 numbers apart."""
    x = likelihoods(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    return K.pairwise_ld(x, "vec_id", "label", "vec_id", 40).withColumn("r2", F.round("r2", 6))


@R.add("listed_ld")
def listed_ld(spark: SparkSession, d: str) -> DataFrame:
    """Squared correlation of listed pairs of sites."""
    x = likelihoods(spark, d)
    return K.listed_ld(x.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 7).alias("b")), x, "vec_id").withColumn("r2", F.round("r2", 6))


@R.add("group_estimates")
def group_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies of two groups of samples and likelihood ratios with one and two degrees of freedom."""
    x = V.group_estimates(likelihoods(spark, d), "vec_id", 8)
    return x.select("vec_id", *[F.round(c, 6).alias(c) for c in x.columns if c != "vec_id"])


@R.add("site_posteriors")
def site_posteriors(spark: SparkSession, d: str) -> DataFrame:
    """The posterior that a site varies under the other priors and for haploid samples."""
    x = likelihoods(spark, d)
    parts = [V.site_estimates(x, "vec_id", prior=p, ploidy=n).select("vec_id", F.lit(f"{p}{n}").alias("model"), F.round("p_variant", 6).alias("p_variant")) for p, n in (("cond2", 2), ("flat", 2), ("full", 1))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.add("phased_sites")
def phased_sites(spark: SparkSession, d: str) -> DataFrame:
    """Haplotypes of the sites where reads show two bases, and the reads of each."""
    return P.phased(B.calls_of_two(pile_blocks(spark, d, "ord"), bases_of))
