"""Queries over variants, likelihoods and pileups with bases."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions.cigar import query_len
from readloom.functions.flags import has
from readloom.operators import aggregates as A
from readloom.operators import calling as K
from readloom.operators import filters as X
from readloom.operators import piles as B
from readloom.operators import variants as V
from readloom.plans.alignment_queries import _BLOCKS, ops_sql
from readloom.plans.derive import PL_SQL, REGION_SQL, alignments, likelihoods, regions
from readloom.plans.registry import Registry
from readloom.session import table

R = Registry()

VARS = [
    ("vid", "o_orderkey"), ("tid", "cast(o_custkey % 25 as int)"), ("pos", "cast(o_orderkey * 13 % 100000 as int)"),
    ("ref", "case cast(o_orderkey % 5 as int) when 0 then 'A' when 1 then 'C' when 2 then 'G' when 3 then 'T' else 'AC' end"),
    ("alt", "case cast(o_custkey % 6 as int) when 0 then 'A' when 1 then 'C' when 2 then 'G' when 3 then 'T' when 4 then 'ACGT' else 'X' end"),
    ("qual", "cast(floor(o_totalprice / 1000) as int)"), ("dp", "cast(o_custkey % 60 as int)"),
]
VAR = "var as (select " + ", ".join(f"{e} as {n}" for n, e in VARS) + " from orders)"
PL = f"p as ({PL_SQL})"
_INDEL = "(length(ref) > 1 or (alt <> 'X' and length(alt) > 1))"
_S = "list_transform(range(0, len(pl) // 3), lambda i: pl[i * 3 + 1:i * 3 + 3])"


def variants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(*[f"{e} as {n}" for n, e in VARS])


@R.add("variant_filter", f"with {VAR} select vid from var where alt <> 'X' and not {_INDEL} and qual >= 100")
def variant_filter(spark: SparkSession, d: str) -> DataFrame:
    """SNPs of enough quality."""
    return V.variant_filter(variants(spark, d), no_indels=True, min_quality=100).select("vid")


@R.add("indel_spectrum", f"with {VAR} select cast(length(alt) - length(ref) as int) as len, count(*) as n, count(*) filter ((length(alt) - length(ref)) % 3 = 0) as n_in_frame from var where alt <> 'X' and {_INDEL} group by 1")
def indel_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of insertions and deletions."""
    x = variants(spark, d).where((F.col("alt") != "X") & V.is_indel("ref", "alt")).withColumn("len", F.length("alt") - F.length("ref"))
    return x.groupBy("len").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("len") % 3 == 0).cast("bigint")).alias("n_in_frame"))


@R.add(
    "quality_strata",
    f"""with {VAR}, reg as ({REGION_SQL}), k as (select distinct tid, start as pos from reg),
    v as (select qual, ref || alt in ('AG', 'GA', 'CT', 'TC') as ts, k.pos is not null as known from var left join k using (tid, pos)),
    q as (select qual, count(*) as n, count(*) filter (ts) as t, count(*) filter (known) as k from v group by 1),
    r as (select qual, sum(n) over o as n_variants, sum(t) over o as n_transitions, sum(k) over o as n_known from q window o as (order by qual desc rows unbounded preceding))
    select qual, cast(n_variants as bigint) as n_variants, cast(n_transitions as bigint) as n_transitions, cast(n_known as bigint) as n_known,
      case when n_variants > n_transitions then round(n_transitions / (n_variants - n_transitions), 6) end as ts_tv from r""",
)
def quality_strata(spark: SparkSession, d: str) -> DataFrame:
    """Statistics by quality, with known sites from the regions' starts."""
    known = regions(spark, d).select("tid", F.col("start").alias("pos")).distinct().withColumn("known", F.lit(True))
    x = variants(spark, d).join(known, ["tid", "pos"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return V.strata(x)


@R.add(
    "site_intervals",
    f"""with {VAR}, l as (select tid, pos - lag(pos) over (partition by tid order by pos, vid) as gap from var)
    select tid, count(gap) as n_gaps, cast(sum(gap) as bigint) as span, count(*) filter (gap <= 100) as n_close from l group by 1""",
)
def site_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Distances between neighbouring sites."""
    w = Window.partitionBy("tid").orderBy("pos", "vid")
    x = variants(spark, d).select("tid", (F.col("pos") - F.lag("pos").over(w)).alias("gap"))
    return x.groupBy("tid").agg(F.count("gap").alias("n_gaps"), F.sum("gap").alias("span"), F.sum(F.coalesce(F.col("gap") <= 100, F.lit(False)).cast("bigint")).alias("n_close"))


@R.add(
    "variant_neighbours",
    f"""with {VAR}, x as (select *, {_INDEL} as indel from var where dp between 2 and 10000000)
    select vid from x where case when indel then not exists (select 1 from x y where y.indel and y.tid = x.tid and abs(y.pos - x.pos) <= 10 and (y.qual > x.qual or (y.qual = x.qual and y.vid < x.vid)))
      else not exists (select 1 from x y where y.indel and y.tid = x.tid and abs(y.pos - x.pos) <= 3) end""",
)
def variant_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Depth and neighbour filter."""
    return V.near_filter(variants(spark, d)).select("vid")


_CALLS = f"c as (select vec_id, pl, list_transform({_S}, lambda s: {{'gt': list_position(s, list_min(s)) - 1, 'gq': least(99, list_sort(s)[2] - list_sort(s)[1])}}) as g from p)"


@R.add(
    "genotype_summary",
    f"""with {PL}, {_CALLS} select vec_id, cast(list_sum(list_transform(g, lambda x: x.gt)) as int) as ac, cast(len(g) * 2 as int) as an, cast(list_max(list_transform(g, lambda x: x.gq)) as int) as max_gq,
      cast(len(list_filter({_S}, lambda s: list_max(s) > 0)) as int) as n_covered, cast(list_min(list_transform({_S}, lambda s: list_sort(s)[2] - list_sort(s)[1])) as int) as least_gap,
      cast(list_min([pl[1] + pl[4], pl[2] + pl[5], pl[3] + pl[6]]) - list_min(pl[1:3]) - list_min(pl[4:6]) as int) as pair_gap from c""",
)
def genotype_summary(spark: SparkSession, d: str) -> DataFrame:
    """Calls of 20 samples a site and what follows from them."""
    x = likelihoods(spark, d).withColumn("calls", V.call_genotypes("pl"))
    ac, an = V.allele_counts("calls")
    return x.select(
        "vec_id", ac.alias("ac"), an.alias("an"), V.max_genotype_quality("calls").alias("max_gq"), V.covered_samples("pl").alias("n_covered"), V.least_gap("pl").alias("least_gap"), V.pair_call("pl").alias("pair_gap")
    )


@R.add("genotype_calls", f"with {PL}, {_CALLS}, u as (select vec_id, g, unnest(range(1, len(g) + 1)) as i from c) select vec_id, cast(i as int) as sample, cast(g[i].gt as int) as gt, cast(g[i].gq as int) as gq from u")
def genotype_calls(spark: SparkSession, d: str) -> DataFrame:
    """The genotype and its quality of every sample."""
    x = likelihoods(spark, d).select("vec_id", F.posexplode(V.call_genotypes("pl")).alias("i", "c"))
    return x.select("vec_id", (F.col("i") + 1).alias("sample"), F.col("c.gt").alias("gt"), F.col("c.gq").alias("gq"))


@R.add(
    "likelihood_to_phred",
    """with e as (select vec_id, list_transform(embedding, lambda x: cast(least(255, greatest(0, floor(-10.0 * cast(x as double) + 0.499))) as int)) as q from embeddings)
    select vec_id, cast(list_sum(q) as bigint) as total, cast(list_max(q) as int) as most from e""",
)
def likelihood_to_phred(spark: SparkSession, d: str) -> DataFrame:
    """Log likelihoods to phred scale."""
    x = table(spark, d, "embeddings").select("vec_id", V.likelihood_to_phred(F.transform("embedding", lambda v: v.cast("double"))).alias("q"))
    return x.select("vec_id", F.aggregate("q", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"), F.array_max("q").alias("most"))


_PAIRS = [a + b for i, a in enumerate("ACGT") for b in "ACGT"[i:]]


@R.add("ten_genotypes", f"with {PL}, t as (select vec_id, case when vec_id % 2 = 0 then 'G' else 'C' end as r, case when vec_id % 3 = 0 then 'A' else 'T' end as a, pl from p) select vec_id, " + ", ".join(f"cast(case when r || r = '{p}' then pl[1] when least(r, a) || greatest(r, a) = '{p}' then pl[2] when a || a = '{p}' then pl[3] else 255 end as int) as {p.lower()}" for p in _PAIRS) + " from t")
def ten_genotypes(spark: SparkSession, d: str) -> DataFrame:
    """Ten genotypes from three, for the first sample."""
    x = likelihoods(spark, d).selectExpr("vec_id", "pl", "case when vec_id % 2 = 0 then 'G' else 'C' end as r", "case when vec_id % 3 = 0 then 'A' else 'T' end as a")
    ten = V.ten_genotypes(F.col("pl"), F.col("r"), F.col("a"))
    return x.select("vec_id", ten.alias("t")).select("vec_id", *[F.get("t", i).alias(p.lower()) for i, p in enumerate(_PAIRS)])


@R.add("sample_subset", f"with {PL} select vec_id, pl[1] as s1_ref, pl[16] as s6_ref, pl[24] as s8_alt from p")
def sample_subset(spark: SparkSession, d: str) -> DataFrame:
    """Three of the samples."""
    s = V.samples_of("pl")
    return likelihoods(spark, d).select("vec_id", F.get(F.get(s, 0), 0).alias("s1_ref"), F.get(F.get(s, 5), 0).alias("s6_ref"), F.get(F.get(s, 7), 2).alias("s8_alt"))


@R.add("site_estimates")
def site_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Allele frequency, Hardy-Weinberg p value, probability of a variant."""
    return V.site_estimates(likelihoods(spark, d), "vec_id").select("vec_id", *[F.round(c, 6).alias(c) for c in ("af", "hwe_p", "p_variant")])


@R.add("adjacent_ld")
def adjacent_ld(spark: SparkSession, d: str) -> DataFrame:
    """Squared correlation of neighbouring sites of a label."""
    x = likelihoods(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    return K.adjacent_ld(x, "vec_id", "label", "vec_id").withColumn("r2", F.round("r2", 6))


# --- pileup with bases --------------------------------------------------------------------------

#: bases and base qualities of a read follow from position, offset and mapping quality
_BASE = "substr('ACGT', cast(1 + (pos + case when qpos * mapq % 11 = 5 then 1 else 0 end) % 4 as int), 1)"
_REF = "substr('ACGT', cast(1 + pos % 4 as int), 1)"
_BASEQ = "cast((qpos * 7 + mapq) % 41 as int)"

_QBEG = "cast(coalesce(list_sum(list_transform(range(1, i), lambda j: case when k[j] in ('M', 'I', 'S', '=', 'X') then cast(l[j] as int) else 0 end)), 0) as int)"
PILE = f"""{_BLOCKS.replace("else 0 end)), 0) as int) as beg from u)", "else 0 end)), 0) as int) as beg, " + _QBEG + " as qbeg, cast(i as int) as i, len(k) as nk from u)")},
  pl1 as (select b.ord, b.tid, b.op, b.beg, b.n, b.qbeg, b.i, b.nk, unnest(range(0, b.n)) as w from blk b where b.op in ('M', 'D', 'N', '=', 'X')),
  pile as (select q.ord, q.tid, q.op, cast(q.beg + q.w as int) as pos, cast(case when q.op in ('D', 'N') then q.qbeg else q.qbeg + q.w end as int) as qpos, a.mapq, a.flag, a.pos as start,
    {ops_sql('MIS=X', 'a.cigar')} as qlen, a.pos + {ops_sql('MDN=X', 'a.cigar')} - 1 as stop, a.cigar, q.w = q.n - 1 as at_end
    from pl1 q join aln a using (ord) where a.flag & 1796 = 0)"""


def base_pile(spark: SparkSession, d: str) -> DataFrame:
    reads = X.pileup_reads(alignments(spark, d).where("tid >= 0")).withColumn("qlen", query_len("cigar"))
    x = A.pileup(reads, ["ord", "mapq", "flag", "qlen", "file", "cigar"])
    x = x.withColumns({"base": F.expr(_BASE), "ref_base": F.expr(_REF), "base_q": F.expr(_BASEQ), "reverse": has("flag", 16)})
    return x.withColumn("is_ref", F.col("base") == F.col("ref_base")).withColumn("tail", F.least(F.col("qpos"), F.col("qlen") - 1 - F.col("qpos"), F.lit(25)))


def bases_of(pos: np.ndarray, qpos: np.ndarray, mapq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, reference base, base quality) as _BASE, _REF and _BASEQ have them, bases as places in ACGT."""
    return (pos + (qpos * mapq % 11 == 5)) % 4, pos % 4, (qpos * 7 + mapq) % 41


def inserted_of(pos: np.ndarray, qpos: np.ndarray, mapq: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The i-th base of the insertion behind a base, as _INS_SQL has it."""
    return (qpos + i) * mapq % 4


def pile_blocks(spark: SparkSession, d: str, ordinal: str | None = None) -> DataFrame:
    """The blocks behind ``base_pile`` without deletions."""
    return B.placed_blocks(X.pileup_reads(alignments(spark, d).where("tid >= 0")), ordinal=ordinal)


_ANNOTATED = f"""{PILE}, x as (select *, {_BASE} = {_REF} as is_ref, {_BASEQ} as base_q, flag & 16 <> 0 as reverse, least(qpos, qlen - 1 - qpos, 25) as tail from pile where op in ('M', '=', 'X'))"""
_SUMS = []
for _n, _w in (("ref", "is_ref"), ("alt", "not is_ref")):
    _SUMS += [f"count(*) filter ({_w} and not reverse) as n_{_n}_fwd", f"count(*) filter ({_w} and reverse) as n_{_n}_rev"]
    for _v in ("base_q", "mapq", "tail"):
        _SUMS += [f"cast(coalesce(sum({_v}) filter ({_w}), 0) as bigint) as {_v}_{_n}", f"cast(coalesce(sum({_v} * {_v}) filter ({_w}), 0) as bigint) as {_v}2_{_n}"]


@R.add("site_annotations", f"with {_ANNOTATED} select tid, pos, count(*) as depth, {', '.join(_SUMS)} from x group by all")
def site_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen counters a site."""
    return V.site_annotations(base_pile(spark, d).where("not is_del"), ["tid", "bin", "pos"]).drop("bin")


_HIT, _MISS, _HET = "log10(greatest(1 - e, 1e-10))", "log10(e / 3)", "log10((1 - e) / 2 + e / 6)"


@R.add(
    "base_likelihoods",
    f"""with {_ANNOTATED}, y as (select *, pow(10.0::double, -base_q / 10.0::double) as e from x where base_q > 0),
    g as (select tid, pos, count(*) as depth, sum(case when is_ref then {_HIT} else {_MISS} end) as a, sum({_HET}) as b, sum(case when is_ref then {_MISS} else {_HIT} end) as c from y group by all)
    select tid, pos, depth, """
    + ", ".join(f"cast(least(255, floor(-10 * ({v} - greatest(a, b, c)) + 0.499)) as int) as pl_{n}" for v, n in (("a", "ref"), ("b", "het"), ("c", "alt")))
    + " from g",
)
def base_likelihoods(spark: SparkSession, d: str) -> DataFrame:
    """Likelihoods of three genotypes a site, errors taken as independent."""
    return V.base_likelihoods(base_pile(spark, d).where("not is_del and base_q > 0"), ["tid", "bin", "pos"]).drop("bin")


#: inserted bases follow from their offset on the read, deleted ones from the reference
_INSERTED = "substr('ACGT', cast(1 + ({0} * mapq) % 4 as int), 1)"
_DELETED = "substr('ACGT', cast(1 + ({0}) % 4 as int), 1)"
_case = lambda t: f"case when flag & 16 <> 0 then lower({t}) else {t} end"
_INS_SQL = _case(" || ".join(_INSERTED.format(f"(qpos + {i})") for i in (1, 2)))
_DEL_SQL = _case(" || ".join(_DELETED.format(f"pos + {i}") for i in range(1, 6)))
_TOKEN = f"""case when pos = start then '^' || chr(cast(least(mapq, 93) + 33 as int)) else '' end
  || case when op = 'N' then case when flag & 16 <> 0 then '<' else '>' end when op = 'D' then '*'
    when {_BASE} = {_REF} then case when flag & 16 <> 0 then ',' else '.' end when flag & 16 <> 0 then lower({_BASE}) else {_BASE} end
  || case when cigar = '20M2I28M' and at_end and pos = start + 19 then '+2' || {_INS_SQL} when cigar = '30M5D20M' and at_end and pos = start + 29 then '-5' || {_DEL_SQL} else '' end
  || case when pos = stop then '$' else '' end"""


@R.add(
    "mpileup_text",
    f"with {PILE} select tid, cast(pos + 1 as int) as pos, any_value({_REF}) as ref_base, count(*) as depth, md5(string_agg({_TOKEN}, '' order by ord, op)) as bases, md5(string_agg(chr(cast({_BASEQ} + 33 as int)), '' order by ord, op)) as quals from pile group by all".replace("group by all", "group by tid, pos"),
)
def mpileup_text(spark: SparkSession, d: str) -> DataFrame:
    """Bases and qualities of every position as text, with the bases of indels, by digest."""
    reads = B.placed_reads(X.pileup_reads(alignments(spark, d).where("tid >= 0")), "ord")
    x = B.pileup_text(reads, bases_of, inserted_of)
    return x.select("tid", (F.col("pos") + 1).alias("pos"), "ref_base", "depth", F.md5("bases").alias("bases"), F.md5("quals").alias("quals"))


@R.add("indel_candidates", f"with {PILE} select tid, pos, cast(case when cigar = '20M2I28M' then 2 else -5 end as int) as indel, count(*) as n_reads from pile where at_end and ((cigar = '20M2I28M' and pos = start + 19) or (cigar = '30M5D20M' and pos = start + 29)) group by all")
def indel_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of indel at every position with their support (the scoring by realignment is not built)."""
    x = A.pileup_blocks(X.pileup_reads(alignments(spark, d).where("tid >= 0")), [])
    return V.indel_candidates(x)


_TRIO = sorted({(x + y, a, b) for a in (0, 1, 2) for b in (0, 1, 2) for x in ((0,), (0, 1), (1,))[a] for y in ((0,), (0, 1), (1,))[b]})


@R.add("trio_calls", f"with {PL} select vec_id, cast(least({', '.join(f'pl[{k + 1}] + pl[{a + 4}] + pl[{b + 7}]' for k, a, b in _TRIO)}) - list_min(pl[1:3]) - list_min(pl[4:6]) - list_min(pl[7:9]) as int) as gap from p")
def trio_calls(spark: SparkSession, d: str) -> DataFrame:
    """What inheritance costs the first three samples."""
    return likelihoods(spark, d).select("vec_id", V.trio_gap("pl").alias("gap"))


@R.add(
    "group_contrast",
    f"""with {PL}, {_CALLS}, k as (select vec_id, cast(list_sum(list_transform(g[1:8], lambda x: x.gt)) as double) as a, cast(list_sum(list_transform(g[9:20], lambda x: x.gt)) as double) as b from c)
    select vec_id, case when a + b > 0 and a + b < 40 then round(40 * pow(a * (24 - b) - b * (16 - a), 2) / (16 * 24 * (a + b) * (40 - a - b)), 6) end as chi2 from k""",
)
def group_contrast(spark: SparkSession, d: str) -> DataFrame:
    """The first eight samples against the other twelve."""
    x = likelihoods(spark, d).withColumn("calls", V.call_genotypes("pl"))
    return x.select("vec_id", F.round(V.group_contrast("calls", 8), 6).alias("chi2"))


@R.add(
    "permuted_samples",
    f"""with {PL}, o as (select vec_id, list_sort(list_transform(range(0, len(pl) // 3), lambda i: {{'h': md5(vec_id || ':' || i), 's': pl[i * 3 + 1:i * 3 + 3]}})) as o from p)
    select vec_id, md5(array_to_string(flatten(list_transform(o, lambda x: x.s)), ',')) as digest, cast(len(o) as int) as n_samples from o""",
)
def permuted_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples permuted, in their new order."""
    x = likelihoods(spark, d).select("vec_id", V.permuted_samples("pl", F.col("vec_id")).alias("s"))
    return x.select("vec_id", F.md5(F.array_join(F.transform(F.flatten("s"), lambda v: v.cast("string")), ",")).alias("digest"), F.size("s").alias("n_samples"))


@R.add("variant_view", f"with {VAR.replace(' from orders)', ', o_custkey % 21 as cov from orders)')}, reg as ({REGION_SQL}) select vid from var where alt <> 'X' and cov / 20.0 >= 0.5 and exists (select 1 from reg where reg.tid = var.tid and var.pos < reg.stop and reg.start < var.pos + length(ref))")
def variant_view(spark: SparkSession, d: str) -> DataFrame:
    """variants with data in at least half of the samples that overlap a list of regions."""
    x = table(spark, d, "orders").selectExpr(*[f"{e} as {n}" for n, e in VARS], "o_custkey % 21 as cov")
    return V.variant_filter(x, min_covered=0.5, covered=F.col("cov") / 20.0, regions=regions(spark, d)).select("vid")


@R.add(
    "record_edits",
    f"""with {PL} select vec_id, pl[1] || ',' || pl[2] || ',' || pl[4] || ',' || pl[3] || ',' || pl[5] || ',' || pl[6] as pl, 'GT:PL:GQ' as fields, '0/1:' || pl[1] || ':' || pl[2] as sample,
      case when vec_id % 2 = 0 then '.' else 'AF=1;MQ=3' end as info from p""",
)
def record_edits(spark: SparkSession, d: str) -> DataFrame:
    """Likelihoods of three alleles in another order, the genotype in front, INFO entries removed."""
    text = lambda i: F.get("pl", i).cast("string")
    x = likelihoods(spark, d).withColumn("values", F.concat_ws(":", text(0), text(1), F.lit("0/1"))).withColumn("fields", F.lit("PL:GQ:GT"))
    x = x.withColumn("values", F.concat_ws(":", text(0), F.lit("0/1"), text(1))).withColumn("fields", F.lit("PL:GT:GQ"))
    fields, sample = V.field_first("fields", "values", "GT")
    info = F.when(F.col("vec_id") % 2 == 0, "DP=1;QS=2").otherwise("DP=1;AF=1;QS=2;MQ=3")
    six = V.reorder_likelihoods(F.slice("pl", 1, 6), 3)
    return x.select("vec_id", F.array_join(F.transform(six, lambda v: v.cast("string")), ",").alias("pl"), fields.alias("fields"), sample.alias("sample"), V.without_info(info, "DP", "QS").alias("info"))


@R.add("vcf_output", f"with {VAR} select 'c' || tid || chr(9) || (pos + 1) || chr(9) || '.' || chr(9) || ref || chr(9) || case when alt = 'X' then '.' else alt end || chr(9) || qual || chr(9) || '.' || chr(9) || 'DP=' || dp || case when length(ref) > 1 then ';LONG' else '' end as value, count(*) as n from var group by 1")
def vcf_output(spark: SparkSession, d: str) -> DataFrame:
    """Variants as lines."""
    dp = F.create_map(F.lit("DP"), F.col("dp").cast("string"))
    info = F.when(F.length("ref") > 1, F.map_concat(dp, F.create_map(F.lit("LONG"), F.lit("")))).otherwise(dp)
    x = variants(spark, d).select(F.concat(F.lit("c"), F.col("tid").cast("string")).alias("chrom"), "pos", "ref", "alt", "qual", info.alias("info"))
    return V.format_vcf(x).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@R.add("variant_region", f"with {VAR} select vid from var where tid = 3 and pos >= 20000 and pos < 60000")
def variant_region(spark: SparkSession, d: str) -> DataFrame:
    """Variants of a region."""
    return variants(spark, d).where((F.col("tid") == 3) & (F.col("pos") >= 20000) & (F.col("pos") < 60000)).select("vid")
