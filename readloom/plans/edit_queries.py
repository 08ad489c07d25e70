"""Queries over reads compared with their reference, consensus, gaps, and lines of other programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators import baq as B
from readloom.operators import edits as E
from readloom.plans.derive import SEQ_SQL, sequences
from readloom.plans.registry import Registry
from readloom.plans.variant_queries import VAR, VARS
from readloom.session import table

R = Registry()

# --- reads cut from the derived sequences, changed by rule ---------------------------------------

#: base i of a read stands at this offset of the reference, or is inserted
_OFFSET = "case doc_id % 3 when 0 then i when 1 then case when i < 20 then i else i + 5 end else case when i < 20 then i when i < 22 then -1 else i - 2 end end"
_CIGAR = "case doc_id % 3 when 0 then '50M' when 1 then '20M5D30M' else '20M2I28M' end"
_CHANGED = "(i * 7 + doc_id + pos) % 13 = 0"
_QUAL = "(i * 5 + doc_id) % 38 + 3"
_READS_SQL = f"""s as ({SEQ_SQL}), w as (select doc_id, seq as ref, unnest([0, 20]) as pos from s where length(seq) >= 80),
    b as (select *, unnest(range(0, 50)) as i from w), o as (select *, {_OFFSET} as o from b),
    c as (select *, case when o < 0 then 'G' when {_CHANGED} then 'T' else substr(ref, cast(pos + o + 1 as int), 1) end as base, substr(ref, cast(pos + o + 1 as int), 1) as rbase, {_QUAL} as q from o),
    t as (select *, o >= 0 and base <> rbase as differs from c)"""


def derived_reads(spark: SparkSession, d: str) -> DataFrame:
    """Two reads of 50 bases a sequence: plain, with a deletion or with an insertion; every thirteenth base or so changed."""
    x = sequences(spark, d).where("length(seq) >= 80").selectExpr("doc_id", "seq as ref_seq", "explode(array(0, 20)) as pos")
    base = f"transform(sequence(0, 49), i -> case when {_OFFSET} < 0 then 'G' when {_CHANGED} then 'T' else substring(ref_seq, cast(pos + ({_OFFSET}) + 1 as int), 1) end)"
    return x.selectExpr("doc_id", "pos", f"{_CIGAR} as cigar", f"array_join({base}, '') as seq", f"transform(sequence(0, 49), i -> cast({_QUAL} as int)) as quals", "ref_seq", "0 as ref_beg")


@R.add(
    "recomputed_tags",
    f"""with {_READS_SQL},
    k as (select doc_id, pos, any_value(ref) as ref, count(*) filter (differs) + case doc_id % 3 when 0 then 0 when 1 then 5 else 2 end as nm,
      list(case when differs then rbase else '=' end order by i) filter (o >= 0) as tok from t group by doc_id, pos),
    v as (select *, case when doc_id % 3 = 1 then list_concat(list_append(tok[1:20], '^' || substr(ref, cast(pos + 21 as int), 5)), tok[21:]) else tok end as tk from k),
    r as (select *, list_reduce(list_prepend({{'s': '', 'n': 0}}, list_transform(tk, lambda x: {{'s': x, 'n': 0}})), lambda a, x: case when x.s = '=' then {{'s': a.s, 'n': a.n + 1}} else {{'s': a.s || a.n || x.s, 'n': 0}} end) as m from v)
    select doc_id, pos, cast(nm as int) as nm, m.s || m.n as md from r""",
)
def recomputed_tags(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance and mismatch string of reads with matches, deletions and insertions against their sequences."""
    return E.calmd(derived_reads(spark, d)).select("doc_id", "pos", "nm", "md")


@R.add(
    "capped_quality",
    f"""with {_READS_SQL}, a as (select doc_id, pos, count(*) filter (o >= 0 and base <> 'N' and rbase <> 'N' and q >= 13) as n, count(*) filter (differs and base <> 'N' and rbase <> 'N' and q >= 13) as m,
      coalesce(sum(least(q, 33)) filter (differs and base <> 'N' and rbase <> 'N' and q >= 13), 0) as w from t group by doc_id, pos),
    cq as (select *, w - 4.343 * (m * ln(greatest(n, 1)) - lgamma(m + 1)) as t from a)
    select doc_id, pos, cast(case when t > 40 then -1 else floor(sqrt((40 - greatest(t, 0)) / 40) * 40 + 0.499) end as int) as cap from cq""",
)
def capped_quality(spark: SparkSession, d: str) -> DataFrame:
    """R2: the mapping quality that the mismatches of a read allow."""
    return E.capped_quality(derived_reads(spark, d)).select("doc_id", "pos", "cap")


@R.add("base_alignment_quality")
def base_alignment_quality(spark: SparkSession, d: str) -> DataFrame:
    """Base qualities lowered to what their alignment is worth, and the tag that holds the difference."""
    return B.base_alignment_quality(derived_reads(spark, d)).select("doc_id", "pos", "baq", B.quality_tag().alias("tag"))


@R.add("banded_alignment")
def banded_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Score and CIGAR of the global alignment of each read with the stretch of its reference, in a band of 20."""
    x = derived_reads(spark, d).withColumn("stretch", F.expr("substring(ref_seq, pos + 1, case doc_id % 3 when 0 then 50 when 1 then 55 else 48 end)"))
    return E.aligned(x.select("doc_id", "pos", "seq", "stretch"), "seq", "stretch", band=20).select("doc_id", "pos", "score", "cigar")


# --- gaps and consensus -------------------------------------------------------------------------


@R.add("cut_at_gaps")
def cut_at_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What lies between gap tracts, scored by N against other bases."""
    return E.cut_at_gaps(sequences(spark, d), "doc_id", least=12, penalty=3)


CALLED = [("fq", "cast(o_custkey % 200 - 100 as int)"), ("af", "cast(o_orderkey % 10 as double) / 10"), ("mq", "cast(o_custkey % 40 as int)")]
_CALLED_SQL = VAR.replace(" from orders)", ", " + ", ".join(f"{e} as {n}" for n, e in CALLED) + " from orders)")
_IUPAC = "case least(ref, alt) || greatest(ref, alt) " + " ".join(f"when '{k}' then '{v}'" for k, v in E.HETEROZYGOUS.items()) + " else 'N' end"


def called_sites(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(*[f"{e} as {n}" for n, e in VARS + CALLED])


@R.add(
    "sequence_consensus",
    f"""with {_CALLED_SQL},
    k as (select tid, pos, case when fq < 0 then case when af < 0.5 then ref else alt end else {_IUPAC} end as b, mq >= 10 and dp between 3 and 100000 as good, chr(cast(least(floor(abs(fq) + 33.499), 126) as int)) as q from var where length(ref) = 1 and length(alt) = 1),
    p as (select tid, pos, max({{'b': case when good then b else lower(b) end, 'q': q}}) as c from k group by tid, pos),
    n as (select distinct tid, unnest(range(greatest(pos - 5, 0), pos + length(ref) + 5)) as pos from var where length(ref) > 1 or length(alt) > 1),
    m as (select p.tid, p.pos, case when n.pos is not null then lower(c.b) else c.b end as b, c.q as q from p left join n on p.tid = n.tid and p.pos = n.pos),
    g as (select tid, pos // 4096 as chunk, max(pos) as last from m group by all),
    f as (select tid, chunk, unnest(range(chunk * 4096, last + 1)) as pos from g)
    select f.tid, f.chunk, md5(string_agg(coalesce(b, 'n'), '' order by f.pos)) as seq, md5(string_agg(coalesce(q, '!'), '' order by f.pos)) as qual from f left join m on f.tid = m.tid and f.pos = m.pos group by f.tid, f.chunk""",
)
def sequence_consensus(spark: SparkSession, d: str) -> DataFrame:
    """The consensus of called sites with its qualities, by digest of each chunk of 4,096 bases."""
    x = called_sites(spark, d).withColumnRenamed("tid", "chrom")
    indels = x.where((F.length("ref") > 1) | (F.length("alt") > 1)).select("chrom", "pos", F.length("ref").alias("length"))
    y = E.consensus(E.called_bases(x), indels, width=4096)
    return y.select(F.col("chrom").alias("tid"), "chunk", F.md5("seq").alias("seq"), F.md5("qual").alias("qual"))


@R.add("gap_tracts")
def gap_tracts(spark: SparkSession, d: str) -> DataFrame:
    """The tracts themselves."""
    return E.cut_at_gaps(sequences(spark, d), "doc_id", least=12, penalty=3, gaps=True)


_GENOTYPE = "case o_orderkey % 7 when 0 then '*/*' when 1 then '+AC/*' when 2 then '-ACG/-ACG' when 3 then '+T/+TT' when 4 then '-A/-ACC' when 5 then '*/-G' else '+A/-TC' end"


@R.add(
    "pileup_indels",
    f"""with g as (select o_orderkey as vid, {_GENOTYPE} as g from orders)
    select vid, case g when '+AC/*' then 'N' when '-ACG/-ACG' then 'NACG' when '+T/+TT' then 'N' when '-A/-ACC' then 'NACC' when '*/-G' then 'NG' else 'NTC' end as ref,
      case g when '+AC/*' then 'NAC' when '-ACG/-ACG' then 'N' when '+T/+TT' then 'NT,NTT' when '-A/-ACC' then 'NNN,N' when '*/-G' then 'N' else 'NANN,N' end as alt from g where g <> '*/*'""",
)
def pileup_indels(spark: SparkSession, d: str) -> DataFrame:
    """Alleles of consensus genotypes with insertions and deletions."""
    x = table(spark, d, "orders").selectExpr("o_orderkey as vid", f"{_GENOTYPE} as g").withColumn("a", E.indel_alleles(F.col("g")))
    return x.where("a is not null").select("vid", "a.ref", "a.alt")
