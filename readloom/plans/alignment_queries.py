"""Queries over alignments: expressions, filters, joins, aggregates, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions import cigar as C
from readloom.functions import flags as G
from readloom.functions import hashes as H
from readloom.functions.keys import mate_number
from readloom.operators import aggregates as A
from readloom.operators import filters as X
from readloom.operators import joins as J
from readloom.operators import order as O
from readloom.operators.intervals import stretches_and_gaps
from readloom.plans.derive import ALN_SQL, REGION_SQL, alignments, regions
from readloom.plans.registry import Registry
from readloom.session import table

R = Registry()
ALN = f"aln as ({ALN_SQL})"
REG = f"reg as ({REGION_SQL})"


def ops_sql(ops: str, col: str = "cigar") -> str:
    return f"cast(coalesce(list_sum(list_transform(regexp_extract_all({col}, '([0-9]+)[{ops}]', 1), lambda x: cast(x as int))), 0) as int)"


END = f"(pos + {ops_sql('MDN=X')})"
N11 = "cast(count(*) as bigint)"

# --- expressions --------------------------------------------------------------------------------


@R.add(
    "cigar_parse",
    f"""with {ALN}, c as (select cigar, count(*) as n from aln group by 1),
    u as (select cigar, n, unnest(range(1, len(regexp_extract_all(cigar, '([0-9]+)[MIDNSHP=X]', 1)) + 1)) as i from c)
    select cigar, cast(i as int) as op_index, cast(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1)[i] as int) as op_len,
      regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2)[i] as op, n as n_reads from u""",
)
def cigar_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every operation of every CIGAR."""
    x = alignments(spark, d).groupBy("cigar").agg(F.count(F.lit(1)).alias("n_reads"))
    x = x.select("cigar", "n_reads", F.posexplode(C.parse_cigar("cigar")).alias("i", "o"))
    return x.select("cigar", (F.col("i") + 1).alias("op_index"), F.col("o.len").alias("op_len"), F.col("o.op").alias("op"), "n_reads")


@R.add(
    "cigar_lengths",
    f"""with {ALN} select ord, {END} as end_pos, (pos + {ops_sql('MDN')}) as end_pos_reference, {ops_sql('MIS=X')} as query_len,
      {ops_sql('IDX')} as mismatches, {ops_sql('MI')} as alen from aln""",
)
def cigar_lengths(spark: SparkSession, d: str) -> DataFrame:
    """End, read length, mismatches and aligned length of every read."""
    return alignments(spark, d).select(
        "ord", C.end_pos("pos", "cigar").alias("end_pos"), C.end_pos("pos", "cigar", "reference").alias("end_pos_reference"),
        C.query_len("cigar").alias("query_len"), C.mismatches("cigar").alias("mismatches"), C.aligned_len("cigar").alias("alen"),
    )


@R.add(
    "cigar_op_counts",
    f"""with {ALN} select ord, {ops_sql('M')} as n_m, {ops_sql('I')} as n_i, {ops_sql('D')} as n_d, {ops_sql('=')} as n_eq, {ops_sql('X')} as n_x,
      {ops_sql('IDX')} as n_mismatches from aln""",
)
def cigar_op_counts(spark: SparkSession, d: str) -> DataFrame:
    """P5: operation counters per alignment."""
    return alignments(spark, d).select("ord", *[c.alias(k) for k, c in C.op_counts("cigar").items()])


_LETTERS = " || ".join(f"case when flag & {1 << i} <> 0 then '{c}' else '' end" for i, c in enumerate("pPuUrR12sfd"))


@R.add(
    "flag_fields",
    f"""with {ALN} select ord, cast(case when flag & 16 <> 0 then 1 else 0 end as int) as strand,
      cast(case when flag & 32 <> 0 then 1 else 0 end as int) as mate_strand, {_LETTERS} as letters, '0x' || lower(hex(cast(flag as bigint))) as hex from aln""",
)
def flag_fields(spark: SparkSession, d: str) -> DataFrame:
    """Strands, letters and hexadecimal flags."""
    return alignments(spark, d).select(
        "ord", G.strand("flag").alias("strand"), G.mate_strand("flag").alias("mate_strand"), G.letters("flag").alias("letters"), G.hexadecimal("flag").alias("hex")
    )


@R.add(
    "read_name_mate",
    """select map_no, cast(case when id_seq like '%/1' then 1 when id_seq like '%/2' then 2 when id_seq is not null then 0 end as int) as mate from mappings""",
)
def read_name_mate(spark: SparkSession, d: str) -> DataFrame:
    """P10: end number from the read name."""
    return table(spark, d, "mappings").select("map_no", mate_number("id_seq").alias("mate"))


_RG = "rgs as (select 'rgA' as rg, 'lib1' as lib, 's1' as sm union all select 'rgB', 'lib2', 's2')"


def _groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("rgA", "lib1", "s1"), ("rgB", "lib2", "s2")], "rg string, lib string, sm string")


@R.add(
    "read_group_lookup",
    f"""with {ALN}, {_RG} select ord, lib, coalesce(sm, 'file' || cast(file as varchar)) as sample from aln left join rgs using (rg)""",
)
def read_group_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Library and sample of a read; without a group the file speaks for the sample."""
    x = alignments(spark, d).join(_groups(spark), "rg", "left")
    return x.select("ord", "lib", F.coalesce("sm", F.concat(F.lit("file"), F.col("file").cast("string"))).alias("sample"))


@R.add(
    "record_validity",
    f"""with {ALN} select cast(sum(case when tid >= -1 and tid < 20 and pos >= -1 and mtid >= -1 and mtid < 20 and mpos >= -1 then 1 else 0 end) as bigint) as n_valid,
      count(*) as n_records from aln""",
)
def record_validity(spark: SparkSession, d: str) -> DataFrame:
    """Records whose coordinates are plausible for a header of 20 contigs."""
    return alignments(spark, d).agg(F.sum(X.valid(20).cast("bigint")).alias("n_valid"), F.count(F.lit(1)).alias("n_records"))


_CODES = "list_transform(range(1, length(qname) + 1), lambda i: cast(ascii(substr(qname, i, 1)) as bigint))"
_HASH_SQL = {
    "x31": f"list_reduce({_CODES}, lambda h, c: (h * 31 + c) % 4294967296, cast(0 as bigint))",
    "bkdr": f"list_reduce({_CODES}, lambda h, c: (h * 131 + c) % 4294967296, cast(0 as bigint))",
    "sdbm": f"list_reduce({_CODES}, lambda h, c: (h * 65599 + c) % 4294967296, cast(0 as bigint))",
    "djb": f"list_reduce({_CODES}, lambda h, c: (h * 33 + c) % 4294967296, cast(5381 as bigint))",
    "bp": f"list_reduce({_CODES}, lambda h, c: xor((h * 128) % 4294967296, c), cast(0 as bigint))",
}


@R.add("string_hashes", f"with {ALN}, q as (select distinct qname from aln) select qname, " + ", ".join(f"cast({v} as bigint) as {k}" for k, v in _HASH_SQL.items()) + " from q")
def string_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Classic string hashes of the read names."""
    return alignments(spark, d).select("qname").distinct().select("qname", *[getattr(H, k)("qname").alias(k) for k in _HASH_SQL])


_WRAP = 4294967296
_FOLD = "list_reduce({0}, lambda h, c: {1}, cast({2} as bigint))"
_PAIRED = "(list_reduce(list_prepend({{'h': cast({1} as bigint), 'a': cast({2} as bigint)}}, list_transform({0}, lambda c: {{'h': c, 'a': cast(0 as bigint)}})), lambda s, c: {{'h': {3}, 'a': {4}}})).h"
_MORE_SQL = {
    "rs": _PAIRED.format(_CODES, 0, 63689, f"cast((cast(s.h as hugeint) * s.a % {_WRAP} + c.h) % {_WRAP} as bigint)", f"cast(cast(s.a as hugeint) * 378551 % {_WRAP} as bigint)"),
    "dek": _FOLD.format(_CODES, f"xor(xor((h * 32) % {_WRAP}, h >> 27), c)", "length(qname)"),
    "js": _FOLD.format(_CODES, f"xor(h, ((h * 32) % {_WRAP} + c + (h >> 2))) % {_WRAP}", 1315423911),
    "fnv": _FOLD.format(_CODES, f"xor(cast(cast(h as hugeint) * 2166136261 % {_WRAP} as bigint), c)", 0),
    "elf": _FOLD.format(_CODES, f"(xor((h * 16 + c) % {_WRAP}, ((h * 16 + c) % {_WRAP} & 4026531840) >> 24)) & (4294967295 - ((h * 16 + c) % {_WRAP} & 4026531840))", 0),
    "ap": _PAIRED.format(
        _CODES, 2863311530, 0,
        f"case when s.a % 2 = 0 then xor(s.h, xor((s.h * 128) % {_WRAP}, (c.h * (s.h >> 3)) % {_WRAP})) else xor(s.h, 4294967295 - ((s.h * 2048) % {_WRAP} + xor(c.h, s.h >> 5)) % {_WRAP}) end", "s.a + 1",
    ),
}


@R.add("string_hashes_more", f"with {ALN}, q as (select distinct qname from aln) select qname, " + ", ".join(f"cast({v} as bigint) as {k}" for k, v in _MORE_SQL.items()) + " from q")
def string_hashes_more(spark: SparkSession, d: str) -> DataFrame:
    """The hashes whose steps mix bits."""
    return alignments(spark, d).select("qname").distinct().select("qname", *[getattr(H, k)("qname").alias(k) for k in _MORE_SQL])


_BIN_SQL = f"""case when b = e then 4681 + b when b >> 3 = e >> 3 then 585 + (b >> 3) when b >> 6 = e >> 6 then 73 + (b >> 6)
  when b >> 9 = e >> 9 then 9 + (b >> 9) when b >> 12 = e >> 12 then 1 + (b >> 12) else 0 end"""


@R.add("index_bins", f"with {ALN}, x as (select tid, pos >> 14 as b, ({END} - 1) >> 14 as e from aln) select tid, cast({_BIN_SQL} as int) as bin, count(*) as n_reads from x group by all")
def index_bins(spark: SparkSession, d: str) -> DataFrame:
    """The hierarchical bin of every read, counted per contig."""
    b, e = F.shiftright("pos", 14), F.shiftright(C.end_pos("pos", "cigar") - 1, 14)
    bin_ = F.lit(0)
    for shift, base in ((12, 1), (9, 9), (6, 73), (3, 585), (0, 4681)):
        s = lambda c, k=shift: F.shiftright(c, k)
        bin_ = F.when(s(b) == s(e), s(b) + base).otherwise(bin_)
    return alignments(spark, d).groupBy("tid", bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n_reads"))


# --- filters ------------------------------------------------------------------------------------


def _filter(name: str, where: str, **limits: int) -> None:
    @R.add(name, f"with {ALN} select ord from aln where {where}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return X.filter_alignments(alignments(spark, d), **limits).select("ord")

    run.__doc__ = f"Filter by {limits}."


_filter("filter_chromosome", "tid = 4", chromosome=5)
_filter("filter_mismatches", f"{ops_sql('IDX')} <= 2", max_mismatches=2)
_filter("filter_length", f"{ops_sql('MIS=X')} >= 50", min_length=50)
_filter("filter_quality", "mapq between 20 and 40", min_quality=20, max_quality=40)
_filter("filter_distance", "flag & 2 <> 0 and abs(isize) <= 200", max_distance=200)
_filter(
    "filter_criteria", f"tid = 4 and {ops_sql('IDX')} <= 4 and {ops_sql('MIS=X')} >= 50 and mapq between 10 and 45 and flag & 2 <> 0 and abs(isize) <= 400",
    chromosome=5, max_mismatches=4, min_length=50, min_quality=10, max_quality=45, max_distance=400,
)


@R.add(
    "filter_criteria_reference",
    f"""with {ALN} select ord from aln where ord < coalesce((select min(ord) from aln where not ({ops_sql('MIS=X')} >= 40 and mapq between 2 and 256)), 9223372036854775807)""",
)
def filter_criteria_reference(spark: SparkSession, d: str) -> DataFrame:
    """F6 as the established tool does it: nothing is written after the first failure."""
    return X.filter_alignments(alignments(spark, d), "reference", min_length=40, min_quality=2, max_quality=3).select("ord")


@R.add("view_filter", f"with {ALN} select ord from aln where mapq >= 20 and flag & 2 = 2 and flag & 1028 = 0 and rg in ('rgA')")
def view_filter(spark: SparkSession, d: str) -> DataFrame:
    """quality, flags that must and must not be set, read group."""
    return X.view(alignments(spark, d), 20, 2, 1028, read_groups=["rgA"]).select("ord")


@R.add("view_count", f"with {ALN} select count(*) as n from aln where mapq >= 20 and flag & 1028 = 0")
def view_count(spark: SparkSession, d: str) -> DataFrame:
    """count only."""
    return X.view(alignments(spark, d), 20, 0, 1028).agg(F.count(F.lit(1)).alias("n"))


@R.add("view_regions", f"with {ALN}, {REG} select ord from aln where mapq >= 10 and exists (select 1 from reg where reg.tid = aln.tid and pos < stop and start < {END})")
def view_regions(spark: SparkSession, d: str) -> DataFrame:
    """Reads that overlap any region."""
    return X.view(alignments(spark, d), 10, regions=regions(spark, d)).select("ord")


@R.add("subsample", f"with {ALN}, h as (select ord, ({_HASH_SQL['x31']} + 3) % 4294967296 % 1024 / 1024.0 as u from aln) select ord from h where u < 3.25 - 3")
def subsample(spark: SparkSession, d: str) -> DataFrame:
    """F8: a quarter of the reads by hash of the name, with seed 3: mates stay together."""
    return X.subsample(alignments(spark, d), 3.25).select("ord")


@R.add("pileup_mask", f"with {ALN} select ord from aln where flag & 1796 = 0")
def pileup_mask(spark: SparkSession, d: str) -> DataFrame:
    """reads a pileup uses."""
    return X.pileup_reads(alignments(spark, d)).select("ord")


@R.add("mpileup_reads", f"with {ALN} select ord from aln where flag & 4 = 0 and mapq >= 5 and (rg is null or rg <> 'rgB') and (flag & 1 = 0 or flag & 2 <> 0)")
def mpileup_reads(spark: SparkSession, d: str) -> DataFrame:
    """reads a multi-file pileup uses."""
    return X.mpileup_reads(alignments(spark, d), 5, ["rgB"]).select("ord")


@R.add("mpileup_region_reads", f"with {ALN}, {REG} select ord, chr(cast(33 + greatest(0, 20 + mapq - 31) as int)) || '!' as qual from aln where flag & 4 = 0 and mapq >= 5 and (flag & 1 = 0 or flag & 2 <> 0) and exists (select 1 from reg where reg.tid = aln.tid and pos < stop and start < {END})")
def mpileup_region_reads(spark: SparkSession, d: str) -> DataFrame:
    """those that overlap a list of regions, with qualities of the old scale shifted."""
    x = X.mpileup_reads(alignments(spark, d), 5, regions=regions(spark, d))
    return x.select("ord", X.shifted_quality(F.concat(F.char(F.col("mapq") + 53), F.lit("#"))).alias("qual"))


@R.add("region_query", f"with {ALN} select ord from aln where tid = 7 and pos < 40000 and greatest({END}, pos + 1) > 10000")
def region_query(spark: SparkSession, d: str) -> DataFrame:
    """Reads overlapping a region; contig and start bound reach the scan."""
    return X.region(alignments(spark, d), 7, 10000, 40000).select("ord")


# --- joins --------------------------------------------------------------------------------------


@R.add(
    "region_overlap_join",
    f"with {ALN}, {REG} select ord, part from aln join reg on reg.tid = aln.tid and pos <= stop and {END} - 1 >= start",
)
def region_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Every alignment with every closed region it overlaps."""
    a = alignments(spark, d).select("ord", "tid", "pos", (C.end_pos("pos", "cigar") - 1).alias("last"))
    return J.interval_join(a, regions(spark, d), left_end="last", closed=True).select("ord", "part")


@R.add("region_overlap_semi", f"with {ALN}, {REG} select ord from aln where exists (select 1 from reg where reg.tid = aln.tid and pos < stop and start < {END})")
def region_overlap_semi(spark: SparkSession, d: str) -> DataFrame:
    """Existence of an overlap."""
    a = alignments(spark, d).withColumn("end", C.end_pos("pos", "cigar"))
    return J.overlap_semi(a, regions(spark, d)).select("ord")


_ENDS = f"""{ALN}, e as (select qname, tid, pos, {ops_sql('MIS=X')} as len, case when flag & 64 <> 0 then 1 else 2 end as pe from aln where tid >= 0),
  m as (select a.qname, a.tid, abs(b.pos - (a.pos + a.len)) as distance from e a join e b on a.qname = b.qname and a.tid = b.tid and a.pe = 1 and b.pe = 2
    where abs(b.pos - (a.pos + a.len)) <= 500)"""


def _matches(spark: SparkSession, d: str) -> DataFrame:
    a = alignments(spark, d).where("tid >= 0")
    a = a.select("qname", "tid", "pos", C.query_len("cigar").alias("len"), F.when(G.has("flag", 64), 1).otherwise(2).alias("paired_end"))
    return J.pair_matches(a)


@R.add("pair_join", f"with {_ENDS} select qname, tid, cast(distance as int) as distance, count(*) as n from m group by all")
def pair_join(spark: SparkSession, d: str) -> DataFrame:
    """Matching ends of a read."""
    return _matches(spark, d).groupBy("qname", "tid", "distance").agg(F.count(F.lit(1)).alias("n"))


_TRUTH = f"""{ALN}, f as (select ord, cast(ord as varchar) as qname, flag, tid, pos, {END} as "end", case when flag & 16 <> 0 then 1 else 0 end as strand from aln),
  t as (select qname, tid, case when ord % 5 = 0 then pos + 1 else pos end as pos, case when ord % 7 = 0 then "end" + 2 else "end" end as "end", strand from f where ord % 11 <> 0),
  v as (select f.ord, case when flag & 4 <> 0 then 'unmapped' when t.tid is null then 'unknown'
    when f.tid = t.tid and f.pos = t.pos and f.strand = t.strand {{hard}} then 'right' else 'wrong' end as verdict from f left join t on f.qname = t.qname)"""


def _verdicts(spark: SparkSession, d: str, hard: bool) -> DataFrame:
    f = alignments(spark, d).select(
        "ord", F.col("ord").cast("string").alias("qname"), "flag", "tid", "pos", C.end_pos("pos", "cigar").alias("end"), G.strand("flag").alias("strand")
    )
    t = f.where("ord % 11 <> 0").selectExpr("ord", "qname", "tid", "case when ord % 5 = 0 then pos + 1 else pos end as pos", "case when ord % 7 = 0 then `end` + 2 else `end` end as `end`", "strand")
    return J.validate(f, t, hard=hard)


@R.add("validate_soft", f"with {_TRUTH.format(hard='')} select ord, verdict from v")
def validate_soft(spark: SparkSession, d: str) -> DataFrame:
    """Verdict per read on contig, start and strand."""
    return _verdicts(spark, d, False).select("ord", "verdict")


_SHARES = ", ".join(f"round({c} / greatest(mapped + not_mapped, 1), 6) as {c}_share" for c in ("mapped", "not_mapped", "right_mapped", "wrong_mapped"))


@R.add(
    "validate_hard_counts",
    f"""with {_TRUTH.format(hard='and f."end" = t."end"')},
    c as (select cast(sum(case when verdict in ('right', 'wrong') then 1 else 0 end) as bigint) as mapped, cast(sum(case when verdict in ('unmapped', 'unknown') then 1 else 0 end) as bigint) as not_mapped,
      cast(sum(case when verdict = 'right' then 1 else 0 end) as bigint) as right_mapped, cast(sum(case when verdict = 'wrong' then 1 else 0 end) as bigint) as wrong_mapped from v)
    select *, {_SHARES} from c""",
)
def validate_hard_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counters with the end compared as well."""
    return J.validation_counts(_verdicts(spark, d, True))


@R.add("contig_lookup", f"with {ALN} select c.name, count(*) as n_reads from aln join contigs c using (tid) group by 1")
def contig_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Names of the contigs of the reads."""
    n = alignments(spark, d).groupBy("tid").agg(F.count(F.lit(1)).alias("n_reads"))
    return n.join(table(spark, d, "contigs"), "tid").select("name", "n_reads")


_MATE_SQL = f"""{ALN}, n as (select *, row_number() over (partition by qname order by ord) as rn, case when flag & 16 <> 0 then {END} else pos end as five from aln),
  w as (select *, case when rn % 2 = 1 then lead(ord) over o else lag(ord) over o end as m_ord, case when rn % 2 = 1 then lead(tid) over o else lag(tid) over o end as m_tid,
    case when rn % 2 = 1 then lead(pos) over o else lag(pos) over o end as m_pos, case when rn % 2 = 1 then lead(flag) over o else lag(flag) over o end as m_flag,
    case when rn % 2 = 1 then lead(five) over o else lag(five) over o end as m_five from n window o as (partition by qname order by ord)),
  b as (select *, case when m_flag & 16 <> 0 then flag | 32 else flag & ~32 end as f1 from w)"""


@R.add(
    "fix_mates",
    f"""with {_MATE_SQL} select ord, cast(case when m_ord is not null then m_tid else -1 end as int) as mtid, cast(case when m_ord is not null then m_pos else -1 end as int) as mpos,
      cast(case when m_ord is not null and flag & 12 = 0 and m_flag & 12 = 0 and tid = m_tid then m_five - five else 0 end as int) as isize,
      cast(case when m_ord is not null then case when m_flag & 4 <> 0 then (f1 | 8) & ~2 else f1 end when flag & 1 <> 0 then (flag | 8) & ~34 else flag end as int) as flag from b""",
)
def fix_mates(spark: SparkSession, d: str) -> DataFrame:
    """Mate fields from the neighbour of the same name."""
    return J.fix_mates(alignments(spark, d)).select("ord", "mtid", "mpos", "isize", "flag")


@R.add(
    "compare_mappings",
    f"""with {ALN}, x as (select ord, tid, pos, mapq from aln where ord % 13 <> 0), y as (select ord, tid, pos + (ord % 3) * 60 as pos, (mapq + ord) % 50 as mapq from aln where ord % 7 <> 0),
    j as (select case when x.ord is null then 'only_b' when y.ord is null then 'only_a' when x.tid = y.tid and abs(x.pos - y.pos) < 100 then 'same' else 'different' end as place,
      coalesce(x.mapq >= 10, false) as ga, coalesce(y.mapq >= 10, false) as gb from x full join y on x.ord = y.ord)
    select place, case when ga and gb then 'both' when ga then 'a' when gb then 'b' else 'none' end as confident, count(*) as n_reads from j group by all""",
)
def compare_mappings(spark: SparkSession, d: str) -> DataFrame:
    """Two mappings of the same reads."""
    a = alignments(spark, d).select(F.col("ord").alias("qname"), "tid", "pos", "mapq")
    x, y = a.where("qname % 13 <> 0"), a.where("qname % 7 <> 0").selectExpr("qname", "tid", "pos + (qname % 3) * 60 as pos", "(mapq + qname) % 50 as mapq")
    return J.compare_by_name(x, y)


# --- aggregates ---------------------------------------------------------------------------------


@R.add(
    "qc_basic_stats",
    f"""with {ALN} select count(*) as num_alignments, cast(sum(case when flag & 16 = 0 then 1 else 0 end) as bigint) as strand_counter,
      cast(sum(mapq) // count(*) as bigint) as mean_map_quality, cast(sum({ops_sql('MIS=X')}) // count(*) as bigint) as mean_alignment_length from aln""",
)
def qc_basic_stats(spark: SparkSession, d: str) -> DataFrame:
    """A1: counts and integer means."""
    return A.qc_basic_stats(alignments(spark, d))


def _bins_sql(expr: str, source: str) -> str:
    return f"select least({expr}, 11) as bin, count(*) as n from {source} group by 1"


@R.add(
    "qc_error_histogram",
    f"""with {ALN}, b as (select unnest(range(12)) as bin), e as ({_bins_sql(ops_sql('IDX'), 'aln')}), de as ({_bins_sql(ops_sql('D'), 'aln')}),
      i as ({_bins_sql(ops_sql('I'), 'aln')}), q as ({_bins_sql(ops_sql('='), 'aln')})
    select cast(bin as int) as bin, coalesce(e.n, 0) as errors, coalesce(de.n, 0) as deletions, coalesce(i.n, 0) as insertions, coalesce(q.n, 0) as matches
    from b left join e using (bin) left join de using (bin) left join i using (bin) left join q using (bin)""",
)
def qc_error_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A2: four histograms in one pass."""
    return A.map_error_histogram(alignments(spark, d))


@R.add(
    "qc_mapping_histogram",
    f"""with {_ENDS}, r as (select q.qname, count(m.qname) as n from (select distinct qname from aln) q left join m using (qname) group by 1), h as (select least(n, 11) as bin, count(*) as n from r group by 1)
    select cast(bin as int) as bin, coalesce(h.n, 0) as reads from (select unnest(range(12)) as bin) left join h using (bin)""",
)
def qc_mapping_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A3: reads by number of pair matches."""
    return A.mapping_histogram(alignments(spark, d), _matches(spark, d))


@R.add("qc_pair_distance", f"with {_ENDS} select count(*) as n_matches, cast(coalesce(sum(distance) // count(*), 0) as bigint) as mean_distance from m")
def qc_pair_distance(spark: SparkSession, d: str) -> DataFrame:
    """A3: integer mean of the pair distance."""
    return A.mean_pair_distance(_matches(spark, d))


@R.add(
    "qc_mapping_histogram_query",
    """with c as (select id_seq, count(*) as n from mappings where tid = mtid and isize < 500 group by 1), h as (select least(n, 11) - 1 as bin, count(*) as n from c group by 1),
    f as (select cast(bin as int) as bin, coalesce(h.n, 0) as reads from (select unnest(range(12)) as bin) left join h using (bin))
    select bin, cast(case when bin = 0 then (select count(*) from mappings) - (select sum((bin + 1) * reads) from f where bin between 1 and 10) else reads end as bigint) as reads from f""",
)
def qc_mapping_histogram_query(spark: SparkSession, d: str) -> DataFrame:
    """A4: the histogram of the mappings table."""
    return A.mapping_histogram_by_query(table(spark, d, "mappings"), 500)


@R.add(
    "mappings_per_read",
    "select id_seq, count(*) as n_rows, cast(sum(isize) as bigint) as isize_sum from mappings where tid = mtid and isize < 500 group by 1",
)
def mappings_per_read(spark: SparkSession, d: str) -> DataFrame:
    """A4: the one SELECT itself."""
    table(spark, d, "mappings").createOrReplaceTempView("mappings")
    return spark.sql("select id_seq, count(*) as n_rows, sum(isize) as isize_sum from mappings where tid = mtid and isize < 500 group by id_seq")


_BLOCKS = f"""{ALN}, o as (select ord, tid, pos, regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1) as l, regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2) as k from aln where tid >= 0),
  u as (select ord, tid, pos, unnest(range(1, len(k) + 1)) as i, l, k from o),
  blk as (select ord, tid, k[i] as op, cast(l[i] as int) as n, pos + cast(coalesce(list_sum(list_transform(range(1, i), lambda j: case when k[j] in ('M', 'D', 'N', '=', 'X') then cast(l[j] as int) else 0 end)), 0) as int) as beg from u)"""
_COVER = f"{_BLOCKS}, cov as (select tid, unnest(range(beg, beg + n)) as p from blk where op in ('M', '=', 'X')), dep as (select tid, p, count(*) as depth from cov group by all)"


@R.add("coverage", f"with {_COVER} select cast(tid + 1 as int) as chrom, cast(p + 1 as bigint) as pos, depth from dep")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Depth per base."""
    return A.coverage(alignments(spark, d).where("tid >= 0"))


@R.add("coverage_summary", f"with {_COVER} select count(*) as covered_bases, cast(sum(depth) as bigint) as depth_sum, round(sum(depth) / count(*), 6) as mean_coverage from dep")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    """Covered bases and mean depth, without a row per base."""
    return A.coverage_summary(A.coverage_runs(alignments(spark, d).where("tid >= 0")))


@R.add(
    "coverage_in_regions",
    f"""with {_COVER}, {REG} select part, count(*) as covered_bases, cast(sum(depth) as bigint) as depth_sum from dep join reg on reg.tid = dep.tid and p >= start and p < stop group by 1""",
)
def coverage_in_regions(spark: SparkSession, d: str) -> DataFrame:
    """A5: coverage clipped to regions, by joining runs instead of bases."""
    runs = A.coverage_runs(alignments(spark, d).where("tid >= 0")).withColumnRenamed("end", "upto")
    x = J.interval_join(runs, regions(spark, d), left_start="beg", left_end="upto")
    x = x.withColumn("n", F.least("upto", "stop") - F.greatest("beg", "start"))
    return x.groupBy("part").agg(F.sum("n").alias("covered_bases"), F.sum(F.col("n") * F.col("depth")).alias("depth_sum"))


_FLAGSTAT = {
    "n_reads": "true", "n_mapped": "flag & 4 = 0", "n_dup": "flag & 1024 <> 0", "n_pair_all": "flag & 1 <> 0", "n_pair_good": "flag & 3 = 3",
    "n_read1": "flag & 65 = 65", "n_read2": "flag & 129 = 129", "n_sgltn": "flag & 1 <> 0 and flag & 8 <> 0 and flag & 4 = 0", "n_pair_map": "flag & 13 = 1",
    "n_diffchr": "flag & 13 = 1 and mtid <> tid", "n_diffhigh": "flag & 13 = 1 and mtid <> tid and mapq >= 5",
}


@R.add("flagstat", f"with {ALN} select flag & 512 <> 0 as qc_failed, " + ", ".join(f"cast(sum(case when {v} then 1 else 0 end) as bigint) as {k}" for k, v in _FLAGSTAT.items()) + " from aln group by 1")
def flagstat(spark: SparkSession, d: str) -> DataFrame:
    """The flag counters."""
    return A.flagstat(alignments(spark, d))


@R.add(
    "idxstats",
    f"""with {ALN}, c as (select tid, name, len from contigs union all select -1, '*', 0), n as (select tid, cast(sum(case when flag & 4 = 0 then 1 else 0 end) as bigint) as mapped,
      cast(sum(case when flag & 4 <> 0 then 1 else 0 end) as bigint) as unmapped from aln group by 1)
    select name, cast(len as int) as len, coalesce(mapped, 0) as mapped, coalesce(unmapped, 0) as unmapped from c left join n using (tid)""",
)
def idxstats(spark: SparkSession, d: str) -> DataFrame:
    """Reads per contig."""
    return A.idxstats(alignments(spark, d), table(spark, d, "contigs"))


_DEPTH = f"""{_BLOCKS}, s as (select b.tid, a.file, b.op, unnest(range(b.beg, b.beg + b.n)) as p from blk b join aln a using (ord) where a.mapq >= 20 and b.op in ('M', 'D', 'N', '=', 'X'))"""


@R.add(
    "depth_by_file",
    f"""with {_DEPTH} select tid, cast(p + 1 as int) as pos, cast(sum(case when file = 0 and op in ('M', '=', 'X') then 1 else 0 end) as bigint) as depth_0,
      cast(sum(case when file = 1 and op in ('M', '=', 'X') then 1 else 0 end) as bigint) as depth_1 from s group by all""",
)
def depth_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Depth of two files at every position a read spans."""
    return A.depth_by_file(alignments(spark, d).where("tid >= 0"), ["0", "1"], 20)


@R.add("depth_all", f"with {_BLOCKS}, s as (select tid, unnest(range(beg, beg + n)) as p from blk where op in ('M', 'D', 'N', '=', 'X')) select tid, cast(p + 1 as int) as pos, count(*) as depth from s group by all")
def depth_all(spark: SparkSession, d: str) -> DataFrame:
    """A10: all reads spanning a position, deletions included, from runs."""
    b = alignments(spark, d).where("tid >= 0").select("tid", F.inline(C.ref_blocks("pos", "cigar", keep="MDN=X")))
    runs = A.depth_runs(b, "tid")
    return runs.select("tid", F.explode(F.sequence((F.col("beg") + 1).cast("int"), F.col("end").cast("int"))).alias("pos"), F.col("depth").cast("bigint").alias("depth"))


# --- windows, sorts, duplicates, sets -----------------------------------------------------------


@R.add(
    "merge_regions",
    f"""with {REG}, m as (select *, max(stop) over (partition by tid order by start, stop rows between unbounded preceding and 1 preceding) as pe from (select distinct tid, start, stop from reg where start < stop)),
    g as (select *, sum(case when pe is null or start > pe then 1 else 0 end) over (partition by tid order by start, stop rows unbounded preceding) as k from m)
    select tid, cast(min(start) as bigint) as start, cast(max(stop) as bigint) as stop from g group by tid, k""",
)
def merge_regions(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping and touching regions as one."""
    x = stretches_and_gaps(regions(spark, d), ["tid"], "start", "stop").where("kind = 'covered'")
    return x.select("tid", F.col("seg_start").alias("start"), F.col("seg_end").alias("stop"))


@R.add("sort_position", f"with {ALN} select ord, cast(row_number() over (order by tid < 0, tid, pos, ord) as bigint) as rank from aln")
def sort_position(spark: SparkSession, d: str) -> DataFrame:
    """O1, O3: position sort; the rank is taken without a single-task window."""
    return O.ranked(alignments(spark, d).select("ord", "tid", "pos"), O.position_order("ord")).select("ord", "rank")


@R.add("sort_by_id_reference", f"with {ALN} select ord, cast(row_number() over (order by tid < 0, tid, pos, ord) as bigint) as rank from aln")
def sort_by_id_reference(spark: SparkSession, d: str) -> DataFrame:
    """O4 as the established tool does it: by position."""
    return O.ranked(alignments(spark, d).select("ord", "tid", "pos"), O.position_order("ord")).select("ord", "rank")


@R.add("sort_name", f"with {ALN} select ord, cast(row_number() over (order by cast(substr(qname, 2) as bigint), tid, pos, ord) as bigint) as rank from aln")
def sort_name(spark: SparkSession, d: str) -> DataFrame:
    """O2: natural order of names."""
    x = O.name_keyed(alignments(spark, d).select("ord", "qname", "tid", "pos"), "qname")
    return O.ranked(x, O.name_order("qname", "ord")).select("ord", "rank")


@R.add("sort_dataset", "select map_no, cast(row_number() over (order by id_seq, map_no) as bigint) as rank from mappings where id_seq is not null")
def sort_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Byte order of ids, equal ids in arrival order."""
    x = table(spark, d, "mappings").where("id_seq is not null").select("map_no", "id_seq")
    return O.ranked(x, [F.col("id_seq").asc(), F.col("map_no").asc()]).select("map_no", "rank")


_LIB = f"{ALN}, {_RG}, l as (select aln.* replace (pos - pos % 500 as pos, isize - isize % 300 as isize), lib from aln left join rgs using (rg))"
_OUT = "(flag & 1 = 0 or flag & 12 <> 0 or (mtid >= 0 and tid <> mtid) or tid < 0)"


def _crowded(spark: SparkSession, d: str) -> DataFrame:
    """Alignments on a coarser grid, so that there are duplicates to remove."""
    x = alignments(spark, d).withColumn("pos", F.expr("pos - pos % 500")).withColumn("isize", F.expr("isize - isize % 300"))
    return x.join(_groups(spark).select("rg", "lib"), "rg", "left")


@R.add(
    "rmdup_paired",
    f"""with {_LIB}, h as (select *, row_number() over (partition by lib, tid, pos, isize order by sum_qual desc, ord) as rn from l where not {_OUT} and isize > 0),
    g as (select distinct qname, tid from h where rn > 1)
    select ord from l where {_OUT} union all select ord from h where rn = 1
    union all select ord from l where not {_OUT} and isize <= 0 and not exists (select 1 from g where g.qname = l.qname and g.tid = l.tid)""",
)
def rmdup_paired(spark: SparkSession, d: str) -> DataFrame:
    """Duplicate pairs."""
    return O.rmdup_paired(_crowded(spark, d)).select("ord")


@R.add(
    "rmdup_single",
    f"""with {_LIB}, k as (select *, row_number() over (partition by lib, tid, flag & 16, case when flag & 16 <> 0 then {END} else pos end order by sum_qual desc, ord) as rn from l where flag & 4 = 0)
    select ord from k where rn = 1 union all select ord from l where flag & 4 <> 0""",
)
def rmdup_single(spark: SparkSession, d: str) -> DataFrame:
    """Single-end duplicates, paired reads taken as single."""
    return O.rmdup_single(_crowded(spark, d), force_single=True).select("ord")


@R.add("merge_files", f"with {ALN} select ord, cast(row_number() over (order by tid < 0, tid, pos, (flag & 16) <> 0, file, ord) as bigint) as rank, 'in' || cast(file as varchar) as rg from aln")
def merge_files(spark: SparkSession, d: str) -> DataFrame:
    """Two files merged by position, with the file as read group."""
    x = alignments(spark, d).select("ord", "tid", "pos", "flag", "file")
    files = {f"in{i}": x.where(F.col("file") == i).drop("file") for i in (0, 1)}
    return O.ranked(O.merge_sorted_files(files, rg_from_name=True), O.merge_order("ord")).select("ord", "rank", "rg")


@R.add("cat_files", f"with {ALN} select ord, file from aln")
def cat_files(spark: SparkSession, d: str) -> DataFrame:
    """Concatenation, file by file."""
    x = alignments(spark, d)
    return O.merge_sorted_files({f"in{i}": x.where(F.col("file") == i).drop("file") for i in (0, 1)}).select("ord", "file")


def _multiset(name: str, spark_op: str, sql_op: str) -> None:
    @R.add(name, f"with {ALN} select tid, mapq, count(*) as n from (select tid, mapq from aln where file = 0 {sql_op} select tid, mapq from aln where file = 1) group by all")
    def run(spark: SparkSession, d: str) -> DataFrame:
        x = alignments(spark, d)
        a, b = (x.where(F.col("file") == i).select("tid", "mapq") for i in (0, 1))
        return getattr(a, spark_op)(b).groupBy("tid", "mapq").agg(F.count(F.lit(1)).alias("n"))

    run.__doc__ = f"U3: multiset {spark_op}."


_multiset("set_union_all", "unionAll", "union all")
_multiset("set_intersect_all", "intersectAll", "intersect all")
_multiset("set_except_all", "exceptAll", "except all")


@R.add(
    "unique_mapping",
    f"""with {ALN}, s as (select qname, mapq, row_number() over (partition by qname order by mapq desc, ord) as rn from aln)
    select qname, max(case when rn = 1 then mapq end) as best, max(case when rn = 2 then mapq end) as second,
      cast(max(case when rn = 1 then mapq end) - coalesce(max(case when rn = 2 then mapq end), 0) as int) as margin from s group by 1""",
)
def unique_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Best and second-best score of a read."""
    w = Window.partitionBy("qname").orderBy(F.desc("mapq"), "ord")
    x = alignments(spark, d).select("qname", "mapq", "ord").withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    best, second = (F.max(F.when(F.col("rn") == i, F.col("mapq"))) for i in (1, 2))
    return x.groupBy("qname").agg(best.alias("best"), second.alias("second"), (best - F.coalesce(second, F.lit(0))).alias("margin"))


@R.add("top_reads_per_contig", f"with {ALN}, r as (select tid, ord, mapq, row_number() over (partition by tid order by mapq desc, ord) as rn from aln) select tid, ord, mapq from r where rn <= 3")
def top_reads_per_contig(spark: SparkSession, d: str) -> DataFrame:
    """L1: the three best reads of each contig."""
    w = Window.partitionBy("tid").orderBy(F.desc("mapq"), "ord")
    return alignments(spark, d).select("tid", "ord", "mapq").withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")



@R.add(
    "pileup_counts",
    f"""with {_BLOCKS}, s as (select b.tid, b.op, unnest(range(b.beg, b.beg + b.n)) as p, b.beg, b.n, a.pos as start, {END.replace('pos', 'a.pos').replace('cigar', 'a.cigar')} as stop, a.cigar
      from blk b join aln a using (ord) where b.op in ('M', 'D', 'N', '=', 'X') and a.flag & 1796 = 0)
    select tid, cast(p as int) as pos, count(*) as n_reads, cast(sum(case when op = 'D' then 1 else 0 end) as bigint) as n_del, cast(sum(case when op = 'N' then 1 else 0 end) as bigint) as n_skip,
      cast(sum(case when p = start then 1 else 0 end) as bigint) as n_head, cast(sum(case when p = stop - 1 then 1 else 0 end) as bigint) as n_tail,
      cast(sum(case when cigar = '20M2I28M' and p = start + 19 then 2 when cigar = '30M5D20M' and p = start + 29 then -5 else 0 end) as bigint) as indel_sum from s group by all""",
)
def pileup_counts(spark: SparkSession, d: str) -> DataFrame:
    """What stands at every position, from the exploded pileup."""
    return A.pileup_counts(X.pileup_reads(alignments(spark, d).where("tid >= 0")))


@R.add(
    "pileup_rows",
    f"""with {_BLOCKS} select b.tid, count(*) as n_blocks, cast(sum(b.n) as bigint) as n_rows from blk b join aln a using (ord) where b.op in ('M', 'D', 'N', '=', 'X') and a.flag & 1796 = 0 group by 1""",
)
def pileup_rows(spark: SparkSession, d: str) -> DataFrame:
    """The exploded pileup itself, counted per contig."""
    x = A.pileup(X.pileup_reads(alignments(spark, d).where("tid >= 0")), ["ord"])
    y = x.groupBy("tid", "bin").agg(F.count(F.lit(1)).alias("n")).groupBy("tid").agg(F.sum("n").alias("n_rows"))
    blocks = A.pileup_blocks(X.pileup_reads(alignments(spark, d).where("tid >= 0")), []).groupBy("tid").agg(F.count(F.lit(1)).alias("n_blocks"))
    return blocks.join(y, "tid").select("tid", "n_blocks", "n_rows")
