"""Formats: records written in a format and read back, and conversions between them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions import cigar as C
from readloom.functions.flags import has
from readloom.operators import aggregates as A
from readloom.operators import variants as V
from readloom.plans.alignment_queries import ALN, END, ops_sql
from readloom.plans.derive import REGION_SQL, alignments, regions, sequences
from readloom.plans.registry import Registry
from readloom.plans.sequence_queries import SEQ
from readloom.plans.variant_queries import VAR, variants
from readloom.session import remember, shared_dir, table
from readloom.sources import bam, bcf, fastq, text

R = Registry()

#: the records with contig names and tags, as the text formats want them
_RECORD = """select ord, qname, flag, case when tid < 0 then '*' else 'kx' || cast(tid + 1 as string) end as rname, pos, mapq, cigar,
  case when mtid < 0 then '*' else 'kx' || cast(mtid + 1 as string) end as rnext, mpos as pnext, isize as tlen, repeat('A', {len}) as seq, repeat('I', {len}) as qual, sum_qual as nm, coalesce(rg, 'none') as rg from {aln}"""
REC = f"{ALN}, rec as ({_RECORD.format(len=ops_sql('MIS=X'), aln='aln')})"


def records(spark: SparkSession, d: str) -> DataFrame:
    x = alignments(spark, d).withColumn("__n", C.query_len("cigar"))
    x = x.selectExpr(*_select_list("__n"))
    tag = lambda kind, c: F.struct(F.lit(kind).alias("type"), F.col(c).cast("string").alias("value"))
    return x.withColumn("aux", F.create_map(F.lit("NM"), tag("i", "nm"), F.lit("RG"), tag("Z", "rg")))


def _select_list(length: str) -> list[str]:
    body = _RECORD.format(len=length, aln="").split("select ", 1)[1].rsplit(" from ", 1)[0]
    out, depth, part = [], 0, ""
    for ch in body:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


_SAM_LINE = """qname || chr(9) || flag || chr(9) || rname || chr(9) || (pos + 1) || chr(9) || mapq || chr(9) || cigar || chr(9) || case when rnext = rname and rname <> '*' then '=' else rnext end
  || chr(9) || (pnext + 1) || chr(9) || tlen || chr(9) || seq || chr(9) || qual || chr(9) || 'NM:i:' || nm || chr(9) || 'RG:Z:' || rg"""


@R.add("sam_lines", f"with {REC} select md5({_SAM_LINE}) as digest, count(*) as n from rec group by 1")
def sam_lines(spark: SparkSession, d: str) -> DataFrame:
    """Records as text, by digest."""
    x = text.format_sam(records(spark, d))
    return x.groupBy(F.md5("value").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@R.add("sam_round_trip", f"with {REC} select qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, cast(length(seq) as int) as n_seq, cast(nm as varchar) as nm, rg, count(*) as n from rec group by all")
def sam_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as text and parsed again."""
    x = text.read_sam(spark, text.format_sam(records(spark, d)), "failfast").where("valid")
    x = x.select("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", F.length("seq").alias("n_seq"), F.col("aux")["NM"]["value"].alias("nm"), F.col("aux")["RG"]["value"].alias("rg"))
    return x.groupBy(*x.columns).agg(F.count(F.lit(1)).alias("n"))


def _folder(spark: SparkSession, kind: str) -> str:
    return remember(spark, f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")


def _contigs(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    return [(f"kx{r['tid'] + 1}", r["len"]) for r in table(spark, d, "contigs").orderBy("tid").collect()]


def _written(spark: SparkSession, d: str) -> tuple[str, list[str]]:
    """The records as text, parsed, in binary files; the folder and the names of the contigs."""
    bam.register(spark)
    contigs, place = _contigs(spark, d), _folder(spark, "bam")
    x = bam.of_records(text.read_sam(spark, text.format_sam(records(spark, d))), [n for n, _ in contigs])
    x.write.format("bam").option("contigs", ",".join(f"{n}:{k}" for n, k in contigs)).mode("append").save(place)
    return place, [n for n, _ in contigs]


@R.add("bam_round_trip", f"with {REC} select md5({_SAM_LINE}) as digest, count(*) as n from rec group by 1")
def bam_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Text to binary and back to text, with bases, qualities and tags, the binary files read in small ranges."""
    place, names = _written(spark, d)
    y = bam.to_records(spark.read.format("bam").option("splitbytes", str(1 << 20)).load(place), names)
    return text.format_sam(y).groupBy(F.md5("value").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@R.add("reheader", f"with {ALN} select case when tid < 0 then '*' else 'new' || tid end as rname, count(*) as n from aln group by 1")
def reheader(spark: SparkSession, d: str) -> DataFrame:
    """The binary files with another header, blocks copied as they are."""
    place, names = _written(spark, d)
    fresh, target = [f"new{i}" for i in range(len(names))], _folder(spark, "bam")
    paths = [r["path"] for r in bam.reheader(spark, place, target, "@CO\tnew\n", [(n, 1000) for n in fresh]).collect()]
    known = [n for n, _ in bam.read_bam_header(paths[0])[1]]
    return bam.to_records(spark.read.format("bam").load(target), known).groupBy("rname").agg(F.count(F.lit(1)).alias("n"))


@R.add("bcf_round_trip", f"with {VAR} select vid, tid, pos, ref, case when alt = 'X' then '' else alt end as alt, cast(qual as double) as qual, 'DP=' || dp as info, cast(case when alt = 'X' then 7 else 28 + dp % 3 end as int) as pl_sum, cast(dp + 1 as int) as dp_last from var")
def bcf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Variants with likelihoods and depths of two samples written to binary files and read again."""
    bcf.register(spark)
    place = _folder(spark, "bcf")
    alt = F.when(F.col("alt") == "X", "").otherwise(F.col("alt"))
    pl = F.when(alt == "", F.array(F.lit(3), F.lit(4))).otherwise(F.array(F.lit(0), F.lit(9), F.lit(10), F.lit(9), F.lit(0), F.col("dp") % 3))
    x = variants(spark, d).select(
        "tid", "pos", F.col("vid").cast("string").alias("id"), "ref", alt.alias("alt"), F.col("qual").cast("float").alias("qual"), F.lit("PASS").alias("filter"), F.concat(F.lit("DP="), F.col("dp").cast("string")).alias("info"),
        F.lit("PL:DP").alias("format"), pl.cast("array<int>").alias("pl"), *[F.lit(None).cast("array<int>").alias(c) for c in ("gt", "gq")], F.array("dp", F.col("dp") + 1).alias("dp"), F.lit(None).cast("array<int>").alias("sp"),
    )
    x.write.format("bcf").option("contigs", ",".join(f"c{i}" for i in range(25))).option("samples", "s1,s2").mode("append").save(place)
    y = spark.read.format("bcf").load(place)
    return y.select(F.col("id").cast("bigint").alias("vid"), "tid", "pos", "ref", "alt", F.col("qual").cast("double").alias("qual"), "info", F.aggregate("pl", F.lit(0), lambda a, v: a + v).alias("pl_sum"), F.get("dp", 1).alias("dp_last"))


@R.add("fastq_files", f"with {REC} select qname || '#' || ord as name, md5(seq || ' ' || qual) as digest from rec")
def fastq_files(spark: SparkSession, d: str) -> DataFrame:
    """Reads in four-line files, read again in ranges far smaller than the files."""
    place = _folder(spark, "fastq")
    x = records(spark, d).select(F.concat(F.lit("@"), "qname", F.lit("#"), F.col("ord").cast("string"), F.lit(" more\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))
    x.repartition(3).write.text(place)
    y = fastq.read_fastq(spark, place, split=1 << 18)
    return y.select("name", F.md5(F.concat("seq", F.lit(" "), "qual")).alias("digest"))


@R.add("sam_header", "select name, cast(len as int) as len from contigs")
def sam_header(spark: SparkSession, d: str) -> DataFrame:
    """Header lines of the contigs, parsed."""
    lines = table(spark, d, "contigs").select(F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "name"), F.concat(F.lit("LN:"), F.col("len").cast("string"))).alias("value"))
    return text.contigs_of(text.read_sam_header(spark, lines))


@R.add("bed_lines", f"with reg as ({REGION_SQL}) select 'c' || cast(tid as varchar) as chrom, start, stop, count(*) as n from reg where stop > start group by all")
def bed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Region lines, parsed."""
    lines = regions(spark, d).select(F.concat_ws("\t", F.concat(F.lit("c"), F.col("tid").cast("string")), F.col("start").cast("string"), F.col("stop").cast("string")).alias("value"))
    return text.read_regions(spark, lines).groupBy("chrom", "start", "stop").agg(F.count(F.lit(1)).alias("n"))


@R.add("gff_lines", f"with reg as ({REGION_SQL}) select cast(tid as int) as chrom, cast(start - 1 as int) as start, cast(stop - 1 as int) as \"end\", count(*) as n from reg group by all")
def gff_lines(spark: SparkSession, d: str) -> DataFrame:
    """Annotation lines, parsed to 0-based closed regions."""
    f = [F.concat(F.lit("chr"), F.col("tid").cast("string")), F.lit("src"), F.lit("exon"), F.col("start").cast("string"), F.col("stop").cast("string"), *[F.lit(".")] * 3, F.lit("g")]
    lines = regions(spark, d).select(F.concat_ws("\t", *f).alias("value"))
    return text.read_gff(spark, lines).groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("n"))


@R.add("dataset_lines", f"with {ALN} select qname as seq_id, cast(tid as smallint) as chromosome, pos as start, {END} as \"end\", cast(case when flag & 16 <> 0 then 1 else 0 end as smallint) as strand, cast({ops_sql('IDX')} as smallint) as num_errors, cast({ops_sql('ID')} as smallint) as num_indels, count(*) as n from aln group by all")
def dataset_lines(spark: SparkSession, d: str) -> DataFrame:
    """Dataset lines written and read."""
    x = alignments(spark, d).select(
        F.col("qname").alias("seq_id"), F.col("tid").alias("chromosome"), F.col("pos").alias("start"), C.end_pos("pos", "cigar").alias("end"), has("flag", 16).cast("int").alias("strand"),
        C.mismatches("cigar").alias("num_errors"), C.op_sum("cigar", "ID").alias("num_indels"),
    )
    y = text.read_dataset(spark, text.format_dataset(x))
    return y.groupBy(*y.columns).agg(F.count(F.lit(1)).alias("n"))


@R.add("vcf_lines", f"with {VAR} select 'c' || cast(tid as varchar) as chrom, pos, ref, alt, cast(qual as double) as qual, cast(dp as varchar) as dp, {'(length(ref) > 1)'} as long_ref, vid from var")
def vcf_lines(spark: SparkSession, d: str) -> DataFrame:
    """Variant lines, parsed with their INFO."""
    info = F.concat(F.lit("DP="), F.col("dp").cast("string"), F.lit(";VID="), F.col("vid").cast("string"), F.when(F.length("ref") > 1, ";LONG").otherwise(""))
    f = [F.concat(F.lit("c"), F.col("tid").cast("string")), (F.col("pos") + 1).cast("string"), F.lit("."), F.col("ref"), F.col("alt"), F.col("qual").cast("string"), F.lit("PASS"), info]
    y = text.read_vcf(spark, variants(spark, d).select(F.concat_ws("\t", *f).alias("value")))
    return y.select(
        "chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), "qual", F.col("info")["DP"].alias("dp"), F.map_contains_key("info", "LONG").alias("long_ref"), F.col("info")["VID"].cast("bigint").alias("vid")
    )


@R.add(
    "fastq_records",
    f"""with {REC} select qname || case when flag & 192 = 64 then '/1' when flag & 192 = 128 then '/2' else '' end as name,
      case when flag & 16 <> 0 then repeat('T', length(seq)) else seq end as seq, qual, count(*) as n from rec group by all""",
)
def fastq_records(spark: SparkSession, d: str) -> DataFrame:
    """Reads as they came from the machine."""
    y = text.to_fastq(records(spark, d))
    return y.groupBy(*y.columns).agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "bed_of_reads",
    f"""with {REC}, b as (select rname || chr(9) || pos || chr(9) || (pos + {ops_sql('MDN')}) || chr(9) || qname || chr(9) || mapq || chr(9) || case when flag & 16 <> 0 then '-' else '+' end as value from rec where flag & 4 = 0)
    select value, count(*) as n from b group by 1""",
)
def bed_of_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads as region lines."""
    return text.to_bed(records(spark, d)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "interpolated_depth",
    f"""with {ALN}, s as (select qname, tid, min(pos) as b, max({END}) as e from aln where tid >= 0 and flag & 4 = 0 group by all having max({END}) - min(pos) <= 2000),
    c as (select tid, unnest(range(b, e)) as p from s) select tid, cast(p as int) as pos, count(*) as depth from c group by all""",
)
def interpolated_depth(spark: SparkSession, d: str) -> DataFrame:
    """Depth between all reads of a name, without names that span more than 2,000 bases of a contig; ``interpolated_runs`` has no such limit."""
    x = alignments(spark, d).where("tid >= 0 and flag & 4 = 0").groupBy("qname", "tid").agg(F.min("pos").alias("beg"), F.max(C.end_pos("pos", "cigar")).alias("end"))
    runs = A.depth_runs(x.where("`end` - beg <= 2000"), "tid")
    return runs.select("tid", F.explode(F.sequence(F.col("beg").cast("int"), F.col("end").cast("int") - 1)).alias("pos"), "depth")


@R.add(
    "interpolated_runs",
    f"""with {ALN}, x as (select qname, tid, flag, pos as b, {END} as e, flag & 3 = 3 and flag & 192 in (64, 128) as mate from aln where tid >= 0 and flag & 4 = 0),
    m as (select qname, tid, b, e, row_number() over (partition by qname, tid, flag & 64 order by b, e) as i from x where mate),
    s as (select tid, b, e from x where not mate union all select tid, min(b), max(e) from m group by qname, tid, i),
    v as (select tid, b as p, 1 as n from s union all select tid, e, -1 from s union all select tid, unnest(range(0, max(e), 1048576)), 0 from s group by tid),
    g as (select tid, p, sum(n) as n from v group by all having sum(n) <> 0 or p % 1048576 = 0),
    r as (select tid, p as beg, lead(p) over o as "end", sum(n) over (o rows unbounded preceding) as depth from g window o as (partition by tid order by p))
    select tid, cast(beg as bigint) as beg, cast("end" as bigint) as "end", cast(depth as bigint) as depth from r where depth <> 0""",
)
def interpolated_runs(spark: SparkSession, d: str) -> DataFrame:
    """Depth that counts what lies between proper mates, however far apart, and every other read once, as runs cut at multiples of 2^20."""
    return A.depth_runs(A.interpolated_blocks(alignments(spark, d)), "tid")


_NAMED = "concat('kx', cast(tid as string), '_', cast(pos + 1 + cast(mapq % 9 as int) as string), '_', cast(mpos as string), '_', cast(ord as string))"


@R.add(
    "evaluation_by_quality",
    f"""with {ALN}, x as (select mapq // 10 as decile, ord % 13 <> 0 and mapq % 9 <= 5 as right_ from aln where tid >= 0), q as (select decile, count(*) as n, count(*) filter (not right_) as w from x group by 1)
    select cast(decile as int) as decile, cast(sum(n) over o as bigint) as n_reads, cast(sum(w) over o as bigint) as n_wrong from q window o as (order by decile desc rows unbounded preceding)""",
)
def evaluation_by_quality(spark: SparkSession, d: str) -> DataFrame:
    """Wrong mappings at least as confident as each decile, against the places in the names of simulated reads."""
    x = alignments(spark, d).where("tid >= 0")
    return V.true_place_errors(x.selectExpr(f"{_NAMED} as qname", "concat('kx', cast(case when ord % 13 = 0 then tid + 1 else tid end as string)) as rname", "pos", "mapq"))


@R.add(
    "variant_annotation",
    f"""with {VAR} select vid, length(ref) > 1 or (alt <> 'X' and length(alt) > 1) as indel, ref || alt in ('AG', 'GA', 'CT', 'TC') as transition, case when alt = 'X' then '' else alt end as alt_kept,
      'DP=' || dp || ';QS=' || qual as info from var""",
)
def variant_annotation(spark: SparkSession, d: str) -> DataFrame:
    """Alleles dropped, INFO appended, classes of a variant."""
    info = F.map_concat(F.create_map(F.lit("DP"), F.col("dp").cast("string")), F.create_map(F.lit("QS"), F.col("qual").cast("string")))
    joined = F.array_join(F.transform(F.array_sort(F.map_entries(info)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return variants(spark, d).select(
        "vid", V.is_indel("ref", "alt").alias("indel"), V.is_transition("ref", "alt").alias("transition"), F.when(F.col("alt") == "X", "").otherwise(F.col("alt")).alias("alt_kept"), joined.alias("info")
    )
