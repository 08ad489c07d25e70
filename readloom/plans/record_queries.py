"""Queries over region strings, tags, headers, indexes, other programs' lines and output modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions import tags as T
from readloom.functions.cigar import end_pos
from readloom.functions.regions import region
from readloom.operators import aggregates as A
from readloom.operators import index as I
from readloom.operators import joins as J
from readloom.plans.alignment_queries import _BIN_SQL, ALN, END, ops_sql
from readloom.plans.derive import REGION_SQL, SEQ_SQL, alignments, regions, sequences
from readloom.plans.registry import Registry
from readloom.plans.variant_queries import VAR, variants
from readloom.sources import converters as C
from readloom.sources import text
from readloom.session import table

R = Registry()

# --- region strings, tags, headers --------------------------------------------------------------

_FORMS = "case cast(part % 4 as int) when 0 then concat('c', cast(tid as string), ':', cast(start + 1 as string), '-', cast(stop as string)) when 1 then concat('c', cast(tid as string), ':', cast(start + 1 as string)) when 2 then concat('HLA:c', cast(tid as string)) else concat('c', cast(tid as string), ':', cast((start div 1000) + 1 as string), ',000 - ', cast(stop + 2000 as string)) end"


@R.add(
    "region_strings",
    f"""with reg as ({REGION_SQL}) select part, case cast(part % 4 as int) when 2 then 'HLA:c' else 'c' end || tid as name,
      cast(case cast(part % 4 as int) when 2 then 0 when 3 then (start // 1000 + 1) * 1000 - 1 else start end as bigint) as beg, cast(case cast(part % 4 as int) when 0 then stop when 3 then stop + 2000 else 536870912 end as bigint) as "end" from reg""",
)
def region_strings(spark: SparkSession, d: str) -> DataFrame:
    """Region strings with and without ends, with separators and blanks, and names that hold a colon."""
    x = regions(spark, d).withColumn("text", F.expr(_FORMS)).select("part", region("text").alias("r"))
    return x.select("part", "r.name", "r.beg", "r.end")


@R.add("tag_functions", f"with {ALN} select ord, cast(sum_qual as bigint) as nm, rg, rg is not null as has_rg, cast(1 + case when rg is not null then 1 else 0 end as int) as n_tags, cast(sum_qual + 1 as bigint) as nm_next, cast(0 as int) as left_over, cast(mapq as double) / 2 as xf, cast(0 as bigint) as missing from aln")
def tag_functions(spark: SparkSession, d: str) -> DataFrame:
    """Tags got by type, dropped, appended, and all but one dropped."""
    empty = F.create_map().cast("map<string,struct<type:string,value:string>>")
    aux = T.put_tag(T.put_tag(empty, "NM", "i", F.col("sum_qual")), "RG", "Z", F.col("rg"))
    x = alignments(spark, d).withColumn("aux", aux).withColumn("more", T.put_tag(T.put_tag("aux", "NM", "i", T.tag_int("aux", "NM") + 1), "XF", "f", F.col("mapq") / 2.0))
    return x.select(
        "ord", T.tag_int("aux", "NM").alias("nm"), T.tag("aux", "RG").alias("rg"), T.has_tag("aux", "RG").alias("has_rg"), F.size("aux").alias("n_tags"), T.tag_int("more", "NM").alias("nm_next"),
        F.size(T.drop_tags(T.keep_only("aux", "NM"), "NM")).alias("left_over"), T.tag_float("more", "XF").alias("xf"), T.tag_int("aux", "RG").alias("missing"),
    )


def _header(spark: SparkSession, d: str, which: int) -> DataFrame:
    """A header of two: contigs 0, 1 of three each, the length of every tenth differs, and a group without ID."""
    c = table(spark, d, "contigs").where(F.col("tid") % 3 != 2 - which)
    length = F.when((F.lit(which) == 1) & (F.col("tid") % 10 == 0), F.col("len") + 1).otherwise(F.col("len")).cast("string")
    sq = c.select(F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "name"), F.concat(F.lit("LN:"), length)).alias("value"))
    rest = spark.createDataFrame([("@HD\tVN:1.0",), ("@RG\tSM:s",), ("@RG\tID:g1\tSM:s\tQQ:x",), ("@CO\tfree text",)], "value string")
    return text.read_sam_header(spark, sq.unionByName(rest))


@R.add(
    "header_merge",
    """with a as (select 'SQ' as kind, name, 'SN:' || name || chr(9) || 'LN:' || len as line, tid from contigs where tid % 3 <> 2),
    b as (select 'SQ' as kind, name, 'SN:' || name || chr(9) || 'LN:' || case when tid % 10 = 0 then len + 1 else len end as line, tid from contigs where tid % 3 <> 1),
    u as (select kind, name, line from a union select kind, name, line from b)
    select kind, name, '@SQ' || chr(9) || line as line, count(*) over (partition by name) > 1 as conflict from u""",
)
def header_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two headers merged, with the lines that contradict each other."""
    return text.merge_headers(_header(spark, d, 0), _header(spark, d, 1)).where("kind = 'SQ'")


@R.add("header_validation", "select * from (values ('RG', 'SM:s', 'ID', ''), ('RG', 'ID:g1' || chr(9) || 'SM:s' || chr(9) || 'QQ:x', '', 'QQ')) v(kind, rest, missing, unknown)")
def header_validation(spark: SparkSession, d: str) -> DataFrame:
    """Header lines without a tag they need or with one they may not have."""
    x = text.validate_header(_header(spark, d, 0)).where("missing <> '' or unknown <> ''")
    return x.select("kind", F.expr("substring(line, 5, length(line))").alias("rest"), "missing", "unknown")


@R.add("contig_list", "select name, cast(len as int) as len from contigs")
def contig_list(spark: SparkSession, d: str) -> DataFrame:
    """Contigs from the lines of a sequence index instead of a header."""
    lines = table(spark, d, "contigs").select(F.concat_ws("\t", "name", F.col("len").cast("string"), F.lit("0"), F.lit("60"), F.lit("61")).alias("value"))
    return text.read_contig_list(spark, lines)


_HEX = "concat('0x', lower(hex(flag)))"
_LETTERS = "concat(" + ", ".join(f"case when (flag & {1 << i}) <> 0 then '{c}' else '' end" for i, c in enumerate(text.FLAG_LETTERS)) + ")"


@R.add("flag_styles", f"with {ALN} select distinct flag, '0x' || lower(to_hex(flag)) as hex, {_LETTERS.replace('concat(', '(').replace(', case', ' || case')} as letters, true as same from aln")
def flag_styles(spark: SparkSession, d: str) -> DataFrame:
    """Flags written in hexadecimal and in letters, and read back."""
    x = alignments(spark, d).select("flag").distinct()
    x = x.select("flag", text.flag_text("flag", "hex").alias("hex"), text.flag_text("flag", "letters").alias("letters"))
    back = [text.flag_of(F.col(c)) == F.col("flag") for c in ("hex", "letters")]
    return x.withColumn("same", back[0] & (back[1] | (F.col("letters") == "")))


@R.add(
    "flagstat_shares",
    f"""with {ALN}, f as (select flag & 512 <> 0 as qc_failed, count(*) as n, count(*) filter (flag & 4 = 0) as m, count(*) filter (flag & 1 <> 0) as p, count(*) filter (flag & 3 = 3) as g, count(*) filter (flag & 13 = 9) as s from aln group by 1)
    select qc_failed, round(100.0 * m / n, 2) as mapped_pct, round(100.0 * g / p, 2) as proper_pct, round(100.0 * s / p, 2) as singleton_pct from f""",
)
def flagstat_shares(spark: SparkSession, d: str) -> DataFrame:
    """The percentages."""
    return A.flagstat_shares(A.flagstat(alignments(spark, d)))


# --- indexes ------------------------------------------------------------------------------------

_RANKED = f"x as (select tid, pos, {END} as e, row_number() over (order by tid < 0, tid, pos, ord) as rank from aln)"


@R.add("index_linear", f"with {ALN}, {_RANKED}, w as (select tid, unnest(range(pos >> 14, ((e - 1) >> 14) + 1)) as win, rank from x where tid >= 0) select cast(tid as int) as tid, cast(win as int) as win, min(rank) as first_rank from w group by all")
def index_linear(spark: SparkSession, d: str) -> DataFrame:
    """The linear index: the first record of the sorted file that reaches into each window of 16 kb."""
    return I.linear_index(I.placed(alignments(spark, d)))


@R.add("index_chunks", f"with {ALN}, {_RANKED}, y as (select tid, pos >> 14 as b, (e - 1) >> 14 as e, rank from x where tid >= 0) select tid, cast({_BIN_SQL} as int) as bin, min(rank) as first_rank, max(rank) as last_rank, count(*) as n_reads from y group by all")
def index_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The binning index: the records of each bin lie between two places of the sorted file."""
    return I.bin_index(I.placed(alignments(spark, d)))


@R.add("index_sorted", f"with {ALN}, x as (select tid < 0 as un, tid, pos, lag(tid < 0) over w as pu, lag(tid) over w as pt, lag(pos) over w as pp from aln window w as (order by ord)) select count(*) filter (pt is not null and (un < pu or (un = pu and (tid < pt or (tid = pt and pos < pp))))) as n_unsorted from x")
def index_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Records that stand before an earlier place, in arrival order; an index needs none."""
    return I.out_of_order(alignments(spark, d), "ord")


@R.add(
    "sequence_index",
    f"""with s as ({SEQ_SQL}), l as (select doc_id, length(seq) as len, length('>' || doc_id) + 1 as head from s), b as (select *, len + (len + 59) // 60 as body from l)
    select cast(doc_id as varchar) as name, cast(len as bigint) as len, cast(coalesce(sum(head + body) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) + head as bigint) as "offset", cast(60 as int) as line_bases, cast(61 as int) as line_width from b""",
)
def sequence_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of the sequences as a file with lines of 60 bases: where each begins."""
    return I.sequence_index(sequences(spark, d).select(F.col("doc_id").cast("string").alias("name"), "seq", F.col("doc_id").alias("ord")), "ord")


@R.add(
    "sequence_at",
    f"""with s as ({SEQ_SQL}), i as (select doc_id, seq, cast(doc_id % 40 + 1 as int) as b, cast(doc_id % 40 + 90 as int) as e from s)
    select doc_id, md5(substr(seq, b, e - b + 1)) as digest from i where b <= length(seq)""",
)
def sequence_at(spark: SparkSession, d: str) -> DataFrame:
    """Bases of region strings from the sequences they name."""
    asked = sequences(spark, d).select(F.concat(F.col("doc_id").cast("string"), F.lit(":"), (F.col("doc_id") % 40 + 1).cast("string"), F.lit("-"), (F.col("doc_id") % 40 + 90).cast("string")).alias("text"))
    x = I.fetch(sequences(spark, d).select(F.col("doc_id").cast("string").alias("name"), "seq"), asked.select(region("text").alias("r")).select("r.*"))
    return x.select(F.col("name").cast("bigint").alias("doc_id"), F.md5("bases").alias("digest"))


@R.add(
    "sequence_by_bed",
    f"""with s as ({SEQ_SQL}), b as (select doc_id, seq, unnest([0, 7, 100]) as b, unnest([5, 60, 250]) as e from s)
    select doc_id, cast(b as int) as beg, md5(substr(seq, b + 1, least(e, length(seq)) - b)) as digest from b where b < length(seq)""",
)
def sequence_by_bed(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of a region list, cut at the sequence's end; regions beyond it give nothing."""
    bed = sequences(spark, d).select(F.col("doc_id").alias("name"), F.explode(F.array(*[F.struct(F.lit(b).alias("beg"), F.lit(e).alias("end")) for b, e in ((0, 5), (7, 60), (100, 250))])).alias("r")).select("name", "r.*")
    x = I.fetch(sequences(spark, d).select(F.col("doc_id").alias("name"), "seq"), bed)
    return x.select(F.col("name").alias("doc_id"), F.col("beg").cast("int").alias("beg"), F.md5("bases").alias("digest"))


@R.add("file_digest", f"with s as ({SEQ_SQL}) select count(*) as n, md5(string_agg(md5(seq), '' order by doc_id)) as ordered from s")
def file_digest(spark: SparkSession, d: str) -> DataFrame:
    """A digest of all sequences in their order; ``A.unordered_digest`` does not depend on it."""
    x = sequences(spark, d).select("doc_id", F.md5(F.upper("seq")).alias("m"))
    return I.ordered_digest(x, "doc_id", "m")


@R.add("unordered_digest", f"""with s as ({SEQ_SQL}), m as (select md5(seq) as m from s) select lower(to_hex(bit_xor(cast('0x' || m[1:15] as bigint)))) as x0, lower(to_hex(bit_xor(cast('0x' || m[16:30] as bigint)))) as x1 from m""")
def unordered_digest(spark: SparkSession, d: str) -> DataFrame:
    """The digests of all sequences put together by exclusive or, whatever their order."""
    return I.unordered_digest(sequences(spark, d).select(F.md5(F.upper("seq")).alias("m")), "m")


# --- sets, levels, neighbours -------------------------------------------------------------------


@R.add("set_symmetric_difference", f"with {ALN}, a as (select tid, mapq, count(*) filter (file = 0) - count(*) filter (file = 1) as n from aln group by all) select tid, mapq, abs(n) as n from a where n <> 0")
def set_symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    """Multiset symmetric difference."""
    x = alignments(spark, d)
    a, b = (x.where(F.col("file") == i).select("tid", "mapq") for i in (0, 1))
    return a.exceptAll(b).unionAll(b.exceptAll(a)).groupBy("tid", "mapq").agg(F.count(F.lit(1)).alias("n"))


@R.add("display_levels")
def display_levels(spark: SparkSession, d: str) -> DataFrame:
    """The display row of every read: the lowest one that is free at its start."""
    x = alignments(spark, d).where("tid >= 0").select("ord", "tid", F.col("pos").alias("beg"), end_pos("pos", "cigar").alias("end"))
    return I.display_levels(x, "ord")


@R.add(
    "dense_variants",
    f"""with {VAR} select vid from var x where (select count(*) from var y where y.tid = x.tid and y.pos between x.pos - 10 and x.pos + 10 and length(y.ref) = 1 and (y.alt = 'X' or length(y.alt) = 1)) > 2
      and length(ref) = 1 and (alt = 'X' or length(alt) = 1)""",
)
def dense_variants(spark: SparkSession, d: str) -> DataFrame:
    """Single-base variants with more than two of them within ten bases of either side."""
    x = variants(spark, d).where((F.length("ref") == 1) & ((F.col("alt") == "X") | (F.length("alt") == 1)))
    return I.within_reach(x, "tid", "pos", 10).where("n_near > 2").select("vid")


# --- other programs' lines ----------------------------------------------------------------------

_COUNTED = lambda x: x.groupBy(*x.columns).agg(F.count(F.lit(1)).alias("n"))


@R.add("bowtie_lines", f"with {ALN} select qname, cast(case when flag & 16 <> 0 then 16 else 0 end + case when ord % 3 = 1 then 65 else 0 end as int) as flag, 'c' || tid as rname, pos, cast(case when mapq % 2 = 0 then 25 else 0 end as int) as mapq, '8M' as cigar, cast(mapq % 3 as int) as nm, count(*) as n from aln group by all")
def bowtie_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of one aligner as records."""
    f = ["concat(qname, case when ord % 3 = 1 then '/1' else '' end)", "case when flag & 16 <> 0 then '-' else '+' end", "concat('c', cast(tid as string))", "cast(pos as string)", "'ACGTACGT'", "'IIIIIIII'", "cast(mapq % 2 as string)", "case mapq % 3 when 0 then '' when 1 then '3:A>C' else '3:A>C,5:G>T' end"]
    return _COUNTED(C.from_bowtie(alignments(spark, d).selectExpr(f"concat_ws('\t', {', '.join(f)}) as value")).drop("seq", "qual"))


@R.add("soap_lines", f"with {ALN} select qname, cast(case when flag & 16 <> 0 then 16 else 0 end + case when ord % 2 = 1 then 64 else 128 end as int) as flag, 'c' || tid as rname, pos, cast(case when mapq % 2 = 1 then 30 else 0 end as int) as mapq, '8M' as cigar, cast(mapq % 3 as int) as nm, count(*) as n from aln group by all")
def soap_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of another aligner as records."""
    f = ["qname", "'ACGTACGT'", "'IIIIIIII'", "cast(mapq % 2 as string)", "case when ord % 2 = 1 then 'a' else 'b' end", "'8'", "case when flag & 16 <> 0 then '-' else '+' end", "concat('c', cast(tid as string))", "cast(pos + 1 as string)", "cast(mapq % 3 as string)"]
    return _COUNTED(C.from_soap(alignments(spark, d).selectExpr(f"concat_ws('\t', {', '.join(f)}) as value")).drop("seq", "qual"))


@R.add("psl_lines", f"with {ALN} select qname, cast(case when flag & 16 <> 0 then 16 else 0 end as int) as flag, 'c' || tid as rname, pos, case mapq % 3 when 0 then '5H45M' when 1 then '20M2I28M' else '30M7D20M' end as cigar, count(*) as n from aln group by all")
def psl_lines(spark: SparkSession, d: str) -> DataFrame:
    """Block alignments as records."""
    strand = "case when flag & 16 <> 0 then '-' else '+' end"
    blocks = "case mapq % 3 when 0 then concat('45,\t5,\t', cast(pos as string), ',') when 1 then concat('20,28,\t0,22,\t', cast(pos as string), ',', cast(pos + 20 as string), ',') else concat('30,20,\t0,30,\t', cast(pos as string), ',', cast(pos + 37 as string), ',') end"
    line = f"concat_ws('\t', '48', '1', '0', '0', '0', '0', '0', '0', {strand}, qname, '50', '0', '50', concat('c', cast(tid as string)), '1000000', cast(pos as string), '0', '2', {blocks}) as value"
    return _COUNTED(C.from_psl(alignments(spark, d).selectExpr(line)).select("qname", "flag", "rname", "pos", "cigar"))


@R.add("novo_lines", f"with {ALN} select qname, cast(case when flag & 4 <> 0 then 4 when flag & 16 <> 0 then 16 else 0 end + case when ord % 2 = 1 then 65 else 129 end as int) as flag, case when flag & 4 <> 0 then '*' else 'c' || tid end as rname, cast(case when flag & 4 <> 0 then -1 else pos end as int) as pos, cast(case when flag & 4 <> 0 then 0 else mapq end as int) as mapq, case when flag & 20 = 16 then 'GGTTT' else 'AAACC' end as seq, count(*) as n from aln group by all")
def novo_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a third aligner as records, reverse reads turned round."""
    f = ["concat('@', qname)", "case when ord % 2 = 1 then 'L' else 'R' end", "'AAACC'", "'IIIHH'", "case when flag & 4 <> 0 then 'NM' else 'U' end", "'9'", "cast(mapq as string)", "concat('>c', cast(tid as string))", "cast(pos + 1 as string)", "case when flag & 16 <> 0 then 'R' else 'F' end"]
    return _COUNTED(C.from_novo(alignments(spark, d).selectExpr(f"concat_ws('\t', {', '.join(f)}) as value")).drop("qual", "cigar", "nm"))


@R.add("archive_read_groups", "select '@RG' || chr(9) || 'ID:R' || s_suppkey || chr(9) || 'SM:al' || (s_nationkey % 5) || chr(9) || 'LB:lib' || s_nationkey as value, count(*) as n from supplier group by 1")
def archive_read_groups(spark: SparkSession, d: str) -> DataFrame:
    """Read groups of archive records."""
    s = table(spark, d, "supplier")
    runs = s.selectExpr("""concat('<RUN_SET><RUN alias="x" accession="R', cast(s_suppkey as string), '">\n<EXPERIMENT_REF accession="E', cast(s_nationkey as string), '"/></RUN></RUN_SET>') as value""")
    exps = s.select("s_nationkey").distinct().selectExpr("""concat('<EXPERIMENT accession="E', cast(s_nationkey as string), '"><SAMPLE_DESCRIPTOR refname="S', cast(s_nationkey % 5 as string), '"/><LIBRARY_NAME> lib', cast(s_nationkey as string), '\n</LIBRARY_NAME></EXPERIMENT>') as value""")
    samples = s.selectExpr("s_nationkey % 5 as k").distinct().selectExpr("""concat('<SAMPLE alias="al', cast(k as string), '" accession="S', cast(k as string), '"></SAMPLE>') as value""")
    return _COUNTED(C.read_groups(runs, exps, samples))


@R.add(
    "hapmap_variants",
    """with g as (select o_orderkey as k, o_orderkey % 7 as m, case when o_orderkey % 5 = 0 then 'A/CC' when o_orderkey % 2 = 0 then 'A/C' else 'G/A' end as alleles from orders where o_orderkey % 11 <> 0),
    s as (select *, case when m = 6 then 'T' else 'A' end as ref from g where length(alleles) = 3 and m <> 5), a as (select *, case when alleles = 'A/C' then 'C' else 'G' end as alt from s where ref = 'A')
    select 'c' || (k % 20) as chrom, k * 3 as pos, 'rs' || k as id, ref, alt, case when m = 1 then '1/0' else '0/1' end || ',./.,0/0' as gt from a""",
)
def hapmap_variants(spark: SparkSession, d: str) -> DataFrame:
    """Genotype rows at the places of known sites."""
    o = table(spark, d, "orders").selectExpr("o_orderkey as k", "o_orderkey % 7 as m", "case when o_orderkey % 5 = 0 then 'A/CC' when o_orderkey % 2 = 0 then 'A/C' else 'G/A' end as alleles")
    b = "case when alleles = 'G/A' then 'G' else 'C' end"
    geno = o.selectExpr("concat('rs', cast(k as string)) as rs", "alleles", f"array(case when m = 5 then 'TA' when m = 1 then concat({b}, 'A') else concat('A', {b}) end, 'NN', 'AA') as calls")
    places = o.where("k % 11 <> 0").selectExpr("concat('rs', cast(k as string)) as rs", "concat('c', cast(k % 20 as string)) as chrom", "k * 3 as pos", "case when m = 6 then 'T' else 'A' end as ref")
    return C.from_hapmap(geno, places).withColumn("gt", F.array_join("gt", ","))


_NATION = "n_nationkey, n_name"
_MODES = {
    "list": "n_nationkey || '|' || n_name", "tabs": "n_nationkey || chr(9) || n_name", "csv": "n_nationkey || ',' || case when contains(n_name, ' ') then '\"' || n_name || '\"' else n_name end",
    "line": "'n_nationkey = ' || n_nationkey || chr(10) || '     n_name = ' || n_name", "column": "rtrim(rpad(cast(n_nationkey as varchar), 10, ' ') || '  ' || rpad(n_name, 10, ' '))",
    "html": "'<TR><TD>' || n_nationkey || '</TD>' || chr(10) || '<TD>' || n_name || '</TD>' || chr(10) || '</TR>'", "insert": "'INSERT INTO t VALUES(' || n_nationkey || ',''' || n_name || ''');'",
    "tcl": "'\"' || n_nationkey || '\" \"' || n_name || '\"'", "json": "'{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}'",
}


@R.add("output_modes", " union all ".join(f"select '{m}' as mode, {v} as value from nation" for m, v in _MODES.items()))
def output_modes(spark: SparkSession, d: str) -> DataFrame:
    """Rows as the lines of each output mode."""
    x, out = table(spark, d, "nation").selectExpr(*_NATION.split(", ")), None
    for m in _MODES:
        y = C.render(x, m, "t").withColumn("mode", F.lit(m))
        out = y if out is None else out.unionByName(y)
    return out


_UCSC = "select o_orderkey as k, o_orderkey % 4 as m, case when o_custkey % 2 = 0 then '+' else '-' end as strand from orders"


@R.add(
    "known_site_lines",
    f"""with k as ({_UCSC}) select 'c' || (k % 20) as chrom, cast(case when m = 3 then k * 2 else k * 2 + 1 end as int) as pos, 'rs' || k as id, case when m = 3 then 'N' else 'A' end as ref,
      case m when 0 then 'G' when 1 then 'G' when 2 then 'C,G' else case when strand = '+' then 'NCA' else 'NTG' end end as alt,
      'molType=genomic;class=' || case when m = 3 then 'in-del' else 'single' end || case when m = 1 then '' else ';valid=by-freq' end || case when m = 2 then ';AF=0.25' else '' end as info from k""",
)
def known_site_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of known sites as variants, alleles of the other strand turned round."""
    forward = "case m when 0 then 'A/G' when 1 then 'G/A' when 2 then 'A/C/G' else '-/CA' end"
    backward = "case m when 0 then 'T/C' when 1 then 'C/T' when 2 then 'C/G/T' else '-/CA' end"
    f = [
        "'585'", "concat('c', cast(k % 20 as string))", "cast(k * 2 as string)", "cast(k * 2 + 1 as string)", "concat('rs', cast(k as string))", "'0'", "strand", "case when m = 3 then '-' else 'A' end", "'A'",
        f"case when strand = '+' then {forward} else {backward} end", "'genomic'", "case when m = 3 then 'in-del' else 'single' end", "case when m = 1 then 'unknown' else 'by-freq' end", "case when m = 2 then '0.25' else '0' end",
    ]
    lines = table(spark, d, "orders").selectExpr("o_orderkey as k", "o_orderkey % 4 as m", "case when o_custkey % 2 = 0 then '+' else '-' end as strand").selectExpr(f"concat_ws('\t', {', '.join(f)}) as value")
    return C.from_ucsc(lines)
