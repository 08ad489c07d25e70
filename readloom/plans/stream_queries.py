"""Streams over the harness tables, row operators in Python, and report lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.cigar import end_pos, ref_blocks
from readloom.operators import aggregates as A
from readloom.operators import realign as Z
from readloom.plans.alignment_queries import _BLOCKS, ALN, _matches, ops_sql
from readloom.plans.alignment_queries import R as QC
from readloom.plans.derive import ALN as ALN_EXPRS
from readloom.plans.derive import alignments, sequences
from readloom.plans.registry import Registry
from readloom.session import remember, shared_dir
from readloom.sources.report import coverage_lines, qc_report, write_histogram, write_html
from readloom.streaming import running as S

R = Registry()


def _alignment_stream(spark: SparkSession, d: str) -> DataFrame:
    return S.stream_table(spark, d, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in ALN_EXPRS])


@R.add("stream_qc_stats", f"with {ALN} select count(*) as num_alignments, count(*) filter (flag & 16 = 0) as strand_counter, cast(sum(mapq) as bigint) as quality_sum, cast(sum({ops_sql('MIS=X')}) as bigint) as length_sum from aln")
def stream_qc_stats(spark: SparkSession, d: str) -> DataFrame:
    """Running QC sums."""
    return S.run_to_table(S.qc_stats_stream(_alignment_stream(spark, d)), "complete")


@R.add(
    "stream_flagstat",
    f"with {ALN} select flag & 512 <> 0 as qc_failed, count(*) as n_reads, count(*) filter (flag & 4 = 0) as n_mapped, count(*) filter (flag & 1024 <> 0) as n_dup, count(*) filter (flag & 1 <> 0) as n_pair_all, count(*) filter (flag & 3 = 3) as n_pair_good from aln group by 1",
)
def stream_flagstat(spark: SparkSession, d: str) -> DataFrame:
    """Running flag counters."""
    return S.run_to_table(S.flagstat_stream(_alignment_stream(spark, d)), "complete")


@R.add("stream_mapping_counts", "select id_seq, count(*) as n_rows from mappings where tid = mtid and isize < 500 group by 1")
def stream_mapping_counts(spark: SparkSession, d: str) -> DataFrame:
    """Running rows per read."""
    return S.run_to_table(S.mapping_counts_stream(S.stream_table(spark, d, "mappings")), "update", ["id_seq"])


@R.add(
    "stream_depth",
    f"""with {_BLOCKS}, cov as (select tid, unnest(range(beg, beg + n)) as p from blk where op in ('M', '=', 'X'))
    select tid, cast(p as int) as pos, count(*) as depth from cov group by all""",
)
def stream_depth(spark: SparkSession, d: str) -> DataFrame:
    """All depths, each given out when the position watermark has passed it; a late block stops the query."""
    x = alignments(spark, d).where("tid >= 0").select("tid", F.inline(ref_blocks("pos", "cigar"))).where("beg < end").select("tid", "beg", "end")
    return S.positions_of(S.run_to_table(S.depth_runs_stream(S.position_ordered(x), "error"), "append"))


@R.add("target_regions")
def target_regions(spark: SparkSession, d: str) -> DataFrame:
    """Covered targets."""
    x = alignments(spark, d).where("tid >= 0").select("tid", F.inline(ref_blocks("pos", "cigar")))
    return Z.target_regions(x)


@R.add("simulated_reads")
def simulated_reads(spark: SparkSession, d: str) -> DataFrame:
    """G1: read pairs of the derived sequences."""
    return Z.simulate_reads(sequences(spark, d).select(F.col("doc_id").cast("string").alias("name"), "seq"))


@R.add(
    "coverage_lines",
    f"""with {_BLOCKS}, cov as (select tid, unnest(range(beg, beg + n)) as p from blk where op in ('M', '=', 'X')), dep as (select tid, p, count(*) as depth from cov group by all)
    select cast(tid + 1 as varchar) || chr(9) || cast(p + 1 as varchar) || chr(9) || cast(depth as varchar) as value from dep""",
)
def coverage_text(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the coverage file."""
    return coverage_lines(A.coverage(alignments(spark, d).where("tid >= 0")))


def _values(sql: str, columns: list[str]) -> str:
    return " union all ".join(f"select '{c}' as name, cast({c} as double) as value from ({sql})" for c in columns)


_REPORT = {
    "qc_basic_stats": ["num_alignments", "strand_counter", "mean_map_quality", "mean_alignment_length"], "qc_pair_distance": ["n_matches", "mean_distance"],
    "coverage_summary": ["covered_bases", "depth_sum", "mean_coverage"],
}


@R.add("qc_report", " union all ".join(_values(QC.sql[q], c) for q, c in _REPORT.items()))
def report(spark: SparkSession, d: str) -> DataFrame:
    """The report as lines."""
    a = alignments(spark, d)
    return qc_report(a, _matches(spark, d), A.coverage_runs(a.where("tid >= 0")))


@R.add("qc_histogram_file", "select cast(bin as varchar) || chr(9) || reads as value from (" + QC.sql["qc_mapping_histogram"] + ")")
def qc_histogram_file(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a histogram file."""
    path = remember(spark, f"{shared_dir(spark)}/report-{uuid.uuid4().hex}")
    write_histogram(A.mapping_histogram(alignments(spark, d), _matches(spark, d)), f"{path}/mappings.tsv")
    return spark.read.text(f"{path}/mappings.tsv")


@R.add("qc_page", " union all ".join(f"select '{c}' as name, count(*) as n from ({QC.sql[q]})" for q, cs in _REPORT.items() for c in cs))
def qc_page(spark: SparkSession, d: str) -> DataFrame:
    """The values on the report's page, each once."""
    path = remember(spark, f"{shared_dir(spark)}/report-{uuid.uuid4().hex}")
    write_html(report(spark, d), {"mappings per read": A.mapping_histogram(alignments(spark, d), _matches(spark, d))}, f"{path}/page.html")
    page = spark.read.option("wholetext", "true").text(f"{path}/page.html")
    cells = F.regexp_extract_all("value", F.lit("<tr><td>([a-z_]+)</td><td>[^<]+</td></tr>"), F.lit(1))
    return page.select(F.explode(cells).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@R.add("capped_pileup")
def capped_pileup(spark: SparkSession, d: str) -> DataFrame:
    """The reads a pileup holds when no position may have more than three."""
    x = alignments(spark, d).where("tid >= 0").select("ord", "tid", "pos", end_pos("pos", "cigar").alias("end"))
    return A.capped_reads(x, 3, "ord").select("ord", "tid", "pos")
