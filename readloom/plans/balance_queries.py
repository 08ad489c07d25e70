"""Queries of the two general data-pipeline problems: hot keys (p2) and interval stretches (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.intervals import stretches_and_gaps
from readloom.operators.skew import heavy_keys, keyed_totals
from readloom.plans.registry import Registry
from readloom.session import table

R = Registry()

HEAVY_SHARE = 0.07


@R.add(
    "p2_found",
    """
    with c as (select chromosome as k, count(*) as n from bam_coverage_counter where chromosome > 0 group by 1),
         t as (select tid as k, count(*) as n from read_position where tid >= 0 group by 1)
    select 'bam_coverage_counter' as rec_table, cast(k as int) as key_value from c where n >= 0.07 * (select sum(n) from c)
    union all
    select 'read_position', cast(k as int) from t where n >= 0.07 * (select sum(n) from t)
    """,
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, key, least in (("bam_coverage_counter", "chromosome", 1), ("read_position", "tid", 0)):
        rows = table(spark, d, name).where(F.col(key) >= least)
        parts.append(heavy_keys(rows, key, HEAVY_SHARE).select(F.lit(name).alias("rec_table"), F.col(key).cast("int").alias("key_value")))
    return parts[0].unionByName(parts[1])


@R.add(
    "p2_chromosome_totals",
    """
    select cast(chromosome as int) as chromosome, count(*) as n_rows, cast(coalesce(sum(depth), 0) as bigint) as depth_sum,
      count(distinct pos) as n_positions, min(pos) as first_pos, max(pos) as last_pos
    from bam_coverage_counter group by 1
    """,
)
def p2_chromosome_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bam_coverage_counter").withColumn("chromosome", F.col("chromosome").cast("int"))
    return keyed_totals(rows, ["chromosome"], {"depth_sum": "depth"}, ("n_positions", "pos"), {"pos": ("first_pos", "last_pos")})


@R.add(
    "p2_tid_totals",
    """
    select cast(tid as int) as tid, count(*) as n_rows, count(distinct "position") as n_positions,
      min("position") as first_pos, max("position") as last_pos
    from read_position group by 1
    """,
)
def p2_tid_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "read_position").withColumn("tid", F.col("tid").cast("int"))
    return keyed_totals(rows, ["tid"], None, ("n_positions", "position"), {"position": ("first_pos", "last_pos")})


def covering_alignments(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, tid, seg_start, seg_end) of each usable read position.

    The join keys are unique on the batch side but for rewritten rows with the same values, which
    change no union of intervals, so they need no extra shuffle to be removed.
    """
    rp = table(spark, d, "read_position").where("tid >= 0 and position >= 0").select("run_id", "tid", "position", "batch_id", "aln_no")
    al = table(spark, d, "bam_qc_batch").where("alignment_length_p > 0").select("batch_id", "aln_no", "alignment_length_p")
    x = rp.join(al, ["batch_id", "aln_no"])
    start = F.col("position").cast("bigint")
    return x.select("run_id", F.col("tid").cast("int").alias("tid"), start.alias("seg_start"), (start + F.col("alignment_length_p")).alias("seg_end"))


@R.add(
    "p3_found",
    """
    with a as (
      select distinct r.run_id, cast(r.tid as int) as tid, cast(r."position" as bigint) as s,
        cast(r."position" as bigint) + b.alignment_length_p as e
      from read_position r join bam_qc_batch b on r.batch_id = b.batch_id and r.aln_no = b.aln_no
      where r.tid >= 0 and r."position" >= 0 and b.alignment_length_p > 0),
    m as (select *, max(e) over (partition by run_id, tid order by s, e rows between unbounded preceding and 1 preceding) as pe from a),
    g as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by run_id, tid order by s, e rows unbounded preceding) as k from m),
    c as (select run_id, tid, k, min(s) as seg_start, max(e) as seg_end from g group by 1, 2, 3),
    l as (select *, lag(seg_end) over (partition by run_id, tid order by seg_start) as pe from c)
    select run_id, tid, 'covered' as kind, cast(seg_start as int) as seg_start, cast(seg_end as int) as seg_end from c
    union all
    select run_id, tid, 'gap', cast(pe as int), cast(seg_start as int) from l where pe is not null
    """,
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    x = stretches_and_gaps(covering_alignments(spark, d), ["run_id", "tid"], "seg_start", "seg_end")
    return x.select("run_id", "tid", "kind", F.col("seg_start").cast("int").alias("seg_start"), F.col("seg_end").cast("int").alias("seg_end"))
