"""Queries over sequences, quality strings, contigs and intervals on sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions import seq as S
from readloom.plans.derive import SEQ_SQL, sequences
from readloom.plans.registry import Registry
from readloom.session import table

R = Registry()
SEQ = f"s as ({SEQ_SQL})"
_QUAL = "translate(seq, 'ACGTN', '5I+?!')"


@R.add(
    "sequence_composition",
    f"""with {SEQ} select doc_id, cast(length(seq) as int) as len, """
    + ", ".join(f"cast(length(seq) - length(replace(seq, '{b}', '')) as int) as n_{b.lower()}" for b in "ACGTN")
    + """, cast((length(seq) - length(replace(seq, 'CG', ''))) // 2 as int) as n_cpg from s""",
)
def sequence_composition(spark: SparkSession, d: str) -> DataFrame:
    """Bases and CpG of every sequence."""
    return sequences(spark, d).select(
        "doc_id", F.length("seq").alias("len"), *[S.base_count("seq", b).alias(f"n_{b.lower()}") for b in "ACGTN"], S.word_count("seq", "CG").alias("n_cpg")
    )


_MIXED = "translate(seq, 'ACGTN', 'ARYSB')"


@R.add("ambiguity_classes", f"with {SEQ}, m as (select doc_id, {_MIXED} as m from s) select doc_id, " + ", ".join(f"cast(length(m) - length(translate(m, '{c}', '')) as int) as {k}" for k, c in (("n_two", "RYSWKM"), ("n_three", "BDHV"), ("n_four", "N"), ("n_transitions", "RY"), ("n_transversions", "SWKM"))) + " from m")
def ambiguity_classes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of several bases by class, transitions and transversions."""
    x = sequences(spark, d).selectExpr("doc_id", f"{_MIXED} as m")
    return x.select("doc_id", *[v.alias(k) for k, v in S.ambiguity("m").items()])


@R.add("reverse_complement", f"with {SEQ} select doc_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) as digest from s")
def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    """Reverse complements, by digest."""
    return sequences(spark, d).select("doc_id", F.md5(S.reverse_complement("seq")).alias("digest"))


@R.add("sequence_digest", f"with {SEQ} select doc_id, md5(seq) as digest from s")
def sequence_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digest of every sequence in upper case."""
    return sequences(spark, d).select("doc_id", F.md5(F.upper("seq")).alias("digest"))


_IV = "cast(doc_id % 50 as int) as beg, cast(doc_id % 50 + 75 + doc_id % 200 as int) as stop"


@R.add("sequence_fetch", f"with {SEQ}, i as (select doc_id, seq, {_IV} from s) select doc_id, substr(seq, beg + 1, stop - beg) as bases, cast(length(substr(seq, beg + 1, stop - beg)) as int) as n from i")
def sequence_fetch(spark: SparkSession, d: str) -> DataFrame:
    """An interval of every sequence."""
    x = sequences(spark, d).selectExpr("doc_id", "seq", *_IV.split(", ", 1)).withColumn("bases", S.subsequence("seq", "beg", "stop"))
    return x.select("doc_id", "bases", F.length("bases").alias("n"))


@R.add(
    "sequence_wrap",
    f"""with {SEQ} select doc_id, md5(case when length(seq) > 0 and length(seq) % 60 = 0 then rtrim(regexp_replace(seq, '(.{{60}})', '\\1\n', 'g'), '\n')
      else regexp_replace(seq, '(.{{60}})', '\\1\n', 'g') end) as digest from s""",
)
def sequence_wrap(spark: SparkSession, d: str) -> DataFrame:
    """Sequences wrapped at 60 characters, by digest."""
    return sequences(spark, d).select("doc_id", F.md5(S.wrap("seq")).alias("digest"))


@R.add("sequence_mask", f"with {SEQ} select doc_id, md5(case when length(seq) <= 0 then seq else repeat('N', least(10, length(seq))::int) || substr(seq, 11, 5) || repeat('N', greatest(least(55, length(seq)) - 15, 0)::int) || substr(seq, 56) end) as digest from s")
def sequence_mask(spark: SparkSession, d: str) -> DataFrame:
    """Three intervals of every sequence overwritten."""
    iv = F.array(*[F.struct(F.lit(a).alias("beg"), F.lit(b).alias("end")) for a, b in ((0, 10), (15, 40), (30, 55))])
    return sequences(spark, d).select("doc_id", F.md5(S.mask_intervals("seq", iv)).alias("digest"))


@R.add("sequence_mutate", f"with {SEQ} select doc_id, md5(case when length(seq) >= 8 then substr(seq, 1, 7) || 'T' || substr(seq, 9) else seq end) as digest from s")
def sequence_mutate(spark: SparkSession, d: str) -> DataFrame:
    """The eighth base replaced."""
    return sequences(spark, d).select("doc_id", F.md5(S.mutate("seq", F.lit(8), F.lit("T"))).alias("digest"))


@R.add(
    "quality_mask",
    f"""with {SEQ} select doc_id, md5(translate(seq, 'GN', 'gn')) as digest from s""",
)
def quality_mask(spark: SparkSession, d: str) -> DataFrame:
    """Bases of quality below 20 in lower case; G has 10 and N has 0 here."""
    x = sequences(spark, d).selectExpr("doc_id", "seq", f"{_QUAL} as qual")
    return x.select("doc_id", F.md5(S.soft_mask_quality("seq", "qual", 20)).alias("digest"))


@R.add(
    "sequence_merge",
    f"""with {SEQ}, c as (select doc_id, substr(seq, i, 1) as a, substr(translate(seq, 'ACGTN', 'CATGN'), i, 1) as b, i from (select doc_id, seq, unnest(range(1, length(seq) + 1)) as i from s))
    select doc_id, md5(string_agg(case when a = 'N' then 'N' when a in ('A', 'C') then 'M' else 'K' end, '' order by i)) as digest from c group by 1""",
)
def sequence_merge(spark: SparkSession, d: str) -> DataFrame:
    """The union of a sequence and its transversion, in IUPAC codes."""
    x = sequences(spark, d).where("length(seq) > 0").withColumn("other", F.translate("seq", "ACGTN", "CATGN"))
    return x.select("doc_id", F.md5(S.combine("seq", "other")).alias("digest"))


@R.add("sequence_apply_mask", f"with {SEQ} select doc_id, md5(translate(seq, 'AC', 'ac')) as digest from s")
def sequence_apply_mask(spark: SparkSession, d: str) -> DataFrame:
    """A mask sequence applied."""
    x = sequences(spark, d).withColumn("mask", F.translate("seq", "ACGTN", "xx..."))
    return x.select("doc_id", F.md5(S.mask_by("seq", "mask")).alias("digest"))


@R.add("ambiguous_positions", f"with {SEQ}, p as (select doc_id, unnest(range(1, length(seq) + 1)) as i, seq from s) select doc_id, cast(i as int) as pos from p where substr(seq, i, 1) = 'N'")
def ambiguous_positions(spark: SparkSession, d: str) -> DataFrame:
    """1-based positions of bases that are not one of four."""
    x = sequences(spark, d).select("doc_id", F.posexplode(F.split("seq", "")).alias("i", "c"))
    return x.where("c = 'N'").select("doc_id", (F.col("i") + 1).alias("pos"))


WINDOW, STEP = 100, 20


@R.add(
    "sliding_ambiguity",
    f"""with {SEQ}, p as (select doc_id, unnest(range(0, length(seq))) as i, seq from s), b as (select doc_id, i // {STEP} as k, sum(case when substr(seq, i + 1, 1) = 'N' then 1 else 0 end) as n, count(*) as c from p group by all),
    w as (select doc_id, k, sum(n) over o as n, sum(c) over o as c from b window o as (partition by doc_id order by k range between {WINDOW // STEP - 1} preceding and current row))
    select doc_id, cast(k * {STEP} as int) as upto_step, cast(n as bigint) as n_ambiguous, cast(c as bigint) as n_bases from w""",
)
def sliding_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    """Ambiguous bases in sliding windows, from buckets of one step instead of rows per base.

    A window's frame is five buckets, and a bucket is one row a sequence."""
    x = sequences(spark, d).where("length(seq) > 0")
    x = x.select("doc_id", "seq", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / STEP))).alias("k"))
    part = F.substring("seq", (F.col("k") * STEP + 1).cast("int"), F.lit(STEP))
    x = x.select("doc_id", "k", S.base_count(part, "N").cast("bigint").alias("n"), F.length(part).cast("bigint").alias("c"))
    w = Window.partitionBy("doc_id").orderBy("k").rangeBetween(-(WINDOW // STEP - 1), 0)
    return x.select("doc_id", (F.col("k") * STEP).cast("int").alias("upto_step"), F.sum("n").over(w).alias("n_ambiguous"), F.sum("c").over(w).alias("n_bases"))


@R.add(
    "contig_windows",
    """with c as (select name, len, greatest(1, cast(ceil((len - 5500000) / 5000000.0) as int) + 1) as n from contigs),
    w as (select name, len, n, unnest(range(0, n)) as i from c)
    select name, cast(i * 5000000 + 1 as int) as beg, cast(case when i = n - 1 then len else (i + 1) * 5000000 end as int) as stop from w""",
)
def contig_windows(spark: SparkSession, d: str) -> DataFrame:
    """X11: contigs in windows of 5 Mb, the last at most 1.1 times as long."""
    x = table(spark, d, "contigs").withColumn("n", F.greatest(F.lit(1), F.ceil((F.col("len") - 5500000) / F.lit(5000000.0)).cast("int") + 1))
    x = x.select("name", "len", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    stop = F.when(F.col("i") == F.col("n") - 1, F.col("len")).otherwise((F.col("i") + 1) * 5000000)
    return x.select("name", (F.col("i") * 5000000 + 1).alias("beg"), stop.alias("stop"))


_PICK = "case c when 'M' then {0} when 'R' then {1} when 'W' then {2} when 'S' then {3} else c end".format(*[f"case when even then '{a}' else '{b}' end" for a, b in ("AC", "AG", "AT", "CG")])


@R.add(
    "random_bases",
    f"""with {SEQ}, u as (select doc_id, translate(seq, 'ACGTN', 'MRWSN') as t, unnest(range(0, length(seq))) as i from s),
    e as (select substr(t, i + 1, 1) as c, contains('02468ace', substr(md5(doc_id || ':' || i), 1, 1)) as even from u) select {_PICK} as base, count(*) as n from e group by 1""",
)
def random_bases(spark: SparkSession, d: str) -> DataFrame:
    """One base for every two-base code, chosen by a hash of document and position."""
    x = sequences(spark, d).select("doc_id", F.posexplode(F.split(F.translate("seq", "ACGTN", "MRWSN"), "")).alias("i", "c"))
    return x.groupBy(S.random_base(F.col("c"), F.concat_ws(":", "doc_id", "i")).alias("base")).agg(F.count(F.lit(1)).alias("n"))


# --- primitive families -------------------------------------------------------------------------


@R.add(
    "running_scan",
    """select report_id, cast(sum(num_alignments) over (partition by run_id order by report_id rows unbounded preceding) as bigint) as inclusive,
      cast(coalesce(sum(num_alignments) over (partition by run_id order by report_id rows between unbounded preceding and 1 preceding), 0) as bigint) as exclusive,
      num_alignments - coalesce(lag(num_alignments) over (partition by run_id order by report_id), 0) as difference from bam_qc_report""",
)
def running_scan(spark: SparkSession, d: str) -> DataFrame:
    """Scans and adjacent differences by key."""
    w = Window.partitionBy("run_id").orderBy("report_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = table(spark, d, "bam_qc_report")
    n = F.col("num_alignments")
    return x.select(
        "report_id", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("inclusive"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias("exclusive"),
        (n - F.coalesce(F.lag(n).over(w), F.lit(0))).alias("difference"),
    )


@R.add(
    "reduce_extremes",
    """select run_id, count(*) as n, min(num_alignments) as least, max(num_alignments) as most, arg_min(report_id, (num_alignments, report_id)) as least_at, arg_max(report_id, (num_alignments, report_id)) as most_at,
      bool_and(num_alignments > 0) as all_positive, bool_or(num_alignments = 0) as any_zero, cast(sum(num_alignments * strand_counter) as hugeint)::varchar as inner_product from bam_qc_report group by 1""",
)
def reduce_extremes(spark: SparkSession, d: str) -> DataFrame:
    """Reductions by key: count, extremes with their places, logic, inner product."""
    n = F.col("num_alignments")
    return table(spark, d, "bam_qc_report").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(n).alias("least"), F.max(n).alias("most"),
        F.min(F.struct(n, F.col("report_id"))).getField("report_id").alias("least_at"), F.max(F.struct(n, F.col("report_id"))).getField("report_id").alias("most_at"),
        F.bool_and(n > 0).alias("all_positive"), F.bool_or(n == 0).alias("any_zero"),
        F.sum((n * F.col("strand_counter")).cast("decimal(38,0)")).cast("string").alias("inner_product"),
    )


@R.add(
    "consecutive_unique",
    """with x as (select cov_id, run_id, depth, lag(depth) over (partition by run_id order by cov_id) as p, row_number() over (partition by run_id order by cov_id) as rn from bam_coverage_counter)
    select cov_id from x where rn = 1 or depth is distinct from p""",
)
def consecutive_unique(spark: SparkSession, d: str) -> DataFrame:
    """Unique by runs of equal neighbours."""
    w = Window.partitionBy("run_id").orderBy("cov_id")
    x = table(spark, d, "bam_coverage_counter").select("cov_id", "depth", F.lag("depth").over(w).alias("p"), F.row_number().over(w).alias("rn"))
    return x.where((F.col("rn") == 1) | ~F.col("depth").eqNullSafe(F.col("p"))).select("cov_id")


@R.add(
    "lower_bound_join",
    """select e.event_id, max(o.event_id) as previous_purchase from events e left join events o on o.user_id = e.user_id and o.event_type = 'purchase' and (o.ts < e.ts or (o.ts = e.ts and o.event_id < e.event_id)) and o.ts = (
      select max(z.ts) from events z where z.user_id = e.user_id and z.event_type = 'purchase' and (z.ts < e.ts or (z.ts = e.ts and z.event_id < e.event_id))) group by 1""",
)
def lower_bound_join(spark: SparkSession, d: str) -> DataFrame:
    """Search in a sorted sequence: the last purchase of the user before each event, by a window."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    hit = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, d, "events").select("event_id", F.last(hit, ignorenulls=True).over(w).alias("previous_purchase"))


@R.add(
    "sequence_colours",
    f"""with {SEQ}, c as (select doc_id, i, strpos('ACGT', substr(seq, i, 1)) - 1 as a, strpos('ACGT', substr(seq, i + 1, 1)) - 1 as b from (select doc_id, seq, unnest(range(1, length(seq))) as i from s))
    select doc_id, md5(string_agg(case when a < 0 or b < 0 then '4' else cast(xor(a, b) as varchar) end, '' order by i)) as digest from c group by 1""",
)
def sequence_colours(spark: SparkSession, d: str) -> DataFrame:
    """Colours of neighbouring bases."""
    return sequences(spark, d).where("length(seq) > 1").select("doc_id", F.md5(S.colours("seq")).alias("digest"))
