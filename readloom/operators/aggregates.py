"""Quality-control statistics, coverage, depth and pileup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions.cigar import end_pos, op_counts, op_sum, ref_blocks
from readloom.functions.flags import has
from readloom.schema import DUP, MUNMAP, PAIRED, PROPER, QCFAIL, READ1, READ2, REVERSE, UNMAP

#: bins of every histogram: 0..10 and one for all beyond
HISTOGRAM_BINS = 12


def _total(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("bigint")


def qc_basic_stats(df: DataFrame) -> DataFrame:
    """Alignments, those on the forward strand, and the integer means of quality and aligned length."""
    x = df.agg(
        F.count(F.lit(1)).alias("num_alignments"),
        _total(~has("flag", REVERSE)).alias("strand_counter"),
        _total(F.col("mapq")).alias("__q"),
        _total(op_sum("cigar", "MIS=X")).alias("__l"),
    )
    mean = lambda c: F.expr(f"case when num_alignments = 0 then 0 else {c} div num_alignments end")
    return x.select("num_alignments", "strand_counter", mean("__q").alias("mean_map_quality"), mean("__l").alias("mean_alignment_length"))


def _zero_filled(counts: DataFrame, names: list[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    spark = counts.sparkSession
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counts, "bin", "left").select("bin", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])


def map_error_histogram(df: DataFrame) -> DataFrame:
    """Reads by number of errors, deletions, insertions and matches (= only), in 12 zero-filled bins.

    One pass: each read gives four (kind, bin) pairs, which are counted before they are shuffled."""
    ops = op_counts("cigar")
    kinds = {"errors": ops["n_mismatches"], "deletions": ops["n_d"], "insertions": ops["n_i"], "matches": ops["n_eq"]}
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.least(c, F.lit(HISTOGRAM_BINS - 1)).alias("bin")) for k, c in kinds.items()])))
    sums = [_total(F.col("kind") == k).alias(k) for k in kinds]
    return _zero_filled(rows.groupBy("bin").agg(*sums), list(kinds))


def mapping_histogram(reads: DataFrame, matches: DataFrame, name: str = "qname") -> DataFrame:
    """Reads by their number of pair matches (0..10, more), reads without any included."""
    n = matches.groupBy(name).agg(F.count(F.lit(1)).alias("__n"))
    x = reads.select(name).distinct().join(n, name, "left")
    b = F.least(F.coalesce("__n", F.lit(0)), F.lit(HISTOGRAM_BINS - 1)).cast("int").alias("bin")
    return _zero_filled(x.groupBy(b).agg(F.count(F.lit(1)).alias("reads")), ["reads"])


def mean_pair_distance(matches: DataFrame) -> DataFrame:
    x = matches.agg(F.count(F.lit(1)).alias("n_matches"), _total(F.col("distance")).alias("__d"))
    return x.selectExpr("n_matches", "case when n_matches = 0 then 0 else __d div n_matches end as mean_distance")


def mapping_histogram_by_query(mappings: DataFrame, max_distance: int, total: int | Column | None = None) -> DataFrame:
    """The other definition: rows of a read with both ends on one contig and isize below the bound.

    bin k holds reads with k + 1 such rows (the last one all beyond); bin 0 is what is left of all
    rows, so that every row is in one bin.
    """
    ok = mappings.where((F.col("tid") == F.col("mtid")) & (F.col("isize") < max_distance))
    per = ok.groupBy("id_seq").agg(F.count(F.lit(1)).alias("n"))
    counts = per.groupBy((F.least("n", F.lit(HISTOGRAM_BINS - 1)) - 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("reads"))
    full = _zero_filled(counts, ["reads"])
    rows = mappings.agg(F.count(F.lit(1)).alias("n")).scalar() if total is None else F.lit(total)
    beyond = full.where("bin between 1 and 10").agg(F.sum((F.col("bin") + 1) * F.col("reads")).alias("k")).scalar()
    return full.withColumn("reads", F.when(F.col("bin") == 0, rows - beyond).otherwise(F.col("reads")).cast("bigint"))


def coverage_runs(df: DataFrame, chrom: str = "tid", pos: str = "pos", cigar: str = "cigar", bin_width: int = 1 << 20) -> DataFrame:
    """Depth of M, = and X blocks as runs (chrom, beg, end, depth), half-open, depth > 0.

    Only the two borders of a block travel, added up per position before the shuffle. Blocks are cut
    at bin borders, so the running sum is taken per (contig, bin) and a contig is many tasks.
    """
    b = df.select(chrom, F.inline(ref_blocks(pos, cigar))).where("beg < end").select(chrom, "beg", "end")
    return depth_runs(b, chrom, bin_width=bin_width)


def _borders(chrom: str, measures: list[str], width: int):
    """The borders of a batch of blocks, cut at bins, with the measures added up per (chrom, bin, position)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            b, e = x.column("__b").to_numpy(), x.column("__e").to_numpy()
            k, n = b // width, (e - 1) // width - b // width + 1
            at = np.repeat(np.arange(len(b)), n)
            k = k[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            b, e = np.maximum(b[at], k * width), np.minimum(e[at], (k + 1) * width)
            at = pa.array(np.concatenate([at, at]))
            columns = [x.column(chrom).take(at), pa.array(np.concatenate([k, k])), pa.array(np.concatenate([b, e]))]
            sign = np.repeat(np.array([1, -1]), len(k))
            columns += [pa.array(np.where(sign > 0, v, -v)) for v in (x.column(m).fill_null(0).take(at).to_numpy() for m in measures)]
            table = pa.table(columns, names=[chrom, "__k", "__p", *measures]).group_by([chrom, "__k", "__p"], use_threads=False)
            out = table.aggregate([(m, "sum") for m in measures]).rename_columns({f"{m}_sum": m for m in measures})
            yield from out.select([chrom, "__k", "__p", *measures]).to_batches()

    return run


def measure_runs(blocks: DataFrame, chrom: str, measures: list[str], beg: str = "beg", end: str = "end", bin_width: int = 1 << 20) -> DataFrame:
    """Sums of measures over half-open blocks as runs (chrom, beg, end, measures): between two borders
    nothing changes. Runs may be cut at bin borders; stretches where every measure is 0 are left out.

    Borders are added up within the task, so a position a third of all blocks begin at travels once a batch; one
    exchange by (chrom, bin) then serves the sum per position and the running sums.
    """
    long = [F.col(m).cast("bigint").alias(m) for m in measures]
    b = blocks.select(chrom, F.col(beg).cast("bigint").alias("__b"), F.col(end).cast("bigint").alias("__e"), *long).where("__b < __e")
    of = lambda n: T.StructField(n, T.LongType())
    events = b.mapInArrow(_borders(chrom, measures, bin_width), T.StructType([b.schema[chrom], of("__k"), of("__p"), *map(of, measures)]))
    events = events.repartition(chrom, "__k").groupBy(chrom, "__k", "__p").agg(*[F.sum(m).alias(m) for m in measures])
    events = events.where(" or ".join(f"`{m}` <> 0" for m in measures))
    by = Window.partitionBy(chrom, "__k").orderBy("__p")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    runs = events.select(chrom, F.col("__p").alias("beg"), F.lead("__p").over(by).alias("end"), *[F.sum(m).over(upto).alias(m) for m in measures])
    return runs.where("`end` is not null and (" + " or ".join(f"`{m}` <> 0" for m in measures) + ")")


def depth_runs(blocks: DataFrame, chrom: str, beg: str = "beg", end: str = "end", bin_width: int = 1 << 20) -> DataFrame:
    """The number of blocks over each position, as runs with depth > 0."""
    return measure_runs(blocks.withColumn("depth", F.lit(1)), chrom, ["depth"], beg, end, bin_width)


def interpolated_blocks(df: DataFrame) -> DataFrame:
    """Blocks (tid, beg, end) of mapped reads: a proper pair counts from its first start to its last
    end, whatever lies between; every other read counts its own extent.

    Mates are a first and a second read of one name on one contig, both flagged as properly paired.
    Where a name has several of either, they are paired in the order of their positions; what has no
    partner left counts its own extent.
    """
    x = df.where((F.col("tid") >= 0) & ~has("flag", UNMAP)).select("qname", "tid", "flag", F.col("pos").alias("beg"), end_pos("pos", "cigar").alias("end"))
    mate = has("flag", PAIRED) & has("flag", PROPER) & (has("flag", READ1) != has("flag", READ2))
    number = F.row_number().over(Window.partitionBy("qname", "tid", has("flag", READ1)).orderBy("beg", "end"))
    pairs = x.where(mate).withColumn("__i", number).groupBy("qname", "tid", "__i").agg(F.min("beg").alias("beg"), F.max("end").alias("end"))
    return x.where(~mate).select("tid", "beg", "end").unionByName(pairs.select("tid", "beg", "end"))


def coverage(df: DataFrame, mode: str = "intended", **names: str) -> DataFrame:
    """(chrom, pos, depth): contig number + 1, 1-based position, depth > 0. ``reference`` wraps the depth
    at 65,536, as a 16-bit counter does."""
    chrom = names.get("chrom", "tid")
    runs = coverage_runs(df, **names)
    x = runs.select((F.col(chrom) + 1).alias("chrom"), F.explode(F.sequence(F.col("beg") + 1, F.col("end"))).alias("pos"), "depth")
    if mode == "reference":
        x = x.withColumn("depth", F.col("depth") % 65536).where("depth > 0")
    return x


def coverage_summary(runs: DataFrame) -> DataFrame:
    """Covered bases, depth sum and mean depth, from runs: no row per base is made."""
    x = runs.agg(_total(F.col("end") - F.col("beg")).alias("covered_bases"), _total((F.col("end") - F.col("beg")) * F.col("depth")).alias("depth_sum"))
    return x.withColumn("mean_coverage", F.round(F.col("depth_sum") / F.greatest("covered_bases", F.lit(1)), 6))


def flagstat(df: DataFrame) -> DataFrame:
    """The eleven counters, one row for records that passed and one for those that failed the QC bit."""
    paired, mapped, mate = has("flag", PAIRED), ~has("flag", UNMAP), ~has("flag", MUNMAP)
    both = paired & mapped & mate
    far = both & (F.col("mtid") != F.col("tid"))
    each = {
        "n_reads": F.lit(True), "n_mapped": mapped, "n_dup": has("flag", DUP), "n_pair_all": paired, "n_pair_good": paired & has("flag", PROPER),
        "n_read1": paired & has("flag", READ1), "n_read2": paired & has("flag", READ2), "n_sgltn": paired & ~mate & mapped, "n_pair_map": both,
        "n_diffchr": far, "n_diffhigh": far & (F.col("mapq") >= 5),
    }
    kinds = df.sparkSession.createDataFrame([(False,), (True,)], "qc_failed boolean")
    x = df.groupBy(has("flag", QCFAIL).alias("qc_failed")).agg(*[_total(c).alias(k) for k, c in each.items()])
    return kinds.join(x, "qc_failed", "left").na.fill(0, list(each))


def flagstat_shares(counts: DataFrame) -> DataFrame:
    """The percentages of ``flagstat``: mapped of all, properly paired and singletons of the paired; null where there is nothing to divide by."""
    share = lambda a, b: F.when(F.col(b) > 0, F.round(100.0 * F.col(a) / F.col(b), 2))
    return counts.select("qc_failed", share("n_mapped", "n_reads").alias("mapped_pct"), share("n_pair_good", "n_pair_all").alias("proper_pct"), share("n_sgltn", "n_pair_all").alias("singleton_pct"))


def idxstats(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """Per contig its name and length with mapped and unmapped reads placed on it; ``*`` holds those
    without a contig."""
    un = has("flag", UNMAP)
    n = df.groupBy(F.when(F.col("tid") >= 0, F.col("tid")).otherwise(-1).alias("tid")).agg(_total(~un).alias("mapped"), _total(un).alias("unmapped"))
    star = df.sparkSession.createDataFrame([(-1, "*", 0)], "tid int, name string, len int")
    return contigs.select("tid", "name", "len").unionByName(star).join(n, "tid", "left").na.fill(0, ["mapped", "unmapped"]).select("name", "len", "mapped", "unmapped")


def pileup_blocks(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per read and block that it has on the reference: (keep, tid, start, beg, end, op, qbeg, after,
    last_block). ``after`` is the indel that follows the block's last base: the length of an insertion, or
    minus that of a deletion."""
    # tested before it is cast: a failing try_cast costs an exception a row
    last = F.regexp_extract("cigar", r"([0-9]+)I([0-9]+[SHP])*$", 1)
    tail = F.when(last != "", last.cast("int")).otherwise(0)
    x = df.select(*keep, "tid", F.col("pos").alias("start"), ref_blocks("pos", "cigar", keep="MDN=X").alias("__blocks"), tail.alias("__tail"))

    def finished(b: Column, i: Column) -> Column:
        """The block with what follows it: looked up here, so that no row carries the array along."""
        then = F.get("__blocks", i + 1)
        inserted = then["qbeg"] - b["qbeg"] - F.when(b["op"].isin("D", "N"), 0).otherwise(b["end"] - b["beg"])
        after = F.when(then.isNull(), F.col("__tail")).when(inserted > 0, inserted).when(then["op"] == "D", then["beg"] - then["end"]).otherwise(0)
        return F.struct(
            b["beg"].alias("beg"), b["end"].alias("end"), b["op"].alias("op"), b["qbeg"].alias("qbeg"), after.alias("after"), (i == F.size("__blocks") - 1).alias("last_block")
        )

    return x.select(*keep, "tid", "start", F.inline(F.transform("__blocks", finished))).where("beg < end")


def pileup(df: DataFrame, keep: list[str], bin_shift: int = 14, spread: int = 1) -> DataFrame:
    """One row per read and reference position it spans: (keep, tid, bin, pos, qpos, is_del, is_refskip,
    indel, is_head, is_tail).

    ``indel`` stands at the last base of a block. qpos is the 0-based offset on the read; in a deletion that
    of the next base. The blocks, not the positions, are shuffled: they are cut at bins of
    2**bin_shift, placed by (tid, bin) and spread out there, so a result grouped by (tid, bin, pos)
    needs no further shuffle. Where a few positions hold most of the reads, ``spread`` > 1 places a bin
    on that many tasks and the grouping combines their partial states.
    """
    x = pileup_blocks(df, keep)
    first, last = F.shiftright("beg", bin_shift), F.shiftright(F.col("end") - 1, bin_shift)
    x = x.withColumn("bin", F.explode(F.sequence(first, last)))
    place = ["tid", "bin"] if spread == 1 else ["tid", "bin", F.pmod(F.xxhash64(*x.columns), F.lit(spread))]
    x = x.repartition(*place)
    edge = F.shiftleft("bin", bin_shift)
    x = x.withColumn("pos", F.explode(F.sequence(F.greatest(F.col("beg"), edge), F.least(F.col("end"), edge + (1 << bin_shift)) - 1)))
    is_del = F.col("op").isin("D", "N")
    at_end = F.col("pos") == F.col("end") - 1
    return x.select(
        *keep, "tid", "bin", "pos", F.when(is_del, F.col("qbeg")).otherwise(F.col("qbeg") + F.col("pos") - F.col("beg")).cast("int").alias("qpos"),
        is_del.alias("is_del"), (F.col("op") == "N").alias("is_refskip"), F.when(at_end, F.col("after")).otherwise(0).cast("int").alias("indel"),
        (F.col("pos") == F.col("start")).alias("is_head"), (at_end & F.col("last_block")).alias("is_tail"),
    )


PILE_COUNTS = ["n_reads", "n_del", "n_skip", "n_head", "n_tail", "indel_sum"]


def pileup_counts(df: DataFrame) -> DataFrame:
    """What stands at every position: (tid, pos 0-based, reads, deletions, skips, heads, tails, sum of
    indels), from the borders of the blocks; positions are only made at the end."""
    x = pileup_blocks(df, [])

    def part(beg, end, **values):
        return F.struct(beg.alias("beg"), end.alias("end"), *[values.get(m, F.lit(0)).cast("bigint").alias(m) for m in PILE_COUNTS])

    b, e, one = F.col("beg"), F.col("end"), F.lit(1)
    whole = part(b, e, n_reads=one, n_del=(F.col("op") == "D").cast("int"), n_skip=(F.col("op") == "N").cast("int"))
    tip = part(e - 1, e, n_tail=F.col("last_block").cast("int"), indel_sum=F.col("after"))
    head = part(b, b + 1, n_head=one)
    parts = F.concat(
        F.array(whole), F.when(F.col("last_block") | (F.col("after") != 0), F.array(tip)).otherwise(F.slice(F.array(tip), 1, 0)),
        F.when(b == F.col("start"), F.array(head)).otherwise(F.slice(F.array(head), 1, 0)),
    )
    runs = measure_runs(x.select("tid", F.inline(parts)), "tid", PILE_COUNTS)
    return runs.select("tid", F.explode(F.sequence(F.col("beg").cast("int"), F.col("end").cast("int") - 1)).alias("pos"), *PILE_COUNTS)


def depth_by_file(df: DataFrame, files: list[str], min_quality: int = 0) -> DataFrame:
    """(tid, pos 1-based, one depth per file): bases of enough mapping quality, deletions and skips not
    counted, but every position a read spans is there."""
    x = df.where(F.col("mapq") >= min_quality)
    b = x.select("file", "tid", F.inline(ref_blocks("pos", "cigar", keep="MDN=X")))
    names = [f"depth_{f}" for f in files]
    base = F.col("op").isin("M", "=", "X")
    b = b.select("tid", "beg", "end", F.lit(1).alias("__any"), *[((F.col("file") == f) & base).cast("int").alias(n) for f, n in zip(files, names)])
    runs = measure_runs(b, "tid", ["__any", *names]).where("__any > 0")
    return runs.select("tid", F.explode(F.sequence((F.col("beg") + 1).cast("int"), F.col("end").cast("int"))).alias("pos"), *names)


def depth_of_bases(pile: DataFrame, files: list[int], keys: list[str], min_base_quality: int = 0, min_quality: int = 0) -> DataFrame:
    """(keys, one depth a file) from a pile with ``file``, ``base_q`` and ``mapq``: bases of enough quality of reads of enough
    mapping quality; deletions and skips don't count, but every position such a read spans is there."""
    counts = ~F.col("is_del") & (F.col("base_q") >= min_base_quality)
    x = pile.where(F.col("mapq") >= min_quality)
    return x.groupBy(*keys).agg(*[F.sum((counts & (F.col("file") == f)).cast("bigint")).alias(f"depth_{f}") for f in files])


def capped_reads(df: DataFrame, cap: int, ordinal: str) -> DataFrame:
    """The reads (tid, pos, end) a pileup keeps when it holds at most ``cap`` of them at any position: in the order of places a read is
    left out where so many kept ones reach over its start. Reads of a contig stream through one task, which holds the ends of at most
    ``cap`` reads; without a cap no such pass is needed."""
    import heapq

    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tid, ends = None, []
        for b in batches:
            keep = []
            for t, beg, end in zip(b.column("tid").to_pylist(), b.column("pos").to_pylist(), b.column("end").to_pylist()):
                if t != tid:
                    tid, ends = t, []
                while ends and ends[0] <= beg:
                    heapq.heappop(ends)
                keep.append(len(ends) < cap)
                if keep[-1]:
                    heapq.heappush(ends, max(end, beg + 1))
            yield b.filter(pa.array(keep, pa.bool_()))

    return df.repartition("tid").sortWithinPartitions("tid", "pos", ordinal).mapInArrow(run, schema)
