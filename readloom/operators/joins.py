"""Interval joins, read-pair joins and mapping validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.cigar import end_pos
from readloom.functions.flags import has
from readloom.schema import MREVERSE, MUNMAP, PAIRED, PROPER, REVERSE, UNMAP

BIN_SHIFT = 14


#: Bin sizes of the semi join, as powers over BIN_SHIFT; the last one holds any 32-bit interval.
LEVELS = (0, 4, 8, 12, 17)


def _level(length: Column, shift: int) -> Column:
    """The least of LEVELS whose bins are not shorter than the interval."""
    level = F.lit(LEVELS[-1])
    for lv in reversed(LEVELS[:-1]):
        level = F.when(length <= (1 << (shift + lv)), lv).otherwise(level)
    return level


def interval_join(
    left: DataFrame,
    right: DataFrame,
    chrom: str = "tid",
    left_start: str = "pos",
    left_end: str = "end",
    right_start: str = "start",
    right_end: str = "stop",
    closed: bool = False,
    shift: int = BIN_SHIFT,
    salts: int = 1,
) -> DataFrame:
    """Pairs whose intervals overlap on the same contig.

    An interval has a level by its length, so that it touches at most two bins of its level. Pairs are joined by
    (contig, level, bin) at the higher level of the two, as an ordinary equi-join, and checked: a region as long
    as a contig is two rows, not thousands. The levels the right side has are looked up first (five at most), so
    a left row is entered once where all regions are short. A pair that shares two bins is kept in the one
    where the later start lies, so no distinct is needed. ``salts`` > 1 spreads a hot bin of the left side
    over as many tasks. Half-open intervals, or closed ones. The columns of the right side
    must not clash, but for the contig, which is taken from the left. Nulls overlap nothing.
    """
    more = 1 if closed else 0

    def entered(df: DataFrame, start: str, stop: str, own: str, levels: Column) -> DataFrame:
        x = df.withColumn(own, _level(F.col(stop) + more - F.col(start), shift)).withColumn("__at", F.explode(levels))
        places = f"sequence(shiftright(cast({start} as bigint), {shift} + __at), shiftright(cast({stop} + {more} - 1 as bigint), {shift} + __at))"
        return x.withColumn("__bin", F.explode(F.expr(places)))

    a = left.where(F.col(left_start) < F.col(left_end) + more)
    b = right.where(F.col(right_start) < F.col(right_end) + more).withColumnRenamed(chrom, "__rchrom")
    have = sorted(r[0] for r in b.select(_level(F.col(right_end) + more - F.col(right_start), shift).alias("l")).distinct().collect())
    others = F.filter(F.array(*[F.lit(lv) for lv in have]).cast("array<int>"), lambda lv: lv > F.col("__own"))
    a = entered(a, left_start, left_end, "__own", F.concat(F.array("__own"), others))
    every = F.array(*[F.lit(lv) for lv in LEVELS])
    b = entered(b, right_start, right_end, "__rown", F.filter(every, lambda lv: lv >= F.col("__rown")))
    on = (F.col(chrom) == F.col("__rchrom")) & (F.col("__at") == F.col("__rat")) & (F.col("__bin") == F.col("__rbin"))
    b = b.withColumnsRenamed({"__at": "__rat", "__bin": "__rbin"})
    if salts > 1:
        a = a.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
        b = b.withColumn("__rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        on = on & (F.col("__salt") == F.col("__rsalt"))
    x = a.join(b, on).where(F.col("__at") == F.greatest("__own", "__rown"))
    x = x.where((F.col(left_start) < F.col(right_end) + more) & (F.col(right_start) < F.col(left_end) + more))
    later = F.greatest(F.col(left_start), F.col(right_start)).cast("bigint")
    x = x.withColumn("__later", later).where(F.expr(f"shiftright(__later, {shift} + __at)") == F.col("__bin"))
    return x.drop("__bin", "__rbin", "__rchrom", "__at", "__rat", "__own", "__rown", "__salt", "__rsalt", "__later")


#: Entries of regions up to which the semi join ships them to every task; checked, as an estimate doesn't see how many bins a region has.
FEW_ENTRIES = 1 << 18


def overlap_semi(
    df: DataFrame, regions: DataFrame, chrom: str = "tid", start: str = "pos", end: str = "end", shift: int = BIN_SHIFT
) -> DataFrame:
    """Rows that overlap any region (chrom, start, stop; half-open), each once, as a left semi join.

    A row is looked up at one bin only: the one of its start, of the least size not below its length.
    Such a row reaches at most into the next bin, so a region is entered at the bins it touches and
    the one before, for each size. Nothing on the side of the rows is spread or made distinct. Nulls
    overlap nothing; a row with end <= start is taken as one base.

    The entries of a bin are joined to disjoint stretches first, over gaps too: a row of a level is longer than the bins of
    the level below, so it can't lie in a gap of that length. Only up to ``FEW_ENTRIES`` entries are broadcast, more
    meet the rows in a sort merge join.
    """
    length = F.greatest(F.col(end) - F.col(start), F.lit(1))
    level = _level(length, shift)
    rows = df.withColumn("__l", level).withColumn("__b", F.expr(f"shiftright(cast({start} as bigint), {shift} + __l)"))
    r = regions.where(F.col("start") < F.col("stop")).select(F.col(chrom).alias("__rc"), F.col("start").cast("bigint").alias("__rs"), F.col("stop").cast("bigint").alias("__re"))
    gaps = [0, *[1 << (shift + lv) for lv in LEVELS[:-1]]]
    r = r.select("*", F.inline(F.array(*[F.struct(F.lit(lv).alias("__rl"), F.lit(g).cast("bigint").alias("__gap")) for lv, g in zip(LEVELS, gaps)])))
    bins = f"sequence(shiftright(__rs, {shift} + __rl) - 1, shiftright(__re - 1, {shift} + __rl))"
    r = r.withColumn("__rb", F.explode(F.expr(bins)))
    few = r.limit(FEW_ENTRIES + 1).count() <= FEW_ENTRIES
    # what lies before the bin or behind the next one no row of the bin reaches
    r = r.withColumns({"__rs": F.expr(f"greatest(__rs, shiftleft(__rb, {shift} + __rl))"), "__re": F.expr(f"least(__re, shiftleft(__rb + 2, {shift} + __rl))")})
    key = ["__rc", "__rl", "__rb"]
    w = Window.partitionBy(*key).orderBy("__rs")
    upto = F.max("__re").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("__new", F.coalesce(F.col("__rs") > upto + F.col("__gap"), F.lit(True)).cast("int"))
    r = r.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.groupBy(*key, "__i").agg(F.min("__rs").alias("__rs"), F.max("__re").alias("__re")).hint("broadcast" if few else "shuffle_merge")
    stop = F.greatest(F.col(end), F.col(start) + 1)
    hit = (F.col(chrom) == F.col("__rc")) & (F.col("__l") == F.col("__rl")) & (F.col("__b") == F.col("__rb"))
    return rows.join(r, hit & (F.col(start) < F.col("__re")) & (F.col("__rs") < stop), "left_semi").drop("__l", "__b")


def pair_matches(df: DataFrame, max_distance: int = 500, name: str = "qname", end_number: str = "paired_end") -> DataFrame:
    """Matches of end 1 with end 2 of a read on the same contig: distance from the end of end 1
    (pos + len) to the start of end 2, at most ``max_distance``. (name, tid, distance)

    Joined by (read, contig, bin of the position), end 2 in its bin and the two beside it, so a read with
    very many mappings is many keys and only near ones meet.
    """
    w = max_distance + 1
    bin_of = lambda c: F.floor(F.col(c) / w)
    a = df.where(F.col(end_number) == 1).select(name, "tid", (F.col("pos") + F.col("len")).alias("__p1")).withColumn("__b", bin_of("__p1"))
    b = df.where(F.col(end_number) == 2).select(name, "tid", F.col("pos").alias("__p2"))
    b = b.withColumn("__b", F.explode(F.sequence(bin_of("__p2") - 1, bin_of("__p2") + 1)))
    x = a.join(b, [name, "tid", "__b"]).withColumn("distance", F.abs(F.col("__p2") - F.col("__p1")))
    return x.where(F.col("distance") <= max_distance).select(name, "tid", "distance")


def unnamed(name: str) -> Column:
    """Whether a record has no name: null, empty or the placeholder."""
    return F.coalesce(F.col(name).isin("", "*"), F.lit(True))


def validate(found: DataFrame, truth: DataFrame, name: str = "qname", hard: bool = False) -> DataFrame:
    """Each found record with its verdict: unmapped, unknown, right or wrong.

    soft: contig, start and strand agree; hard: the end as well. The truth has one row a name (the
    last one given wins, by ``ord``). Unmapped is the bit, not the whole flag. Records without a name are unknown.
    """
    w = Window.partitionBy(name).orderBy(F.desc("ord"))
    t = truth.where(~unnamed(name)).withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
    t = t.select(F.col(name), F.col("tid").alias("t_tid"), F.col("pos").alias("t_pos"), F.col("end").alias("t_end"), F.col("strand").alias("t_strand"))
    x = found.join(t, name, "left")
    same = (F.col("tid") == F.col("t_tid")) & (F.col("pos") == F.col("t_pos")) & (F.col("strand") == F.col("t_strand"))
    if hard:
        same = same & (F.col("end") == F.col("t_end"))
    verdict = F.when(has("flag", UNMAP), "unmapped").when(F.col("t_tid").isNull(), "unknown").when(same, "right").otherwise("wrong")
    return x.withColumn("verdict", verdict)


def validation_counts(verdicts: DataFrame) -> DataFrame:
    """mapped, not mapped, right and wrong, with their shares of mapped + not mapped."""
    n = lambda *v: F.coalesce(F.sum(F.col("verdict").isin(*v).cast("bigint")), F.lit(0)).cast("bigint")
    x = verdicts.agg(n("right", "wrong").alias("mapped"), n("unmapped", "unknown").alias("not_mapped"), n("right").alias("right_mapped"), n("wrong").alias("wrong_mapped"))
    total = F.greatest(F.col("mapped") + F.col("not_mapped"), F.lit(1)).cast("double")
    for c in ("mapped", "not_mapped", "right_mapped", "wrong_mapped"):
        x = x.withColumn(f"{c}_share", F.round(F.col(c) / total, 6))
    return x


def fix_mates(df: DataFrame, ordinal: str = "ord", name: str = "qname", mode: str = "intended") -> DataFrame:
    """Mate fields of name-sorted records: the 1st and 2nd record of a name, the 3rd and 4th and so on
    are mates; one left over is a singleton. The insert size runs between the 5' ends. Records without a name
    have no mates, so they are no group of one task either."""
    w = Window.partitionBy(name, F.when(unnamed(name), F.xxhash64(ordinal))).orderBy(ordinal)
    x = df.withColumn("__n", F.row_number().over(w))
    five = F.when(has("flag", REVERSE), end_pos("pos", "cigar", mode)).otherwise(F.col("pos"))
    x = x.withColumn("__five", five)
    first = F.col("__n") % 2 == 1
    mate = lambda c: F.when(first, F.lead(c).over(w)).otherwise(F.lag(c).over(w))
    x = x.withColumns({f"__{c}": mate(c) for c in ("tid", "pos", "flag", "__five")})
    paired = F.col("__flag").isNotNull()
    both = ~has("flag", UNMAP | MUNMAP) & ~has("__flag", UNMAP | MUNMAP) & (F.col("tid") == F.col("__tid"))
    flag = F.col("flag")
    set_ = lambda f, bit, on: F.when(on, f.bitwiseOR(F.lit(bit))).otherwise(f.bitwiseAND(F.lit(~bit)))
    mated = set_(flag, MREVERSE, has("__flag", REVERSE))
    mated = F.when(has("__flag", UNMAP), mated.bitwiseOR(F.lit(MUNMAP)).bitwiseAND(F.lit(~PROPER))).otherwise(mated)
    lone = F.when(has("flag", PAIRED), flag.bitwiseOR(F.lit(MUNMAP)).bitwiseAND(F.lit(~(MREVERSE | PROPER)))).otherwise(flag)
    return x.withColumns({
        "mtid": F.when(paired, F.col("__tid")).otherwise(-1),
        "mpos": F.when(paired, F.col("__pos")).otherwise(-1),
        "isize": F.when(paired & both, F.col("____five") - F.col("__five")).otherwise(0),
        "flag": F.when(paired, mated).otherwise(lone).cast("int"),
    }).drop("__n", "__five", "__tid", "__pos", "__flag", "____five")


def compare_by_name(a: DataFrame, b: DataFrame, name: str = "qname", min_quality: int = 10, near: int = 100) -> DataFrame:
    """Outcome counts of two mappings of the same reads (one row a name): where both or one of them is
    confident (mapq >= min_quality) and whether they lie within ``near`` on one contig."""
    side = lambda df, p: df.select(F.col(name), F.col("tid").alias(f"{p}_tid"), F.col("pos").alias(f"{p}_pos"), F.col("mapq").alias(f"{p}_q"))
    x = side(a, "a").join(side(b, "b"), name, "full_outer")
    good = lambda p: F.coalesce(F.col(f"{p}_q") >= min_quality, F.lit(False))
    place = (
        F.when(F.col("a_tid").isNull(), "only_b").when(F.col("b_tid").isNull(), "only_a")
        .when((F.col("a_tid") == F.col("b_tid")) & (F.abs(F.col("a_pos") - F.col("b_pos")) < near), "same").otherwise("different")
    )
    sure = F.when(good("a") & good("b"), "both").when(good("a"), "a").when(good("b"), "b").otherwise("none")
    return x.groupBy(place.alias("place"), sure.alias("confident")).agg(F.count(F.lit(1)).alias("n_reads"))
