"""Record filters; each is a predicate Catalyst pushes to the scan where it can."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.cigar import end_pos, mismatches, query_len
from readloom.functions.flags import has, has_all
from readloom.functions.hashes import x31
from readloom.operators.joins import overlap_semi
from readloom.schema import PAIRED, PILEUP_MASK, PROPER, UNMAP


def criteria(
    chromosome: int | None = None,
    max_mismatches: int | None = None,
    min_length: int | None = None,
    min_quality: int | None = None,
    max_quality: int | None = None,
    max_distance: int | None = None,
) -> list[Column]:
    """One predicate per given criterion; ``chromosome`` is 1-based, tid is not."""
    out: list[Column] = []
    if chromosome is not None:
        out.append(F.col("tid") == chromosome - 1)
    if max_mismatches is not None:
        out.append(mismatches("cigar") <= max_mismatches)
    if min_length is not None:
        out.append(query_len("cigar") >= min_length)
    if min_quality is not None:
        out.append(F.col("mapq").between(min_quality, 256 if max_quality is None else max_quality))
    elif max_quality is not None:
        out.append(F.col("mapq") <= max_quality)
    if max_distance is not None:
        out.append(has("flag", PROPER) & (F.abs("isize") <= max_distance))
    return out


def filter_alignments(df: DataFrame, mode: str = "intended", ordinal: str = "ord", **limits: int | None) -> DataFrame:
    """Records that meet every criterion.

    ``mode='reference'`` reproduces the combined filter of the established tool where it is
    deterministic: it looks at chromosome, least length, least quality and the distance of the
    starts, and once a record has failed nothing more is written, so it is the prefix before the
    first failure in file order.
    """
    if mode == "intended":
        return df.where(reduce(lambda a, b: a & b, criteria(**limits), F.lit(True)))
    kept = {k: v for k, v in limits.items() if k in ("chromosome", "min_length", "min_quality") and v is not None}
    tests = criteria(**kept)
    if limits.get("max_distance") is not None:
        tests.append(F.abs(F.col("pos") - F.col("mpos")) <= limits["max_distance"])
    ok = reduce(lambda a, b: a & b, tests, F.lit(True))
    failed = df.where(~ok).agg(F.min(ordinal).alias("o")).scalar()
    return df.where(failed.isNull() | (F.col(ordinal) < failed))


def subsample(df: DataFrame, fraction: float, name: str = "qname") -> DataFrame:
    """Keeps whole pairs: the decision is a hash of the name. The whole part of ``fraction`` is the seed."""
    seed = int(fraction + 0.499)
    k = (x31(name) + seed).bitwiseAND(F.lit(0xFFFFFFFF))
    return df.where((k % 1024) / F.lit(1024.0) < fraction - seed)


def view(
    df: DataFrame,
    min_quality: int = 0,
    flags_on: int = 0,
    flags_off: int = 0,
    regions: DataFrame | None = None,
    fraction: float = 0.0,
    read_groups: list[str] | None = None,
    library: str | None = None,
    mode: str = "intended",
) -> DataFrame:
    """The view filter. With ``read_groups``, a record without one passes in ``reference`` mode only."""
    x = df.where((F.col("mapq") >= min_quality) & has_all("flag", flags_on) & ~has("flag", flags_off))
    if fraction > 0:
        x = subsample(x, fraction)
    if read_groups is not None:
        keep = F.col("rg").isin(read_groups)
        x = x.where(keep | F.col("rg").isNull() if mode == "reference" else keep)
    if library is not None:
        x = x.where(F.col("lib") == library)
    if regions is not None:
        x = overlap_semi(x.withColumn("__end", end_pos("pos", "cigar", mode)), regions, "tid", "pos", "__end").drop("__end")
    return x


def pileup_reads(df: DataFrame, mask: int = PILEUP_MASK) -> DataFrame:
    return df.where(~has("flag", mask))


def mpileup_reads(df: DataFrame, min_quality: int = 0, exclude_groups: list[str] | None = None, drop_orphans: bool = True, regions: DataFrame | None = None) -> DataFrame:
    """Mapped reads of enough quality, without excluded groups and without paired but improper ones; with ``regions`` those that overlap any."""
    x = df.where(~has("flag", UNMAP) & (F.col("mapq") >= min_quality))
    if exclude_groups:
        x = x.where(F.col("rg").isNull() | ~F.col("rg").isin(exclude_groups))
    if drop_orphans:
        x = x.where(~has("flag", PAIRED) | has("flag", PROPER))
    if regions is not None:
        x = overlap_semi(x.withColumn("__end", end_pos("pos", "cigar")), regions, "tid", "pos", "__end").drop("__end")
    return x


def shifted_quality(qual: Column | str, by: int = 31, offset: int = 33) -> Column:
    """Quality characters of a scale that begins ``by`` higher, brought to this one; what would be below 0 is 0."""
    q = F.split(F.col(qual) if isinstance(qual, str) else qual, "")
    return F.array_join(F.transform(q, lambda c: F.char(F.greatest(F.ascii(c) - by, F.lit(offset)))), "")


def region(df: DataFrame, tid: int, begin: int, end: int, mode: str = "intended") -> DataFrame:
    """Records overlapping [begin, end) of a contig; a read without reference bases counts as one base."""
    stop = F.greatest(end_pos("pos", "cigar", mode), F.col("pos") + 1)
    return df.where((F.col("tid") == tid) & (F.col("pos") < end) & (stop > begin))


def valid(max_tid: int) -> Column:
    """Plausible coordinates: contig numbers in range or -1, positions from -1 on."""
    ok = lambda t, p: (F.col(t) >= -1) & (F.col(t) < max_tid) & (F.col(p) >= -1)
    return ok("tid", "pos") & ok("mtid", "mpos") & F.col("qname").isNotNull() & (F.length("qname") < 255)
