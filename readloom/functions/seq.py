"""Sequence expressions over strings of bases; native throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sixteen IUPAC codes; the place of a code is the bit set of its bases (A 1, C 2, G 4, T 8).
IUPAC = "=ACMGRSVTWYHKDBN"
_COMPLEMENT = ("ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(_c(seq), *_COMPLEMENT))


def base_count(seq: Column | str, bases: str) -> Column:
    """How many characters are among ``bases``."""
    s = _c(seq)
    return F.length(s) - F.length(F.translate(s, bases, ""))


def word_count(seq: Column | str, word: str) -> Column:
    """Occurrences of a word that can't overlap itself."""
    s = _c(seq)
    return ((F.length(s) - F.length(F.replace(s, F.lit(word), F.lit("")))) / len(word)).cast("int")


def subsequence(seq: Column | str, beg: Column | str, end: Column | str) -> Column:
    """Bases of [beg, end), 0-based, clipped to the sequence."""
    s, b = _c(seq), F.greatest(_c(beg), F.lit(0))
    return F.substring(s, b + 1, F.greatest(_c(end) - b, F.lit(0)))


def wrap(seq: Column | str, width: int = 60) -> Column:
    """Lines of ``width`` characters joined by line breaks, none at the end."""
    return F.regexp_replace(_c(seq), f"(.{{{width}}})(?=.)", "$1\n")


def bits(base: Column) -> Column:
    """The bit set of an IUPAC code; unknown characters count as N."""
    at = F.instr(F.lit(IUPAC), F.upper(base)) - 1
    return F.when(at < 0, 15).otherwise(at)


def code(bit_set: Column) -> Column:
    return F.substring(F.lit(IUPAC), bit_set + 1, F.lit(1))


def combine(a: Column | str, b: Column | str, how: str = "or") -> Column:
    """Base by base union (or) or intersection (and) of two sequences; an empty intersection is N, the
    longer sequence is cut."""
    n = F.least(F.length(_c(a)), F.length(_c(b)))
    left, right = (F.split(F.substring(_c(x), F.lit(1), n), "") for x in (a, b))

    def one(x: Column, y: Column) -> Column:
        both = bits(x).bitwiseOR(bits(y)) if how == "or" else bits(x).bitwiseAND(bits(y))
        return F.when(both == 0, "N").otherwise(code(both))

    return F.array_join(F.zip_with(left, right, one), "")


def mask_by(seq: Column | str, mask: Column | str, codes: str = "x") -> Column:
    """Lower-cases the bases whose place in the mask holds one of ``codes``."""
    n = F.least(F.length(_c(seq)), F.length(_c(mask)))
    s, m = (F.split(F.substring(_c(x), F.lit(1), n), "") for x in (seq, mask))
    return F.array_join(F.zip_with(s, m, lambda b, k: F.when(F.instr(F.lit(codes), k) > 0, F.lower(b)).otherwise(b)), "")


def mask_intervals(seq: Column | str, intervals: Column | str, fill: str = "N") -> Column:
    """Overwrites [beg, end) of each interval with ``fill``, or lower-cases it with fill=''."""
    s = _c(seq)

    def one(acc: Column, iv: Column) -> Column:
        b, e = F.greatest(iv["beg"], F.lit(0)), F.least(iv["end"], F.length(s))
        n = F.greatest(e - b, F.lit(0))
        new = F.repeat(F.lit(fill), n) if fill else F.lower(F.substring(acc, b + 1, n))
        return F.when(n > 0, F.overlay(acc, new, b + 1, n)).otherwise(acc)

    return F.aggregate(_c(intervals), s, one)


def mutate(seq: Column | str, pos: Column | str, base: Column | str) -> Column:
    """The base at a 1-based position replaced; positions outside change nothing."""
    s, p = _c(seq), _c(pos)
    return F.when((p >= 1) & (p <= F.length(s)), F.overlay(s, _c(base), p, F.lit(1))).otherwise(s)


def soft_mask_quality(seq: Column | str, qual: Column | str, least: int, offset: int = 33) -> Column:
    """Bases whose quality is below ``least`` in lower case."""
    s, q = F.split(_c(seq), ""), F.split(_c(qual), "")
    return F.array_join(F.zip_with(s, q, lambda b, k: F.when(F.ascii(k) - offset < least, F.lower(b)).otherwise(b)), "")


def random_base(code_: Column, seed: Column) -> Column:
    """One of the bases of a two-base code, chosen by a hash of ``seed``; others as they are."""
    b = bits(code_)
    two = F.bit_count(b) == 2
    low = F.when(b.bitwiseAND(F.lit(1)) > 0, "A").when(b.bitwiseAND(F.lit(2)) > 0, "C").otherwise("G")
    high = F.when(b.bitwiseAND(F.lit(8)) > 0, "T").when(b.bitwiseAND(F.lit(4)) > 0, "G").otherwise("C")
    return F.when(two, F.when(F.instr(F.lit("02468ace"), F.substring(F.md5(seed), 1, 1)) > 0, low).otherwise(high)).otherwise(code_)


def colours(seq: Column | str) -> Column:
    """The colour between each two neighbouring bases (0 to 3), 4 where one of them is not A, C, G or T."""
    s = F.split(F.upper(_c(seq)), "")
    number = lambda b: F.instr(F.lit("ACGT"), b) - 1
    both = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: F.when((number(a) < 0) | (number(b) < 0), "4").otherwise(number(a).bitwiseXOR(number(b)).cast("string")))
    return F.when(F.length(_c(seq)) > 1, F.array_join(both, "")).otherwise("")


def ambiguity(seq: Column | str) -> dict[str, Column]:
    """Bases of two-, three- and four-base codes, and the two-base ones that are transitions (R, Y) or transversions."""
    s = F.upper(_c(seq))
    n = lambda codes: F.length(s) - F.length(F.translate(s, codes, ""))
    return {"n_two": n("RYSWKM"), "n_three": n("BDHV"), "n_four": n("N"), "n_transitions": n("RY"), "n_transversions": n("SWKM")}
