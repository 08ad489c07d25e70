"""CIGAR expressions: plain Column builders over the text, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_cigar(cigar: Column | str) -> Column:
    """array<struct<len:int, op:string>>; ``*`` and empty give an empty array, null gives null."""
    c = _c(cigar)
    lens = F.regexp_extract_all(c, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    ops = F.regexp_extract_all(c, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(lens, ops, lambda n, o: F.struct(n.cast("int").alias("len"), o.alias("op")))


def op_sum(cigar: Column | str, ops: str) -> Column:
    """Sum of the lengths of the given operations; 0 where there is none."""
    found = F.regexp_extract_all(_c(cigar), F.lit(rf"(\d+)[{ops}]"), F.lit(1))
    return F.aggregate(found, F.lit(0), lambda a, n: a + n.cast("int"))


def end_pos(pos: Column | str, cigar: Column | str, mode: str = "intended") -> Column:
    """Exclusive end on the reference.

    ``intended`` counts every operation that advances on the reference (M, D, N, =, X); ``reference`` counts
    M, D and N only, as the established tool does.
    """
    return _c(pos) + op_sum(cigar, "MDN=X" if mode == "intended" else "MDN")


def query_len(cigar: Column | str) -> Column:
    return op_sum(cigar, "MIS=X")


def mismatches(cigar: Column | str) -> Column:
    return op_sum(cigar, "IDX")


def aligned_len(cigar: Column | str) -> Column:
    return op_sum(cigar, "MI")


def op_counts(cigar: Column | str) -> dict[str, Column]:
    each = {"n_m": "M", "n_i": "I", "n_d": "D", "n_eq": "=", "n_x": "X", "n_mismatches": "IDX"}
    return {k: op_sum(cigar, v) for k, v in each.items()}


def ref_blocks(pos: Column | str, cigar: Column | str, keep: str = "M=X", advance: str = "MDN=X") -> Column:
    """array<struct<beg, end, op, qbeg>> of the operations in ``keep``: half-open on the reference, with
    the offset on the read where each begins. One pass over the operations."""
    one = F.regexp_extract(_c(cigar), r"^([0-9]+)M$", 1)  # by far the most common shape needs no fold
    plain = lambda n: F.array(F.struct(_c(pos).cast("int").alias("beg"), (_c(pos) + n).cast("int").alias("end"), F.lit("M").alias("op"), F.lit(0).alias("qbeg")))
    start = F.struct(
        _c(pos).cast("int").alias("r"),
        F.lit(0).alias("q"),
        F.array().cast("array<struct<beg:int,end:int,op:string,qbeg:int>>").alias("out"),
    )

    def step(acc: Column, o: Column) -> Column:
        n, op = o["len"], o["op"]
        r = acc["r"] + F.when(F.instr(F.lit(advance), op) > 0, n).otherwise(0)
        q = acc["q"] + F.when(F.instr(F.lit("MIS=X"), op) > 0, n).otherwise(0)
        block = F.struct(acc["r"].alias("beg"), (acc["r"] + n).alias("end"), op.alias("op"), acc["q"].alias("qbeg"))
        out = F.when(F.instr(F.lit(keep), op) > 0, F.concat(acc["out"], F.array(block))).otherwise(acc["out"])
        return F.struct(r.alias("r"), q.alias("q"), out.alias("out"))

    folded = F.aggregate(parse_cigar(cigar), start, step)["out"]
    return F.when((one != "") & F.lit("M" in keep), plain(one.cast("int"))).otherwise(folded)
