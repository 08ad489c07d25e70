"""FLAG tests and renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.schema import FLAG_LETTERS, MREVERSE, REVERSE


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def has(flag: Column | str, bits: int) -> Column:
    """Any of the bits is set."""
    return _c(flag).bitwiseAND(F.lit(bits)) != 0


def has_all(flag: Column | str, bits: int) -> Column:
    return _c(flag).bitwiseAND(F.lit(bits)) == bits


def strand(flag: Column | str) -> Column:
    return F.when(has(flag, REVERSE), 1).otherwise(0)


def mate_strand(flag: Column | str) -> Column:
    return F.when(has(flag, MREVERSE), 1).otherwise(0)


def letters(flag: Column | str) -> Column:
    """The letters of the set bits, lowest bit first."""
    return F.concat(*[F.when(has(flag, 1 << i), F.lit(c)).otherwise(F.lit("")) for i, c in enumerate(FLAG_LETTERS)])


def hexadecimal(flag: Column | str) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(_c(flag).cast("bigint"))))
