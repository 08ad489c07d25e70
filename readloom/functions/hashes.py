"""Classic 32-bit string hashes as native folds over the characters' codes.

Each is one ``aggregate`` over the bytes of an ASCII string with the wrap done by a mask, so it runs in
the JVM without Python. The multipliers and seeds are fixed values of the published functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF


def _codes(text: Column) -> Column:
    n = F.length(text)
    return F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("bigint"))


def _wrap(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK))


def _fold(text: Column | str, seed: int, step) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.when(t.isNotNull(), F.aggregate(_codes(t), F.lit(seed).cast("bigint"), lambda h, c: _wrap(step(h, c))))


def multiply_add(text: Column | str, factor: int, seed: int = 0) -> Column:
    """h = h * factor + c: BKDR with 131, SDBM with 65599, DJB with 33 from 5381, X31 with 31."""
    return _fold(text, seed, lambda h, c: h * factor + c)


def x31(text: Column | str) -> Column:
    """The hash behind mate-preserving subsampling: the first code, then h * 31 + c."""
    return multiply_add(text, 31)


def bkdr(text: Column | str) -> Column:
    return multiply_add(text, 131)


def sdbm(text: Column | str) -> Column:
    return multiply_add(text, 65599)


def djb(text: Column | str) -> Column:
    return multiply_add(text, 33, 5381)


def rs(text: Column | str) -> Column:
    """h = h * a + c where a itself is multiplied by 378551 after every character, from 63689."""
    t = F.col(text) if isinstance(text, str) else text
    start = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(63689).cast("bigint").alias("a"))

    def product(x: Column, y: Column) -> Column:  # 32 x 32 bits would pass 63: split one factor
        low = _wrap(x.bitwiseAND(F.lit(0xFFFF)) * y)
        high = _wrap(F.shiftright(x, 16) * y)
        return _wrap(low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16))

    folded = F.aggregate(
        _codes(t), start, lambda s, c: F.struct(_wrap(product(s["h"], s["a"]) + c).alias("h"), product(s["a"], F.lit(378551).cast("bigint")).alias("a"))
    )
    return F.when(t.isNotNull(), folded["h"])


def dek(text: Column | str) -> Column:
    """Rotation by 5 and xor, from the length."""
    t = F.col(text) if isinstance(text, str) else text
    step = lambda h, c: _wrap(F.shiftleft(h, 5)).bitwiseXOR(F.shiftright(h, 27)).bitwiseXOR(c)
    return F.when(t.isNotNull(), F.aggregate(_codes(t), F.length(t).cast("bigint"), step))


def js(text: Column | str) -> Column:
    """h ^= (h << 5) + c + (h >> 2), from 1315423911."""
    return _fold(text, 1315423911, lambda h, c: h.bitwiseXOR(_wrap(F.shiftleft(h, 5)) + c + F.shiftright(h, 2)))


def fnv(text: Column | str) -> Column:
    """h = h * 0x811C9DC5 ^ c, from 0."""

    def step(h: Column, c: Column) -> Column:
        low = _wrap(h.bitwiseAND(F.lit(0xFFFF)) * F.lit(0x811C9DC5))
        high = _wrap(F.shiftright(h, 16) * F.lit(0x811C9DC5))
        return _wrap(low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseXOR(c)

    return _fold(text, 0, step)


def bp(text: Column | str) -> Column:
    """h = (h << 7) ^ c."""
    return _fold(text, 0, lambda h, c: _wrap(F.shiftleft(h, 7)).bitwiseXOR(c))


def elf(text: Column | str) -> Column:
    """h = (h << 4) + c with the top four bits folded back; PJW gives the same for 32 bits."""

    def step(h: Column, c: Column) -> Column:
        x = _wrap(F.shiftleft(h, 4) + c)
        top = x.bitwiseAND(F.lit(0xF0000000))
        return x.bitwiseXOR(F.shiftright(top, 24)).bitwiseAND(F.bitwise_not(top))

    return _fold(text, 0, step)


def ap(text: Column | str) -> Column:
    """Two mixing steps by turns, from 0xAAAAAAAA."""
    t = F.col(text) if isinstance(text, str) else text
    start = F.struct(F.lit(0xAAAAAAAA).cast("bigint").alias("h"), F.lit(0).alias("i"))

    def step(s: Column, c: Column) -> Column:
        h = s["h"]
        even = h.bitwiseXOR(_wrap(F.shiftleft(h, 7)).bitwiseXOR(_wrap(c * F.shiftright(h, 3))))
        odd = h.bitwiseXOR(_wrap(F.bitwise_not(_wrap(F.shiftleft(h, 11)) + c.bitwiseXOR(F.shiftright(h, 5)))))
        return F.struct(_wrap(F.when(s["i"] % 2 == 0, even).otherwise(odd)).alias("h"), (s["i"] + 1).alias("i"))

    return F.when(t.isNotNull(), F.aggregate(_codes(t), start, step)["h"])
