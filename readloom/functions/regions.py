"""Region strings ``name``, ``name:beg`` and ``name:beg-end``, 1-based and closed, with or without thousands separators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: the end of a region that names none
OPEN_END = 1 << 29
_PATTERN = r"^(.+):([0-9][0-9,]*)(?:-([0-9][0-9,]*)?)?$"


def parse_region(text: str) -> tuple[str, int, int]:
    """(name, beg, end), 0-based and half-open. A colon that no numbers follow belongs to the name."""
    text = re.sub(r"\s", "", text)
    m = re.match(_PATTERN, text)
    if not m:
        return text, 0, OPEN_END
    number = lambda s: int(s.replace(",", ""))
    beg = number(m[2])
    return m[1], max(beg - 1, 0), number(m[3]) if m[3] else OPEN_END


def region(text: Column | str) -> Column:
    """struct<name, beg, end> of a column of region strings, as ``parse_region`` reads them; a null stays null."""
    t = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\s", "")
    part = lambda i: F.nullif(F.regexp_replace(F.regexp_extract(t, _PATTERN, i), ",", ""), F.lit("")).cast("bigint")
    whole = ~t.rlike(_PATTERN)
    name = F.when(whole, t).otherwise(F.regexp_extract(t, _PATTERN, 1))
    beg = F.when(whole, F.lit(0)).otherwise(F.greatest(part(2) - 1, F.lit(0)))
    return F.when(t.isNotNull(), F.struct(name.alias("name"), beg.cast("bigint").alias("beg"), F.coalesce(part(3), F.lit(OPEN_END)).cast("bigint").alias("end")))
