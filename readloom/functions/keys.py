"""Read-name keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def read_key(id_seq: Column | str) -> Column:
    """Key of a read name: no surrounding blanks, no ending ``/1`` or ``/2``; case is kept.

    Null, empty, blank and ``*`` ids have no key (null). Plain string functions only, so the whole
    expression stays inside generated code.
    """
    c = F.col(id_seq) if isinstance(id_seq, str) else id_seq
    trimmed = F.btrim(c, F.lit(BLANKS))
    cut = F.when(
        trimmed.endswith("/1") | trimmed.endswith("/2"),
        F.btrim(F.substring(trimmed, F.lit(1), F.length(trimmed) - 2), F.lit(BLANKS)),
    ).otherwise(trimmed)
    return F.when((cut != "") & (cut != "*"), cut)


#: The same rule for the DuckDB side; {c} is the column.
READ_KEY_SQL = (
    "(case when trim(regexp_replace(trim({c}, ' \t\r\n'), '/[12]$', ''), ' \t\r\n') in ('', '*') then null "
    "else trim(regexp_replace(trim({c}, ' \t\r\n'), '/[12]$', ''), ' \t\r\n') end)"
)


def read_key_sql(col: str) -> str:
    return READ_KEY_SQL.replace("{c}", col)


def mate_number(id_seq: Column | str) -> Column:
    """1 or 2 from the ``/1`` / ``/2`` suffix of a read name, else 0; null stays null."""
    c = F.col(id_seq) if isinstance(id_seq, str) else id_seq
    return F.when(c.endswith("/1"), 1).when(c.endswith("/2"), 2).when(c.isNotNull(), 0).cast("int")
