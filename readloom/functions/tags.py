"""Tags of a record: a map from two letters to (type, value)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(aux: Column | str) -> Column:
    return F.col(aux) if isinstance(aux, str) else aux


def tag(aux: Column | str, name: str) -> Column:
    """The value as text, null where there is none."""
    return F.try_element_at(_c(aux), F.lit(name))["value"]


def tag_int(aux: Column | str, name: str) -> Column:
    """The value of an integer tag; 0 where it is missing or of another type."""
    t = F.try_element_at(_c(aux), F.lit(name))
    return F.when(t["type"].isin(*"cCsSiI"), t["value"].cast("bigint")).otherwise(F.lit(0)).cast("bigint")


def tag_float(aux: Column | str, name: str) -> Column:
    """The value of a number tag; 0 where it is missing or of another type."""
    t = F.try_element_at(_c(aux), F.lit(name))
    return F.when(t["type"].isin(*"fdcCsSiI"), t["value"].cast("double")).otherwise(F.lit(0.0))


def has_tag(aux: Column | str, name: str) -> Column:
    return F.map_contains_key(_c(aux), name)


def drop_tags(aux: Column | str, *names: str) -> Column:
    return F.map_filter(_c(aux), lambda k, v: ~k.isin(*names))


def keep_only(aux: Column | str, name: str) -> Column:
    return F.map_filter(_c(aux), lambda k, v: k == name)


def put_tag(aux: Column | str, name: str, type_: str, value: Column) -> Column:
    """With the tag set to the value; a null value leaves the tags as they are."""
    fresh = F.create_map(F.lit(name), F.struct(F.lit(type_).alias("type"), value.cast("string").alias("value")))
    return F.when(value.isNull(), _c(aux)).otherwise(F.map_concat(drop_tags(aux, name), fresh))
