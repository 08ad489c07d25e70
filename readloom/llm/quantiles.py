"""Percentiles with guaranteed relative error from mergeable logarithmic buckets.

A value v != 0 falls into bucket ceil(log(|v|) / log(gamma)) of its sign, gamma = (1 + a) / (1 - a);
every value of the bucket is within the relative error ``a`` of 2 * gamma ** i / (gamma + 1). A sketch
is nothing but bucket counts, so sketches of partitions, days or runs are combined by adding counts.
Everything is a native aggregate: tasks send one state per (group, bucket), never values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gamma_of(error: float) -> float:
    return (1 + error) / (1 - error)


def sketch(df: DataFrame, groups: Sequence[str], value: Column | str, error: float = 0.01) -> DataFrame:
    """Bucket counts: (groups, sgn, bucket, n).

    Null and NaN values are not counted and infinite ones neither; zero has a bucket of its own; a
    null group is a group of its own; repeated rows count again; an empty table gives no rows.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    lg = math.log(gamma_of(error))
    x = df.select(*groups, v.alias("__v")).where("__v is not null and not isnan(__v) and abs(__v) < double('infinity')")
    bucket = F.when(F.col("__v") != 0, F.ceil(F.log(F.abs("__v")) / F.lit(lg))).otherwise(F.lit(0)).cast("int")
    return x.groupBy(*groups, F.signum("__v").cast("int").alias("sgn"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sketches of finer groups, of days or of partitions, added up to ``groups``."""
    return sketches.groupBy(*groups, "sgn", "bucket").agg(F.sum("n").cast("bigint").alias("n"))


def percentiles(sketches: DataFrame, groups: Sequence[str], ps: dict[str, float], error: float = 0.01) -> DataFrame:
    """(groups, n_values, one column per percentile); ``ps``: name -> p in [0, 1].

    The value has rank floor(p * (n - 1)) among the n sorted values of the group, with a relative
    error of at most ``error``. A group's window holds its buckets, whose number is bounded by the
    range of doubles, not by the rows.
    """
    g = gamma_of(error)
    w = Window.partitionBy(*groups)
    rank = F.col("sgn") * F.col("bucket")
    upto = F.sum("n").over(w.orderBy("sgn", rank).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = sketches.withColumn("__upto", upto).withColumn("__all", F.sum("n").over(w))
    # a power first: 2 / (gamma + 1) is applied to it in one fixed order
    x = x.withColumn("__value", F.col("sgn") * (F.lit(2 / (g + 1)) * F.pow(F.lit(g), F.col("bucket").cast("double"))))
    found = {
        name: F.min(F.when(F.col("__upto") > F.floor(F.lit(p) * (F.col("__all") - 1)), F.struct("sgn", rank.alias("r"), F.col("__value").alias("v"))))
        for name, p in ps.items()
    }
    out = x.groupBy(*groups).agg(F.max("__all").alias("n_values"), *[c.getField("v").alias(name) for name, c in found.items()])
    return out
