"""Per-key results whose cost does not depend on how the rows spread over the keys.

Every result here is algebraic: each task folds its rows into a bounded hash table of mergeable key
states (Spark's partial hash aggregate, which spills), and only those states are shuffled. A key
with a third of all rows costs one state per task, like any other. A distinct count is not
algebraic, so it is taken in two steps: first over (keys, value), whose shuffle is spread by the
pair, then over keys, whose shuffle again only moves states.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_totals(
    df: DataFrame,
    keys: Sequence[str],
    sums: dict[str, str] | None = None,
    distinct: tuple[str, str] | None = None,
    extremes: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Rows, sums, distinct values and extremes per key.

    ``sums``: output name -> column, nulls count as nothing and a key with only nulls sums to 0.
    ``distinct``: (output name, column), nulls are not values. ``extremes``: column -> (min name,
    max name), null for a key without values. A null key is a key of its own; an empty table gives
    no rows; repeated rows count again; columns that are not named are not read.
    """
    sums, extremes = sums or {}, extremes or {}
    keys = list(keys)
    if distinct is None:
        aggs: list[Column] = [F.count(F.lit(1)).alias("n_rows")]
        aggs += [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(o) for o, c in sums.items()]
        for c, (lo, hi) in extremes.items():
            aggs += [F.min(c).alias(lo), F.max(c).alias(hi)]
        return df.groupBy(*keys).agg(*aggs)
    name, value = distinct
    first = df.groupBy(*keys, F.col(value).alias("__value")).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(c).cast("bigint").alias(f"__s{i}") for i, c in enumerate(sums.values())],
        *[f(c).alias(f"__x{i}{j}") for i, c in enumerate(extremes) for j, f in enumerate((F.min, F.max))],
    )
    aggs = [F.sum("__n").cast("bigint").alias("n_rows"), F.count("__value").alias(name)]
    aggs += [F.coalesce(F.sum(f"__s{i}"), F.lit(0)).cast("bigint").alias(o) for i, o in enumerate(sums)]
    for i, (lo, hi) in enumerate(extremes.values()):
        aggs += [F.min(f"__x{i}0").alias(lo), F.max(f"__x{i}1").alias(hi)]
    return first.groupBy(*keys).agg(*aggs)


def heavy_keys(df: DataFrame, key: str, min_share: float) -> DataFrame:
    """Keys that hold at least ``min_share`` of the rows: (key, n_rows, share).

    Rows with a null key are left out of both numbers; an empty table gives no rows; all keys of
    equal weight are kept. The total is a scalar sub-query over the same partial states.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg(F.sum("n_rows").cast("double").alias("t")).scalar()
    return counts.withColumn("share", F.col("n_rows") / total).where(F.col("share") >= min_share)
