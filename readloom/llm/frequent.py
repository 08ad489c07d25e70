"""Most frequent items in bounded memory: lossy counting with mergeable summaries.

Each task keeps (item, count, delta) entries; delta is the most that can have been missed before the
entry was made. At every boundary of a bucket of ``width`` rows, entries with count + delta not above
the number of buckets are dropped. An item's true count in the task lies in [count, count + delta],
or in [0, buckets] if it has no entry; the rows behind the last full bucket are not pruned and add nothing to that.
Summaries are merged by adding: a task without the item adds its number of full buckets to the undercount. Over
all tasks the undercount is at most rows / width.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.session import materialize

SUMMARY = "item string, n bigint, delta bigint, buckets bigint"
_SCHEMA = pa.schema([("item", pa.string()), ("n", pa.int64()), ("delta", pa.int64())])


def _summaries(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = _SCHEMA.empty_table()
        waiting: list[pa.Array] = []
        rows, bucket = 0, 1

        def close(full: bool) -> pa.Table:
            vc = pa.chunked_array(waiting, pa.string()).value_counts()
            fresh = pa.table([vc.field("values"), vc.field("counts"), pa.array([bucket - 1] * len(vc), pa.int64())], schema=_SCHEMA)
            both = pa.concat_tables([entries, fresh]).group_by("item").aggregate([("n", "sum"), ("delta", "min")])
            both = both.select(["item", "n_sum", "delta_min"]).rename_columns(["item", "n", "delta"])
            # an entry that was there keeps its delta: it is never above bucket - 1
            return both.filter(pc.greater(pc.add(both["n"], both["delta"]), bucket)) if full else both

        for b in batches:
            column, at = b.column(0), 0
            while at < len(column):
                take = min(len(column) - at, width - rows)
                waiting.append(column.slice(at, take))
                at += take
                rows += take
                if rows == width:
                    entries = close(True)
                    waiting, rows, bucket = [], 0, bucket + 1
        if rows:
            entries = close(False)
        buckets = bucket - 1
        if entries.num_rows or buckets:
            out = entries.append_column("buckets", pa.array([buckets] * entries.num_rows, pa.int64()))
            # one row without an item tells how many full buckets this task had
            head = pa.table([pa.nulls(1, pa.string()), [0], [0], [buckets]], schema=out.schema)
            yield from pa.concat_tables([head, out]).to_batches(max_chunksize=20_000)

    return run


def _merged(df: DataFrame, item: Column, width: int) -> tuple[DataFrame, DataFrame]:
    """(item, at_least, at_most) and, as one row, the most rows an item without an entry can have."""
    x = df.select(item.cast("string").alias("item")).where("item is not null")
    summary = materialize(x.mapInArrow(_summaries(width), SUMMARY), "lossy")
    bound = summary.where("item is null").agg(F.coalesce(F.sum("buckets"), F.lit(0)).alias("b"))
    merged = summary.where("item is not null").groupBy("item").agg(
        F.sum("n").alias("at_least"), F.sum(F.col("buckets") - F.col("delta")).alias("known")
    )
    return merged.select("item", "at_least", (F.col("at_least") + bound.scalar() - F.col("known")).alias("at_most")), bound


def lossy_counts(df: DataFrame, item: Column, width: int = 50_000) -> DataFrame:
    """The merged summary: (item, at_least, at_most) of every item some task kept an entry of.

    The true count of an item lies in the interval; an item without a row here has at most
    rows / width rows. Null items are not counted; an empty table gives no rows.
    """
    return _merged(df, item, width)[0]


def most_frequent(df: DataFrame, item: Column, k: int, width: int = 50_000, exact: bool = True, max_width: int = 1 << 22) -> DataFrame:
    """The ``k`` most frequent items: (item, at_least, at_most, n_rows, complete), ties at the last place kept.

    Candidates are all items whose interval reaches the k-th largest guaranteed count. Where that count does not
    pass what an item without an entry may have (a column that is nearly flat), the buckets are made eight
    times as wide and the items counted again, up to ``max_width``, which bounds the memory of a task; ``complete`` says
    whether it passes in the end, so that no item outside can be among the k. With ``exact`` a second pass counts the
    candidates, and only them, behind a semi join by item. Without ``exact`` n_rows is null and the k best by
    ``at_least`` come back. Null items don't count, fewer than k items give fewer rows, an empty table none.
    """
    while True:
        merged, bound = _merged(df, item, width)
        counts = materialize(merged, "lossy-counts")
        missed = bound.first()["b"]
        top = [r["at_least"] for r in counts.orderBy(F.desc("at_least")).select("at_least").limit(k).collect()]
        floor = top[-1] if len(top) == k else 0
        complete = missed == 0 or floor > missed
        if complete or width >= max_width:
            break
        width = min(8 * width, max_width)
    if exact:
        # written, so that Spark knows their size when it chooses the join
        candidates = materialize(counts.where(F.col("at_most") >= floor), "candidates")
        rows = df.select(item.cast("string").alias("item")).join(candidates.select("item"), "item", "left_semi")
        # counted per task before the shuffle, so an item with a third of all rows is a row of each task
        candidates = candidates.join(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n_rows")), "item")
        by = "n_rows"
    else:
        candidates, by = counts.withColumn("n_rows", F.lit(None).cast("bigint")), "at_least"
    best = candidates.orderBy(F.desc(by)).limit(k).agg(F.min(by).alias("m")).scalar()
    return candidates.where(F.col(by) >= best).withColumn("complete", F.lit(complete))
