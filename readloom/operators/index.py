"""Indexes of sorted records and of sequences, places by name, display levels, neighbours within reach."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.cigar import end_pos
from readloom.operators.order import position_order, ranked


def placed(df: DataFrame, ordinal: str = "ord") -> DataFrame:
    """(tid, beg, end, rank) of the records in sorted order; the rank stands for the place in the file."""
    x = df.select(ordinal, "tid", "pos", end_pos("pos", "cigar").alias("end"))
    return ranked(x, position_order(ordinal)).select("tid", F.col("pos").alias("beg"), "end", "rank").where("tid >= 0")


def linear_index(x: DataFrame, shift: int = 14) -> DataFrame:
    """(tid, win, first_rank): the first record that reaches into each window of 2**shift bases."""
    win = F.sequence(F.shiftright("beg", shift), F.shiftright(F.col("end") - 1, shift))
    return x.select("tid", F.explode(win).alias("win"), "rank").groupBy("tid", "win").agg(F.min("rank").alias("first_rank"))


def bin_index(x: DataFrame) -> DataFrame:
    """(tid, bin, first_rank, last_rank, n_reads) by the least bin of six levels that holds a record whole."""
    b, e = F.shiftright("beg", 14), F.shiftright(F.col("end") - 1, 14)
    of = F.lit(0)
    for shift, first in ((12, 1), (9, 9), (6, 73), (3, 585), (0, 4681)):
        of = F.when(F.shiftright(b, shift) == F.shiftright(e, shift), F.shiftright(b, shift) + first).otherwise(of)
    x = x.select("tid", of.cast("int").alias("bin"), "rank")
    return x.groupBy("tid", "bin").agg(F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"), F.count(F.lit(1)).alias("n_reads"))


def out_of_order(df: DataFrame, ordinal: str) -> DataFrame:
    """(n_unsorted): records before whose place the one before them in arrival order stands.

    Arrival order is a range partitioning; each task compares its own rows and hands on its edges, one row a task."""
    x = df.select(ordinal, F.struct((F.col("tid") < 0).cast("int").alias("u"), "tid", "pos").alias("k"))
    x = x.repartitionByRange(ordinal).sortWithinPartitions(ordinal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = first = last = None
        wrong = 0
        for b in batches:
            if not b.num_rows:
                continue
            u, t, p = (b.column("k").field(c).to_numpy().astype(np.int64) for c in ("u", "tid", "pos"))
            key = (u << 62) + ((t + 1) << 31) + p
            if first is None:
                at, first = b.column(ordinal)[0].as_py(), int(key[0])
            else:
                wrong += int(key[0] < last)
            wrong += int((key[1:] < key[:-1]).sum())
            last = int(key[-1])
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (at, first, last, wrong)], ["at", "first", "last", "wrong"])

    parts = x.mapInArrow(run, "at bigint, first bigint, last bigint, wrong bigint")
    before = F.lag("last").over(Window.orderBy("at"))
    parts = parts.withColumn("edge", F.coalesce((F.col("first") < before).cast("bigint"), F.lit(0)))
    return parts.agg(F.coalesce(F.sum(F.col("wrong") + F.col("edge")), F.lit(0)).alias("n_unsorted"))


def sequence_index(seqs: DataFrame, order: str, line: int = 60) -> DataFrame:
    """(name, len, offset, line_bases, line_width) of sequences (name, seq) written in this order in lines of ``line`` bases.

    Offsets are running sums taken in two steps over a range partitioning, so no task sees all sequences."""
    n = F.length("seq").cast("bigint")
    x = seqs.select(order, "name", n.alias("len"), (F.octet_length("name") + 2).cast("bigint").alias("__head"))
    x = ranked(x.withColumn("__size", F.col("__head") + F.col("len") + F.floor((F.col("len") + line - 1) / line)), [F.col(order).asc()], "__rank")
    block = x.withColumn("__b", F.expr("(__rank - 1) div 4096"))
    w = Window.partitionBy("__b").orderBy("__rank").rowsBetween(Window.unboundedPreceding, -1)
    sums = block.groupBy("__b").agg(F.sum("__size").alias("__s"))
    sums = sums.select("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    block = block.withColumn("__in", F.coalesce(F.sum("__size").over(w), F.lit(0))).join(sums, "__b")
    return block.select("name", "len", (F.col("__before") + F.col("__in") + F.col("__head")).cast("bigint").alias("offset"), F.lit(line).alias("line_bases"), F.lit(line + 1).alias("line_width"))


def fetch(seqs: DataFrame, regions: DataFrame) -> DataFrame:
    """(name, beg, end, bases) of regions (name, beg, end; half-open) of sequences (name, seq), cut at their ends; regions that
    begin beyond the end, or of no sequence, give nothing."""
    x = regions.join(seqs.select("name", "seq"), "name").where(F.col("beg") < F.length("seq"))
    end = F.least(F.col("end"), F.length("seq").cast("bigint"))
    return x.select("name", "beg", end.alias("end"), F.substring(F.col("seq"), (F.col("beg") + 1).cast("int"), (end - F.col("beg")).cast("int")).alias("bases"))


def ordered_digest(df: DataFrame, order: str, digest: str) -> DataFrame:
    """(n, ordered): one digest over the digests of all rows in their order. The text of all digests is 32 bytes a row, put together in one task: for the sequences of a genome, not for reads."""
    x = df.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(order, digest))).alias("l"))
    return x.select("n", F.md5(F.array_join(F.transform("l", lambda e: e[digest]), "")).alias("ordered"))


def unordered_digest(df: DataFrame, digest: str) -> DataFrame:
    """(x0, x1): the first thirty digits of the digests put together by exclusive or, in two halves; a partial aggregate of any number of rows."""
    part = lambda i: F.lower(F.hex(F.bit_xor(F.conv(F.substring(digest, i, 15), 16, 10).cast("bigint"))))
    return df.agg(part(1).alias("x0"), part(16).alias("x1"))


def display_levels(df: DataFrame, ordinal: str) -> DataFrame:
    """(ordinal, tid, level): the lowest display row, from 1, that is free when a read begins, in the order of places.

    Reads of a contig stream through one task in order; it holds only the rows in use, whose number is the depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tid, busy, free, most = None, [], [], 0
        for b in batches:
            levels = []
            for t, beg, end in zip(b.column("tid").to_pylist(), b.column("beg").to_pylist(), b.column("end").to_pylist()):
                if t != tid:
                    tid, busy, free, most = t, [], [], 0
                while busy and busy[0][0] <= beg:
                    heapq.heappush(free, heapq.heappop(busy)[1])
                if free:
                    level = heapq.heappop(free)
                else:
                    most += 1
                    level = most
                heapq.heappush(busy, (max(end, beg + 1), level))
                levels.append(level)
            yield pa.RecordBatch.from_arrays([b.column(ordinal), b.column("tid"), pa.array(levels, pa.int32())], [ordinal, "tid", "level"])

    x = df.select(ordinal, "tid", "beg", "end").repartition("tid").sortWithinPartitions("tid", "beg", ordinal)
    return x.mapInArrow(run, f"`{ordinal}` {df.schema[ordinal].dataType.simpleString()}, tid int, level int")


def within_reach(df: DataFrame, group: str, place: str, reach: int, width: int = 1 << 16) -> DataFrame:
    """The rows with ``n_near``, the rows of their group at most ``reach`` away, themselves included. Bins with a margin, so a group is many tasks."""
    bins = F.sequence(F.floor((F.col(place) - reach) / width), F.floor((F.col(place) + reach) / width))
    x = df.withColumn("__own", F.floor(F.col(place) / width)).withColumn("__bin", F.explode(bins))
    w = Window.partitionBy(group, "__bin").orderBy(place).rangeBetween(-reach, reach)
    return x.withColumn("n_near", F.count(F.lit(1)).over(w)).where("__bin = __own").drop("__bin", "__own")
