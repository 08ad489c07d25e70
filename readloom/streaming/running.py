"""Statistics over streams of alignment records.

Micro-batches stand for the bounded batches of the batch tools. Running aggregates keep one state a
group. A position-ordered stream is handled by its watermark: a position is final once the head of its contig has
moved beyond it, and a record behind the watermark is an error or is dropped, as asked for. A table in
any order becomes such a stream through ``position_ordered``, which also ends it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.cigar import op_sum
from readloom.functions.flags import has
from readloom.schema import DUP, PAIRED, PROPER, QCFAIL, REVERSE, UNMAP
from readloom.session import remember, shared_dir


#: bytes of files that a batch takes, one file at least: a batch costs seconds of its own, however small
BATCH_BYTES = 256 << 20


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table of the harness as a stream of its files, by bytes or by so many files a batch."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    limit = ("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else ("maxBytesPerTrigger", BATCH_BYTES)
    return spark.readStream.schema(schema).option(*limit).parquet(path if _is_folder(path) else f"{sf_dir}/{name}.parquet*")


def _is_folder(path: str) -> bool:
    import os

    return os.path.isdir(path)


def run_to_table(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there and gives its result as a table.

    Every batch is written to the shared folder under its number, so a batch that is repeated after a
    failure replaces itself. In complete and update mode the last state of a key is what counts;
    complete mode writes whole states and the last one is read. In update mode a batch writes the states of the ``keys``
    it has changed only, which suits results of many rows.
    """
    spark = stream.sparkSession
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{place}/out"
    seen: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        seen.append(number)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/log").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{out}/batch={max(seen)}")
    paths = [f"{out}/batch={n}" for n in sorted(set(seen))]
    if mode == "update" and len(paths) > 1:
        x = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch bigint").option("basePath", out).parquet(*paths)
        x = x.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in stream.columns if c not in keys])
        return x.select(*stream.columns)
    return spark.read.schema(stream.schema).parquet(*paths)


def _n(c: Column) -> Column:
    return F.sum(c.cast("bigint"))


def qc_stats_stream(alignments: DataFrame) -> DataFrame:
    """Running sums behind the QC report; means are taken from them when they are read."""
    return alignments.groupBy().agg(
        F.count(F.lit(1)).alias("num_alignments"), _n(~has("flag", REVERSE)).alias("strand_counter"), _n(F.col("mapq")).alias("quality_sum"), _n(op_sum("cigar", "MIS=X")).alias("length_sum")
    )


def flagstat_stream(alignments: DataFrame) -> DataFrame:
    """Running flag counters by QC bit."""
    each = {"n_mapped": ~has("flag", UNMAP), "n_dup": has("flag", DUP), "n_pair_all": has("flag", PAIRED), "n_pair_good": has("flag", PAIRED) & has("flag", PROPER)}
    return alignments.groupBy(has("flag", QCFAIL).alias("qc_failed")).agg(F.count(F.lit(1)).alias("n_reads"), *[_n(c).alias(k) for k, c in each.items()])


def mapping_counts_stream(mappings: DataFrame) -> DataFrame:
    """Running number of rows per read with both ends on one contig."""
    return mappings.where("tid = mtid and isize < 500").groupBy("id_seq").agg(F.count(F.lit(1)).alias("n_rows"))


def windowed_counts_stream(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Event-time windows with a watermark: rows later than ``late`` behind the newest are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


#: start of the marker that ends a contig; no block starts there
END_OF_CONTIG = (1 << 31) - 1


#: bytes of blocks that a batch of a stream in order takes
ORDERED_BYTES = 32 << 20


def position_ordered(blocks: DataFrame, files: int | None = None) -> DataFrame:
    """Blocks (tid, beg, end) in any order as a stream in the order of their starts: ``files`` of them, one a batch, or as
    many a batch as make ``ORDERED_BYTES``.

    A file holds the blocks of one range of starts on all contigs, so that all contigs advance side by
    side. The last file holds an empty block a contig at ``END_OF_CONTIG``, behind which nothing is open.
    The file source reads by modification time, which is set to the order of the ranges; where a file
    system ignores that, a reader that treats late blocks as an error stops.
    """
    spark = blocks.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = remember(spark, f"{shared_dir(spark)}/ordered-{uuid.uuid4().hex}")
    x = blocks.select("tid", "beg", "end")
    x.repartitionByRange(n, "beg", "tid").write.parquet(f"{place}/blocks")
    ordered = spark.read.schema(x.schema).parquet(f"{place}/blocks")
    marker = F.lit(END_OF_CONTIG)
    ends = ordered.select("tid").distinct().select("tid", *[marker.cast(x.schema[c].dataType).alias(c) for c in ("beg", "end")])
    ends.coalesce(1).write.parquet(f"{place}/ends")
    paths = [*sorted(ordered.inputFiles()), *spark.read.schema(x.schema).parquet(f"{place}/ends").inputFiles()]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for i, p in enumerate(paths):
        where = jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(conf)
        first = fs.getFileStatus(where).getModificationTime() if i == 0 else first
        fs.setTimes(where, first + 1000 * i, -1)
        total += fs.getFileStatus(where).getLen()
    each = 1 if files else max(1, len(paths) * ORDERED_BYTES // max(total, 1))
    return spark.readStream.schema(x.schema).option("maxFilesPerTrigger", min(each, len(paths))).option("recursiveFileLookup", "true").parquet(place)


DEPTH_RUNS = "tid int, beg int, end int, depth bigint"


def _summed(p: list[np.ndarray], d: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Borders in order, each once, with the sums of their steps."""
    at, where = np.unique(np.concatenate(p), return_inverse=True)
    return at, np.bincount(where, np.concatenate(d), len(at)).astype(np.int64)


def depth_runs_stream(blocks: DataFrame, late: str = "error") -> DataFrame:
    """Final depths of a position-ordered stream of blocks (tid, beg, end), as runs of one depth: (tid, beg, end, depth).

    The state of a contig is its open borders, those at or behind the start of its newest block; they
    are bounded by the depth and length of the blocks, not by the contig. A block that starts before
    the newest start of an earlier batch is late: ``error`` stops the query, ``drop`` leaves it out.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        head, positions, steps = state.get if state.exists else (-1, [], [])
        newest, pos, d, held = head, [np.asarray(positions, np.int64)], [np.asarray(steps, np.int64)], 0
        for f in frames:
            b, e = f["beg"].to_numpy(np.int64), f["end"].to_numpy(np.int64)
            behind = b < head
            if behind.any():
                if late == "error":
                    raise ValueError(f"block at {b[behind][0]} on contig {key[0]} comes after {head}")
                b, e = b[~behind], e[~behind]
            newest = max(newest, int(b.max(initial=-1)))
            b, e = b[b < e], e[b < e]
            pos.append(np.concatenate([b, e]))
            d.append(np.repeat(np.array([1, -1]), len(b)))
            held += 2 * len(b)
            if held > 1 << 20:
                p, n = _summed(pos, d)
                pos, d, held = [p], [n], 0
        p, n = _summed(pos, d)
        depth = np.cumsum(n)
        k = int(np.searchsorted(p, newest))
        # the run at the newest start is cut there and goes on with the depth it has
        open_ = int(depth[k - 1]) if k else 0
        left, more = p[k:], n[k:]
        if open_:
            left, more = np.concatenate([[newest], left]), np.concatenate([[open_], more])
        state.update((newest, left.tolist(), more.tolist()))
        ends = np.append(p[1:k], newest)[:k]
        some = (depth[:k] > 0) & (p[:k] < ends)
        yield pd.DataFrame({"tid": np.full(int(some.sum()), key[0]), "beg": p[:k][some], "end": ends[some], "depth": depth[:k][some]})

    return blocks.groupBy("tid").applyInPandasWithState(step, DEPTH_RUNS, "head int, positions array<int>, steps array<bigint>", "append", "NoTimeout")


def positions_of(runs: DataFrame) -> DataFrame:
    """(tid, pos, depth), a row a position of runs."""
    return runs.select("tid", F.explode(F.sequence(F.col("beg"), F.col("end") - 1)).alias("pos"), "depth")


def depth_stream(blocks: DataFrame, late: str = "error") -> DataFrame:
    """``depth_runs_stream`` by position: (tid, pos 0-based, depth)."""
    return positions_of(depth_runs_stream(blocks, late))
