"""Phasing: which alleles of heterozygous sites stand on one chromosome, from reads that cover several of them.

Sites that reads join directly or over others form a block; blocks are independent, so each is a group of its own. Inside
a block a path over windows of ``k`` neighbouring sites is looked for: a state is the alleles of one haplotype in the window, and a
read piece counts as many matches as it has with that haplotype or with the other one, whichever is more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.intervals import stretches_and_gaps
from readloom.operators.joins import interval_join
from readloom.session import materialize


def pieces(site: np.ndarray, allele: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(first site, mask, alleles) of a read's calls, cut so that each spans at most ``k`` sites; neighbouring pieces share a call."""
    out, a = [], 0
    while a < len(site) - 1:
        b = int(np.searchsorted(site, site[a] + k))
        if b - a < 2:
            a += 1
            continue
        at = site[a:b] - site[a]
        out.append((int(site[a]), int((1 << at).sum()), int((allele[a:b].astype(np.int64) << at).sum())))
        if b >= len(site):
            break
        a = b - 1
    return out


def best_haplotype(n: int, reads: list[tuple[int, int, int]], k: int) -> np.ndarray:
    """Alleles of ``n`` sites on the haplotype with the first site's 0 that the pieces fit best."""
    k = min(k, n)
    states = np.arange(1 << k)
    starts = n - k + 1
    by: list[dict[tuple[int, int], int]] = [{} for _ in range(starts)]
    for first, mask, bits in reads:
        i = min(first, starts - 1)
        key = (mask << (first - i), bits << (first - i))
        by[i][key] = by[i].get(key, 0) + 1
    score, back = np.zeros(1 << k), []
    for i in range(starts):
        if i:
            before = (states & ((1 << (k - 1)) - 1)) << 1
            pick = score[before | 1] > score[before]
            back.append(pick)
            score = np.maximum(score[before], score[before | 1])
        for (mask, bits), times in by[i].items():
            wrong = np.bitwise_count((states ^ bits) & mask)
            score = score + times * np.maximum(wrong, mask.bit_count() - wrong)
    state = int(score.argmax())
    out = [(state >> t) & 1 for t in range(k)][::-1]
    for pick in reversed(back):
        d = int(pick[state])
        out.append(d)
        state = ((state & ((1 << (k - 1)) - 1)) << 1) | d
    haplotype = np.array(out[::-1], np.int8)
    return haplotype ^ haplotype[0]


def phased(calls: DataFrame, k: int = 8) -> DataFrame:
    """(tid, block, kind, pos, read, haplotype) of calls (tid, pos, read, allele 0 or 1) at heterozygous sites.

    ``kind`` ``site``: the allele of the site on haplotype 0 of its block. ``read``: the haplotype most of the read's calls agree
    with, 2 on a tie. A block is named by its first site. Reads with one call join nothing and are left out; of repeated
    calls of a read at a site the lesser allele counts; null calls don't.
    """
    # one exchange serves both groupings; a call is one number, twice its place and the allele
    x = calls.where("allele in (0, 1) and pos is not null and read is not null").repartition("tid", "read")
    x = x.groupBy("tid", "read", "pos").agg(F.min("allele").cast("bigint").alias("allele"))
    reads = x.groupBy("tid", "read").agg(F.min("pos").alias("beg"), F.max("pos").alias("end"), F.array_sort(F.collect_list(F.col("pos").cast("bigint") * 2 + F.col("allele"))).alias("calls")).where("beg < `end`")
    reads = materialize(reads, "reads")
    blocks = stretches_and_gaps(reads, ["tid"], "beg", "end").where("kind = 'covered'").select("tid", F.col("seg_start").cast("int").alias("block"), F.col("seg_end").cast("int").alias("stop"))
    joined = interval_join(reads.withColumn("one", F.col("beg") + 1), blocks, "tid", "beg", "one", "block", "stop").select("tid", "block", "read", "calls")
    kind = joined.schema["read"].dataType.simpleString()

    def solved(tid: int, block: int, reads_: list, calls_: list) -> list[tuple]:
        every = np.array([c for calls in calls_ for c in calls], np.int64)
        cuts = np.cumsum([len(calls) for calls in calls_])[:-1]
        sites, where = np.unique(every >> 1, return_inverse=True)
        own = list(zip(np.split(where, cuts), np.split(every & 1, cuts)))
        haplotype = best_haplotype(len(sites), [p for s, a in own for p in pieces(s, a, k)], k)
        out = [(tid, block, "site", p, None, h) for p, h in zip(sites.tolist(), haplotype.tolist())]
        for read, (s, a) in zip(reads_, own):
            twice = 2 * int((haplotype[s] == a).sum())
            out.append((tid, block, "read", None, read, 0 if twice > len(a) else 1 if twice < len(a) else 2))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reads_, calls_, out = None, [], [], []

        def batch() -> pa.RecordBatch:
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), kinds[0], pa.int32()]
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["tid", "block", "kind", "pos", "read", "haplotype"])
            out.clear()
            return done

        for b in batches:
            kinds = [b.schema.field("read").type]
            for tid, block, read, calls in zip(*(b.column(c).to_pylist() for c in ("tid", "block", "read", "calls"))):
                if (tid, block) != key:
                    if key is not None:
                        out += solved(*key, reads_, calls_)
                    key, reads_, calls_ = (tid, block), [], []
                reads_.append(read)
                calls_.append(calls)
            if len(out) > 5_000:
                yield batch()
        if key is not None:
            out += solved(*key, reads_, calls_)
        if out:
            yield batch()

    # a number of its own: the work is far more than the bytes by which small partitions would be put together
    parts = int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = joined.repartition(parts, "tid", "block").sortWithinPartitions("tid", "block", "read")
    return joined.mapInArrow(run, f"tid int, block int, kind string, pos bigint, read {kind}, haplotype int")
