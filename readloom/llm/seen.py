"""Has this key been seen before?

Rows are spread by key hash and every task reads its rows in arrival order. Keys that are new go into
an exact set, the current batch; when that set is full it is sealed: a minimal perfect hash and a
fingerprint array replace it and the keys are forgotten. Later rows probe the sealed sets by
fingerprint at the computed slot and the current batch exactly. Batches double up to ``max_batch``
keys, so a task with n keys holds about n * (fp_bits + 6) bits and few sets.

A key with a third of all rows would fill one task. Before the shuffle, each Arrow batch keeps only
the first row of a key as a candidate; its later rows are already known to be seen and travel without
their key to an arbitrary task. So a hot key costs one candidate per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.perfect import SealedSet

#: kinds of row in the shuffle: sealed sets of a store come first, then earlier keys, then candidates in order,
#: then decided rows
SEALED, KNOWN, CANDIDATE, DECIDED = -1, 0, 1, 2
_SHUFFLED = "part bigint, kind tinyint, ord bigint, h bigint, fp int, key string"
_LAST = np.iinfo(np.int64).max


def _first_rows(buckets: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            order = b.column("ord").to_numpy(zero_copy_only=False)
            code = b.column("key").dictionary_encode().indices.to_numpy()
            first = np.full(int(code.max()) + 1, _LAST)
            np.minimum.at(first, code, order)
            later = order > first[code]
            kept = b.filter(pa.array(~later))
            part = kept.column("h") if buckets is None else pa.array(_bucket(kept.column("h").to_numpy(), buckets))
            yield pa.RecordBatch.from_arrays(
                [part, pa.array(np.full(kept.num_rows, CANDIDATE, np.int8)), *(kept.column(c) for c in ("ord", "h", "fp", "key"))],
                ["part", "kind", "ord", "h", "fp", "key"],
            )
            o = order[later]
            if len(o):
                spread = (o.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                nulls = [pa.nulls(len(o), t) for t in (pa.int64(), pa.int32(), pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spread), pa.array(np.full(len(o), DECIDED, np.int8)), pa.array(o), *nulls],
                    ["part", "kind", "ord", "h", "fp", "key"],
                )

    return run


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a store: the upper half of the hash, so that it says nothing about the slots."""
    return ((h.view(np.uint64) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


class CurrentBatch:
    """The exact set of keys met since the last sealing, with their first arrival number, hash and fingerprint."""

    def __init__(self) -> None:
        self.slots: dict[str, int] = {}
        self.data = np.empty((3, 1024), np.int64)

    def __len__(self) -> int:
        return len(self.slots)

    def fold(self, keys: pa.Array, order: np.ndarray, h: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """For each row whether its key came with a smaller number, in these rows or before; new keys are added."""
        coded = keys.dictionary_encode()
        code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        first = np.full(len(names), _LAST)
        np.minimum.at(first, code, order)
        row = np.zeros(len(names), np.int64)
        row[code[::-1]] = np.arange(len(code))[::-1]
        slot = np.fromiter(map(self.slots.get, names, repeat(-1)), np.int64, len(names))
        before = np.where(slot >= 0, self.data[0, slot], _LAST)
        fresh = np.flatnonzero(slot < 0)
        n = len(self.slots)
        if n + len(fresh) > self.data.shape[1]:
            self.data = np.concatenate([self.data, np.empty((3, max(n, len(fresh))), np.int64)], axis=1)
        at = row[fresh]
        self.data[:, n : n + len(fresh)] = first[fresh], h[at], fp[at]
        self.slots.update(zip(map(names.__getitem__, fresh.tolist()), range(n, n + len(fresh))))
        return np.minimum(first, before)[code] < order

    def seal(self, before: int | None, fp_type: type) -> SealedSet | None:
        """The set of the keys first met before this arrival number, which are forgotten; a tie must stay exact."""
        order, h, fp = self.data[:, : len(self.slots)]
        done = np.ones(len(order), bool) if before is None else order < before
        if not done.any():
            return None
        names = list(self.slots)
        out = SealedSet(h[done].view(np.uint64), fp[done].astype(fp_type))
        left = np.flatnonzero(~done)
        self.slots = {names[i]: k for k, i in enumerate(left.tolist())}
        self.data[:, : len(left)] = self.data[:, left]
        return out


def _fp_type(bits: int) -> type:
    return np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32


def _decide(batch_keys: int, max_batch: int, buckets: int | None = None, fp_bits: int = 32):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored: dict[int, list[SealedSet]] = {}
        sealed: list[SealedSet] = []
        current = CurrentBatch()
        limit, known_open = batch_keys, False

        def seal(before: int | None) -> None:
            nonlocal limit
            done = current.seal(before, _fp_type(fp_bits))
            if done is not None:
                sealed.append(done)
                limit = min(2 * limit, max_batch)

        for b in batches:
            kind = b.column("kind").to_numpy()
            for what in np.unique(kind):
                part = b.filter(pa.array(kind == what))
                if what == DECIDED:
                    yield pa.RecordBatch.from_arrays([part.column("ord"), pa.array(np.ones(part.num_rows, bool))], ["ord", "seen"])
                    continue
                if what == SEALED:
                    for k, data in zip(part.column("part").to_pylist(), part.column("sealed").to_pylist()):
                        stored.setdefault(k, []).append(SealedSet.from_bytes(data))
                    continue
                h, fp = part.column("h").to_numpy(), part.column("fp").to_numpy()
                hu, fu = h.view(np.uint64), fp.view(np.uint32).astype(_fp_type(fp_bits))
                seen = np.zeros(part.num_rows, bool)
                if what == CANDIDATE and known_open:
                    seal(None)
                    known_open = False
                if stored:  # a bucket's keys meet only its own sets
                    at = _bucket(h, buckets)
                    for k in np.unique(at).tolist():
                        for s in stored.get(k, ()):
                            left = np.flatnonzero(~seen & (at == k))
                            seen[left] = s.contains(hu[left], fu[left])
                for s in sealed:
                    left = np.flatnonzero(~seen)
                    if not len(left):
                        break
                    seen[left] = s.contains(hu[left], fu[left])
                left = np.flatnonzero(~seen)
                order = part.column("ord").to_numpy()
                if len(left):
                    seen[left] = current.fold(part.column("key").take(pa.array(left)), order[left], h[left], fu[left].astype(np.int64))
                if what == KNOWN:
                    known_open = True
                    if len(current) >= limit:
                        seal(None)
                    continue
                if len(current) >= limit:
                    seal(int(order[-1]))
                yield pa.RecordBatch.from_arrays([part.column("ord"), pa.array(seen)], ["ord", "seen"])

    return run


def _hashed(df: DataFrame, key: Column, order: Column, fp_bits: int = 32) -> DataFrame:
    x = df.select(key.cast("string").alias("key"), F.coalesce(order.cast("bigint"), F.lit(_LAST)).alias("ord")).where("key is not null")
    return x.select(
        "ord", F.xxhash64("key").alias("h"), F.shiftright(F.xxhash64(F.lit(7), "key"), 64 - fp_bits).cast("int").alias("fp"), "key"
    )


def seal_keys(keys: DataFrame, key: Column, buckets: int = 1024, batch_keys: int = 1 << 20) -> DataFrame:
    """A store of keys without the keys: (bucket, buckets, sealed), to be written as a table.

    Later calls of ``seen_before`` take it as ``store``; stores of several days with the same number of
    buckets are combined by union. Null keys are left out, repeated keys are kept once a batch. A bucket
    gives one set for every ``batch_keys`` keys, so a task never holds more keys than that.
    """
    x = keys.select(key.cast("string").alias("key")).where("key is not null").select(F.xxhash64("key").alias("h"), F.shiftright(F.xxhash64(F.lit(7), "key"), 32).cast("int").alias("fp"))
    x = x.dropDuplicates(["h", "fp"]).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 32), F.lit(buckets)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            rows = np.concatenate(held)
            held.clear()
            sets = [rows[rows[:, 0] == k] for k in np.unique(rows[:, 0])]
            data = [SealedSet(s[:, 1].view(np.uint64).copy(), s[:, 2].astype(np.uint32)).to_bytes() for s in sets]
            return pa.RecordBatch.from_arrays(
                [pa.array([int(s[0, 0]) for s in sets], pa.int32()), pa.array([buckets] * len(sets), pa.int32()), pa.array(data, pa.binary())], ["bucket", "buckets", "sealed"]
            )

        for b in batches:
            if b.num_rows:
                held.append(np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("bucket", "h", "fp")], 1))
                if sum(map(len, held)) >= batch_keys:
                    yield close()
        if held:
            yield close()

    return x.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, buckets int, sealed binary")


def seen_before(
    records: DataFrame,
    key: Column,
    order: str,
    known: DataFrame | None = None,
    known_key: Column | None = None,
    store: DataFrame | None = None,
    batch_keys: int = 1 << 16,
    max_batch: int = 1 << 20,
    fp_bits: int = 32,
) -> DataFrame:
    """(``order``, seen): for each row with a key, whether the key is known or stands in an earlier row.

    ``order`` names the arrival number. Rows with a null key have no answer and are left out; an empty
    string is a key. Rows with equal arrival numbers don't count as earlier than each other; a null
    number counts as the last and comes back as null. Repeated rows are rows of their own. An empty
    table gives no rows. A known key may be repeated. ``store`` holds earlier keys sealed by
    ``seal_keys``; it is joined by bucket and its keys are never needed again. Other columns are not read, whatever their
    names. Wrong answers are only ever "seen" for a new key: with fingerprints of ``fp_bits`` bits (1 to 32; a store always has 32) at most
    (sealed sets of its task) * 2 ** -fp_bits per new key; ``error_rates`` measures them.
    """
    buckets = None
    if store is not None:
        first = store.select("buckets").first()
        buckets = first["buckets"] if first else None
    if store is not None:
        fp_bits = 32
    rows = _hashed(records, key, F.col(order), fp_bits).mapInArrow(_first_rows(buckets), _SHUFFLED)
    if known is not None:
        part = F.col("h") if buckets is None else F.pmod(F.shiftrightunsigned("h", 32), F.lit(buckets))
        k = _hashed(known, known_key, F.lit(-1), fp_bits)
        rows = rows.unionByName(k.select(part.alias("part"), F.lit(KNOWN).cast("tinyint").alias("kind"), "ord", "h", "fp", "key"))
    if buckets is not None:
        kept = store.select(F.col("bucket").cast("bigint").alias("part"), F.lit(SEALED).cast("tinyint").alias("kind"), F.lit(-1).cast("bigint").alias("ord"), "sealed")
        rows = rows.unionByName(kept, allowMissingColumns=True)
    rows = rows.repartition("part").sortWithinPartitions("kind", "ord")
    out = rows.mapInArrow(_decide(batch_keys, max_batch, buckets, fp_bits), "ord bigint, seen boolean")
    return out.select(F.when(F.col("ord") != _LAST, F.col("ord")).alias(order), "seen")


def error_rates(
    answers: DataFrame,
    records: DataFrame,
    key: Column,
    order: str,
    known: DataFrame | None = None,
    known_key: Column | None = None,
) -> DataFrame:
    """One row: answers, how many say seen, and the wrong ones of either kind with their rate.

    The truth is exact: a key's first row is new unless the key is known. It is compared with the
    answers through the arrival number, which is unique, so no key of any size meets one task.
    """
    firsts = records.select(key.alias("key"), F.col(order).alias("ord")).where("key is not null")
    firsts = firsts.groupBy("key").agg(F.min("ord").alias("ord"))
    if known is not None:
        earlier = known.select(known_key.alias("key")).where("key is not null").distinct()
        firsts = firsts.join(earlier, "key", "left_anti")
    x = answers.select(F.col(order).alias("ord"), "seen").join(firsts.select("ord", F.lit(True).alias("new")), "ord", "left")
    new = F.coalesce("new", F.lit(False))
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("bigint")
    x = x.agg(
        F.count(F.lit(1)).alias("n_answers"),
        count(F.col("seen")).alias("n_seen"),
        count(F.col("seen") & new).alias("wrong_seen"),
        count(~F.col("seen") & ~new).alias("wrong_new"),
    )
    rate = (F.col("wrong_seen") + F.col("wrong_new")) / F.greatest(F.col("n_answers"), F.lit(1))
    return x.withColumn("wrong_rate", rate.cast("double"))
