"""Continuous stretches and gaps of interval sets.

A mergeable aggregate whose state is a sorted list of disjoint intervals. Every task folds its rows into
disjoint intervals in a bounded buffer; these runs are written once and tell how wide the coordinate bins must be. The runs
become one list per key, bin and task, and a reduction tree combines the lists of ``fan_in`` tasks at a time by linear
merges of two sorted lists, as many levels as the number of tasks asks for, so no task ever gets all partial
lists of a hot key and bin. The last step joins stretches that cross bins with a window over one summary
row per bin, and emits the lists and their complement.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.session import materialize

#: intervals a bin of a key with all rows would hold, if they were evenly spread
BIN_ROWS = 1 << 17
#: a position inside a bin and the number of a group fit into 64 bits together
_WIDEST = 1 << 42


def sweep(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals of intervals sorted by start: (row at which each begins, its end). Touching ones are one."""
    if not len(start):
        return np.zeros(0, np.int64), end
    upto = np.maximum.accumulate(end)
    at = np.flatnonzero(np.concatenate([[True], start[1:] > upto[:-1]]))
    return at, upto[np.append(at[1:], len(start)) - 1]


def merge_sorted(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Linear merge of two lists (starts, ends), each sorted and disjoint, into one."""
    (sa, ea), (sb, eb) = a, b
    s, e = np.empty(len(sa) + len(sb), np.int64), np.empty(len(sa) + len(sb), np.int64)
    ia = np.arange(len(sa)) + np.searchsorted(sb, sa, "left")
    ib = np.arange(len(sb)) + np.searchsorted(sa, sb, "right")
    s[ia], e[ia], s[ib], e[ib] = sa, ea, sb, eb
    at, e = sweep(s, e)
    return s[at], e


def _codes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """An integer per row, equal where the keys are; nulls are equal to each other."""
    code = np.zeros(table.num_rows, np.int64)
    for k in keys:
        column = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        c = column.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (len(column.dictionary) + 1) + c, return_inverse=True)[1]
    return code


def disjoint(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsorted intervals of several groups to disjoint ones: (row at which each begins, its end), by group and start.

    The sweep runs over (group, coordinate) as one number; where coordinates are too far apart for that,
    their ranks stand for them.
    """
    if not len(start):
        return np.zeros(0, np.int64), end
    base, span = int(start.min()), int(end.max()) - int(start.min()) + 1
    back = None
    if (int(code.max()) + 1) * span < 1 << 62:
        s, e = start - base, end - base
    else:
        back, ranks = np.unique(np.concatenate([start, end]), return_inverse=True)
        s, e, span = ranks[: len(start)], ranks[len(start) :], len(back)
    s, e = s + code * span, e + code * span
    order = np.argsort(s, kind="stable")
    # the end of one group may equal the start of the next, never pass it: a group's first row always begins a list
    new = np.concatenate([[True], code[order[1:]] != code[order[:-1]]])
    s, e = s[order], np.maximum.accumulate(e[order])
    at = np.flatnonzero(new | np.concatenate([[True], s[1:] > e[:-1]]))
    e = e[np.append(at[1:], len(s)) - 1] - code[order[at]] * span
    return order[at], back[e] if back is not None else e + base


def _fold(table: pa.Table, keys: Sequence[str]) -> pa.Table:
    """Rows (keys, __s, __e) to disjoint rows."""
    at, e = disjoint(_codes(table, keys), table.column("__s").to_numpy(), table.column("__e").to_numpy())
    picked = table.take(pa.array(at))
    return picked.set_column(picked.schema.get_field_index("__e"), "__e", pa.array(e, pa.int64()))


def _runs(keys: list[str], buffer_rows: int):
    """Disjoint rows of a task, and its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[pa.Table] = []
        rows = 0

        def out(folded: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from folded.append_column("__task", pa.array(np.full(folded.num_rows, task))).to_batches(max_chunksize=50_000)

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= buffer_rows:
                folded = _fold(pa.concat_tables(held), keys)
                if folded.num_rows > buffer_rows // 2:  # no longer compact: hand it on
                    yield from out(folded)
                    held, rows = [], 0
                else:
                    held, rows = [folded], folded.num_rows
        if rows:
            yield from out(_fold(pa.concat_tables(held), keys))

    return run


def bin_width(n: int, span: int, length: int) -> int:
    """A power of two: wide enough that ``BIN_ROWS`` of ``n`` rows spread over ``span`` share a bin, and that
    cutting at bin borders makes at most a quarter more rows, ``length`` being that of all of them together."""
    least = max(1024, span * BIN_ROWS // max(n, 1), 4 * length // max(n, 1))
    return min(1 << (least - 1).bit_length(), _WIDEST)


def _to_lists(keys: list[str], width: int):
    """Disjoint rows, cut at bin borders, to sorted lists: one per (keys with the task, bin) and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            s, e = (table.column(c).to_numpy() for c in ("__s", "__e"))
            b0, b1 = s // width, (e - 1) // width
            n = b1 - b0 + 1
            at = np.repeat(np.arange(len(s)), n)
            b = b0[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            # positions within the bin: the borders of the outermost bins may lie beyond 64 bits
            ls = np.where(b == b0[at], s[at] % width, 0)
            le = np.where(b == b1[at], (e[at] - 1) % width + 1, width)
            group = np.unique(np.stack([_codes(table, keys)[at], b]), axis=1, return_inverse=True)[1].ravel()
            order = np.argsort(group * width + ls, kind="stable")
            at, b, ls, le, group = at[order], b[order], ls[order], le[order], group[order]
            # a file may hold several runs of a task
            first, le = disjoint(group, ls, le)
            at, b, ls, group = at[first], b[first], ls[first], group[first]
            new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            ends = pa.array(np.append(new, len(ls)).astype(np.int32))
            out = table.select(keys).take(pa.array(at[new])).append_column("__bin", pa.array(b[new], pa.int64()))
            out = out.append_column("__starts", pa.ListArray.from_arrays(ends, pa.array(ls, pa.int64())))
            yield from out.append_column("__ends", pa.ListArray.from_arrays(ends, pa.array(le, pa.int64()))).to_batches(max_chunksize=2_000)

    return run


def reduce_lists(group: np.ndarray, offsets: np.ndarray, s: np.ndarray, e: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted disjoint lists to one list per group, by rounds of linear merges of two lists of a group each.

    Groups are numbered 0, 1, ... in the order of the lists; list i is s[offsets[i]:offsets[i + 1]] with positions in [0, width].
    """
    while len(group) and (group[1:] == group[:-1]).any():
        first = np.searchsorted(group, group)
        rank = np.arange(len(group)) - first
        pair = np.cumsum(rank % 2 == 0) - 1
        row = np.repeat(np.arange(len(group)), np.diff(offsets))
        shift = pair[row] * (2 * width)
        odd = (rank % 2 == 1)[row]
        key_s, key_e = s + shift, e + shift
        key_s, key_e = merge_sorted((key_s[~odd], key_e[~odd]), (key_s[odd], key_e[odd]))
        where = key_s // (2 * width)
        group = group[rank % 2 == 0]
        offsets = np.searchsorted(where, np.arange(len(group) + 1))
        s, e = key_s - where * (2 * width), key_e - where * (2 * width)
    return group, offsets, s, e


def _list_arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, starts, ends) of the list columns."""
    starts, ends = (table.column(c).combine_chunks() for c in ("__starts", "__ends"))
    offsets = starts.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], starts.flatten().to_numpy(), ends.flatten().to_numpy()


def _merge_level(keys: list[str], width: int):
    """Combine lists that arrive sorted by (keys, bin). The lists of the group that is still open are kept as they are
    until they hold as much as its merged list, so every interval is merged a logarithmic number of times."""

    by = [*keys, "__bin"]

    def merged(table: pa.Table) -> pa.Table:
        code = _codes(table, by)
        new = np.concatenate([[True], code[1:] != code[:-1]])
        offsets, s, e = _list_arrays(table)
        _, offsets, s, e = reduce_lists(np.cumsum(new) - 1, offsets, s, e, width)
        ends = pa.array(offsets.astype(np.int32))
        out = table.select(by).take(pa.array(np.flatnonzero(new)))
        out = out.append_column("__starts", pa.ListArray.from_arrays(ends, pa.array(s)))
        return out.append_column("__ends", pa.ListArray.from_arrays(ends, pa.array(e)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.Table] = []
        waiting, size = 0, 0
        columns = [*by, "__starts", "__ends"]
        plain = pa.schema([])
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, s, e = _list_arrays(pa.Table.from_batches([batch]))
            ends = pa.array(offsets.astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (s, e)]
            table = pa.Table.from_arrays([*[batch.column(c) for c in by], *lists], columns)
            plain = table.schema
            code = _codes(pa.concat_tables([open_[-1].slice(0, 1), table]) if open_ else table, by)
            head, code = (code[0], code[1:]) if open_ else (None, code)
            tail = int(np.flatnonzero(code != code[-1])[-1]) + 1 if (code != code[-1]).any() else 0
            if open_ and (tail or code[-1] != head):  # the open group ends in this batch
                done = merged(pa.concat_tables([*open_, table.slice(0, tail)]))
                yield from done.to_batches(max_chunksize=2_000)
                open_, waiting, size = [], 0, 0
            elif tail:
                yield from merged(table.slice(0, tail)).to_batches(max_chunksize=2_000)
            open_.append(table.slice(tail))
            waiting += int(offsets[-1] - offsets[tail])
            if waiting > max(size, 1 << 16):
                open_ = [merged(pa.concat_tables(open_)).cast(plain)]
                waiting, size = 0, len(open_[0].column("__starts").combine_chunks().flatten())
        if open_:
            yield from merged(pa.concat_tables(open_)).to_batches(max_chunksize=2_000)

    return run


def interval_states(df: DataFrame, keys: Sequence[str], start: str, end: str, width: int | None = None, buffer_rows: int = 1 << 18, fan_in: int = 64) -> tuple[DataFrame, int]:
    """The merged states, one row (keys, __bin, __starts, __ends) per key and bin with positions inside the bin, and the width of the bins."""
    keys = list(keys)
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)],
        F.col(start).cast("bigint").alias("__s"),
        F.col(end).cast("bigint").alias("__e"),
    ).where("__s < __e")
    key_fields = rows.schema.fields[: len(keys)]
    long = T.LongType()
    runs = materialize(rows.mapInArrow(_runs(names, buffer_rows), T.StructType([*rows.schema.fields, T.StructField("__task", long)])), "runs")
    size = runs.agg(
        F.count(F.lit(1)).alias("n"), F.min("__s").alias("s"), F.max("__e").alias("e"), F.sum(F.col("__e").cast("decimal(38,0)") - F.col("__s")).alias("length"), F.max("__task").alias("task")
    ).first()
    if width is None:
        width = bin_width(size["n"], (size["e"] or 0) - (size["s"] or 0), int(size["length"] or 0))
    lists_of = [T.StructField("__bin", long), *[T.StructField(c, T.ArrayType(long, False)) for c in ("__starts", "__ends")]]
    by = [*names, "__task"]
    with_task = T.StructType([*key_fields, T.StructField("__task", long), *lists_of])
    lists = runs.mapInArrow(_to_lists(by, width), with_task)
    tasks = (size["task"] or 0) + 1
    while tasks > fan_in:  # the tree: lists of fan_in tasks become one
        lists = lists.withColumn("__task", F.expr(f"__task div {fan_in}"))
        lists = lists.repartition(*by, "__bin").sortWithinPartitions(*by, "__bin").mapInArrow(_merge_level(by, width), with_task)
        tasks = -(-tasks // fan_in)
    lists = lists.drop("__task").repartition(*names, "__bin").sortWithinPartitions(*names, "__bin")
    return lists.mapInArrow(_merge_level(names, width), T.StructType([*key_fields, *lists_of])), width


def stretches_and_gaps(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    width: int | None = None,
    buffer_rows: int = 1 << 18,
    fan_in: int = 64,
) -> DataFrame:
    """Covered stretches and the gaps between them: (keys, kind, seg_start, seg_end).

    Intervals are half-open; those that overlap, nest or touch are one stretch. Rows with a null or
    empty interval (start >= end) cover nothing; repeated rows change nothing; a null key is a key of
    its own; an empty table gives no rows. Only the named columns are read. Coordinates are any 64-bit integers, dates or
    instants as integers included; the width of the bins follows from the data unless one is given.
    """
    keys = list(keys)
    names = [f"__k{i}" for i in range(len(keys))]
    states, width = interval_states(df, keys, start, end, width, buffer_rows, fan_in)
    states = materialize(states, "intervals")
    low = F.col("__bin") * F.lit(width)
    states = states.withColumns({c: F.transform(c, lambda p: p + low) for c in ("__starts", "__ends")})
    brief = states.select(
        *names,
        "__bin",
        F.element_at("__starts", 1).alias("__first"),
        F.element_at("__starts", -1).alias("__last"),
        F.element_at("__ends", -1).alias("__end"),
        F.size("__starts").alias("__n"),
    )
    # at most (coordinate range / bin_width) rows a key, however many rows the key has
    w = Window.partitionBy(*names).orderBy("__bin")
    brief = brief.withColumn("__prev", F.lag("__end").over(w)).withColumn("__next", F.lead("__first").over(w))
    joins = F.coalesce(F.col("__prev") == F.col("__first"), F.lit(False))
    brief = brief.withColumn("__joins", joins).withColumn("__goes_on", F.coalesce(F.col("__next") == F.col("__end"), F.lit(False)))
    anchor = F.when((F.col("__n") > 1) | ~F.col("__joins"), F.col("__last"))
    chain = F.last(anchor, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    brief = brief.withColumn("__chain", chain).withColumn("__from", F.lag("__chain").over(w))
    brief = brief.select(*[F.col(n).alias(f"b{n}") for n in names], F.col("__bin").alias("b__bin"), "__first", "__prev", "__joins", "__goes_on", "__from")
    on = F.col("__bin") == F.col("b__bin")
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"b{n}"))
    x = states.join(brief, on)
    n = F.size("__starts")
    starts = F.when(F.col("__joins"), F.concat(F.array("__from"), F.slice("__starts", F.lit(2), n))).otherwise(F.col("__starts"))
    kept = n - F.col("__goes_on").cast("int")

    def pairs(kind: str, a, b):
        return F.zip_with(a, b, lambda p, q: F.struct(F.lit(kind).alias("kind"), p.alias("seg_start"), q.alias("seg_end")))

    covered = pairs("covered", F.slice(starts, F.lit(1), kept), F.slice(F.col("__ends"), F.lit(1), kept))
    inner = pairs("gap", F.slice(F.col("__ends"), F.lit(1), n - 1), F.slice(F.col("__starts"), F.lit(2), n - 1))
    before = F.when(
        ~F.col("__joins") & F.col("__prev").isNotNull(),
        pairs("gap", F.array("__prev"), F.array("__first")),
    ).otherwise(F.slice(pairs("gap", F.array("__first"), F.array("__first")), 1, 0))
    return x.select(*[F.col(n_).alias(k) for n_, k in zip(names, keys)], F.inline(F.concat(covered, inner, before)))
