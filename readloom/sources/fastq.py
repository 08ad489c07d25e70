"""Reads with qualities, split by byte ranges: a task begins at the first record that begins in its range."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from readloom.sources.files import files_of, open_at, ranges_of, size_of

_BASES = re.compile(rb"[ACGTUNRYSWKMBDHVacgtunryswkmbdhv.*~\-]*$")
#: whole records in a row that tell where the first one begins
_CHAIN = 3
_OUT = 5_000


def _lines(f, start: int, size: int, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(place, line) from the first line that begins at or behind ``start`` on."""
    if start:
        f.seek(start - 1)
        at, rest, fresh = start - 1, b"", False
    else:
        f.seek(0)
        at, rest, fresh = 0, b"", True
    while True:
        data = f.read(chunk)
        parts = (rest + data).split(b"\n")
        if data:
            rest = parts.pop()
        for p in parts:
            if data or p:
                if fresh:
                    yield at, p.rstrip(b"\r")
                fresh = True
                at += len(p) + 1
        if not data:
            return


def _record(lines: list[tuple[int, bytes]], i: int) -> tuple[int, bytes, bytes, bytes] | None:
    """(next line, name, bases, qualities) of the record at line i, None where it is cut off or there is none."""
    if i >= len(lines) or not lines[i][1].startswith(b"@"):
        return None
    j, seq = i + 1, []
    while j < len(lines) and not lines[j][1].startswith(b"+"):
        if not _BASES.match(lines[j][1]):
            return None
        seq.append(lines[j][1])
        j += 1
    bases = b"".join(seq)
    j, qual, n = j + 1, [], 0
    while j < len(lines) and (n < len(bases) or not qual):
        qual.append(lines[j][1])
        n += len(lines[j][1])
        j += 1
    if n != len(bases) or not qual:
        return None
    head = lines[i][1][1:].split()
    return j, head[0] if head else b"", bases, b"".join(qual)


def _range(path: str, start: int, stop: int, mode: str) -> Iterator[tuple]:
    size = size_of(path)
    with open_at(path) as f:
        held: list[tuple[int, bytes]] = []
        source = _lines(f, start, size)
        ended = False

        def more(n: int) -> None:
            nonlocal ended
            while len(held) < n and not ended:
                got = next(source, None)
                if got is None:
                    ended = True
                else:
                    held.append(got)

        i, want = 0, 16
        if start:  # a line of qualities may begin with @: a chain of records must hold together
            while True:
                more(i + want)
                if i >= len(held) or held[i][0] >= stop:
                    return
                at, chain = i, 0
                while chain < _CHAIN and at < len(held) and (r := _record(held, at)) and r[0] == at + 4:
                    at, chain = r[0], chain + 1
                blank = all(not x for _, x in held[at:])
                if chain == _CHAIN or (chain and ended and blank):
                    break
                # it may only lack the lines that aren't read yet
                if held[i][1].startswith(b"@") and not ended and want < 1 << 14 and (chain or all(_BASES.match(x) for _, x in held[i + 1 :])):
                    want *= 4
                    continue
                i, want = i + 1, 16
        while True:
            more(i + 8)
            while i < len(held) and not held[i][1]:
                i += 1
                more(i + 8)
            if i >= len(held) or held[i][0] >= stop:
                return
            r, n = _record(held, i), 8
            while r is None and not ended:
                n *= 2
                more(i + n)
                r = _record(held, i)
            if r is None:
                if mode == "failfast":
                    raise ValueError(f"incomplete record at byte {held[i][0]} of {path}")
                yield held[i][1][1:].decode(errors="replace").split(" ")[0], None, None
                return
            yield r[1].decode(), r[2].decode(), r[3].decode()
            held, i = held[r[0] :], 0


def read_fastq(spark: SparkSession, path: str, split: int = 64 << 20, mode: str = "failfast", wrapped: bool = False) -> DataFrame:
    """(name, seq, qual) of the records of a file or a folder, four lines each, read in ranges of ``split`` bytes.

    With ``wrapped`` records may have more lines; where one begins inside such a file can't be told for sure, so a file is then read
    by one task, record by record.

    A record that is cut off stops the query, in permissive mode its name comes out with nulls and ends its range. Empty files give nothing."""
    ranges = [(p, 0, n) for p, n in files_of(path) if n] if wrapped else ranges_of(path, split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, a, e in zip(*(b.column(c).to_pylist() for c in ("path", "start", "stop"))):
                rows: list[tuple] = []
                for r in _range(p, a, e, mode):
                    rows.append(r)
                    if len(rows) == _OUT:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["name", "seq", "qual"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["name", "seq", "qual"])

    if not ranges:
        return spark.createDataFrame([], "name string, seq string, qual string")
    x = spark.createDataFrame(ranges, "path string, start bigint, stop bigint").repartition(len(ranges))
    return x.mapInArrow(run, "name string, seq string, qual string")
