"""Binary variant files: ``spark.read.format("bcf")`` and ``write``, one task a file.

A file is a series of gzip members as in ``bam``: a header with the sequence names, the sample names and free text, then
records with place, quality, five texts (id, ref, alt, filter, info), the names of the genotype fields and their data. Genotype fields known:
PL (bytes, as many as genotypes), GT and GQ (a byte), DP (two bytes), SP (four bytes); others are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition
from pyspark.sql.types import StructType

from readloom.sources.bam import EOF, _Written, member, members
from readloom.sources.files import files_of, open_at, publish, remove

SCHEMA = "tid int, pos int, id string, ref string, alt string, qual float, filter string, info string, format string, pl array<int>, gt array<int>, gq array<int>, dp array<int>, sp array<int>"
#: bytes of a sample's value
_WIDTH = {"GT": ("B", 1), "GQ": ("B", 1), "DP": ("H", 2), "SP": ("i", 4)}


def header_bytes(contigs: list[str], samples: list[str], text: str) -> bytes:
    parts = ["\0".join(contigs) + "\0" if contigs else "", "\0".join(samples) + "\0" if samples else "", text + "\0"]
    return b"BCF\4" + b"".join(struct.pack("<i", len(p.encode())) + p.encode() for p in parts)


def read_header(data: bytes) -> tuple[list[str], list[str], str, int] | None:
    """(contigs, samples, text, length), None where more bytes are needed."""
    if data[:4] != b"BCF\4"[: len(data)]:
        raise ValueError("not a BCF file")
    at, parts = 4, []
    for _ in range(3):
        if at + 4 > len(data):
            return None
        n = struct.unpack_from("<i", data, at)[0]
        if at + 4 + n > len(data):
            return None
        parts.append(data[at + 4 : at + 4 + n].decode())
        at += 4 + n
    names = lambda t: t.rstrip("\0").split("\0") if t.rstrip("\0") else []
    return names(parts[0]), names(parts[1]), parts[2].rstrip("\0"), at


def n_genotypes(alt: str) -> int:
    n = 1 + (0 if alt in ("", ".") else alt.count(",") + 1)
    return n * (n + 1) // 2


def encode(row, n_samples: int) -> bytes:
    texts = [row[c] or "" for c in ("id", "ref", "alt", "filter", "info", "format")]
    body = b"".join(t.encode() + b"\0" for t in texts)
    out = struct.pack("<iifi", row["tid"], row["pos"], row["qual"] or 0.0, len(body)) + body
    for key in filter(None, texts[5].split(":")):
        values = row[key.lower()] if key == "PL" or key in _WIDTH else None
        if values is None:
            raise ValueError(f"no values for {key}")
        kind, n = ("B", n_genotypes(texts[2])) if key == "PL" else (_WIDTH[key][0], 1)
        if len(values) != n * n_samples:
            raise ValueError(f"{key} needs {n * n_samples} values")
        out += struct.pack(f"<{len(values)}{kind}", *values)
    return out


def decode(data: bytes, at: int, n_samples: int) -> tuple[tuple, int] | None:
    """(record, its end), None where more bytes are needed."""
    if at + 16 > len(data):
        return None
    tid, pos, qual, n = struct.unpack_from("<iifi", data, at)
    if at + 16 + n > len(data):
        return None
    texts = data[at + 16 : at + 16 + n].decode().split("\0")
    at += 16 + n
    fields: dict[str, list[int]] = {}
    for key in filter(None, texts[5].split(":")):
        if key != "PL" and key not in _WIDTH:
            raise ValueError(f"genotype field {key} is not known")
        kind, width, many = ("B", 1, n_genotypes(texts[2])) if key == "PL" else (*_WIDTH[key], 1)
        many *= n_samples
        if at + many * width > len(data):
            return None
        fields[key] = list(struct.unpack_from(f"<{many}{kind}", data, at))
        at += many * width
    return (tid, pos, *texts[:3], qual, *texts[3:6], *(fields.get(k) for k in ("PL", "GT", "GQ", "DP", "SP"))), at


class _File(InputPartition):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size


class BcfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[_File]:
        return [_File(p, n) for p, n in files_of(self.path, ".bcf")]

    def read(self, part: _File) -> Iterator[tuple]:
        with open_at(part.path) as f:
            data, at, samples = b"", 0, None
            for _, content in members(f, 0, part.size):
                data, at = data[at:] + content, 0
                if samples is None:
                    head = read_header(data)
                    if head is None:
                        continue
                    samples, at = len(head[1]), head[3]
                while (got := decode(data, at, samples)) is not None:
                    record, at = got
                    yield record
            if at < len(data):
                raise ValueError(f"truncated file {part.path}")


class BcfWriter(DataSourceWriter):
    """One file a task, with the header of the options ``contigs``, ``samples`` (by commas) and ``header``."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.names = [[n for n in options.get(k, "").split(",") if n] for k in ("contigs", "samples")]
        self.text = options.get("header", "")

    def write(self, rows) -> _Written:
        from pyspark import TaskContext

        context = TaskContext.get()

        def body(f) -> None:
            data = header_bytes(*self.names, self.text)
            for row in rows:
                data += encode(row, len(self.names[1]))
                while len(data) > 60_000:
                    f.write(member(data[:60_000]))
                    data = data[60_000:]
            if data:
                f.write(member(data))
            f.write(EOF)

        return _Written(publish(self.path, f"part-{context.partitionId():05d}.bcf", str(context.taskAttemptId()), body))

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None:
                remove(m.path)


class BcfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bcf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BcfReader:
        return BcfReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> BcfWriter:
        return BcfWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BcfSource)
