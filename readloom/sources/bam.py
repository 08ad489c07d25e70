"""Binary alignment files as a Python data source: ``spark.read.format("bam")`` and ``write``.

The container is a series of gzip members of at most 64 KB, each with its size in an extra field. A
partition is a byte range of the file: it starts at the first member that begins in the range and,
for all but the first, at the first byte that begins a plausible chain of records; it ends when a
record begins in the next range. So a file is read by as many tasks as asked for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from readloom.sources.files import files_of, open_at, publish, ranges_of, remove, size_of

# fixed values of the format: base codes, operation codes, end-of-file member
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SCHEMA = "qname string, flag int, tid int, pos int, mapq int, cigar string, mtid int, mpos int, isize int, seq string, qual string, aux map<string,string>"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4, "d": 8}
_CODES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f", "d": "d"}


def member_size(buffer: bytes, at: int) -> int:
    """Size of the gzip member at ``at``, or 0 if there is none."""
    if buffer[at : at + 4] != b"\x1f\x8b\x08\x04" or len(buffer) < at + 18:
        return 0
    extra = struct.unpack_from("<H", buffer, at + 10)[0]
    k, end = at + 12, at + 12 + extra
    while k + 4 <= end:
        name, n = buffer[k : k + 2], struct.unpack_from("<H", buffer, k + 2)[0]
        if name == b"BC" and n == 2:
            return struct.unpack_from("<H", buffer, k + 4)[0] + 1
        k += 4 + n
    return 0


def members(f, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place in the file, content) of the members from ``start`` on."""
    f.seek(start)
    at, buffer = start, f.read(1 << 17)
    while buffer:
        n = member_size(buffer, 0)
        if not n:
            raise ValueError(f"no block at byte {at}")
        if len(buffer) < n:
            raise ValueError("truncated file")
        yield at, zlib.decompress(buffer[:n], 31)
        at += n
        buffer = buffer[n:]
        if len(buffer) < 1 << 16:
            buffer += f.read(1 << 17)


def first_member(f, start: int, size: int) -> int:
    """The first member that begins at or behind ``start``."""
    f.seek(start)
    buffer = f.read(1 << 18)
    at = buffer.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        n = member_size(buffer, at)
        if n and (start + at + n >= size or buffer[at + n : at + n + 4] == b"\x1f\x8b\x08\x04"[: max(0, len(buffer) - at - n)]):
            return start + at
        at = buffer.find(b"\x1f\x8b\x08\x04", at + 1)
    return size


def read_header(f, size: int) -> tuple[str, list[tuple[str, int]], int]:
    """(text, contigs, length of the header in uncompressed bytes)."""
    data, source = b"", members(f, 0, size)

    def need(n: int) -> None:
        nonlocal data
        while len(data) < n:
            data += next(source)[1]

    need(8)
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    n_text = struct.unpack_from("<i", data, 4)[0]
    need(12 + n_text)
    text = data[8 : 8 + n_text].rstrip(b"\0").decode()
    at = 8 + n_text
    n_ref = struct.unpack_from("<i", data, at)[0]
    at += 4
    contigs = []
    for _ in range(n_ref):
        need(at + 4)
        n = struct.unpack_from("<i", data, at)[0]
        need(at + 8 + n)
        contigs.append((data[at + 4 : at + 3 + n].decode(), struct.unpack_from("<i", data, at + 4 + n)[0]))
        at += 8 + n
    return text, contigs, at


def plausible(data: bytes, at: int, n_ref: int) -> bool:
    """Whether a record may begin here, by its fixed fields."""
    if at + 36 > len(data):
        return False
    size, tid, pos, name, _, _, n_cigar, flag, n_seq, mtid, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (32 <= size < 1 << 24 and -1 <= tid < n_ref and -1 <= mtid < n_ref and pos >= -1 and mpos >= -1 and name > 1 and 0 <= n_seq < 1 << 23 and flag < 1 << 12):
        return False
    if 32 + name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq > size:
        return False
    end = at + 36 + name - 1
    return end >= len(data) or data[end] == 0


def decode(r: bytes) -> tuple:
    """A record without its size field."""
    tid, pos, n_name, mapq, _, n_cigar, flag, n_seq, mtid, mpos, isize = struct.unpack_from("<iiBBHHHiiii", r)
    at = 32
    name = r[at : at + n_name - 1].decode()
    at += n_name
    cigar = "".join(f"{c >> 4}{OPS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", r, at)) or "*"
    at += 4 * n_cigar
    packed = r[at : at + (n_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_seq] or "*"
    at += (n_seq + 1) // 2
    q = r[at : at + n_seq]
    qual = "*" if not q or q[0] == 255 else "".join(chr(x + 33) for x in q)
    at += n_seq
    aux = {}
    while at + 3 <= len(r):
        key, kind = r[at : at + 2].decode(), chr(r[at + 2])
        at += 3
        if kind in "ZH":
            end = r.index(b"\0", at)
            aux[key] = f"{kind}:{r[at:end].decode()}"
            at = end + 1
        elif kind == "B":
            sub, n = chr(r[at]), struct.unpack_from("<I", r, at + 1)[0]
            values = struct.unpack_from(f"<{n}{_CODES[sub]}", r, at + 5)
            aux[key] = "B:" + ",".join([sub, *(f"{v:g}" if sub in "fd" else str(v) for v in values)])
            at += 5 + n * _SIZES[sub]
        elif kind == "A":
            aux[key] = f"A:{chr(r[at])}"
            at += 1
        else:
            v = struct.unpack_from(f"<{_CODES[kind]}", r, at)[0]
            aux[key] = f"f:{v:g}" if kind in "fd" else f"i:{v}"
            at += _SIZES[kind]
    return name, flag, tid, pos, mapq, cigar, mtid, mpos, isize, seq, qual, aux


def reg2bin(beg: int, end: int) -> int:
    last = max(end, beg + 1) - 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if beg >> shift == last >> shift:
            return first + (beg >> shift)
    return 0


def encode(row) -> bytes:
    import re

    name = row["qname"].encode() + b"\0"
    ops = [] if row["cigar"] in (None, "*") else [(int(n), OPS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"])]
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    codes = [max(BASES.find(c.upper()), 0) if c.upper() in BASES else 15 for c in seq]
    packed = bytes((codes[i] << 4) | (codes[i + 1] if i + 1 < len(codes) else 0) for i in range(0, len(codes), 2))
    qual = b"\xff" * len(seq) if row["qual"] in (None, "*") else bytes(ord(c) - 33 for c in row["qual"])
    aux = b""
    for key, value in (row["aux"] or {}).items():
        kind, v = value.split(":", 1)
        aux += key.encode()
        if kind in "ZH":
            aux += kind.encode() + v.encode() + b"\0"
        elif kind == "A":
            aux += b"A" + v.encode()
        elif kind == "i":
            aux += b"i" + struct.pack("<i", int(v)) if -(2**31) <= int(v) < 2**31 else b"I" + struct.pack("<I", int(v))
        elif kind == "f":
            aux += b"f" + struct.pack("<f", float(v))
        elif kind == "B":
            sub, *values = v.split(",")
            aux += b"B" + sub.encode() + struct.pack(f"<I{len(values)}{_CODES[sub]}", len(values), *[float(x) if sub in "fd" else int(x) for x in values])
    span = sum(n for n, o in ops if OPS[o] in "MDN=X")
    fixed = struct.pack(
        "<iiBBHHHiiii", row["tid"], row["pos"], len(name), row["mapq"], reg2bin(max(row["pos"], 0), max(row["pos"], 0) + span), len(ops), row["flag"], len(seq), row["mtid"], row["mpos"], row["isize"]
    )
    body = fixed + name + struct.pack(f"<{len(ops)}I", *[n << 4 | o for n, o in ops]) + packed + qual + aux
    return struct.pack("<i", len(body)) + body


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def header_bytes(text: str, contigs: list[tuple[str, int]]) -> bytes:
    out = b"BAM\x01" + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(contigs))
    for name, n in contigs:
        out += struct.pack("<i", len(name.encode()) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    return out


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int) -> None:
        self.path, self.start, self.stop = path, start, stop


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.split = int(options.get("splitbytes", 32 << 20))

    def partitions(self) -> list[_Range]:
        return [_Range(*r) for r in ranges_of(self.path, self.split, ".bam")]

    def read(self, part: _Range) -> Iterator[tuple]:
        size = size_of(part.path)
        with open_at(part.path) as f:
            _, contigs, skip = read_header(f, size)
            begin = 0 if part.start == 0 else first_member(f, part.start, size)
            data, at, seen, synced = b"", 0, [], part.start == 0
            left = skip if synced else 0
            for where, content in members(f, begin, size):
                if left:  # the header
                    cut = min(left, len(content))
                    content, left = content[cut:], left - cut
                seen.append((len(data), where))
                data += content
                if not synced:  # the first chain of two records that holds together
                    if len(data) < 1 << 17 and where + 1 < size and len(content):
                        if len(seen) < 4:
                            continue
                    at = self._sync(data, len(contigs))
                    if at is None:
                        return
                    synced = True
                while at + 4 <= len(data):
                    origin = [w for a, w in seen if a <= at][-1]
                    if origin >= part.stop:
                        return
                    n = struct.unpack_from("<i", data, at)[0]
                    if at + 4 + n > len(data):
                        break
                    yield decode(data[at + 4 : at + 4 + n])
                    at += 4 + n
                last = [w for a, w in seen if a <= at][-1]
                data, seen, at = data[at:], [(0, last), *[(a - at, w) for a, w in seen if a > at]], 0
            if not synced and data:
                at = self._sync(data, len(contigs))
                while at is not None and at + 4 <= len(data):
                    if [w for a, w in seen if a <= at][-1] >= part.stop:
                        return
                    n = struct.unpack_from("<i", data, at)[0]
                    yield decode(data[at + 4 : at + 4 + n])
                    at += 4 + n

    @staticmethod
    def _sync(data: bytes, n_ref: int) -> int | None:
        for at in range(len(data)):
            k, chain = at, 0
            while chain < 4 and plausible(data, k, n_ref):
                k += 4 + struct.unpack_from("<i", data, k)[0]
                chain += 1
            if chain == 4 or (chain and k == len(data)):
                return at
        return None


class _Written(WriterCommitMessage):
    def __init__(self, path: str) -> None:
        self.path = path


class BamWriter(DataSourceWriter):
    """One file a task, each a whole BAM with the header given by the options ``header`` and ``contigs``."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.header = options.get("header", "")
        self.contigs = [(c.rsplit(":", 1)[0], int(c.rsplit(":", 1)[1])) for c in options.get("contigs", "").split(",") if c]

    def write(self, rows) -> _Written:
        from pyspark import TaskContext

        context = TaskContext.get()

        def body(f) -> None:
            f.write(member(header_bytes(self.header, self.contigs)))
            data = b""
            for row in rows:
                data += encode(row)
                while len(data) > 60_000:
                    f.write(member(data[:60_000]))
                    data = data[60_000:]
            if data:
                f.write(member(data))
            f.write(EOF)

        return _Written(publish(self.path, f"part-{context.partitionId():05d}.bam", str(context.taskAttemptId()), body))

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None:
                remove(m.path)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> BamWriter:
        return BamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def read_bam_header(path: str) -> tuple[str, list[tuple[str, int]]]:
    with open_at(path) as f:
        text, contigs, _ = read_header(f, size_of(path))
    return text, contigs


def reheader(spark: SparkSession, source: str, target: str, text: str, contigs: list[tuple[str, int]]) -> DataFrame:
    """Every file of ``source`` written to the folder ``target`` with another header: (path). The records are not
    decoded: what shares a block with the old header is packed again, the blocks behind it are copied as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for path, size in zip(b.column("path").to_pylist(), b.column("size").to_pylist()):
                with open_at(path) as f:
                    left = read_header(f, size)[2]
                    for at, content in members(f, 0, size):
                        if left <= len(content):
                            break
                        left -= len(content)
                    f.seek(at)
                    behind = at + member_size(f.read(1 << 17), 0)

                    def body(out, rest=content[left:], f=f, behind=behind) -> None:
                        out.write(member(header_bytes(text, contigs)))
                        if rest:
                            out.write(member(rest))
                        f.seek(behind)
                        while data := f.read(1 << 22):
                            out.write(data)

                    done.append(publish(target, path.rsplit("/", 1)[1], "copy", body))
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    files = spark.createDataFrame(files_of(source, ".bam"), "path string, size bigint")
    return files.repartition(max(1, files.count())).mapInArrow(run, "path string")


def of_records(df: DataFrame, names: list[str]) -> DataFrame:
    """Text records (rname, rnext, pnext, tlen, aux map of type and value) as the binary source takes them; contigs by their place in ``names``."""
    index = lambda c: F.coalesce(F.array_position(F.lit(names), F.col(c)), F.lit(0)).cast("int") - 1
    aux = F.transform_values("aux", lambda k, v: F.concat(F.when(v["type"].isin(*"cCsSiI"), "i").otherwise(v["type"]), F.lit(":"), v["value"]))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return df.select("qname", "flag", index("rname").alias("tid"), "pos", "mapq", "cigar", index("rnext").alias("mtid"), F.col("pnext").alias("mpos"), zero("tlen").alias("isize"), "seq", "qual", aux.alias("aux"))


def to_records(df: DataFrame, names: list[str]) -> DataFrame:
    """The other way round."""
    name = lambda c: F.coalesce(F.get(F.lit(names), F.col(c)), F.lit("*"))
    aux = F.transform_values("aux", lambda k, v: F.struct(F.substring(v, 1, 1).alias("type"), F.substring(v, F.lit(3), F.length(v)).alias("value")))
    return df.select("qname", "flag", name("tid").alias("rname"), "pos", "mapq", "cigar", name("mtid").alias("rnext"), F.col("mpos").alias("pnext"), F.col("isize").alias("tlen"), "seq", "qual", aux.alias("aux"))
