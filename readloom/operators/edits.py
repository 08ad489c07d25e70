"""Sequences edited: gaps cut out, consensus written, reads compared with their reference in batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.cigar import ref_blocks

# --- gaps ---------------------------------------------------------------------------------------


def gap_tracts(seq: str, least: int = 1000, penalty: int = 10) -> list[tuple[int, int]]:
    """Tracts of N with few other bases inside, half-open: N counts 1, any other base -``penalty``.

    A tract goes from a first N as far as the running score is greatest before it falls below 0, and back from there in the
    same way. The score only changes direction at the borders of runs of N, so runs are looped over, not bases.
    """
    runs = [m.span() for m in re.finditer("[Nn]+", seq)]
    out, k = [], 0
    while k < len(runs):
        score = best = 0
        last = k
        for i in range(k, len(runs)):
            score -= penalty * (runs[i][0] - runs[i - 1][1]) if i > k else 0
            if score < 0:
                break
            score += runs[i][1] - runs[i][0]
            if score > best:
                best, last = score, i
        score = best = 0
        first = last
        for i in range(last, -1, -1):
            score -= penalty * (runs[i + 1][0] - runs[i][1]) if i < last else 0
            if score < 0:
                break
            score += runs[i][1] - runs[i][0]
            if score > best:
                best, first = score, i
        if runs[last][1] - runs[first][0] >= least:
            out.append((runs[first][0], runs[last][1]))
        k = last + 1
    return out


def cut_at_gaps(df: DataFrame, key: str, seq: str = "seq", least: int = 1000, penalty: int = 10, gaps: bool = False) -> DataFrame:
    """(key, beg, end) of what lies between the gap tracts of each sequence, or of the tracts themselves; half-open.

    A null or empty sequence gives nothing, one without tracts itself."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, beg, end = [], [], []
            for i, s in enumerate(b.column("s").to_pylist()):
                tracts = gap_tracts(s, least, penalty) if s else []
                edges = tracts if gaps else list(zip([0, *(e for _, e in tracts)], [*(a for a, _ in tracts), len(s or "")]))
                for x, y in edges:
                    if x < y:
                        rows.append(i)
                        beg.append(x)
                        end.append(y)
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(rows, pa.int64())), pa.array(beg, pa.int32()), pa.array(end, pa.int32())], [key, "beg", "end"])

    return df.select(F.col(key).alias("k"), F.col(seq).alias("s")).mapInArrow(run, f"`{key}` {kind}, beg int, end int")


# --- consensus ----------------------------------------------------------------------------------

HETEROZYGOUS = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}


def two_bases(a: Column, b: Column) -> Column:
    """The code of two bases, N where there is none."""
    pair = F.concat(F.least(a, b), F.greatest(a, b))
    out = F.lit("N")
    for k, v in HETEROZYGOUS.items():
        out = F.when(pair == k, v).otherwise(out)
    return out


def called_bases(sites: DataFrame, min_depth: int = 3, max_depth: int = 100_000, min_mapq: int = 10) -> DataFrame:
    """(chrom, pos, base, qual) of single-base records (chrom, pos 0-based, ref, alt, fq, af, mq, dp): below 0 ``fq`` means
    one allele, the alternative one from a frequency of one half; else both. In capitals where depth and mapping
    quality are within the bounds. ``alt`` "." is the reference."""
    one = F.when((F.coalesce("af", F.lit(0.0)) < 0.5) | (F.col("alt") == "."), F.col("ref")).otherwise(F.col("alt"))
    base = F.lower(F.when(F.col("fq") < 0, one).otherwise(two_bases(F.col("ref"), F.col("alt"))))
    good = F.coalesce((F.col("mq") >= min_mapq) & F.col("dp").between(min_depth, max_depth), F.lit(False))
    quality = F.least(F.floor(F.abs("fq") + 33 + 0.499), F.lit(126)).cast("int")
    x = sites.where((F.length("ref") == 1) & (F.length("alt") == 1))
    return x.select("chrom", "pos", F.when(good, F.upper(base)).otherwise(base).alias("base"), F.char(quality).alias("qual"))


def consensus(called: DataFrame, indels: DataFrame | None = None, near: int = 5, width: int = 1 << 16) -> DataFrame:
    """(chrom, chunk, seq, qual): the consensus in chunks of ``width`` bases, ``n`` and ``!`` where nothing is called.

    ``called``: (chrom, pos, base, qual), the greatest of repeated positions stays; ``indels``: (chrom, pos, length of the reference allele), bases within ``near`` of one
    come out in small letters. A chunk runs to its last called base, and chunks without any are left out: they are
    all ``n``. A chromosome is as many rows as it has chunks, so no string grows with it.
    """
    x = called.withColumn("chunk", F.floor(F.col("pos") / width))
    x = x.groupBy("chrom", "chunk", "pos").agg(F.max(F.struct("base", "qual")).alias("__c"))
    x = x.select("chrom", "chunk", "pos", "__c.base", "__c.qual")
    if indels is not None:
        around = indels.select(F.col("chrom"), F.explode(F.sequence(F.greatest(F.col("pos") - near, F.lit(0)), F.col("pos") + F.col("length") - 1 + near)).alias("pos")).distinct()
        x = x.join(around.withColumn("__near", F.lit(True)), ["chrom", "pos"], "left").withColumn("base", F.when(F.col("__near"), F.lower("base")).otherwise(F.col("base")))
    x = x.select("chrom", "chunk", (F.col("pos") - F.col("chunk") * width).cast("int").alias("at"), "base", "qual")
    kind = x.schema["chrom"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, qual, last = None, np.full(width, ord("n"), np.uint8), np.full(width, ord("!"), np.uint8), -1

        def out() -> pa.RecordBatch:
            text = [pa.array([v[: last + 1].tobytes().decode()]) for v in (seq, qual)]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], kinds[0]), pa.array([key[1]], pa.int64()), *text], ["chrom", "chunk", "seq", "qual"])

        for b in batches:
            if not b.num_rows:
                continue
            kinds = [b.schema.field("chrom").type]
            chrom, chunk = b.column("chrom"), b.column("chunk").to_numpy()
            code = chrom.dictionary_encode().indices.fill_null(-1).to_numpy()
            at = b.column("at").to_numpy()
            letters = [np.frombuffer("".join(b.column(c).to_pylist()).encode(), np.uint8) for c in ("base", "qual")]
            new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])]))
            for lo, hi in zip(new.tolist(), [*new[1:].tolist(), b.num_rows]):
                now = (chrom[lo].as_py(), int(chunk[lo]))
                if now != key:
                    if key is not None:
                        yield out()
                    key, last = now, -1
                    seq[:], qual[:] = ord("n"), ord("!")
                seq[at[lo:hi]], qual[at[lo:hi]] = letters[0][lo:hi], letters[1][lo:hi]
                last = max(last, int(at[hi - 1]))
        if key is not None:
            yield out()

    return x.repartition("chrom", "chunk").sortWithinPartitions("chrom", "chunk", "at").mapInArrow(run, f"chrom {kind}, chunk bigint, seq string, qual string")


def indel_alleles(genotype: Column) -> Column:
    """struct<ref, alt> of a consensus genotype of insertions and deletions as +XY/-Z, as two alleles against a shared reference
    base N; null where there is none."""
    parts = F.filter(F.split(genotype, "/"), lambda p: p.rlike(r"^[+-].+"))
    ref = lambda p: F.when(p.startswith("-"), F.concat(F.lit("N"), F.substring(p, F.lit(2), F.length(p)))).otherwise("N")
    alt = lambda p: F.when(p.startswith("+"), F.concat(F.lit("N"), F.substring(p, F.lit(2), F.length(p)))).otherwise("N")
    a, b = F.get(parts, 0), F.get(parts, 1)
    ra, rb, aa, ab = ref(a), ref(b), alt(a), alt(b)
    longer = F.when(F.length(ra) < F.length(rb), rb).otherwise(ra)
    fill = lambda x, own: F.concat(x, F.repeat(F.lit("N"), F.length(longer) - F.length(own)))
    first, second = fill(aa, ra), fill(ab, rb)
    both = (
        F.when(F.length(ra) < F.length(rb), F.concat(first, F.lit(","), second)).when(F.length(ra) > F.length(rb), F.concat(second, F.lit(","), first))
        .when(first == second, first).otherwise(F.concat(first, F.lit(","), second))
    )
    return F.when(b.isNotNull(), F.struct(longer.alias("ref"), both.alias("alt"))).when(a.isNotNull(), F.struct(ra.alias("ref"), aa.alias("alt")))


# --- reads against their reference --------------------------------------------------------------


def _flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column in capitals, and where each row begins."""
    texts = [t.upper().encode() if t is not None else b"" for t in column.to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _spread(beg: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """beg, beg + 1, ... of every row, n of them, and the row of each."""
    row = np.repeat(np.arange(len(n)), n)
    return beg[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), row


def _compared(b: pa.RecordBatch) -> tuple:
    """Bases of a batch that stand against a reference base: (row, offset on read, offset on reference, read base, reference base),
    and the blocks (row, op, beg, end, qbeg)."""
    blocks = b.column("blocks")
    offsets = blocks.offsets.to_numpy().astype(np.int64)
    inner = blocks.flatten()
    of = lambda c: inner.field(c).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
    op, beg, end, qbeg = (of(c) for c in ("op", "beg", "end", "qbeg"))
    start = b.column("ref_beg").to_numpy(zero_copy_only=False)[row]
    seq, seq_at = _flat_text(b.column("seq"))
    ref, ref_at = _flat_text(b.column("ref_seq"))
    base = np.isin(op, ["M", "=", "X"])
    q, which = _spread(qbeg[base], (end - beg)[base])
    r, _ = _spread((beg - start)[base], (end - beg)[base])
    rows = row[base][which]
    ok = (q < np.diff(seq_at)[rows]) & (r >= 0) & (r < np.diff(ref_at)[rows])
    q, r, rows = q[ok], r[ok], rows[ok]
    return rows, q, r, seq[seq_at[rows] + q], ref[ref_at[rows] + r], (row, op, beg - start, end - start, qbeg), (ref, ref_at)


def _prepared(df: DataFrame, extra: list[str]) -> DataFrame:
    inserted = F.coalesce(F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)I"), F.lit(1)), F.lit(0), lambda a, n: a + n.cast("int")), F.lit(0))
    usable = F.coalesce((F.col("cigar") != "*") & (F.col("seq") != "*") & F.col("ref_seq").isNotNull(), F.lit(False))
    return df.select("*", ref_blocks("pos", "cigar", keep="MDN=X").alias("blocks"), inserted.alias("inserted"), usable.alias("usable")).select(*dict.fromkeys([*df.columns, *extra]), "blocks", "inserted", "usable")


def _added(df: DataFrame, work: DataFrame, columns: str, make) -> DataFrame:
    """df with the columns ``make`` computes from each batch of ``work``, which has the columns of df first."""
    own = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *make(b)], [*own, *names])

    return work.mapInArrow(run, f"{schema}, {columns}")


def calmd(df: DataFrame) -> DataFrame:
    """The reads (pos, cigar, seq) with nm and md against the reference slice ``ref_seq`` that begins at ``ref_beg``; null where there is
    no CIGAR, sequence or reference. Bases are compared for the whole batch at once; only mismatches and
    deletions are looped over for the text."""

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        rows, q, r, x, y, (row, op, beg, end, _), (ref, ref_at) = _compared(b)
        differs = (x != y) & (x != ord("="))
        deleted = op == "D"
        n = b.num_rows
        nm = np.bincount(rows[differs], minlength=n) + np.bincount(row[deleted], (end - beg)[deleted], n).astype(np.int64) + b.column("inserted").to_numpy()
        # matched bases before each base of its read
        same = np.concatenate([[0], np.cumsum(~differs)])
        first = np.searchsorted(rows, np.arange(n + 1))
        events: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        at = np.flatnonzero(differs)
        for i, k, c in zip(rows[at].tolist(), (same[at] - same[first[rows[at]]]).tolist(), y[at].tolist()):
            events[i].append((k, chr(c)))
        texts, usable = [], b.column("usable").to_pylist()
        if deleted.any():
            order = {}
            for i, a, e in zip(row[deleted].tolist(), beg[deleted].tolist(), end[deleted].tolist()):
                done = int(np.searchsorted(r[first[i] : first[i + 1]], a)) + int(first[i])
                order.setdefault(i, []).append((int(same[done] - same[first[i]]), done - int(first[i]), "^" + ref[ref_at[i] + a : ref_at[i] + e].tobytes().decode()))
            for i, more in order.items():
                # mismatches with as many matches before them keep their order by place
                places = np.flatnonzero(differs[first[i] : first[i + 1]]).tolist()
                both = sorted([(p, 1, k, t) for p, (k, t) in zip(places, events[i])] + [(p, 0, k, t) for k, p, t in more])
                events[i] = [(k, t) for _, _, k, t in both]
        total = (same[first[1:]] - same[first[:-1]]).tolist()
        for i in range(n):
            out, seen = [], 0
            for k, t in events[i]:
                out += [str(k - seen), t]
                seen = k
            texts.append("".join(out) + str(total[i] - seen) if usable[i] else None)
        ok = np.array(usable)
        return [pa.array(nm.astype(np.int32), mask=~ok), pa.array(texts, pa.string())]

    return _added(df, _prepared(df, []), "nm int, md string", make)


def capped_quality(df: DataFrame, threshold: int = 40, mode: str = "intended") -> DataFrame:
    """The reads (pos, cigar, seq, base qualities ``quals``) with ``cap``: the mapping quality that mismatches of good bases allow, -1 where they
    weigh more than ``threshold``. ``reference`` counts every aligned base twice in the length, as the established tool does."""
    clip = lambda o: F.aggregate(F.regexp_extract_all("cigar", F.lit(rf"(\d+){o}"), F.lit(1)), F.lit(0), lambda a, n: a + n.cast("int"))
    lead = F.coalesce(F.expr("try_cast(nullif(regexp_extract(cigar, '^(?:[0-9]+H)?([0-9]+)S', 1), '') as int)"), F.lit(0))
    tail = clip("S") - lead
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)
    clipped = total(F.slice("quals", F.lit(1), lead)) + total(F.slice("quals", F.size("quals") - tail + 1, tail)) + 13 * clip("H")
    work = _prepared(df, []).withColumn("clipped", F.coalesce(clipped, F.lit(0)))

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        rows, q, _, x, y, (row, op, beg, end, _), _ = _compared(b)
        quals = b.column("quals")
        at = quals.offsets.to_numpy().astype(np.int64)
        quality = quals.values.to_numpy(zero_copy_only=False)[at[rows] + q]
        n = b.num_rows
        counts = (x != ord("N")) & (y != ord("N")) & (quality >= 13)
        wrong = counts & (x != y) & (x != ord("="))
        length = np.bincount(rows[counts], minlength=n).astype(float)
        if mode == "reference":
            base = np.isin(op, ["M", "=", "X"])
            length += np.bincount(row[base], (end - beg)[base], n)
        mm = np.bincount(rows[wrong], minlength=n)
        weight = np.bincount(rows[wrong], np.minimum(quality[wrong], 33), n)
        # log of length ** mm / mm!
        factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, max(int(mm.max(initial=0)), 1) + 1)))])
        t = weight - 4.343 * (mm * np.log(np.maximum(length, 1)) - factorial[mm]) + b.column("clipped").to_numpy() / 5
        cap = np.floor(np.sqrt(np.clip(threshold - np.maximum(t, 0), 0, None) / threshold) * threshold + 0.499)
        return [pa.array(np.where(t > threshold, -1, cap).astype(np.int32), mask=~np.array(b.column("usable").to_pylist()))]

    return _added(df, work, "cap int", make)


def aligned(df: DataFrame, a: str, b: str, band: int = 50) -> DataFrame:
    """The rows with ``score`` and ``cigar`` of the best global alignment of two texts, within ``band`` of the diagonal (wider where
    their lengths differ by more); null where one is null."""
    from readloom.operators.realign import global_align

    own = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = [global_align(p, q, band=band) if p is not None and q is not None else (None, None) for p, q in zip(x.column(a).to_pylist(), x.column(b).to_pylist())]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], [*own, "score", "cigar"])

    return df.mapInArrow(run, f"{schema}, score int, cigar string")
