"""Row operators that compare reads with their reference, and segmentation along contigs."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.aggregates import depth_runs


def nm_md(pos: int, cigar: str, seq: str, ref: str) -> tuple[int, str]:
    """Edit distance and mismatch string of one read; the reference begins at 0."""
    nm, run, out, r, q = 0, 0, [], pos, 0
    for n, op in ((int(a), b) for a, b in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        if op in "M=X":
            for k in range(n):
                a, b = seq[q + k].upper(), ref[r + k].upper() if r + k < len(ref) else "N"
                if a in (b, "="):
                    run += 1
                else:
                    nm += 1
                    out.append(f"{run}{b}")
                    run = 0
            r, q = r + n, q + n
        elif op == "D":
            out.append(f"{run}^{ref[r:r + n].upper()}")
            run, nm, r = 0, nm + n, r + n
        elif op == "I":
            nm, q = nm + n, q + n
        elif op == "S":
            q += n
        elif op == "N":
            r += n
    return nm, "".join(out) + str(run)


def global_align(a: str, b: str, match: int = 1, mismatch: int = -3, gap_open: int = -5, gap_extend: int = -2, band: int | None = None) -> tuple[int, str]:
    """Score and CIGAR of the best global alignment of two sequences, with affine gaps.

    Row by row with numpy; gaps along the row by a running maximum, so only rows are looped over. With ``band``
    cells farther from the diagonal are left out; it is never narrower than the lengths differ.
    """
    n, m = len(a), len(b)
    reach = max(n, m) if band is None else max(band, abs(n - m))
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    low = -(10**9)
    steps = np.arange(m + 1)
    h = np.where(steps > 0, gap_open + gap_extend * steps, 0)
    e = np.full(m + 1, low)  # ends in a base of a alone
    trace_h, trace_e, trace_f = [], [], []
    for i in range(1, n + 1):
        e_open, e_more = h + gap_open + gap_extend, e + gap_extend
        e = np.maximum(e_open, e_more)
        diag = np.full(m + 1, low)
        diag[1:] = h[:-1] + np.where(y == x[i - 1], match, mismatch)
        best = np.maximum(diag, e)
        best[0] = e[0] = gap_open + gap_extend * i
        # f[j]: the best start k < j of a gap along the row, from a running maximum
        start = np.maximum.accumulate(best - gap_extend * steps)
        f = np.full(m + 1, low)
        f[1:] = start[:-1] + gap_open + gap_extend * steps[1:]
        new = np.maximum(best, f)
        if reach < max(n, m):
            new[np.abs(steps - i) > reach] = low
            e[np.abs(steps - i) > reach] = low
        trace_h.append(np.where(new == diag, 0, np.where(new == e, 1, 2)))
        trace_e.append(e == e_more)
        trace_f.append((new, f))
        h = new
    ops, i, j, state = [], n, m, 0
    while i > 0 or j > 0:
        if i == 0:
            ops.append("D")
            j -= 1
        elif j == 0:
            ops.append("I")
            i -= 1
        elif state == 1:
            ops.append("I")
            state = 1 if trace_e[i - 1][j] and i > 1 else 0
            i -= 1
        elif state == 2:
            ops.append("D")
            new, f = trace_f[i - 1]
            state = 0 if f[j] == new[j - 1] + gap_open + gap_extend else 2
            j -= 1
        elif trace_h[i - 1][j] == 0:
            ops.append("M")
            i, j = i - 1, j - 1
        else:
            state = int(trace_h[i - 1][j])
    out = "".join(f"{len(g[0])}{g[0][0]}" for g in re.finditer(r"M+|I+|D+", "".join(reversed(ops))))
    return int(h[m]), out


def two_state_path(score: np.ndarray, change: float) -> np.ndarray:
    """Best 0/1 path where state 1 scores ``score`` and state 0 nothing, and a change costs ``change``."""
    back = np.zeros((len(score), 2), np.int8)
    a = b = 0.0
    for i, s in enumerate(score.tolist()):
        from_b, from_a = b - change, a - change
        back[i] = (from_b > a, from_a <= b)
        a, b = max(a, from_b), max(b, from_a) + s
    path, state = np.zeros(len(score), np.int8), int(b > a)
    for i in range(len(score) - 1, -1, -1):
        path[i] = state
        state = int(back[i, state])
    return path


def target_regions(blocks: DataFrame, chrom: str = "tid", window: int = 100, least: float = 1.0, change: float = 3.0) -> DataFrame:
    """(chrom, start, stop) of contiguous covered targets: a two-state path over the mean depth of windows.

    Depths are summed per window natively; only windows that hold any depth, one row each, go to the
    path of their contig, which is bounded by the contig's length over ``window``.
    """
    runs = depth_runs(blocks, chrom)
    runs = runs.withColumn("w", F.explode(F.sequence(F.floor(F.col("beg") / window), F.floor((F.col("end") - 1) / window))))
    size = F.least("end", (F.col("w") + 1) * window) - F.greatest("beg", F.col("w") * window)
    means = runs.groupBy(chrom, "w").agg((F.sum(size * F.col("depth")) / window).alias("mean"))

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("w")
        w, mean = frame["w"].to_numpy(), frame["mean"].to_numpy()
        out = []
        part = np.flatnonzero(np.r_[True, np.diff(w) > 1])  # an empty stretch ends a target
        for a, b in zip(part, np.r_[part[1:], len(w)]):
            on = two_state_path(np.log((mean[a:b] + 0.1) / (least + 0.1)), change)
            edge = np.flatnonzero(np.diff(np.r_[0, on, 0]))
            out += [(w[a] + s, w[a] + e) for s, e in zip(edge[::2], edge[1::2])]
        key = frame[chrom].iloc[0]
        return pd.DataFrame([(key, s * window, e * window) for s, e in out], columns=[chrom, "start", "stop"])

    return means.groupBy(chrom).applyInPandas(cut, f"{chrom} int, start bigint, stop bigint")


def simulate_reads(refs: DataFrame, per_base: float = 0.05, length: int = 70, insert: int = 300, error: float = 0.01, seed: int = 11) -> DataFrame:
    """Read pairs of sequences (name, seq): (qname, name, pos1, pos2, seq1, seq2), errors drawn by hash.

    The name holds the true places, so a mapping of the reads can be judged.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = str.maketrans("ACGTacgt", "TGCAtgca")
        for f in frames:
            rows = []
            for name, seq in zip(f["name"], f["seq"]):
                if not isinstance(seq, str) or len(seq) < insert:
                    continue
                rng = np.random.default_rng([seed, zlib.crc32(str(name).encode())])
                for k in range(int(len(seq) * per_base)):
                    a = int(rng.integers(0, len(seq) - insert + 1))
                    b = a + insert - length

                    def noisy(s: str) -> str:
                        hit = rng.random(len(s)) < error
                        return "".join("ACGT"[rng.integers(0, 4)] if h else c for c, h in zip(s, hit))

                    rows.append((f"{name}_{a}_{b}_{k}", str(name), a, b, noisy(seq[a : a + length]), noisy(seq[b : b + length].translate(turn)[::-1])))
            yield pd.DataFrame(rows, columns=["qname", "name", "pos1", "pos2", "seq1", "seq2"])

    return refs.mapInPandas(run, "qname string, name string, pos1 int, pos2 int, seq1 string, seq2 string")
