"""Base alignment quality: how sure it is that a base stands against the reference base it is aligned with.

A hidden Markov model of matches, insertions and deletions, global for the read and local for the reference
(published as a probabilistic realignment), run forward and backward over a band. The reads of a batch that have one
shape go through together: every step is a vector operation over reads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values of the model: gap open, gap extension, emission of a wrong and of an inserted base, least band
OPEN, EXTEND, WRONG, INSERTED, BAND = 0.001, 0.1, 0.33333333333, 0.25, 7
_CODE = np.full(256, 4, np.int8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def posterior(ref: np.ndarray, query: np.ndarray, error: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(reference place, whether it is an insertion, phred of its being wrong) of every base of every read.

    ``ref`` (reads, reference bases) and ``query`` (reads, bases) in codes 0..3, 4 for an unknown base, ``error`` (reads, bases).
    Cells of a row lie on a band of 2 * band + 1 diagonals; slot w of row i is reference base i + w - band.
    """
    n, lq = query.shape
    lr = ref.shape[1]
    bw = max(min(max(lr, lq), band), abs(lr - lq))
    width = 2 * bw + 1
    end = 1.0 / (2 * lq + 2)
    mm, mi, md = (1 - 2 * OPEN) * (1 - end), OPEN * (1 - end), OPEN * (1 - end)
    im, ii = (1 - EXTEND) * (1 - end), EXTEND * (1 - end)
    dm, dd = 1 - EXTEND, EXTEND
    first_m, first_i = (1 - OPEN) / lr, OPEN / lr
    slots = np.arange(width)
    padded = np.concatenate([ref, np.full((n, 1), 4, ref.dtype)], 1)

    def emission(i: int) -> np.ndarray:
        """Of base i (from 1) against the reference bases of its row: (slots, reads)."""
        r = padded[:, np.clip(i + slots - bw - 1, 0, lr)].T
        q, e = query[:, i - 1], error[:, i - 1]
        return np.where((r > 3) | (q > 3), 1.0, np.where(r == q, 1 - e, e * WRONG))

    def inside(i: int) -> np.ndarray:
        k = i + slots - bw
        return (k >= 1) & (k <= lr)

    zero = np.zeros((1, n))
    forward = np.zeros((lq + 1, 3, width, n))
    scale = np.ones((lq + 2, n))
    for i in range(1, lq + 1):
        ok = inside(i)[:, None]
        e = emission(i)
        m, ins, dele = forward[i]
        if i == 1:
            ok = ok & (slots >= bw)[:, None]
            m[:], ins[:] = np.where(ok, e * first_m, 0), np.where(ok, INSERTED * first_i, 0)
        else:
            pm, pi, pd = forward[i - 1]
            m[:] = np.where(ok, e * (mm * pm + im * pi + dm * pd), 0)
            up = lambda v: np.concatenate([v[1:], zero])
            ins[:] = np.where(ok, INSERTED * (mi * up(pm) + ii * up(pi)), 0)
            for w in np.flatnonzero(ok[:, 0]):
                if w:
                    dele[w] = md * m[w - 1] + dd * dele[w - 1]
        scale[i] = forward[i].sum((0, 1))
        forward[i] /= scale[i]
    scale[lq + 1] = (forward[lq, 0] + forward[lq, 1]).sum(0) * end
    back = np.zeros((3, width, n))
    ok = inside(lq)[:, None]
    back[0] = back[1] = np.where(ok, end / scale[lq] / scale[lq + 1], 0)
    place, insertion, phred = np.zeros((n, lq), np.int64), np.zeros((n, lq), bool), np.zeros((n, lq), np.int64)
    for i in range(lq, 0, -1):
        if i < lq:
            ok = inside(i)[:, None]
            nm, ni, _ = back
            e = np.where((i + slots - bw < lr)[:, None], emission(i + 1) * nm, 0)
            down = np.concatenate([zero, ni[:-1]])
            new = np.zeros_like(back)
            for w in np.flatnonzero(ok[:, 0])[::-1]:
                after = new[2, w + 1] if w + 1 < width else 0.0
                new[0, w] = e[w] * mm + INSERTED * mi * down[w] + md * after
                new[1, w] = e[w] * im + INSERTED * ii * down[w]
                new[2, w] = e[w] * dm + dd * after if i > 1 else 0.0
            back = new / scale[i]
        z = (forward[i] * back)[:2].reshape(2 * width, n)
        total = np.maximum(z.sum(0), 1e-300)
        best = z.argmax(0)
        place[:, i - 1] = best % width + i - bw - 1
        insertion[:, i - 1] = best >= width
        wrong = 1 - z[best, np.arange(n)] / total
        value = np.floor(-4.343 * np.log(np.maximum(wrong, 1e-45)) + 0.499)
        phred[:, i - 1] = np.where(value > 100, 99, value)
    return place, insertion, phred


def _shape(pos: int, cigar: str, bases: int) -> tuple[int, int, int, list[tuple[int, int, int]]] | None:
    """(first and last reference base to look at, band, aligned stretches (read, reference, length)); None where there is nothing to do."""
    x, y, aligned = pos, 0, []
    for n, op in ((int(a), b) for a, b in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        if op in "M=X":
            aligned.append((y, x, n))
            x, y = x + n, y + n
        elif op in "IS":
            y += n
        elif op == "D":
            x += n
        elif op == "N":
            return None
    if not aligned or not bases:
        return None
    yb, xb = aligned[0][:2]
    ye, xe = aligned[-1][0] + aligned[-1][2], aligned[-1][1] + aligned[-1][2]
    skew = abs((xe - xb) - (ye - yb))
    band = skew + 3 if skew > BAND else BAND
    xb, xe = max(0, xb - yb - band // 2), xe + bases - ye + band // 2
    spare = xe - xb - bases - band
    if spare > 0:
        xb, xe = xb + spare // 2, xe - (xe - xb - spare // 2 - bases - band) // 2
    return xb, xe, band, aligned


def base_alignment_quality(df: DataFrame, extended: bool = False, chunk: int = 512) -> DataFrame:
    """The reads (pos, cigar, seq, base qualities ``quals``) with ``baq``, the qualities lowered to what the alignment of each
    base is worth, against the reference slice ``ref_seq`` that begins at ``ref_beg``. ``extended``: a base takes over
    the lesser of the best values to its left and right in its stretch before it is compared. Reads with skips or without
    alignment, sequence or reference keep their qualities.
    """
    own = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(c).to_pylist() for c in ("pos", "cigar", "seq", "quals", "ref_seq", "ref_beg")]
            out, shapes, groups = list(rows[3]), {}, {}
            for i, (pos, cigar, seq, quals, ref, beg) in enumerate(zip(*rows)):
                if None in (pos, cigar, seq, quals, ref, beg) or seq == "*" or len(quals) != len(seq):
                    continue
                shape = _shape(pos, cigar, len(seq))
                if shape is None:
                    continue
                lo, hi = max(shape[0], beg), min(shape[1], beg + len(ref))
                if hi > lo and sum(n for *_, n in shape[3]):
                    shapes[i] = (lo, hi, shape[2], shape[3])
                    groups.setdefault((len(seq), hi - lo, shape[2]), []).append(i)
            for (lq, lr, band), members in groups.items():
                for a in range(0, len(members), chunk):
                    part = members[a : a + chunk]
                    text = lambda t: _CODE[np.frombuffer(t.encode(), np.uint8)]
                    query = np.stack([text(rows[2][i]) for i in part])
                    ref = np.stack([text(rows[4][i][shapes[i][0] - rows[5][i] : shapes[i][1] - rows[5][i]]) for i in part])
                    quals = np.array([rows[3][i] for i in part])
                    place, insertion, phred = posterior(ref, query, 10.0 ** (-quals / 10), band)
                    for r, i in enumerate(part):
                        value = quals[r].copy()
                        for y, x, n in shapes[i][3]:
                            fits = ~insertion[r, y : y + n] & (place[r, y : y + n] == x - shapes[i][0] + np.arange(n))
                            worth = np.where(fits, phred[r, y : y + n], 0)
                            if extended:
                                worth = np.minimum(np.maximum.accumulate(worth), np.maximum.accumulate(worth[::-1])[::-1])
                            value[y : y + n] = np.minimum(value[y : y + n], worth)
                        out[i] = value.tolist()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(out, pa.list_(pa.int32()))], [*own, "baq"])

    return df.mapInArrow(run, f"{schema}, baq array<int>")


def quality_tag(quals: str = "quals", baq: str = "baq"):
    """The tag that holds what was taken off every base, as characters from @ on."""
    return F.array_join(F.transform(F.arrays_zip(F.col(quals).alias("a"), F.col(baq).alias("b")), lambda z: F.char(z["a"] - z["b"] + 64)), "")
