"""Evaluation passages in training text.

Two kinds of windows are cut from the items: passages of ``window`` words at every word, for items that
leaked in part, and windows as long as the item (by length class), for items leaked whole with edits all
over. Every document is read at every word. A window is embedded by a CGK random walk: step j writes the word the
walk stands on and moves on if bit j of that word's hash is set, so windows at a small edit distance are
written at a small Hamming distance. A signature is the words at ``bits`` sampled steps. Equal windows have
equal signatures whatever the walk; for windows at most k word edits apart walk and sample are repeated until
the wanted recall is reached, measured on edited copies of the items' own windows, with words changed, left
out, put in, and all of it mixed. Where ``most`` walks don't reach it, exact pieces take their place: k edits leave one
of k + 1 pieces whole, so none is missed. Every candidate is verified by exact edit distance over words.

One plan for any number of items: the signatures of the items set the bits of a table of bounded size, the
tasks over the documents keep the places whose signature is in the table (it passes some too many, never too
few), and these alone are joined by signature with the items, salted so that a signature half of the corpus
has is no single task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.words import flat, word_hashes

_PAD = np.uint64(0x9AE16A3B2F90404F)
_P = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 15
_SPAN = 1 << 20
_SAMPLE = 1000
KINDS = ("changed", "left out", "put in", "mixed")


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    x = h ^ np.uint64((seed * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Walk:
    """One repetition: a random walk and the sampled steps of its output."""

    def __init__(self, window: int, bits: int, seed: int) -> None:
        self.window, self.seed = window, seed
        self.sample = np.sort(np.random.default_rng(1000 + seed).choice(2 * window, bits, replace=False)).tolist()

    def signatures(self, words: np.ndarray, starts: np.ndarray, stops: np.ndarray | None = None) -> np.ndarray:
        """Signature of the window at each start, up to its text's stop if that is nearer; ``words`` (uint64) reaches one word beyond the last."""
        moves = _mixed(words, self.seed)
        out = np.empty(len(starts), np.uint64)
        for a in range(0, len(starts), _BLOCK):
            first = starts[a : a + _BLOCK].astype(np.int64)
            at, end = first.copy(), first + self.window
            if stops is not None:
                np.minimum(end, stops[a : a + _BLOCK], out=end)
            sig = np.full(len(first), np.uint64(self.seed + 1))
            for j in range(self.sample[-1] + 1):
                if j in self.sample:
                    sig = (sig ^ np.where(at < end, words[at], _PAD)) * _P
                    sig ^= sig >> np.uint64(32)
                at += ((moves[at] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
                np.minimum(at, end, out=at)
            out[a : a + _BLOCK] = sig
        return out


class Piece:
    """The words [at, at + length) of a window, for the exact way."""

    def __init__(self, at: int, length: int) -> None:
        self.at, self.length = at, length

    def signatures(self, words: np.ndarray, starts: np.ndarray, stops: np.ndarray | None = None) -> np.ndarray:
        first = starts.astype(np.int64) + self.at
        end = first + self.length if stops is None else stops
        sig = np.full(len(first), np.uint64(0xA24BAED4963EE407 + self.at))
        for j in range(self.length):
            at = first + j
            sig = (sig ^ np.where(at < end, words[np.minimum(at, len(words) - 1)], _PAD)) * _P
            sig ^= sig >> np.uint64(32)
        return sig


def edit_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Levenshtein distance of each row of x to the same row of y, over words."""
    return prefix_distances(x, y)[-1]


def prefix_distances(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Levenshtein distance of each row of x to the first 0, 1, ... words of the same row of y."""
    n, m = x.shape[1], y.shape[1]
    previous = [np.full(len(x), j, np.int16) for j in range(m + 1)]
    for i in range(1, n + 1):
        row = [np.full(len(x), i, np.int16)]
        for j in range(1, m + 1):
            change = previous[j - 1] + (x[:, i - 1] != y[:, j - 1])
            row.append(np.minimum(np.minimum(previous[j], row[j - 1]) + 1, change))
        previous = row
    return previous


def edited(windows: np.ndarray, edits: int, kind: str, seed: int) -> np.ndarray:
    """What a window of the same size shows of copies with ``edits`` words changed, left out or put in."""
    rng = np.random.default_rng(seed)
    n, w = windows.shape
    fresh = lambda *shape: rng.integers(1, 2**63, shape, dtype=np.uint64)
    out = np.concatenate([windows, fresh(n, edits)], axis=1)
    rows, step = np.arange(n), np.arange(w + edits)
    for _ in range(edits):
        at = rng.integers(0, w, n)
        what = rng.integers(0, 3, n) if kind == "mixed" else np.full(n, KINDS.index(kind))
        move = (what == 1).astype(np.int64)[:, None] * (step >= at[:, None]) - (what == 2).astype(np.int64)[:, None] * (step > at[:, None])
        out = np.take_along_axis(out, np.minimum(step + move, w + edits - 1), 1)
        put = what != 1
        out[rows[put], at[put]] = fresh(int(put.sum()))
    return out[:, :w]


def _hits(signers: list, windows: np.ndarray, copies: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each signer, which rows of each of the copies have the signature of their window."""
    pad, at = np.zeros(1, np.uint64), np.arange(len(windows)) * windows.shape[1]
    for s in signers:
        a, *b = (s.signatures(np.concatenate([x.ravel(), pad]), at) for x in (windows, *copies))
        yield a == np.stack(b)


def plan_walks(windows: np.ndarray, bits: int, max_edits: int, recall: float, most: int = 64) -> list:
    """As many walks as the measured hit rate at ``max_edits`` asks for, for the worst kind of edit.

    Measured on 1,000 edited copies of the given windows; at distance 0 every walk hits, so one is
    enough. Where ``most`` walks are not enough, the exact pieces come back instead.
    """
    window = windows.shape[1]
    walks = [Walk(window, min(bits, 2 * window), s) for s in range(most)]
    if max_edits == 0 or not len(windows):
        return walks[:1]
    some = windows[np.random.default_rng(3).permutation(_SAMPLE) % len(windows)]
    missed = np.ones((len(KINDS), len(some)), bool)
    for n, hit in enumerate(_hits(walks, some, [edited(some, max_edits, k, 5) for k in KINDS]), 1):
        missed &= ~hit
        if missed.mean(1).max() <= 0.8 * (1 - recall):  # the rest is for the error of the measurement
            return walks[:n]
    if max_edits >= window:
        raise ValueError("a window needs more words than edits")
    cuts = np.linspace(0, window, max_edits + 2).astype(int).tolist()
    return [Piece(a, b - a) for a, b in zip(cuts, cuts[1:])]


@dataclass
class Kind:
    """One class of windows: the items' windows of ``width`` words and how to look for them."""

    number: int
    width: int
    edits: int
    reach: int
    signers: list
    windows: np.ndarray

    @property
    def exact(self) -> bool:
        return isinstance(self.signers[0], Piece)

    def recall(self) -> dict[str, float]:
        """Measured on copies other than those the walks were chosen by; the exact way misses none."""
        if self.exact or not self.edits:
            return dict.fromkeys(KINDS, 1.0)
        some = self.windows[np.random.default_rng(4).permutation(2 * _SAMPLE) % len(self.windows)]
        found = np.zeros((len(KINDS), len(some)), bool)
        for hit in _hits(self.signers, some, [edited(some, self.edits, k, 6) for k in KINDS]):
            found |= hit
        return dict(zip(KINDS, found.mean(1).tolist()))


def passage_starts(offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all passages of ``window`` words that stay inside their text, and the text of each."""
    n = np.maximum(np.diff(offsets) - window + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return offsets[row] + step, row


class BitTable:
    """A set of 64-bit hashes in a table of bounded size: says yes to each of them and to few others."""

    PROBES = 3

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.bits, self.words = bits, words

    @staticmethod
    def places(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
        return (_mixed(h, 7001 + probe) >> np.uint64(64 - bits)).astype(np.int64)

    @classmethod
    def build(cls, hashes: DataFrame, n: int, most_bytes: int) -> BitTable:
        """From a column ``h`` of about ``n`` hashes. Tasks send the words of the table they set, so what
        reaches the driver has the size of the table at most (twice, with the places)."""
        bits = min(max(16, math.ceil(math.log2(max(n, 1) * 32))), int(math.log2(most_bytes * 8)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = b.column("h").to_numpy().view(np.uint64)
                at = np.unique(np.concatenate([cls.places(h, p, bits) for p in range(cls.PROBES)]))
                place, first = np.unique(at >> 6, return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(value.view(np.int64))], ["place", "value"])

        rows = hashes.select("h").mapInArrow(run, "place bigint, value bigint").groupBy("place").agg(F.bit_or("value").alias("value")).toArrow()
        words = np.zeros(max(1, (1 << bits) >> 6), np.int64)
        words[rows.column("place").to_numpy()] = rows.column("value").to_numpy()
        return cls(bits, words.view(np.uint64))

    def contains(self, h: np.ndarray) -> np.ndarray:
        """Indices of the hashes the table says yes to."""
        left = np.arange(len(h))
        for p in range(self.PROBES):
            at = self.places(h[left], p, self.bits)
            left = left[((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)]
        return left


def _lists(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(hi - lo)])
    inside = np.arange(ends[-1]) - np.repeat(ends[:-1] - lo, hi - lo)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[inside].view(np.int64)))


def _places(kinds: list[Kind], table: BitTable, vocabulary: BitTable):
    """The places of a task's texts whose signature is in the table, with the words around them edits may reach.

    A stretch at most k edits from a window has at most k words in its first ``width`` that no item has (twice
    that where the place may be off by the edits before a piece), so other places are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets = flat(b.column("words"))
            words = np.concatenate([values.view(np.uint64), np.zeros(1, np.uint64)])
            known = np.zeros(len(words), bool)
            known[vocabulary.contains(words[:-1])] = True
            upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(known)])
            for kind in kinds:
                starts, row = passage_starts(offsets, max(1, kind.width - kind.edits))
                for a in range(0, len(starts), _SPAN):  # bounded memory for texts of any length
                    s, r = starts[a : a + _SPAN], row[a : a + _SPAN]
                    slack = kind.edits * (2 if kind.exact else 1)
                    near = upto[np.minimum(s + kind.width, offsets[r + 1])] - upto[s] >= kind.width - slack
                    s, r = s[near], r[near]
                    if not len(s):
                        continue
                    for signer in kind.signers:
                        sig = signer.signatures(words, s, offsets[r + 1])
                        at = table.contains(sig)
                        for c in range(0, len(at), _BLOCK):
                            x = at[c : c + _BLOCK]
                            p, t = s[x], r[x]
                            lo, hi = np.maximum(p - kind.edits, offsets[t]), np.minimum(p + kind.reach + 2 * kind.edits, offsets[t + 1])
                            yield pa.RecordBatch.from_arrays(
                                [b.column("doc_id").take(pa.array(t)), pa.array(np.full(len(x), kind.number, np.int32)), pa.array(sig[x].view(np.int64)), pa.array(p - offsets[t]), pa.array(p - lo), _lists(words, lo, hi)],
                                ["doc_id", "kind", "sig", "at", "before", "stretch"],
                            )

    return run


def _sign(kinds: list[Kind]):
    """The signatures of the items' windows; ``words`` may be longer than the window."""
    by = {k.number: k for k in kinds}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = b.column("kind").to_numpy()
            for n in np.unique(number).tolist():
                mine = b.filter(pa.array(number == n))
                values, offsets = flat(mine.column("words"))
                words = np.concatenate([values.view(np.uint64), np.zeros(1, np.uint64)])
                for signer in by[n].signers:
                    sig = signer.signatures(words, offsets[:-1])
                    yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(sig.view(np.int64))], [*mine.schema.names, "h"])

    return run


def _matches(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, s: np.ndarray, passages: np.ndarray, max_edits: int, anchored: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits or -1, start, words) of the stretch of the text words[lo:hi] that matches the passage at s.

    A stretch equal to the passage counts as it is. Otherwise the nearest one of up to ``max_edits`` words
    more or less that starts at most ``max_edits`` words off s is taken, so that a stretch with a word
    too many or too few at its edge becomes the one it belongs to. ``anchored``: only what
    matches where it stands may move.
    """
    window = passages.shape[1]
    d, start, length = np.full(len(s), -1, np.int32), s.copy(), np.full(len(s), window)
    whole = np.flatnonzero(s + window <= hi)
    d[whole[(words[s[whole][:, None] + np.arange(window)] == passages[whole]).all(1)]] = 0
    rest = np.flatnonzero(d < 0) if max_edits else np.zeros(0, np.int64)
    for a in range(0, len(rest), _BLOCK):
        part = rest[a : a + _BLOCK]
        least = np.full(len(part), 1 << 40)
        for off in sorted(range(-max_edits, max_edits + 1), key=abs):
            b = s[part] + off
            y = words[np.clip(b[:, None] + np.arange(window + max_edits), 0, len(words) - 1)]
            far = prefix_distances(passages[part], y)
            for n in range(window - max_edits, window + max_edits + 1):
                rank = (far[n].astype(np.int64) * 1000 + abs(n - window)) * 1000 + abs(off)
                ok = (b >= lo[part]) & (b + n <= hi[part]) & (far[n] <= max_edits) & (rank < least)
                least[ok], d[part[ok]], start[part[ok]], length[part[ok]] = rank[ok], far[n][ok], b[ok], n
            if off == 0 and anchored:
                part, least = part[d[part] >= 0], least[d[part] >= 0]
    return d, start, length


def whole_matches(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, s: np.ndarray, items: np.ndarray, max_edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits or -1, start, words) of the nearest stretch of words[lo:hi] that starts at most ``max_edits`` words off s.

    One pass of the edit distance with a free start over a band of the table; among equally near starts of an end the one nearest to s.
    """
    n, k = items.shape[1], max_edits
    m = n + 3 * k
    at = s[:, None] - k + np.arange(m)
    inside = (at >= lo[:, None]) & (at < hi[:, None])
    y = np.where(inside, words[np.clip(at, 0, len(words) - 1)], _PAD)
    far = np.int64(1 << 40)
    # a cell holds edits * 2**20 + distance of the start from s * 2**10 + start
    order = np.abs(np.arange(2 * k + 1) - k) * 1024 + np.arange(2 * k + 1)
    free = np.concatenate([inside, np.zeros((len(s), 1), bool)], 1)
    previous = {j: np.where(free[:, j], order[j], far) for j in range(min(2 * k, m) + 1)}
    none = np.full(len(s), far)
    for i in range(1, n + 1):
        row: dict[int, np.ndarray] = {}
        for j in range(max(0, i - k), min(m, i + 3 * k) + 1):
            best = previous.get(j, none) + (1 << 20)
            if j:
                best = np.minimum(best, row.get(j - 1, none) + (1 << 20))
                best = np.minimum(best, previous.get(j - 1, none) + np.where((items[:, i - 1] == y[:, j - 1]) & inside[:, j - 1], 0, 1 << 20))
            row[j] = best
        previous = row
    ends = np.array(sorted(previous))
    cells = np.stack([np.where(inside[:, j - 1] if j else True, previous[j], far) for j in ends.tolist()], 1)
    edits, first = cells >> 20, cells & 1023
    length = ends[None] - first
    rank = edits * 4096 + np.abs(length - n)
    rows = np.arange(len(s))
    best = rank.argmin(1)
    d = np.where(edits[rows, best] <= k, edits[rows, best], -1).astype(np.int32)
    return d, s - k + first[rows, best], length[rows, best]


def _check(kinds: list[Kind], rate: float):
    by = {k.number: k for k in kinds}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            number = b.column("kind").to_numpy()
            item, item_at = flat(b.column("words"))
            size = np.diff(item_at)
            words, offsets = flat(b.column("stretch"))
            words, item = words.view(np.uint64), item.view(np.uint64)
            s = offsets[:-1] + b.column("before").to_numpy()
            d, start, n = np.full(b.num_rows, -1, np.int32), s.copy(), np.zeros(b.num_rows, np.int64)
            for c, w in np.unique(np.stack([number, size], 1), axis=0).tolist():
                mine = np.flatnonzero((number == c) & (size == w))
                for a in range(0, len(mine), 4096):
                    part = mine[a : a + 4096]
                    x = item[item_at[part][:, None] + np.arange(w)]
                    if c == 0:
                        got = _matches(words, offsets[part], offsets[part + 1], s[part], x, by[c].edits, not by[c].exact)
                    else:
                        got = whole_matches(words, offsets[part], offsets[part + 1], s[part], x, int(rate * w))
                    d[part], start[part], n[part] = got
            out = pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("kind"), b.column("pid"), pa.array(d), pa.array(b.column("at").to_numpy() + start - s), pa.array(n)],
                ["doc_id", "kind", "pid", "edits", "at", "n_words"],
            )
            yield out.filter(pa.array(d >= 0))

    return run


def _classes(window: int, longest: int) -> list[int]:
    """Widths of the windows of whole items: each is half as wide again as the one before."""
    widths = [window]
    while widths[-1] * 3 // 2 <= longest:
        widths.append(widths[-1] * 3 // 2)
    return widths


class Leaks:
    """The search prepared for some items: their windows, the walks of each class with the measured recall,
    and the tables of bounded size that are shipped to the tasks."""

    def __init__(self, items: DataFrame, item: tuple[str, str], window: int, max_edits: int, whole_edits: float | None, bits: int, recall: float, table_bytes: int) -> None:
        i = items.select(F.col(item[0]).cast("bigint").alias("item_id"), word_hashes(F.col(item[1])).alias("words"))
        self.items = i.where((F.size("words") >= window) & F.col("item_id").isNotNull()).distinct()
        self.rate = whole_edits or 0.0
        n = F.size("words")
        size = self.items.agg(F.coalesce(F.sum(n - (window - 1)), F.lit(0)).alias("n"), F.coalesce(F.sum(n), F.lit(0)).alias("w"), F.max(n).alias("longest")).first()
        widths = _classes(window, size["longest"] or 0) if whole_edits is not None else []
        whole = F.lit(0)
        for c, w in enumerate(widths, 1):
            whole = F.when(n >= w, F.lit(c)).otherwise(whole)
        places = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda p: F.slice("words", p, F.lit(window)))
        parts = self.items.select("item_id", F.lit(0).alias("kind"), F.explode(places).alias("words"))
        if widths:
            parts = parts.unionByName(self.items.select("item_id", whole.alias("kind"), "words"))
        parts = parts.withColumn("pid", F.xxhash64("words"))
        #: which item has a window, and the different windows: what many items share is looked for once
        self.owners = parts.select("kind", "pid", "item_id").distinct()
        self.windows = parts.groupBy("kind", "pid").agg(F.first("words").alias("words"))
        counts = {r["kind"]: (r["n"], r["longest"]) for r in self.windows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max(n).alias("longest")).collect()}
        self.kinds = []
        for c, (many, longest) in sorted(counts.items()):
            width = window if c == 0 else widths[c - 1]
            edits = max_edits if c == 0 else int(self.rate * longest)
            some = self.windows.where((F.col("kind") == c) & (F.pmod("pid", F.lit(-(-many // _SAMPLE))) == 0)).orderBy("pid").limit(2 * _SAMPLE)
            rows = some.select(F.slice("words", 1, width).alias("words")).toArrow().column("words").combine_chunks()
            sample = flat(rows)[0].view(np.uint64).reshape(-1, width) if len(rows) else np.zeros((0, width), np.uint64)
            self.kinds.append(Kind(c, width, edits, longest, plan_walks(sample, bits if c == 0 else min(bits, 4), edits, recall), sample))
        if self.kinds:
            self.signed = self.windows.mapInArrow(_sign(self.kinds), "kind int, pid bigint, words array<bigint>, h bigint")
            self.table = BitTable.build(self.signed, sum(counts[k.number][0] * len(k.signers) for k in self.kinds), table_bytes)
            self.vocabulary = BitTable.build(self.items.select(F.explode("words").alias("h")), size["w"], table_bytes)

    def recall(self) -> list[tuple]:
        """(kind, window, max_edits, signatures, exact, edit, recall) for each class and kind of edit."""
        return [(k.number, k.width, k.edits, len(k.signers), k.exact, e, r) for k in self.kinds for e, r in k.recall().items()]

    def search(self, docs: DataFrame, salts: int = 8) -> DataFrame | None:
        """(doc_id, item_id, kind, pid, at, n_words, edits), ``docs`` (doc_id, words)."""
        if not self.kinds:
            return None
        least = min(max(1, k.width - k.edits) for k in self.kinds)
        at = docs.where(F.size("words") >= least).mapInArrow(
            _places(self.kinds, self.table, self.vocabulary), "doc_id bigint, kind int, sig bigint, at bigint, before bigint, stretch array<bigint>"
        )
        at = at.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(salts)))
        salted = lambda x: x.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        pairs = at.join(salted(self.signed.select("kind", "pid", F.col("h").alias("sig"))), ["kind", "sig", "salt"])
        pairs = pairs.join(salted(self.windows), ["kind", "pid", "salt"]).select("doc_id", "kind", "pid", "at", "before", "stretch", "words")
        hits = pairs.mapInArrow(_check(self.kinds, self.rate), "doc_id bigint, kind int, pid bigint, edits int, at bigint, n_words bigint")
        hits = hits.groupBy("doc_id", "kind", "pid", "at", "n_words").agg(F.min("edits").alias("edits"))
        return hits.join(self.owners, ["kind", "pid"])


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc: tuple[str, str] = ("doc_id", "text"),
    item: tuple[str, str] = ("item_id", "text"),
    window: int = 12,
    max_edits: int = 1,
    whole_edits: float | None = 0.1,
    bits: int = 6,
    recall: float = 0.95,
    table_bytes: int = 1 << 23,
) -> DataFrame:
    """One row per document and item that share a passage: (doc_id, item_id, n_passages, edits,
    first_word, last_word, whole_edits).

    A shared passage is one of ``window`` words of the item at most ``max_edits`` words changed, left out or
    put in away from a stretch of the document; ``edits`` is the least distance found, 0 for a passage of
    ``window`` equal consecutive words, and null where only the whole item matches. n_passages counts the
    matching pairs of passages, first_word and last_word bound the document's words in them, or in the whole item.
    ``whole_edits`` of the result is the least distance of the whole item to a stretch of the document, where it is
    at most the share ``whole_edits`` of the item's words; with None whole items are not looked for.

    Pairs at distance 0 are all found; those farther apart with at least ``recall`` for each window
    (``leak_recall`` measures it). Null, empty and short texts (items of fewer words than the window, documents that
    even edits cannot bring to it) share nothing, nor do items without an id; documents without an id are one document, repeated documents and
    items count as one by id; an empty side gives no rows; texts are processed whole, in blocks of
    bounded memory; other columns are not read. ``table_bytes`` bounds each of the two tables shipped to the tasks; with more
    items than fit they pass more places on to the join, and the rows stay the same.
    """
    leaks = Leaks(items, item, window, max_edits, whole_edits, bits, recall, table_bytes)
    d = docs.select(F.col(doc[0]).cast("bigint").alias("doc_id"), word_hashes(F.col(doc[1])).alias("words"))
    hits = leaks.search(d)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, n_passages bigint, edits int, first_word bigint, last_word bigint, whole_edits int")
    part = F.col("kind") == 0
    end = F.col("at") + F.col("n_words") - 1
    own = lambda f, c: F.coalesce(f(F.when(part, c)), f(c))
    return hits.groupBy("doc_id", "item_id").agg(
        F.count(F.when(part, 1)).alias("n_passages"),
        F.min(F.when(part, F.col("edits"))).alias("edits"),
        own(F.min, F.col("at")).alias("first_word"),
        own(F.max, end).alias("last_word"),
        F.min(F.when(~part, F.col("edits"))).alias("whole_edits"),
    )


def leak_recall(
    items: DataFrame, item: tuple[str, str] = ("item_id", "text"), window: int = 12, max_edits: int = 1, whole_edits: float | None = 0.1, bits: int = 6, recall: float = 0.95, table_bytes: int = 1 << 23
) -> DataFrame:
    """The recall ``find_leaks`` has for a window with as many edits as its class allows, by class and kind of edit,
    measured on edited copies of the items: (kind, width, max_edits, n_signatures, exact, edit, recall)."""
    rows = Leaks(items, item, window, max_edits, whole_edits, bits, recall, table_bytes).recall()
    return items.sparkSession.createDataFrame(rows, "kind int, width int, max_edits int, n_signatures int, exact boolean, edit string, recall double")
