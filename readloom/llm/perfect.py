"""Sealed key sets: a minimal perfect hash over 64-bit key hashes plus a fingerprint array.

The hash is built level by level: every remaining key picks a slot, keys alone in their slot are
placed there, the others go to the next, smaller level. A key's number is the count of placed slots
before its own, so the fingerprint array has exactly one entry per key. Memory is about 4 bits of
slots, 2 bits of ranks and ``fp_bits`` per key; no key is kept.
"""

from __future__ import annotations

import io

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15


def _slot(h: np.ndarray, level: int, slots: int) -> np.ndarray:
    x = h + np.uint64((_GOLDEN * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


class SealedSet:
    """Membership of keys in a set that will not change any more.

    Never answers "absent" for a key that was sealed; answers "present" for another key with
    probability 2 ** -fp_bits at most.
    """

    MAX_LEVELS = 48

    def __init__(self, hashes: np.ndarray, fingerprints: np.ndarray, gamma: float = 2.0) -> None:
        self.size = len(hashes)
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        order = np.zeros(self.size, np.int64)
        left, base = np.arange(self.size), 0
        for level in range(self.MAX_LEVELS):
            if not len(left):
                break
            slots = max(64, -(-int(gamma * len(left)) // 64) * 64)
            at = _slot(hashes[left], level, slots)
            alone = np.bincount(at, minlength=slots)[at] == 1
            bits = np.zeros(slots, np.uint8)
            bits[at[alone]] = 1
            words = np.packbits(bits, bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words))[:-1])).astype(np.int32)
            self.levels.append((slots, words, before, base))
            order[left[alone]] = self._rank(words, before, at[alone]) + base
            base += int(alone.sum())
            left = left[~alone]
        #: Distinct keys with one 64-bit hash can't be told apart by any level; they are kept as pairs.
        self.rest = set(zip(hashes[left].tolist(), fingerprints[left].tolist()))
        self.fingerprints = np.zeros(base, fingerprints.dtype)
        placed = np.ones(self.size, bool)
        placed[left] = False
        self.fingerprints[order[placed]] = fingerprints[placed]

    @staticmethod
    def _rank(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def contains(self, hashes: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        left = np.arange(len(hashes))
        for level, (slots, words, before, base) in enumerate(self.levels):
            if not len(left):
                break
            at = _slot(hashes[left], level, slots)
            set_ = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            hit = left[set_]
            found[hit] = self.fingerprints[self._rank(words, before, at[set_]) + base] == fingerprints[hit]
            left = left[~set_]
        if self.rest and len(left):
            pairs = zip(hashes[left].tolist(), fingerprints[left].tolist())
            found[left] = [p in self.rest for p in pairs]
        return found

    def to_bytes(self) -> bytes:
        arrays = {"fingerprints": self.fingerprints, "levels": np.array([(n, b) for n, _, _, b in self.levels], np.int64).reshape(-1, 2)}
        arrays |= {f"words{i}": w for i, (_, w, _, _) in enumerate(self.levels)}
        arrays["rest"] = np.array(sorted(self.rest), np.uint64).reshape(-1, 2)
        out = io.BytesIO()
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> SealedSet:
        x = np.load(io.BytesIO(data), allow_pickle=False)
        out = cls.__new__(cls)
        out.fingerprints, out.levels = x["fingerprints"], []
        for i, (slots, base) in enumerate(x["levels"].tolist()):
            words = x[f"words{i}"]
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words))[:-1])).astype(np.int32)
            out.levels.append((slots, words, before, base))
        out.rest = {tuple(r) for r in x["rest"].tolist()}
        out.size = len(out.fingerprints) + len(out.rest)
        return out

    def nbytes(self) -> int:
        return self.fingerprints.nbytes + sum(w.nbytes + b.nbytes for _, w, b, _ in self.levels)
