"""A linear-chain conditional random field with two labels, content (0) and boilerplate (1).

Features are binary and act on the score of boilerplate against content; transitions have a score
each. Sequences of a batch are handled together, step by step, so the cost in Python is the length
of the longest sequence, not the number of lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def _steps(offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For t = 0, 1, ...: (sequences longer than t, their row at t)."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    sizes = n[order]
    t = 0
    while True:
        k = int(np.searchsorted(-sizes, -t, "left"))
        if not k:
            return
        seq = order[:k]
        yield seq, offsets[seq] + t
        t += 1


class ChainCRF:
    def __init__(self, weights: np.ndarray, transitions: np.ndarray) -> None:
        self.weights, self.transitions = weights, transitions

    def _scores(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.weights
        return np.stack([np.zeros_like(s), s], 1)

    def viterbi(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The best label of every row; a tie goes to content."""
        s = self._scores(x)
        best = np.zeros((len(offsets) - 1, 2))
        back = np.zeros((len(x), 2), np.int8)
        steps = list(_steps(offsets))
        for t, (seq, row) in enumerate(steps):
            if t == 0:
                best[seq] = s[row]
                continue
            via = best[seq][:, :, None] + self.transitions[None]
            back[row] = via.argmax(1)
            best[seq] = via.max(1) + s[row]
        label = np.zeros(len(x), np.int8)
        state = best.argmax(1)
        last = np.diff(offsets) - 1
        for t in range(len(steps) - 1, -1, -1):
            seq, row = steps[t]
            ends = last[seq] == t
            now = np.where(ends, state[seq], 0)
            if t + 1 < len(steps):
                on = ~ends
                now[on] = back[row[on] + 1, label[row[on] + 1]]
            label[row] = now
        return label

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, offsets: np.ndarray, rounds: int = 120, rate: float = 0.2, l2: float = 1e-3) -> ChainCRF:
        """Maximum likelihood by forward-backward and Adam; the same data give the same model."""
        model = cls(np.zeros(x.shape[1]), np.zeros((2, 2)))
        if not len(x):
            return model
        steps = list(_steps(offsets))
        p = np.zeros(x.shape[1] + 4)
        m, v = np.zeros_like(p), np.zeros_like(p)
        want_w = x.T @ y
        want_t = np.zeros((2, 2))
        for _, row in steps[1:]:
            np.add.at(want_t, (y[row - 1], y[row]), 1)
        for k in range(1, rounds + 1):
            model.weights, model.transitions = p[:-4], p[-4:].reshape(2, 2)
            s = model._scores(x)
            a, b = np.zeros_like(s), np.zeros_like(s)
            for t, (_, row) in enumerate(steps):
                a[row] = s[row] if not t else s[row] + np.logaddexp.reduce(a[row - 1][:, :, None] + model.transitions[None], 1)
            for _, row in reversed(steps[1:]):
                b[row - 1] = np.logaddexp.reduce(model.transitions[None] + (s[row] + b[row])[:, None, :], 2)
            z = np.logaddexp.reduce(a + b, 1)
            have_w = x.T @ np.exp(a[:, 1] + b[:, 1] - z)
            have_t = np.zeros((2, 2))
            for _, row in steps[1:]:
                joint = a[row - 1][:, :, None] + model.transitions[None] + (s[row] + b[row])[:, None, :]
                have_t += np.exp(joint - z[row][:, None, None]).sum(0)
            grad = np.concatenate([have_w - want_w, (have_t - want_t).ravel()]) / len(x) + l2 * p
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            p = p - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return cls(p[:-4].copy(), p[-4:].reshape(2, 2).copy())

    def leaning(self, odds: float) -> ChainCRF:
        """A copy whose rows all have ``odds`` more, in logarithms, of being boilerplate; feature 0 is always set."""
        w = self.weights.copy()
        w[0] += odds
        return ChainCRF(w, self.transitions)
