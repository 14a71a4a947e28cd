"""Hashed logistic regression in numpy: fitted on a bounded sample on the driver, applied in tasks.

A row's features are the hashes of its tokens, of adjacent token pairs and of any named extra features,
each with the value 1/sqrt(features of the row). Fitting is deterministic: full-batch AdaGrad with an L2
penalty from a zero start.
"""

from __future__ import annotations

import numpy as np
import xxhash

BITS = 18


class Encoder:
    """Feature indices of many rows at once; hashes of strings are cached up to a bound."""

    def __init__(self, bits: int = BITS, bound: int = 300_000) -> None:
        self.mask, self.bound, self.known = np.uint64((1 << bits) - 1), bound, {}

    def _ids(self, strings: list[str]) -> np.ndarray:
        if len(self.known) > self.bound:
            self.known.clear()
        known, h = self.known, xxhash.xxh3_64_intdigest
        out = np.empty(len(strings), np.uint64)
        for i, s in enumerate(strings):
            v = known.get(s)
            if v is None:
                v = known[s] = h(s)
            out[i] = v
        return out

    def __call__(self, tokens: list[list[str]], extras: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of every feature, rows ascending within each of the three kinds."""
        row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        ids = self._ids([x for t in tokens for x in t])
        with np.errstate(over="ignore"):
            pair = (ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:]) if len(ids) > 1 else ids[:0]
            pair ^= pair >> np.uint64(29)
        same = row[:-1] == row[1:] if len(row) > 1 else np.zeros(0, bool)
        erow = np.repeat(np.arange(len(extras)), [len(t) for t in extras])
        eids = self._ids(["\x00" + x for t in extras for x in t])
        rows = np.concatenate([row, row[:-1][same] if len(row) > 1 else row[:0], erow])
        feats = np.concatenate([ids, pair[same], eids]) & self.mask
        return rows, feats.astype(np.int64)


def _values(rows: np.ndarray, n: int) -> np.ndarray:
    return (1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1)))[rows]


def fit(rows: np.ndarray, feats: np.ndarray, y: np.ndarray, bits: int = BITS, l2: float = 1e-5, steps: int = 150, rate: float = 0.5) -> np.ndarray:
    """Weights, the last being the bias; both classes weigh the same in total."""
    n, size = len(y), 1 << bits
    x = _values(rows, n)
    pos = max(y.sum(), 1)
    weight = np.where(y > 0, 0.5 / pos, 0.5 / max(n - pos, 1))
    w, g2, b, b2 = np.zeros(size), np.full(size, 1e-12), 0.0, 1e-12
    used = np.unique(feats)
    at = np.searchsorted(used, feats)
    wu, g2 = w[used], g2[used]
    for _ in range(steps):
        z = np.bincount(rows, weights=wu[at] * x, minlength=n) + b
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        g = np.bincount(at, weights=err[rows] * x, minlength=len(used)) + l2 * wu
        g2 += g * g
        wu -= rate * g / np.sqrt(g2)
        gb = err.sum()
        b2 += gb * gb
        b -= rate * gb / np.sqrt(b2)
    w[used] = wu
    return np.append(w, b).astype(np.float32)


def score(w: np.ndarray, rows: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
    z = np.bincount(rows, weights=w[feats] * _values(rows, n), minlength=n) + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
