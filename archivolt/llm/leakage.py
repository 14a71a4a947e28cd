"""Evaluation passages inside corpus documents.

Size-partitioned MinHash containment search, then exact verification. A window of W words holds W-4
five-word shingles; two texts that share W consecutive words share a window whose shingle sets are equal
(containment 1), so its MinHash under any number of hash functions is equal too and no leak can be missed.
Documents are partitioned by size (number of windows); larger ones, which bring more windows and so more
chance agreements, are searched with more hash functions per signature, as the containment of a short item
in a long document demands. Candidates are then verified by exact containment of the W-word shingles.

Whole texts are read in numpy arrays, many at once, without a step per word or document. The signatures of
the items (a fixed evaluation set) are broadcast while their number is below a checked bound, and then only
windows with one of them leave a task; beyond it, all distinct signatures are joined by shuffle.

Defined results: null, empty and short texts (fewer than W words) match nothing; repeated documents and
items all count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.session import fits, materialize

WORD = re.compile(r"\w+")
SHINGLE = 5
#: windows up to which a size partition reaches, and its hash functions per signature
PARTITIONS = ((64, 2), (1024, 3), (1 << 62, 4))
BROADCAST_ROWS = 500_000
#: characters of texts that are hashed in one go
SPAN = 1 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_BASE, _INVERSE = 0x100000001B3, pow(0x100000001B3, -1, 1 << 64)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Words:
    """Hashes of the words of many texts at once, without a step per word.

    The texts' characters lie in one array; a word's hash is a difference of prefix sums of characters times
    powers of an odd number, shifted back by the inverse power, so equal words have equal hashes anywhere.
    """

    def __init__(self) -> None:
        self.size = 0
        self.inner = np.zeros(0x110000, bool)
        for i in range(0x110000):
            if WORD.match(chr(i)):
                self.inner[i] = True

    def _powers(self, n: int) -> None:
        if n > self.size:
            up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
            up[0] = down[0] = 1
            with np.errstate(over="ignore"):
                up[1:], down[1:] = np.uint64(_BASE), np.uint64(_INVERSE)
                np.multiply.accumulate(up, out=up)
                np.multiply.accumulate(down, out=down)
            self.up, self.down, self.size = up, down, n

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text number) of every word in order."""
        low = [t.lower() for t in texts]
        codes = np.frombuffer("\0".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(codes)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._powers(n + 1)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = self.inner[codes]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
            h = (sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
        ends = np.cumsum([len(t) + 1 for t in low])
        return h ^ (h >> np.uint64(29)), np.searchsorted(ends, start, side="right")


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _MIX[k]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    step, out = 1, x
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - step : len(out)][: len(x) - width + 1]) if width > step else out


def window_signatures(h: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The text of each window that lies in one text, and its MinHash signatures of 1, 2, ... hash functions."""
    n, most = len(h) - window + 1, PARTITIONS[-1][1]
    if n < 1:
        return np.zeros(0, np.int64), [np.zeros(0, np.uint64)] * most
    with np.errstate(over="ignore"):
        shingle = np.zeros(len(h) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            shingle = shingle * np.uint64(_BASE) + h[k : k + len(shingle)]
        one = np.flatnonzero(owner[:n] == owner[window - 1 :])
        out, signature = [], np.zeros(len(one), np.uint64)
        for k in range(most):
            signature = signature * np.uint64(0x9E3779B1) + _least(_mixed(shingle, k), window - SHINGLE + 1)[one]
            out.append(signature)
    return owner[one], out


def _spans(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SPAN characters together; a longer text is one of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SPAN:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def signatures(df: DataFrame, key: str, text: str, window: int, every: bool = False, wanted=None) -> DataFrame:
    """(key, r, sig): with every, for each number r of hash functions (items); else for the size's own.

    wanted, if given, is a broadcast of sorted signatures by r: only windows with one of them come out.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = Words()
        for f in frames:
            texts, keys = f["_t"].fillna("").tolist(), f["_k"].to_numpy()
            for lo, hi in _spans(texts):
                owner, sigs = window_signatures(*hashed(texts[lo:hi]), window)
                if not len(owner):
                    continue
                count = np.bincount(owner, minlength=hi - lo)[owner]
                low = 0
                for most, r in PARTITIONS:
                    ks, ss, rs = [], [], []
                    for j in range(1, PARTITIONS[-1][1] + 1) if every else (r,):
                        pick = (count > low) & (count <= most)
                        o, g = owner[pick], sigs[j - 1][pick]
                        if wanted is not None and len(g):
                            known = wanted.value.get(j, np.zeros(0, np.uint64))
                            at = np.searchsorted(known, g)
                            ok = (at < len(known)) & (known[np.minimum(at, max(len(known) - 1, 0))] == g) if len(known) else np.zeros(len(g), bool)
                            o, g = o[ok], g[ok]
                        if len(g):
                            pair = np.unique(np.rec.fromarrays([o, g]))
                            ks.append(keys[lo + pair["f0"]])
                            ss.append(pair["f1"])
                            rs.append(np.full(len(pair), j))
                    low = most
                    if ks:
                        yield pd.DataFrame({"_k": np.concatenate(ks), "r": np.concatenate(rs), "sig": np.concatenate(ss).view(np.int64)})

    return df.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t")).mapInPandas(run, "_k long, r int, sig long").withColumnRenamed("_k", key)


def shared_windows(a: str, b: str, window: int) -> int:
    """How many distinct windows of words two texts share, exactly."""
    x, y = words_of(a), words_of(b)
    grams = {tuple(y[i : i + window]) for i in range(len(y) - window + 1)}
    return len({g for i in range(len(x) - window + 1) if (g := tuple(x[i : i + window])) in grams})


def leaks(docs: DataFrame, items: DataFrame, window: int = 12) -> DataFrame:
    """doc_id, item_id, n_shared (windows) of the documents that hold at least window words of an item."""
    if window < SHINGLE:
        raise ValueError(f"a window holds at least {SHINGLE} words")
    wanted = materialize(signatures(items, "item_id", "item_text", window, every=True))
    if fits(wanted, BROADCAST_ROWS):
        known: dict = {}
        for x in wanted.select("r", "sig").distinct().toLocalIterator():  # a bounded number
            known.setdefault(x["r"], []).append(x["sig"])
        shared = docs.sparkSession.sparkContext.broadcast({r: np.sort(np.array(v, np.int64).view(np.uint64)) for r, v in known.items()})
        hit = signatures(docs, "doc_id", "text", window, wanted=shared)
    else:
        hit = signatures(docs, "doc_id", "text", window)
    pairs = materialize(hit.join(wanted, ["r", "sig"]).select("doc_id", "item_id").distinct())
    # texts of such items only as have a candidate; the engine sends them to all tasks if they are small
    texts = items.select(F.col("item_id").cast("long"), "item_text").join(pairs.select("item_id").distinct(), "item_id", "left_semi")
    both = pairs.join(docs.select("doc_id", "text"), "doc_id").join(texts, "item_id")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = [shared_windows(a, b, window) for a, b in zip(f["text"], f["item_text"])]
            yield f[["doc_id", "item_id"]].assign(n_shared=n)

    return both.select("doc_id", "item_id", "text", "item_text").mapInPandas(verify, "doc_id long, item_id long, n_shared int").filter("n_shared > 0")
