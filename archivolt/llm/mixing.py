"""Mixing sources to target shares of all tokens.

Documents are counted by exact token length (a public tokenizer's); per source a budget is filled: whole
passes over the source first, then an even part of every length, and the rest of the budget by bounded
knapsack dynamic programming over the remaining counts of each length, which hits the budget exactly
whenever a sum of lengths does. Which documents of a length are taken follows a seeded hash order.

Only the histogram (source, length, count) meets in a task, by source. Documents of one length are ranked
in hash-ordered buckets, of which only the one where the budget ends is sorted, so a length that holds a
third of all documents is never sorted in one task.

The total is by default the largest for which every source reaches its share within its repeats. Defined
results: documents of sources without a target and documents without tokens are not used; sources with no
documents get 0 tokens and do not bound the total; copies count as documents of their own.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.session import materialize

TOKENIZERS = os.environ.get("ARCHIVOLT_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
BUCKETS = 64


# How the byte-level vocabularies part a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@functools.lru_cache(2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """The token counts of texts under a vocabulary file: ranks (.tiktoken) or a tokenizer's description (.json)."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [len(encode(t)) for t in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [len(e) for i in range(0, len(texts), 256) for e in t.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens), whole texts; the vocabulary file travels to the executors with the job."""
    docs.sparkSession.sparkContext.addFile(f"{folder}/{vocabulary}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(SparkFiles.get(vocabulary))
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "source": f["source"], "n_tokens": count(f["text"].fillna("").tolist())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "source", "text").mapInPandas(run, f"doc_id {kind}, source string, n_tokens long")


def fill(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum comes as near to the budget as can be from below."""
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    part = budget / total if total else 0
    take = [int(c * part) for c in counts]
    rest = budget - sum(n * k for n, k in zip(lengths, take))
    # the rest shall be 8 to 12 of the longest documents: enough room for the search, bounded at any size
    most = max(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if rest > 12 * most and lengths[i]:
            k = min(counts[i] - take[i], (rest - 10 * most) // lengths[i])
            take[i] += k
            rest -= k * lengths[i]
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        if rest < 8 * most and lengths[i]:
            k = min(take[i], -(-(8 * most - rest) // lengths[i]))
            take[i] -= k
            rest += k * lengths[i]
    # bounded knapsack: bit s of reach is set if some choice sums to s, first[s] is the item that first reached it;
    # counts go in powers of two, so an item is never needed twice
    items = []
    for i, (n, c) in enumerate(zip(lengths, counts)):
        left, size = min(c - take[i], rest // n if n else 0), 1
        while left > 0:
            k = min(size, left)
            items.append((i, k, n * k))
            left, size = left - k, size * 2
    full, reach = (1 << (rest + 1)) - 1, 1
    first = np.zeros(rest + 1, np.int32)
    for j, (_, _, n) in enumerate(items):
        new = (reach << n) & full & ~reach
        if new:
            bits = np.unpackbits(np.frombuffer(new.to_bytes(rest // 8 + 1, "little"), np.uint8), bitorder="little")
            first[np.flatnonzero(bits)] = j
            reach |= new
        if reach >> rest & 1:
            break
    s = reach.bit_length() - 1
    while s:
        i, k, n = items[first[s]]
        take[i] += k
        s -= n
    return take


def plan(histogram: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, n_tokens, passes, extra): all documents of that length are used passes times, extra of them once more."""
    sizes = histogram.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("tokens"))
    goal = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).join(sizes, "source").filter("share > 0 and tokens > 0 and repeats > 0")
    most = F.lit(total).cast("double") if total is not None else F.min(F.col("repeats") * F.col("tokens") / F.col("share"))
    goal = goal.crossJoin(F.broadcast(goal.agg(most.cast("double").alias("total"))))  # the second side is one row
    budget = F.least(F.round(F.col("total") * F.col("share")).cast("long"), F.col("repeats") * F.col("tokens"))

    def of(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("n_tokens")
        tokens, b = int(f["tokens"].iloc[0]), int(f["budget"].iloc[0])
        passes, rest = divmod(b, tokens)
        extra = fill([int(x) for x in f["n_tokens"]], [int(x) for x in f["n"]], rest)
        return pd.DataFrame({"source": f["source"], "n_tokens": f["n_tokens"], "passes": passes, "extra": extra})

    joined = histogram.join(goal.select("source", "tokens", budget.alias("budget")), "source")
    return joined.groupBy("source").applyInPandas(of, "source string, n_tokens long, passes int, extra long")


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """The selection: doc_id, source, n_tokens, repeats."""
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))
    counted = materialize(token_counts(docs.filter("source is not null"), vocabulary, folder).filter("n_tokens > 0").withColumn("_order", order).withColumn("_bucket", F.shiftright("_order", 58)))
    buckets = counted.groupBy("source", "n_tokens", "_bucket").agg(F.count("*").alias("n"))
    decided = materialize(plan(buckets.groupBy("source", "n_tokens").agg(F.sum("n").alias("n")), targets, total))
    upto = Window.partitionBy("source", "n_tokens").orderBy("_bucket")
    need = buckets.join(decided, ["source", "n_tokens"]).withColumn("_left", F.col("extra") - (F.sum("n").over(upto) - F.col("n"))).select("source", "n_tokens", "_bucket", "passes", "n", "_left")
    rows = counted.join(need, ["source", "n_tokens", "_bucket"])
    whole = rows.filter("_left >= n or _left <= 0").withColumn("repeats", F.col("passes") + F.when(F.col("_left") > 0, 1).otherwise(0))
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "_bucket").orderBy("_order", "doc_id"))
    split = rows.filter("_left > 0 and _left < n").withColumn("repeats", F.col("passes") + F.when(rank <= F.col("_left"), 1).otherwise(0))
    out = ["doc_id", "source", "n_tokens", F.col("repeats").cast("int").alias("repeats")]
    return whole.select(*out).unionByName(split.select(*out)).filter("repeats > 0")


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, n_docs, n_tokens, actual_share) of every target."""
    by = selection.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"))
    all_ = by.agg(F.sum("n_tokens").alias("_all"))  # one row
    return targets.select("source", "target_share").join(by, "source", "left").crossJoin(F.broadcast(all_)).select("source", "target_share", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce(F.round(F.col("n_tokens") / F.col("_all"), 8), F.lit(0.0)).alias("actual_share"))
