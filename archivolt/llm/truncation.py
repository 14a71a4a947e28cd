"""Texts cut off by field limits or in transfer.

A hashed logistic regression is fitted on a bounded sample: intact texts (they end in a full stop) and
texts that close with a line of their own are negatives, artificially cut intact texts (within words or
sentences, at a source's limit, some with a mark of omission) are positives. Features are the closing
characters and words, the punctuation of the last line and the distance of the length from the source's
limits. The limits are spikes in the length counts (characters and bytes) of all documents. Every record
is then scored by its close; its whole length counts. A text of blanks at its last CLOSE characters is not cut.

Defined results: null, empty and blank texts are not cut; a null source is a source of its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.llm.linear import Encoder, fit, score
from archivolt.session import fits, materialize

#: most rows of each kind in the training sample; about as many rows, chosen by hash, are looked at for it
SAMPLE, POOL = 4000, 60_000
#: characters of a text's close and of its beginning that features are made of
CLOSE, HEAD = 400, 60
DIGITS, SENTENCE = re.compile(r"\d+"), re.compile(r"[.!?]\s")
MARK = re.compile(r"(\s*(?:\[(?:…|\.{3})\]|\((?:…|\.{3})\)|…|\.{3,}))\s*$")
TOKEN = re.compile(r"\w+|[^\w\s]")
INTACT = r"[\p{L}\p{N})\]”\"»’'%][.!?][)”\"»’']?\s*$"
OWN_LINE = r"(?s)[.!?][)”\"»’']?\s*\n[^\n]{1,80}\s*$"


def limits(docs: DataFrame, share: float = 0.004, ratio: float = 6.0) -> DataFrame:
    """(source, unit, size) where far more of a source's texts end than around it, over all documents."""
    sizes = docs.filter(F.length("text") > 0).select("source", F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.length("text").alias("size")), F.struct(F.lit("b").alias("unit"), F.octet_length("text").alias("size")))).alias("x"))
    counts = sizes.groupBy("source", "x.unit", "x.size").agg(F.count("*").alias("n"))
    near = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-20, 20)
    whole = counts.groupBy("source", "unit").agg(F.sum("n").alias("total"))
    around = counts.withColumn("around", (F.sum("n").over(near) - F.col("n")) / 40)
    return around.join(whole.withColumnRenamed("source", "_s"), F.expr("source <=> _s") & (around["unit"] == whole["unit"])).filter((F.col("n") >= 4) & (F.col("n") >= ratio * F.col("around")) & (F.col("n") >= share * F.col("total"))).select("source", around["unit"], "size")


def with_limits(docs: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """(key, source, text, at_limit): at_limit is 'c', 'b' or '' as the length sits at a limit."""
    reach = found.select(F.col("source").alias("_s"), F.col("unit"), F.explode(F.when(F.col("unit") == "b", F.sequence(F.col("size") - 3, F.col("size"))).otherwise(F.array("size"))).alias("size")).distinct()
    small = fits(reach, 100_000)
    side = F.broadcast if small else (lambda d: d)
    c, b = side(reach.filter("unit = 'c'").select(F.col("_s").alias("_cs"), F.col("size").alias("_c"))), side(reach.filter("unit = 'b'").select(F.col("_s").alias("_bs"), F.col("size").alias("_b")))
    d = docs.select(F.col(key), "source", "text")
    d = d.join(c, F.expr("source <=> _cs") & (F.length("text") == F.col("_c")), "left").join(b, F.expr("source <=> _bs") & (F.octet_length("text") == F.col("_b")), "left")
    return d.select(key, "source", "text", F.when(F.col("_c").isNotNull(), "c").when(F.col("_b").isNotNull(), "b").otherwise("").alias("at_limit"))


def close(text: Column) -> Column:
    """struct(tail, head, lines): what the features of a text's close are made of, so that no whole text leaves the engine.

    lines tells of a text longer than its tail whether it has a line before that.
    """
    before = F.length(text) - CLOSE
    return F.struct(F.right(text, F.lit(CLOSE)).alias("tail"), F.when(before > 0, F.left(text, F.lit(HEAD))).alias("head"), F.when(before > 0, F.instr(F.left(text, before), "\n") > 1).otherwise(False).alias("lines"))


def close_of(text: str) -> tuple[str, str | None, bool]:
    """As close(), of a string."""
    before = len(text) - CLOSE
    return (text[-CLOSE:], text[:HEAD], "\n" in text[1:before]) if before > 0 else (text, None, False)


def features(tail: str, at_limit: str, head: str | None = None, lines: bool = False) -> tuple[list[str], list[str]]:
    """Tokens of the close and extra features; of a longer text, head and lines tell what lies before the tail."""
    mark = MARK.search(tail)
    core = tail[: mark.start()] if mark else tail
    blank = core != core.rstrip() and not mark
    core = core.rstrip()
    before, _, line = core.rpartition("\n")
    prev = before.rstrip()[-1:]
    shape = lambda s: DIGITS.sub("0", s)
    tokens = [shape(t) for t in TOKEN.findall(line.lower())]
    fragment = SENTENCE.split(line)[-1]
    own = bool(before) or lines
    far = head is not None and not before  # the last line began before the tail
    start = [shape(t) for t in TOKEN.findall((head if far and not lines else "" if far else line[:HEAD]).lower())][:2]
    last = line[-1:]
    kind = "letter" if last.isalpha() else "digit" if last.isdigit() else last
    words = fragment.split()
    n = len(words)
    extras = [
        f"end={kind}", f"end={kind},own={own}", f"mark={mark.group(1).strip()[:1] if mark else ''}", f"mark={bool(mark)},end={kind},words={min(n, 4)}", f"limit={at_limit}", f"limit={at_limit},end={kind}", f"blank={blank}",
        f"last={tokens[-1] if tokens else ''}", f"last2={' '.join(tokens[-2:])}", f"first={start[0] if start else ''}|{own}", f"first2={' '.join(start)}|{own}", f"prev={'far' if far and lines else prev if own else 'none'}", f"lower={line.islower()}",
        f"fragment={min(n, 8)},own={own}", f"whole={not far and fragment == line},own={own}", f"fend={kind},{shape(words[0].lower()) if n else ''}", f"chars={line[-3:].lower()}" if kind != "digit" else "chars=0",
    ]
    return tokens[-6:], extras


def cut(text: str, seed: int, sizes: list[int]) -> tuple[str, str] | None:
    """An intact text cut within a word or sentence, and whether at a limit."""
    body = text.rstrip()
    r = lambda k, n: xxhash.xxh3_64_intdigest(f"{seed}:{k}") % n
    fitting = [s for s in sizes if s is not None and s < len(body)]
    at, flag = (fitting[r(1, len(fitting))], "c") if fitting and r(2, 2) else (int(len(body) * (0.3 + 0.68 * r(3, 1000) / 1000)), "")
    mark = ["", "", "", "", "", "…", "..."][r(4, 7)]
    if flag:
        at -= len(mark)
    part = body[:at]
    if len(part.strip()) < 20 or re.search(r"[.!?][)”\"»’']?\s*$", part) or (at < len(body) and body[at] in ".!?\n" and not mark):
        return None
    return part + mark, flag


def training_sample(rows: DataFrame, key: str, found: DataFrame, n: int, sample: int = SAMPLE) -> pd.DataFrame:
    """(text, at_limit, kind, low, high): at most `sample` texts of either kind, from a pool chosen by hash, in one pass.

    low and high are two of the limits of the text's source that it exceeds, chosen by hash, for its cut twins.
    """
    pool = rows.withColumn("o", F.xxhash64(F.col(key).cast("string"), F.lit("truncation"))).filter(F.pmod("o", F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, POOL / max(n, 1))))
    end = F.right("text", F.lit(CLOSE))
    intact = end.rlike(INTACT)
    kind = F.when(intact & ~end.rlike(r"(…|\.\.\.)\s*$"), "intact").when((F.col("at_limit") == "") & end.rlike(OWN_LINE) & ~intact & ~end.rlike(r"\.\.\.\s*$|\s$"), "line")
    few = pool.withColumn("kind", kind).filter("kind is not null").withColumn("at", F.row_number().over(Window.partitionBy("kind").orderBy("o"))).filter(F.col("at") <= sample)
    limit = found.filter("unit = 'c'").select(F.col("source").alias("_s"), "size")
    j = few.join(limit, F.expr("source <=> _s and kind = 'intact' and size < length(text)"), "left")
    order = F.xxhash64("size", "o")
    return j.groupBy("kind", "at", "text", "at_limit").agg(F.min_by("size", order).alias("low"), F.max_by("size", order).alias("high")).orderBy("kind", "at").toPandas()


def train(rows: DataFrame, key: str, found: DataFrame, n: int, sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most `sample` intact texts, their cut twins, and as many texts with a closing line."""
    data = training_sample(rows, key, found, n, sample)
    cases = [(t, f, 0) for t, f in zip(data["text"], data["at_limit"])]
    intact = data[data["kind"] == "intact"]
    for seed, (t, low, high) in enumerate(zip(intact["text"], intact["low"], intact["high"])):
        sizes = [int(x) for x in (low, high) if not pd.isna(x)]
        for k in (0, 1):
            if c := cut(t, 2 * seed + k, sizes):
                cases.append((*c, 1))
    if len({y for _, _, y in cases}) < 2:
        return np.append(np.zeros(1 << 18), -1).astype(np.float32)
    pairs = []
    for t, f, _ in cases:
        tail, head, lines = close_of(t)
        pairs.append(features(tail, f, head, lines))
    r, f = Encoder()([p[0] for p in pairs], [p[1] for p in pairs])
    return fit(r, f, np.array([y for _, _, y in cases], float))


def scores(docs: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(key, source, p_cut) for every document."""
    found = materialize(limits(docs))
    rows = with_limits(docs, key, found)
    weights = docs.sparkSession.sparkContext.broadcast(train(rows, key, found, docs.count(), sample))
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder()
        for f in frames:
            tails = f["tail"].fillna("").tolist()
            some = np.array([bool(t.strip()) for t in tails], float)
            pairs = [features(t, a, h, n) if s else ([], []) for t, a, h, n, s in zip(tails, f["at_limit"], f["head"], f["lines"], some)]
            r, i = encode([p[0] for p in pairs], [p[1] for p in pairs])
            yield pd.DataFrame({key: f[key], "source": f["source"], "p_cut": score(weights.value, r, i, len(f)) * some})

    c = close(F.coalesce("text", F.lit("")))
    narrow = rows.select(key, "source", "at_limit", c.alias("c")).select(key, "source", "at_limit", "c.tail", "c.head", "c.lines")
    return narrow.mapInPandas(run, f"{key} {kind}, source string, p_cut double")


def rates(scored: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, cut_rate) of every source."""
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("p_cut") >= 0.5).alias("n_cut"), F.round(F.avg((F.col("p_cut") >= 0.5).cast("double")), 6).alias("cut_rate"))
