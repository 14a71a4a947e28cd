"""Template residue, filler, error-page text and script notices among real content.

Two hashed linear classifiers are fitted on a bounded sample with weak labels and applied to every field:
one reads whole texts (word n-grams, length, field and title features), one reads the surroundings of each
suspicious mark (n-grams of their shape), as an unfilled slot may stand anywhere in a long text. Weak labels
come from phrases that make up a whole text, from slot notations, and from response-status messages of the
fetching program, which are negatives. Hosts are split by hash: the sample comes from training hosts only,
and validate() measures on the others, and on texts of phrases that its own training never saw.

Defined results: null, empty and blank fields are no case; repeated rows are judged alike.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.llm.linear import Encoder, fit, score

#: most rows of each label and field in the training sample
SAMPLE = 2500
#: about as many rows, chosen by the row's hash, are given weak labels at all
POOL = 120_000
# Phrases that, as a whole text, weakly label it as residue.
PHRASES = (
    r"please enable javascript", r"javascript (is disabled|pour fonctionner)", r"n[ée]cessite javascript", r"activar javascript", r"javascript und cookies", r"turn on scripts", r"scripts (required|must be allowed)", r"works best with scripts", r"enable scripting",
    r"page you requested could not be found", r"link you followed may be broken", r"seite nicht gefunden", r"p[áa]gina no encontrada", r"erreur \d+ ?: une erreur", r"something went wrong on our end", r"service temporarily unavailable", r"bad gateway", r"403 forbidden", r"access denied\. reference", r"too many requests", r"are you a robot", r"checking your browser", r"(store|shop) is currently unavailable", r"shop has been closed", r"domain has expired", r"404 not found nginx", r"only held a redirect",
    r"lorem ipsum dolor", r"blindtext", r"texte? [àa] venir", r"texto de ejemplo", r"your (own )?text here", r"description goes here", r"coming soon . copy to follow", r"enter a short summary", r"test product, please ignore", r"sample (title|paragraph)",
)
#: phrases whose texts validation keeps out of training
HELD = PHRASES[::5]
WHOLE = (r"(null|undefined|nan|none|n/a)([\s/–()|-]+(null|undefined|nan|none|n/a))+\)?", r"\[object object\]", r"tbd", r"(asdf\s*)+", r"(x{3,}\s*)+", r"sample title \d+")
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat"
# Slot notations.
SLOTS = r"\{\{[^{}]*\}\}|\{%[^{}]*%\}|<%=?[^<>]*%>|[$#]\{[^{}]*\}|%\([A-Za-z_]+\)[sS]|%%\w+%%|%[A-Za-z]+(_[A-Za-z]+)+%|%(?-i:[A-Z]{3,})%|\$[A-Za-z]+(_[A-Za-z]+)+\$|@@\w+@@|__[A-Za-z]+__|\[\[\w+\]\]|\[insert [^\[\]]*\]|\{\w+\}|<your [^<>]*>|«\w+_\w+»"
PROGRAM = r"^(http )?\d(\d\d|xx)\b(?!.*(page|–))|^(timed? ?out|timeout|dns|tls|connection|invalid|corrupt|truncated|json error|parse failed|size mismatch|content-type|redirect loop|empty body|blocked by robots|all methods|placeholder image)"
MARKS = re.compile(r"[{}\[\]%$#@_«»<>=]")
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


def flat(c: Column) -> Column:
    """Lower case, tags of paragraphs and lines as blanks, one blank between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"</?(p|br|noscript)\s*/?>", " "), r"[\s\u00a0]+", " "))


def weak_label(c: Column, field: Column) -> Column:
    """1 residue, 0 content."""
    t = flat(c)
    core = F.regexp_replace(t, r"( \||\| shop| -+| – archive)+$", "")
    latin = F.transform(F.split(core, r"[\s.,]+"), lambda w: F.lit(f" {LATIN} ").contains(F.concat(F.lit(" "), w, F.lit(" "))).cast("int"))
    filler = (F.size(latin) >= 4) & (F.aggregate(latin, F.lit(0), lambda a, x: a + x) >= 0.8 * F.size(latin))
    phrase = t.rlike("|".join(PHRASES)) & (F.length(t) <= 160)
    program = (field == "error") & t.rlike(PROGRAM)
    return F.when(program, 0).when(phrase | core.rlike("^(" + "|".join(WHOLE) + ")$") | filler, 1).otherwise(0)


def slot_label(c: Column) -> Column:
    return (c.rlike("(?i)" + SLOTS) & ~c.rlike(r"(?i)unexpected token|expected '")).cast("int")


def host_part(url: Column) -> Column:
    """0..4 by the host's hash; 0 is held out for validation."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"https?://([^/?]+)", 1)
    return F.pmod(F.xxhash64(host), F.lit(5))


def clean(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"(?i)</?(p|br)\s*/?>", " ", text)).strip()


def text_features(text: str, field: str) -> tuple[list[str], list[str]]:
    t = clean(text)
    tokens = [x if not x.isdigit() else "0" for x in TOKEN.findall(t.lower())]
    n = len(tokens)
    size = min(n, 12) if n < 12 else 12 + min(n // 10, 10)
    words = [x for x in tokens if len(x) > 1]
    return tokens, [f"size={size}", f"size={size},{field}", f"field={field}", f"first={' '.join(tokens[:2])}", f"last={' '.join(tokens[-2:])}", f"stop={t[-1:] in '.!?'}", f"title={t.istitle()}", f"distinct={len(set(words)) == len(words)},{min(n, 6)}", f"tag={'<p>' in text.lower()}"]


def shape(s: str) -> str:
    return re.sub(r"[A-ZÀ-Þ]+", "A", re.sub(r"[^\W\dA-ZÀ-Þ_]+", "a", re.sub(r"\d+", "0", s)))


def windows(text: str) -> list[str]:
    """Surroundings of each cluster of suspicious marks."""
    t, out, end = clean(text), [], -1
    for m in MARKS.finditer(t):
        if m.start() <= end:
            continue
        left, right = max(0, m.start() - 4), min(len(t), m.start() + 30)
        out.append(t[left:right])
        end = m.start() + 20
    return out


def window_features(w: str) -> list[str]:
    s = f"^{shape(w)}"
    low = s.lower()
    out = [low[i : i + k] for k in (2, 3, 4, 5) for i in range(len(low) - k + 1) if MARKS.search(low[i : i + k])]
    return out + ["c" + s[i : i + 4] for i in range(len(s) - 3) if MARKS.search(s[i : i + 4])] + [x for x in re.findall(r"(?:insert|your)\b", w.lower())]


def has_phrase(c: Column, phrases: tuple[str, ...]) -> Column:
    return flat(c).rlike("|".join(phrases)) & (F.length(flat(c)) <= 160)


def train(rows: DataFrame, sample: int = SAMPLE, held: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Weights of both classifiers from at most `sample` rows of each field and label of the training hosts.

    The sample is cut by a window limit inside each map task, in one pass over a pool chosen by hash. Texts with
    one of the held phrases are left out of it.
    """
    n = rows.count()
    order = F.xxhash64("src_table", "row_id", "field_name", F.lit("residue"))
    some = (rows.filter(~has_phrase(F.col("text"), held)) if held else rows).filter("part <> 0").withColumn("o", order).filter(F.pmod("o", F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, POOL / max(n, 1))))
    labelled = some.select("field_name", "text", "o", weak_label(F.col("text"), F.col("field_name")).alias("y"), slot_label(F.col("text")).alias("slot"), F.col("text").rlike(r"[{}\[\]%$#@_«»=]").alias("marked"))
    kind = Window.partitionBy("field_name", "y", "slot", "marked").orderBy("o")
    data = labelled.withColumn("at", F.row_number().over(kind)).filter(F.col("at") <= sample).drop("at", "marked", "o").toPandas().drop_duplicates()
    pairs, y = [], []
    for t, f, a, b in zip(data["text"], data["field_name"], data["y"], data["slot"]):
        if a or not b:
            pairs.append(text_features(t, f))
            y.append(float(a))
    page = _fit([p[0] for p in pairs], [p[1] for p in pairs], np.array(y))
    found, slots = [], re.compile(SLOTS, re.I)
    ys = []
    for t, b in zip(data["text"], data["slot"]):
        for w in windows(t):
            hit = bool(b) and bool(slots.search(w))
            if hit == bool(b):
                found.append(window_features(w))
                ys.append(float(hit))
    return page, _fit([[] for _ in found], found, np.array(ys))


def _fit(tokens: list, extras: list, y: np.ndarray) -> np.ndarray:
    if len(set(y.tolist())) < 2:
        return np.append(np.zeros(1 << 18), -1).astype(np.float32)
    r, f = Encoder()(tokens, extras)
    return fit(r, f, y)


def fields(products: DataFrame, fetches: DataFrame) -> DataFrame:
    """(src_table, row_id, field_name, text, part) of all fields that hold text."""
    pm = products.select(F.lit("product_metadata").alias("src_table"), F.col("meta_id").alias("row_id"), host_part(F.col("url")).alias("part"), F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("name", "description")])).alias("x")).select("src_table", "row_id", "x.field_name", "x.text", "part")
    fr = fetches.select(F.lit("fetch_result").alias("src_table"), F.col("fetch_id").alias("row_id"), F.lit("error").alias("field_name"), F.col("error").alias("text"), host_part(F.col("original_url")).alias("part"))
    return pm.unionByName(fr).filter(F.trim(F.regexp_replace("text", r"[\s\u00a0]+", " ")) != "")


def scores(rows: DataFrame, sample: int = SAMPLE, held: tuple[str, ...] = ()) -> DataFrame:
    """(src_table, row_id, field_name, part, p_text, p_slot) of every field; rows as of fields(), held phrases unseen in training."""
    weights = rows.sparkSession.sparkContext.broadcast(train(rows, sample, held))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, (page, slot) = Encoder(), weights.value
        for f in frames:
            texts = f["text"].tolist()
            pairs = [text_features(t, k) for t, k in zip(texts, f["field_name"])]
            r, i = encode([p[0] for p in pairs], [p[1] for p in pairs])
            p_text = score(page, r, i, len(texts))
            owner, feats = [], []
            for k, t in enumerate(texts):
                if MARKS.search(t):
                    for w in windows(t):
                        owner.append(k)
                        feats.append(window_features(w))
            p_slot = np.zeros(len(texts))
            if feats:
                r, i = encode([[] for _ in feats], feats)
                np.maximum.at(p_slot, np.array(owner), score(slot, r, i, len(feats)))
            yield f[["src_table", "row_id", "field_name", "part"]].assign(p_text=p_text, p_slot=p_slot)

    return rows.mapInPandas(run, "src_table string, row_id long, field_name string, part long, p_text double, p_slot double")


def found(scored: DataFrame) -> DataFrame:
    return scored.filter("p_text >= 0.5 or p_slot >= 0.5").select("src_table", "row_id", "field_name")


def validate(rows: DataFrame, scored: DataFrame, held: tuple[str, ...] = HELD) -> DataFrame:
    """(field_name, n, precision, recall, n_unseen, recall_unseen) against the weak labels.

    n, precision and recall are on hosts not used for training; n_unseen and recall_unseen on the texts of all
    hosts that hold one of the held phrases, which training saw on none.
    """
    unseen = has_phrase(F.col("text"), held)
    truth = rows.select("src_table", "row_id", "field_name", "part", unseen.alias("unseen"), F.greatest(weak_label(F.col("text"), F.col("field_name")), slot_label(F.col("text"))).alias("y")).filter("part = 0 or unseen")
    both = truth.join(scored.select("src_table", "row_id", "field_name", ((F.col("p_text") >= 0.5) | (F.col("p_slot") >= 0.5)).cast("int").alias("p")), ["src_table", "row_id", "field_name"])
    y, p, host, new = F.col("y"), F.col("p"), F.col("part") == 0, F.col("unseen") & (F.col("y") == 1)
    hits = F.sum(F.when(host, y * p))
    return both.groupBy("field_name").agg(F.count_if(host).alias("n"), F.round(F.try_divide(hits, F.sum(F.when(host, p))), 6).alias("precision"), F.round(F.try_divide(hits, F.sum(F.when(host, y))), 6).alias("recall"), F.count_if(new).alias("n_unseen"), F.round(F.try_divide(F.sum(F.when(new, p)), F.count_if(new)), 6).alias("recall_unseen"))
