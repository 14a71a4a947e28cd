"""Entities matched by keys, containment, tokens and edit ratio; a cascade where each stage sees only the residue."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions import urls
from archivolt.session import fits, materialize, release

STRONG, FLOOR, RATIO, WHOLE = 5, 0.6, 0.85, 12


def sku_to_slug(metadata: DataFrame) -> DataFrame:
    """(sku, slug), upper case, the first row (ordinal) of a sku counting."""
    sku = F.upper(F.trim(F.coalesce(F.nullif(F.col("sku"), F.lit("")), F.col("matched_sku"))))
    return metadata.withColumn("_sku", sku).filter("_sku <> ''").groupBy(F.col("_sku").alias("sku")).agg(F.min_by("slug", "ordinal").alias("slug"))


def directory_map(metadata: DataFrame) -> DataFrame:
    """(dir, slug); of slugs that share a directory the last (ordinal) counts."""
    name = F.coalesce(F.col("name"), F.initcap(F.replace(F.col("slug"), F.lit("-"), F.lit(" "))))
    return metadata.select(urls.dirname(name, F.col("date"), F.col("slug")).alias("dir"), "slug", "ordinal").groupBy("dir").agg(F.max_by("slug", "ordinal").alias("slug"))


def exact_keys(slugs: DataFrame, skus: DataFrame) -> DataFrame:
    """(slug, sku) of equal keys; the last slug of a key and the last sku of a slug count."""
    left = slugs.withColumn("key", urls.slug_match_key(F.col("slug"))).groupBy("key").agg(F.max_by("slug", "ordinal").alias("slug"))
    right = skus.withColumn("key", urls.api_match_key(F.col("name"), F.col("color")))
    return left.join(right, "key").groupBy("slug").agg(F.max("sku").alias("sku"))


def _least(data: np.ndarray, ends: np.ndarray, row: np.ndarray, q: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash): of the q-grams of joined texts the hash that is least in each window of w neighbours in one text."""
    n = len(data) - (q + w - 2)
    if n <= 0:
        return row[:0], row[:0]
    h = np.full(len(data) - q + 1, q, np.uint64)
    for i in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + data[i : i + len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))).view(np.int64)
    least = h[:n]
    for i in range(1, w):
        least = np.minimum(least, h[i : i + n])
    whole = np.arange(n) + (q + w - 2) < ends[row[:n]]
    r, g = row[:n][whole], least[whole]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
    return r[new], g[new]


def _marks(tiers: tuple, first: bool, known: dict | None = None):
    """An Arrow function from texts to their distinct marks in the tiers (q, w), of `known` tiers those it names; null where
    a text is too short. first: only those of the first tier that a text is long enough for."""

    def of(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.binary())
        gone = texts.is_null().to_numpy(zero_copy_only=False)
        texts = pa.concat_arrays([texts.fill_null(b"")])
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]].astype(np.uint64)
        bounds, size = bounds - bounds[0], np.diff(bounds)
        row = np.repeat(np.arange(len(texts)), size)
        rows, values, left = [], [], ~gone
        for q, w in tiers:
            fit = left & (size >= q + w - 1)
            r, g = _least(data, bounds[1:], row, q, w)
            if known is not None and (q, w) in known:
                k = known[q, w]
                r, g = (r[:0], g[:0]) if not len(k) else (lambda hit: (r[hit], g[hit]))(k[np.minimum(np.searchsorted(k, g), len(k) - 1)] == g)
            rows.append(r[fit[r]])
            values.append(g[fit[r]])
            left = left & ~fit if first else left
        r, g = np.concatenate(rows), np.concatenate(values)
        order = np.lexsort((g, r))
        r, g = r[order], g[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
        ends = np.concatenate([[0], np.cumsum(np.bincount(r[new], minlength=len(texts)))]).astype(np.int32)
        short = gone | (size < min(q + w - 1 for q, w in tiers))
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(g[new], pa.int64()), mask=pa.array(short))

    return F.arrow_udf(of, "array<bigint>")


def marks(c, q: int, w: int):
    """Hashes of the q-grams of c's bytes that are least in a window of w neighbours; null below q + w - 1 bytes.

    A text that holds c has each window of c, so it has each of these marks; there are about 2 / (w + 1) a byte.
    """
    return _marks(((q, w),), True)(c)


#: Grams and windows of `marks` by length of the key; up to FEW marks of the shorter keys are sent to the texts, else they are joined.
TIERS, FEW = ((1, 1), (2, 1), (3, 1), (5, 2), (8, 5)), 200_000


def inside(short: DataFrame, long: DataFrame) -> DataFrame:
    """(ks, kl): the distinct keys of `long` that hold a distinct key of `short`; empty keys hold and are held by nothing.

    A key that is held shares all its marks with its holder, so one that lacks a mark among the long keys is
    dropped and any other meets the long keys by its rarest mark alone: a prefix that all keys share makes no
    pairs. Only keys under twelve characters need the denser marks; long keys send those that a short key has.
    Pairs are checked as texts, so clashes of hashes add none.
    """
    s = short.select(F.col("key").alias("ks")).filter("ks <> ''").distinct()
    t = long.select(F.col("key").alias("kl")).filter("kl <> ''").distinct()
    own = _marks(TIERS[::-1], True)(F.col("ks"))
    least = lambda q, w: F.octet_length("ks") >= q + w - 1
    tier = F.coalesce(*[F.when(least(*x), F.lit(i)) for i, x in reversed(list(enumerate(TIERS)))])
    few = s.filter(~least(*TIERS[-1])).select(tier.alias("tier"), F.explode(own).alias("g")).distinct()
    got = few.limit(FEW + 1).toArrow()
    if got.num_rows <= FEW:
        at, g = got["tier"].to_numpy(), got["g"].to_numpy()
        known = {x: np.sort(g[at == i]) for i, x in enumerate(TIERS[:-1]) if (at == i).any()}
        each = t.select("kl", F.explode(_marks((*known, TIERS[-1]), False, known)(F.col("kl"))).alias("g"))
    else:
        dense = t.select("kl", F.explode(_marks(TIERS[:-1], False)(F.col("kl"))).alias("g")).join(few.select("g").distinct(), "g", "left_semi")
        each = t.select("kl", F.explode(_marks(TIERS[-1:], False)(F.col("kl"))).alias("g")).unionByName(dense.select("kl", "g"))
    seen = each.groupBy("g").agg(F.count("*").alias("n"))
    by = [F.xxhash64("ks").alias("i"), F.hash("ks").alias("j"), F.length("ks").alias("m")]
    asked = s.select(*by, own.alias("own")).withColumn("g", F.element_at("own", -1)).join(seen.select("g"), "g", "left_semi")  # most keys end here, before they send all their marks
    asked = asked.select("i", "j", "m", F.size("own").alias("all"), F.explode("own").alias("g")).join(seen, "g")
    rare = asked.groupBy("i", "j", "m", "all").agg(F.min(F.struct("n", "g")).alias("b"), F.count("*").alias("have")).filter("have = all").select("i", "j", "m", F.col("b.g").alias("g"))
    rare = s.select("ks", *by).join(rare, ["i", "j", "m"]).select("ks", "g")
    return rare.join(each, "g").filter(F.contains("kl", "ks")).select("ks", "kl")


def contained(left: DataFrame, right: DataFrame) -> DataFrame:
    """(lid, rid) where one key contains the other; null and empty keys match nothing, repeated rows once."""
    left, right = materialize(left.select("id", "key")), materialize(right.select("id", "key"))  # else filters on keys compute them again
    a, b = left.select(F.col("id").alias("lid"), F.col("key").alias("_l")), right.select(F.col("id").alias("rid"), F.col("key").alias("_r"))
    keys = inside(left, right).select(F.col("ks").alias("_l"), F.col("kl").alias("_r")).unionByName(inside(right, left).select(F.col("kl").alias("_l"), F.col("ks").alias("_r"))).distinct()
    return keys.join(a, "_l").join(b, "_r").select("lid", "rid").distinct()


def name_and_color(slugs: DataFrame, skus: DataFrame) -> DataFrame:
    """(slug, sku) where the slug's key contains both the product's name and its colour; a colour of marks only is in every key."""
    s = slugs.select(F.col("slug"), urls.slug_match_key(F.col("slug")).alias("kl"))
    k = skus.select("sku", "color", urls.match_key(F.col("name")).alias("ks"), urls.match_key(F.col("color")).alias("c")).filter("ks <> '' and color <> ''")
    keys = inside(k.select(F.col("ks").alias("key")), s.select(F.col("kl").alias("key")))
    return keys.join(k, "ks").filter(F.contains("kl", "c")).join(s, "kl").select("slug", "sku").distinct()


#: Pairs of a serial choice that one task goes through at once, and rounds that lessen more of them before it does.
ALONE, ROUNDS = 2_000_000, 3


def serial_choice(pairs: DataFrame, by: str, of: str, rank: str) -> DataFrame:
    """(of, by): each `by`, in ascending order, takes the free `of` of least rank among its pairs (by, of, rank).

    One task goes through the sorted pairs as a stream and remembers what is taken, so no chain of displacements
    costs a job for each of its links. More than ALONE pairs are lessened before: all choose at once, an `of`
    keeps the smallest that chose it and everybody above that one crosses it off. This cannot change the result:
    the smallest gets it, or finds it taken by a smaller one still.
    Null keys take no part; repeated pairs count once.
    """
    rest = materialize(pairs.filter(F.col(by).isNotNull() & F.col(of).isNotNull()).select(by, of, rank))
    for _ in range(ROUNDS):
        if fits(rest, ALONE):
            break
        want = rest.groupBy(by).agg(F.min(F.struct(rank, of)).alias("b")).select(by, F.col(f"b.{of}").alias(of))
        held = want.groupBy(of).agg(F.min(by).alias("_held"))
        left = materialize(rest.join(held, of, "left").filter(F.col("_held").isNull() | (F.col(by) <= F.col("_held"))).select(by, of, rank))
        release(rest)
        rest = left

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, served = set(), None
        for b in batches:
            at = []
            for i, (o, x) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if x != served and o not in taken:
                    taken.add(o)
                    served = x
                    at.append(i)
            yield b.take(pa.array(at, pa.int64()))

    one = rest.repartition(1).sortWithinPartitions(by, rank, of).select(of, by)
    return materialize(one.mapInArrow(take, one.schema))


def match_products(slugs: DataFrame, skus: DataFrame) -> DataFrame:
    """(slug, sku, strategy), one sku a slug: products in the order of their sku take an exact key, else the first free slug
    whose key contains theirs or is contained, else the first free one that holds name and colour.

    slugs: (slug, ordinal), skus: (sku, name, color). Compatible: an exact key takes a slug even if it is taken
    (the last exact sku keeps it), of slugs with one key the last stands for all at the place of the first.
    Null names, colours and slugs count as empty; a sku given twice counts once, by its least name and colour.
    """
    first = slugs.filter(F.coalesce("slug", F.lit("")) != "").groupBy("slug").agg(F.min("ordinal").alias("at"))
    keys = materialize(first.groupBy(urls.slug_match_key(F.col("slug")).alias("key")).agg(F.max_by("slug", "at").alias("slug"), F.min("at").alias("at")))
    p = skus.filter("sku is not null").groupBy("sku").agg(F.min(F.struct(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("color", F.lit("")).alias("color"))).alias("p")).select("sku", "p.name", "p.color")
    p = materialize(p.select("sku", urls.api_match_key(F.col("name"), F.col("color")).alias("api"), urls.match_key(F.col("name")).alias("n"), urls.match_key(F.col("color")).alias("c"), (F.col("color") != "").alias("colored")))
    exact = materialize(p.join(keys, p["api"] == keys["key"]).select("sku", "slug"))
    rest = materialize(p.join(exact.select("sku"), "sku", "left_anti"))
    mine, theirs = rest.select(F.col("api").alias("key")), keys.select("key")
    held = inside(mine, theirs).select(F.col("ks").alias("api"), F.col("kl").alias("key")).unionByName(inside(theirs, mine).select(F.col("kl").alias("api"), F.col("ks").alias("key"))).distinct()
    second = rest.select("sku", "api").join(held, "api").join(keys, "key").select("sku", "slug", F.struct(F.lit(2).alias("strategy"), F.col("at")).alias("rank"))
    named = rest.filter("colored and n <> ''")
    third = named.join(inside(named.select(F.col("n").alias("key")), theirs).withColumnRenamed("ks", "n"), "n").filter(F.contains("kl", "c")).join(keys, F.col("kl") == keys["key"]).select("sku", "slug", F.struct(F.lit(3).alias("strategy"), F.col("at")).alias("rank"))
    pairs = second.unionByName(third).groupBy("sku", "slug").agg(F.min("rank").alias("rank"))
    taken = exact.groupBy("slug").agg(F.min("sku").alias("_from"), F.max("sku").alias("_last"))
    pairs = materialize(pairs.join(taken.select("slug", "_from"), "slug", "left").filter("_from is null or sku < _from").select("sku", "slug", "rank"))
    chosen = serial_choice(pairs, "sku", "slug", "rank").join(pairs, ["sku", "slug"]).select("slug", "sku", F.col("rank.strategy").alias("strategy"))
    return taken.select("slug", F.col("_last").alias("sku"), F.lit(1).alias("strategy")).unionByName(chosen.join(taken.select("slug"), "slug", "left_anti"))


def _sets(t):
    """(h, c, k, strong) of the sets of a sorted array's tokens: two hashes, size, whether one is strong; the empty set first.

    All sets of up to WHOLE tokens; of more tokens those of three and less.
    """
    none = F.array(F.struct(F.lit(1).cast("long").alias("h"), F.lit(1).alias("c"), F.lit(0).alias("k"), F.lit(False).alias("strong")))
    most = F.when(F.size(t) <= WHOLE, F.lit(WHOLE)).otherwise(3)
    more = lambda x: lambda o: F.struct(F.xxhash64(o["h"], x).alias("h"), F.hash(o["c"], x).alias("c"), (o["k"] + 1).alias("k"), (o["strong"] | (F.length(x) >= STRONG)).alias("strong"))
    return F.aggregate(t, none, lambda out, x: F.concat(out, F.transform(F.filter(out, lambda o: o["k"] < most), more(x))))


#: Bytes of the tokens that both sides know, 64 a row added, up to which they are broadcast.
SENT = 8 << 20


def _shuffled(d: DataFrame) -> DataFrame:
    """d as a side of a join that is not broadcast: Spark goes by the size of the files, and rows exploded from them are many times that."""
    return d.hint("merge")


def token_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(lid, rid, score): the best right key sharing a strong token or with token Jaccard at the floor; the smaller id wins ties.

    Exact without pairing the rows of a frequent token. Of the right keys that hold a set of tokens, the shortest
    (then the one of smallest id) has the best score that just this set gives, so one row a set is enough, by an
    aggregation; the best of a left key over all sets of its tokens is its best match, as the set that both share
    is among them. Only tokens that both sides know form sets. Keys with more than WHOLE of these have
    sets of up to three tokens; what such a key shares with another beyond that is counted pair by pair, for pairs
    that share three. Null keys and keys without tokens match nothing. Joins are shuffled but for
    that of up to SENT bytes of tokens, so the driver holds none of the sets.
    """
    spark = right.sparkSession
    a = materialize(left.select(F.col("id").alias("lid"), F.array_sort(urls.tokens(F.col("key"))).alias("t")).filter(F.size("t") > 0).distinct().withColumn("o", F.monotonically_increasing_id()))
    b = right.select(F.col("id").alias("rid"), F.array_sort(urls.tokens(F.col("key"))).alias("t")).filter(F.size("t") > 0)
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 10)  # so that the numbers, which keep the ids' order, have 43 bits
    b = materialize(b.repartitionByRange(parts, F.asc_nulls_first("rid")).sortWithinPartitions(F.asc_nulls_first("rid")).withColumn("o", F.monotonically_increasing_id()))
    word = lambda d: d.select("o", F.size("t").alias("n"), F.explode("t").alias("tok"))
    both = materialize(word(a).select("tok").distinct().join(_shuffled(word(b).select("tok").distinct()), "tok"))
    few = (both.agg(F.sum(F.octet_length("tok") + 64)).first()[0] or 0) <= SENT
    known = lambda d: materialize(word(d).join(F.broadcast(both) if few else _shuffled(both), "tok").groupBy("o", "n").agg(F.array_sort(F.collect_list("tok")).alias("t")))
    ka, kb = known(a), known(b)
    every = lambda d: d.select("o", "n", F.explode(_sets(F.col("t"))).alias("s")).select("o", "n", "s.*").filter("k > 0")
    # a set without a strong token counts from the floor up, which bounds its size
    sets = lambda d: every(d).filter(F.col("strong") | (F.col("k") >= FLOOR * F.col("n") - 1e-9))
    best = sets(kb).groupBy("h", "c", "k").agg(F.min(F.shiftleft(F.col("n").cast("long"), 43).bitwiseOR(F.col("o"))).alias("b"))
    score = F.col("k") / (F.col("n") + F.col("m") - F.col("k"))
    got = sets(ka).join(_shuffled(best), ["h", "c", "k"]).select("o", "n", "k", "strong", F.shiftright("b", 43).alias("m"), F.col("b").bitwiseAND(F.lit((1 << 43) - 1)).alias("r")).withColumn("score", score)
    got = got.filter(F.col("strong") | (F.col("score") >= FLOOR)).select("o", "r", "score")
    la, lb = (d.filter(F.size("t") > WHOLE) for d in (ka, kb))
    three = lambda d, o="o": every(d).filter("k = 3").select("h", "c", F.col("o").alias(o))
    for x, y in ((la, kb), (ka, lb)):
        if x.isEmpty() or y.isEmpty():
            continue
        pairs = three(x).join(_shuffled(three(y, "r")), ["h", "c"]).select("o", "r").distinct()
        pairs = pairs.join(_shuffled(x), "o").join(_shuffled(y.select(F.col("o").alias("r"), F.col("n").alias("m"), F.col("t").alias("u"))), "r").withColumn("t", F.array_intersect("t", "u")).withColumn("k", F.size("t")).withColumn("score", score)
        got = got.unionByName(pairs.filter(F.exists("t", lambda w: F.length(w) >= STRONG) | (F.col("score") >= FLOOR)).select("o", "r", "score"))
    top = got.groupBy("o").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("r"))).alias("b"))
    top = top.join(_shuffled(a.select("o", "lid")), "o").groupBy("lid").agg(F.min("b").alias("b")).select("lid", F.col("b.r").alias("o"), F.round(-F.col("b.s"), 6).alias("score"))
    return top.join(_shuffled(b.select("o", "rid")), "o").select("lid", "rid", "score")


def _numbered(keys: pa.Array) -> pa.Array:
    """The two-letter grams of each key, repeats numbered; of a single letter the letter."""
    out = []
    for k in keys.to_pylist():
        n, grams = {}, []
        for i in range(max(len(k) - 1, 1)):
            g = k[i : i + 2]
            n[g] = n.get(g, 0) + 1
            grams.append(f"{g}{n[g]}")
        out.append(grams)
    return pa.array(out, pa.list_(pa.string()))


def close_matches(left: DataFrame, right: DataFrame, cutoff: float = RATIO) -> DataFrame:
    """(lid, rid, ratio): the most similar right key by the sequence ratio, at the cutoff or above; the greater id wins ties.

    The ratio is Python's difflib one, as no built-in has it. Candidates lose none: a ratio r leaves at most
    (1 - r) of both lengths unmatched, lengths then differ by a factor of r / (2 - r) at most, and each
    unmatched character spoils two of a key's two-letter grams (repeats numbered). So a close pair shares a
    known number of grams and one of the rarest of each side; pairs so found are counted gram by gram before
    any is handed to Python. At 0.85 even the shortest keys share a gram. Null and empty keys match nothing.
    """
    if cutoff <= 0.8:
        raise ValueError("the gram filter holds for ratios above 0.8")

    def keyed(d: DataFrame, k: str) -> DataFrame:
        c = F.col(k)
        return d.select(F.col("key").alias(k)).filter(f"{k} <> ''").distinct().select(k, F.arrow_udf(_numbered, "array<string>")(k).alias("g" + k))

    a = materialize(keyed(left, "kl"))
    lengths = [r[0] for r in a.select(F.length("kl")).distinct().collect()]  # as many as keys have lengths, not rows
    spans = sorted({x for n in lengths for x in range(math.ceil(n * cutoff / (2 - cutoff) - 1e-6), math.floor(n * (2 - cutoff) / cutoff + 1e-6) + 1)})
    b = materialize(keyed(right.filter(F.length("key").isin(spans)), "kr"))
    seen = a.select(F.explode("gkl").alias("g")).unionByName(b.select(F.explode("gkr").alias("g"))).groupBy("g").agg(F.count("*").alias("df"))

    def least(n, other):
        """Grams that a key of n characters shares at the least with a close one of `other` characters."""
        return F.greatest(n - 1 - 2 * F.floor((1 - cutoff) * (n + other) + 1e-9), F.lit(1))

    def rare(d: DataFrame, k: str) -> DataFrame:
        n = F.length(k)
        each = d.select(k, n.alias("n"), F.explode("g" + k).alias("g")).join(seen, "g")
        at = F.row_number().over(Window.partitionBy(k).orderBy("df", "g"))
        return each.withColumn("at", at).filter(F.col("at") <= F.greatest(F.col("n") - 1, F.lit(1)) - least(F.col("n"), F.floor(F.col("n") * (2 - cutoff) / cutoff + 1e-9)) + 1).select(k, "n", "g")

    near = F.least("n", "m") * 2 >= (cutoff - 1e-9) * (F.col("n") + F.col("m"))
    pairs = rare(a, "kl").join(rare(b, "kr").withColumnRenamed("n", "m"), "g").filter(near).select("kl", "kr").distinct()
    enough = F.size(F.array_intersect("gkl", "gkr")) >= least(F.greatest(F.length("kl"), F.length("kr")), F.least(F.length("kl"), F.length("kr")))
    pairs = pairs.join(a, "kl").join(b, "kr").filter(enough).select("kl", "kr")

    def ratio(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out, m = [], difflib.SequenceMatcher()
            for k, r in zip(f["kl"], f["kr"]):
                m.set_seq2(k)
                m.set_seq1(r)
                out.append(m.ratio() if m.real_quick_ratio() >= cutoff and m.quick_ratio() >= cutoff else 0.0)
            yield f.assign(ratio=out)

    hit = materialize(pairs.mapInPandas(ratio, "kl string, kr string, ratio double").filter(F.col("ratio") >= cutoff))
    ids = right.groupBy(F.col("key").alias("kr")).agg(F.max("id").alias("rid"))
    top = hit.join(ids, "kr").groupBy("kl").agg(F.max(F.struct("ratio", "rid")).alias("b"))
    return left.select(F.col("id").alias("lid"), F.col("key").alias("kl")).distinct().join(top, "kl").select("lid", F.col("b.rid").alias("rid"), F.round("b.ratio", 6).alias("ratio"))


def attribute_images(images: DataFrame, slugs: DataFrame, skus: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """(image, slug, stage): exact, parts, sku, containment, tokens, ratio; each stage on what the last ones left.

    Where the order of a set would decide, the smallest slug does. Images without a stem match nothing. Each
    stage's hits and what it leaves are written once and matched by distinct stem part, so repeats cost nothing;
    a stage without hits leaves the table as it is, and none runs on an empty one.
    """
    rest = materialize(images.select("image").distinct().withColumn("stem", urls.image_stem(F.col("image")))).filter("stem <> ''")  # a long expression, else planned and computed for each use
    parts = F.split("stem", "__")
    rest = rest.withColumn("last", F.element_at(parts, -1)).withColumn("prev", F.when(F.size(parts) >= 2, F.element_at(parts, -2)))
    s = materialize(slugs.select("slug").distinct())
    out = None

    def take(hit: DataFrame, stage):
        nonlocal rest, out
        hit = materialize(hit.select("image", "slug", (F.lit(stage) if isinstance(stage, str) else stage).alias("stage")))
        out = hit if out is None else out.unionByName(hit)
        if not hit.isEmpty():
            rest = materialize(rest.join(hit.select("image"), "image", "left_anti"))

    whole = rest.select("image", F.posexplode(F.array("stem", "last", "prev")).alias("at", "cand")).join(s, F.col("cand") == F.col("slug"))
    take(whole.groupBy("image").agg(F.min(F.struct("at", "slug")).alias("b")).select("image", "b.*"), F.when(F.col("at") == 0, "exact").otherwise("parts"))
    if skus is not None:
        code = F.regexp_extract(F.upper(F.substring_index("image", "/", -1)), r"^([A-Z0-9]{6,12})[_\-.]", 1)
        take(rest.withColumn("sku", code).join(skus.select("sku", "slug"), "sku"), "sku")
    last = lambda: rest.select(F.col("last").alias("id"), F.col("last").alias("key")).distinct()
    theirs = s.select(F.col("slug").alias("id"), F.col("slug").alias("key"))
    stages = [("containment", lambda: inside(last().select("key"), s.select(F.col("slug").alias("key"))).groupBy(F.col("ks").alias("last")).agg(F.min("kl").alias("slug")))]
    for stage, match in (("tokens", token_matches), *((("ratio", close_matches),) if fuzzy else ())):
        stages.append((stage, lambda match=match: match(last(), theirs).select(F.col("lid").alias("last"), F.col("rid").alias("slug"))))
    for stage, found in stages:
        if rest.isEmpty():
            break
        take(rest.join(found(), "last"), stage)
    return out


def sole_owner(files: DataFrame, links: DataFrame) -> DataFrame:
    """(file, owner): by raw name, then by stripped name; only files with exactly one owner."""
    def pass_(f: DataFrame, key) -> DataFrame:
        k = f.withColumn("_k", key(F.col("file"))).join(links.select(key(F.col("url")).alias("_k"), "owner").distinct(), "_k")
        return k.groupBy("file").agg(F.countDistinct("owner").alias("n"), F.min("owner").alias("owner"))

    base = lambda c: F.lower(F.substring_index(F.substring_index(c, "?", 1), "/", -1))
    first = pass_(files, base)
    second = pass_(files.join(first, "file", "left_anti"), lambda c: urls.image_stem(c))
    return first.unionByName(second).filter("n = 1").select("file", "owner")


def longest_prefix(names: DataFrame, domains: DataFrame) -> DataFrame:
    """(name, domain) of the longest domain a name starts with: an equi-join on the name's prefixes."""
    lengths = F.array_distinct(F.transform(F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring("name", i + 1, F.lit(1)).isin("_", "", "/")), lambda i: F.substring("name", F.lit(1), i)))
    p = names.filter(F.length("name") > 0).select("name", F.explode(lengths).alias("domain"))
    return p.join(domains.select("domain").distinct(), "domain").groupBy("name").agg(F.max_by("domain", F.length("domain")).alias("domain"))


# Image hosts and the rewrite to the master, in order.
RECIPES = (("i.ebayimg.com", r"/s-l\d+\.", "/s-l1600.", r"/s-l(?!1600)\d+\."), ("i.etsystatic.com", r"/il_\d+x[Nx\d]+\.", "/il_fullxfull.", r"/il_(?!fullxfull)\w+\."), ("u-mercari-images.mercdn.net", r"\?.*$", "", r"\?"), ("media-photos.depop.com", r"/P\d+\.", "/P0.", r"/P(?!0\.)\d+\."), ("media-assets.grailed.com", None, None, None), ("cdn.shopify.com", None, None, None), ("cdninstagram.com", None, None, None), ("gem.app", None, None, None))


def recipe_of(url):
    """struct(host, master, non_master); the host need only end in the recipe's (compatible)."""
    h, out = urls.host(url), F.lit(None).cast("struct<host:string,master:string,non_master:boolean>")
    for name, pattern, by, low in reversed(RECIPES):
        new = F.regexp_replace(url, pattern, by) if pattern else F.lit(None).cast("string")
        s = F.struct(F.lit(name).alias("host"), F.when(new != url, new).alias("master"), (url.rlike(low) if low else F.lit(False)).alias("non_master"))
        out = F.when(h.endswith(name), s).otherwise(out)
    return out
