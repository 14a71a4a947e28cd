"""Attributes of product listings: brand, model, kind, colour, season and measure.

The wordings of kinds, colours and seasons and the units start from fixed lexicons; wordings of other kinds are
mined from listings whose slug and name word one thing in two ways; brands are those of the brand columns. Reference dictionary build-up: brand-model phrases are mined from trusted listings (those whose slug
and name, read apart, leave the same phrase), then found with an Aho-Corasick automaton in slug, name and
description of every listing, where the longest match that is consistent with the listing's brand counts.

The automaton holds at most SHARD phrases at a time; a larger dictionary is split by hash and the listings
are passed over once per part, so what is broadcast has a bound at any size of the data.

Defined results: null, empty and blank fields tell nothing; a listing without any model phrase has none;
attributes that no field tells are null, the kind too: such a listing goes by brand, model and the rest.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.llm.mojibake import utf8_reading
from archivolt.session import fits, materialize

#: most phrases in one automaton; most distinct brands; most mined pairs of wordings
SHARD, BRANDS, WORDINGS = 150_000, 200_000, 10_000
#: sizes so near are one, as units are printed rounded
NEAR = 1.02
ATTRIBUTES = ("brand", "model", "kind", "color", "season", "measure")
# Wordings of one kind of product.
KINDS = {
    "ball cap": ("six panel cap", "ball cap", "baseball cap"), "beanie": ("beanie", "knit cap", "watch cap"), "tote": ("tote bag", "tote", "shopper"), "backpack": ("backpack", "rucksack", "day pack"), "duffel": ("duffel bag", "duffel", "duffle bag", "duffle", "holdall"),
    "hoodie": ("hooded sweatshirt", "hooded sweat", "hoodie"), "t shirt": ("t shirt", "tshirt", "tee"), "overshirt": ("overshirt", "shirt jacket", "shacket"), "fleece": ("fleece pullover", "fleece top", "fleece"), "parka": ("hooded parka", "long parka", "parka"), "rain jacket": ("rain jacket", "waterproof jacket", "rain shell"), "gilet": ("gilet", "vest", "bodywarmer"),
    "chinos": ("chino trousers", "chino pants", "chinos", "chino"), "shorts": ("short pants", "shorts"), "socks": ("crew socks", "socks"), "sneaker": ("low trainer", "trainer", "sneaker", "trainers", "sneakers"), "boot": ("hiking boot", "trail boot", "walking boot"), "belt": ("waist belt", "belt"), "wallet": ("bifold wallet", "billfold", "wallet"), "scarf": ("neck scarf", "muffler", "scarf"), "gloves": ("work gloves", "gloves"),
    "umbrella": ("stick umbrella", "umbrella"), "mug": ("enamel mug", "mug", "cup"), "bottle": ("water bottle", "drink bottle", "flask"), "candle": ("scented candle", "candle"), "poster": ("wall print", "art print", "poster"), "rug": ("floor rug", "woven rug", "rug"), "blanket": ("wool throw", "throw", "blanket"), "deck": ("skateboard deck", "skate deck", "board deck"), "sleeping bag": ("sleeping bag", "mummy bag"),
}
# Wordings of one colour.
COLORS = {
    "black": ("jet black", "black", "blk", "noir", "schwarz"), "white": ("white", "wht", "weiss", "blanc"), "navy": ("navy blue", "navy", "nvy", "marine blue"), "charcoal": ("charcoal grey", "charcoal gray", "charcoal", "char"), "olive": ("olive drab", "olive green", "olive", "olv"), "rust": ("rust red", "rust", "rst"), "sand": ("sand beige", "sand", "snd"), "cream": ("cream", "crm", "creme"), "burgundy": ("burgundy red", "burgundy", "bordeaux", "burg", "bgdy"), "forest": ("forest green", "forest", "frst"),
    "sky": ("sky blue", "sky blu", "sky"), "teal": ("petrol teal", "teal"), "plum": ("plum purple", "plum", "plm"), "mustard": ("mustard yellow", "mustard", "must"), "coral": ("coral pink", "coral", "crl"), "silver": ("silver grey", "silver gray", "silver", "slv"), "lilac": ("lilac", "lilc"), "copper": ("copper brown", "copper", "copr"),
}
# Selling phrases and words for whom, which tell products apart in no way.
PROMO = ("must have", "must be", "best seller", "new", "just in", "limited edition", "free shipping", "final sale", "top rated", "exclusive", "premium quality", "back in stock", "deal of the week", "original", "sale", "staff pick")
GENDER = ("men s", "women s", "mens", "womens", "men", "women", "male", "female", "ladies", "unisex", "kids", "youth", "all", "m", "w", "u", "k")
UNITS = {"mm": ("mm", 1.0), "cm": ("mm", 10.0), "m": ("mm", 1000.0), "in": ("mm", 25.4), "ml": ("ml", 1.0), "cl": ("ml", 10.0), "l": ("ml", 1000.0), "liter": ("ml", 1000.0), "liters": ("ml", 1000.0), "litre": ("ml", 1000.0), "litres": ("ml", 1000.0), "fl oz": ("ml", 29.5735), "floz": ("ml", 29.5735), "g": ("g", 1.0), "kg": ("g", 1000.0), "oz": ("g", 28.3495)}

_YEAR = r"((?:19|20)\d\d|\d\d)"
_SS, _FW = r"(?:spring ?[/-] ?summer|spring|summer|s ?/ ?s|ss)", r"(?:fall ?[/-] ?winter|autumn ?[/-] ?winter|fall|autumn|winter|f ?/ ?w|a ?/ ?w|fw|aw)"
SEASON = re.compile(rf"(?<![a-z0-9])(?:({_SS})|({_FW}))[ -]?{_YEAR}(?![0-9a-z])|(?<![a-z0-9])((?:19|20)\d\d)[ -]?(?:({_SS})|({_FW}))(?![a-z0-9])")
MEASURE = re.compile(r"(?<![0-9a-z±.,])(?<!tolerance )(\d+(?:\.\d+)?)[ -]?(fl ?oz|mm|cm|ml|cl|kg|oz|liters?|litres?|in|m|l|g)(?![a-z0-9])")
SLUG_MEASURE = re.compile(r"(?<![0-9])(?:(\d{1,2})-(\d{1,2})|(\d+))-?(fl-oz|mm|cm|ml|cl|kg|oz|liters?|litres?|in|m|l|g)(?![a-z0-9])")
WORDS, TAG, SUSPECT, MARKED = re.compile("[a-z0-9]+"), re.compile(r"<[^<>]{1,20}>"), re.compile("[ÃÂâÅÄ√├ΓГВ‚┼ÔЕÐ]"), re.compile(r"[^\x00-\x7f]+")
_LETTERS = str.maketrans({"ß": "ss", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "æ": "ae", "œ": "oe", "đ": "d"})


@functools.lru_cache(100_000)
def _reread(run: str, charset: str) -> tuple[str, int, int]:
    return utf8_reading(run, charset)


def repaired(s: str) -> str:
    """UTF-8 misread as a Western character set is read again; other damage stays. Runs of marks recur, so each is read once."""
    for _ in range(2):
        runs = MARKED.findall(s)
        for charset in ("cp1252", "mac_roman", "cp437", "cp850", "cp1251"):
            read = [_reread(r, charset) for r in runs]
            if any(w for _, w, _ in read) and not any(n for _, _, n in read):
                s = MARKED.sub(lambda m: _reread(m.group(), charset)[0], s)  # noqa: B023
                break
    return s


@functools.lru_cache(200_000)
def _bare(run: str) -> str:
    """A run of marks as fold() writes it: no accents, other scripts as blanks."""
    return "".join(c if ord(c) < 128 or c == "±" else "" if unicodedata.combining(c) else " " for c in unicodedata.normalize("NFKD", run.translate(_LETTERS)))


def fold(s: str | None) -> str:
    """Lower case ASCII without accents, entities and tags; white space runs are one blank."""
    if not s:
        return ""
    if "&" in s or "<" in s:
        s = html.unescape(TAG.sub(" ", s))
    if not s.isascii():
        s = repaired(s) if SUSPECT.search(s) else s
        s = MARKED.sub(lambda m: _bare(m.group()), s)
    return " ".join(s.lower().split())


def plain(s: str) -> str:
    """Words only, blanks around and between."""
    return f" {' '.join(WORDS.findall(s))} "


def automaton(entries: Iterable[tuple[str, object]]) -> ahocorasick.Automaton:
    """Finds phrases as whole words in plain() text."""
    a = ahocorasick.Automaton()
    for phrase, value in entries:
        a.add_word(f" {phrase} ", (len(phrase), value))
    a.make_automaton()
    return a


def hits(a: ahocorasick.Automaton, text: str) -> list[tuple[int, int, object]]:
    """(start, end, value) of the longest matches, none overlapping, from the left."""
    if not len(a):
        return []
    found = sorted(((end - n - 1, end, v) for end, (n, v) in a.iter(text)), key=lambda x: (x[0], -x[1]))
    if len(found) < 2:
        return found
    out, at = [], -1
    for s, e, v in found:
        if s >= at:
            out.append((s, e, v))
            at = e
    return out


KIND = automaton((w, k) for k, ws in KINDS.items() for w in ws)
COLOR = automaton((w, c) for c, ws in COLORS.items() for w in ws)
NOISE = automaton((w, w) for w in (*PROMO, *GENDER))


def season_of(s: str) -> str | None:
    m = SEASON.search(s)
    if not m:
        return None
    year = m.group(3) or m.group(4)
    half = "ss" if m.group(1) or m.group(5) else "fw"
    return f"{half}{int(year) % 100:02d}"


def measure_of(s: str, slug: bool = False) -> str | None:
    for m in (SLUG_MEASURE if slug else MEASURE).finditer(s):
        if slug:
            number, unit = float(m.group(3)) if m.group(3) else float(f"{m.group(1)}.{m.group(2)}"), m.group(4).replace("-", " ")
        else:
            number, unit = float(m.group(1)), m.group(2)
        dim, k = UNITS[unit.replace("floz", "fl oz")]
        if number:
            return f"{round(number * k, 3):.12g}{dim}"
    return None


def first(values: Iterable[str | None]) -> str | None:
    return next((v for v in values if v), None)


def cleaned(s: str, slug: bool = False) -> str:
    """Folded text without season, measure and selling phrases, as plain words."""
    s = (SLUG_MEASURE if slug else MEASURE).sub(" ", SEASON.sub(" ", s))
    return without(plain(s), NOISE)


def without(text: str, a: ahocorasick.Automaton) -> str:
    return cut_out(text, hits(a, text))


def cut_out(text: str, found: list[tuple[int, int, object]]) -> str:
    """The text with what was found in it as single blanks."""
    for s, e, _ in reversed(found):
        text = text[:s] + " " + text[e + 1 :]
    return text


def color_of(text: str) -> str | None:
    found = hits(COLOR, text)
    return found[0][2] if found else None


def slug_words(slug: str | None) -> str:
    """A slug without the shop's random tail."""
    return re.sub(r"-[a-z0-9]{5}$", "", re.sub(r"[^a-z0-9]+", "-", fold(slug)).strip("-"))


@functools.lru_cache(50_000)
def _brand(c: str | None) -> str:
    return plain(fold(c)).strip()


@functools.lru_cache(50_000)
def _color(c: str | None) -> str | None:
    return color_of(plain(fold(c)))


@functools.lru_cache(50_000)
def _season(c: str | None) -> str | None:
    return season_of(fold(c))


def brands_of(*tables: DataFrame) -> list[str]:
    """The folded brands of the tables' brand columns that occur more than once, or in a column that is clean."""
    raw = None
    for t in tables:
        part = t.select("brand").filter("trim(brand) <> ''").groupBy("brand").agg(F.count("*").alias("n"))
        raw = part if raw is None else raw.unionByName(part)
    if not fits(raw, BRANDS):
        raise ValueError(f"more than {BRANDS} distinct brand values")
    counts: dict[str, int] = {}
    for r in raw.toLocalIterator():
        b = plain(fold(r["brand"])).strip()
        if b:
            counts[b] = counts.get(b, 0) + r["n"]
    return sorted(b for b, n in counts.items() if n > 1)


def parse(df: DataFrame, key: str, brands: list[str], *, name: str = "name", slug: str | None = None, description: str | None = None, season: str | None = None, kinds: dict[str, str] | None = None) -> DataFrame:
    """(key, brand, kind, color, season, measure, slug_model, name_model, text): all but the dictionary's model.

    kinds are wordings beside the fixed ones with the kind they name (see mined_kinds). text holds the plain words of slug, name and description, set apart by a mark that no phrase has.
    """
    shared = df.sparkSession.sparkContext.broadcast((brands, kinds or {}))
    none = F.lit(None).cast("string")
    cols = [F.col(key).alias("_k"), F.col(name).alias("name"), F.col("brand"), F.col("color"), F.col(slug).alias("slug") if slug else none.alias("slug"), F.col(description).alias("description") if description else none.alias("description"), F.col(season).alias("season") if season else none.alias("season")]
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ba, known = automaton((b, b) for b in shared.value[0]), set(shared.value[0])
        ka = automaton([*((w, k) for k, ws in KINDS.items() for w in ws), *shared.value[1].items()]) if shared.value[1] else KIND
        seen = lambda text, a: first(v for _, _, v in hits(a, text))
        for f in frames:
            rows = []
            for k, nm, br, co, sl, de, se in zip(*(f[c] for c in ("_k", "name", "brand", "color", "slug", "description", "season"))):
                nm, de, sl = fold(nm), fold(de), slug_words(sl)
                ns, ss, ds = cleaned(nm), cleaned(sl, slug=True), plain(de)
                own = _brand(br)
                in_name, in_slug = hits(ba, ns), hits(ba, ss)
                found = (own if own in known else None) or (in_name[0][2] if in_name else None) or (in_slug[0][2] if in_slug else None) or seen(ds, ba) or own or None
                ns_bare, ss_bare = cut_out(ns, in_name), cut_out(ss, in_slug)
                kind_n, kind_s = hits(ka, ns_bare), hits(ka, ss_bare)
                color = _color(co) or color_of(ss) or color_of(ns) or color_of(cleaned(de))
                kind = seen(ss, ka) or seen(ns, ka) or seen(ds, ka)
                rows.append((k, found, kind, color, _season(se) or season_of(nm) or season_of(de), measure_of(nm) or measure_of(sl, slug=True) or measure_of(de), without(cut_out(ss_bare, kind_s), COLOR).strip() or None, without(cut_out(ns_bare, kind_n), COLOR).strip() or None, f"{ss}|{ns}|{ds}"))
            yield pd.DataFrame(rows, columns=["_k", "brand", "kind", "color", "season", "measure", "slug_model", "name_model", "text"])

    out = f"_k {kind}, brand string, kind string, color string, season string, measure string, slug_model string, name_model string, text string"
    return df.select(*cols).mapInPandas(run, out).withColumnRenamed("_k", key)


def reference_dictionary(parsed: DataFrame) -> DataFrame:
    """(phrase, brands): model phrases of trusted listings with the brands they occur with."""
    trusted = parsed.filter("slug_model = name_model")
    return trusted.groupBy(F.col("slug_model").alias("phrase")).agg(F.array_compact(F.collect_set("brand")).alias("brands"))


def with_model(parsed: DataFrame, key: str, dictionary: DataFrame) -> DataFrame:
    """Adds model: the longest dictionary phrase consistent with the brand, found in slug, name or description; else the own phrase.

    Of phrases of one length that of the earlier field counts, then the greater; so the parts of the dictionary
    and their order tell nothing.
    """
    n = dictionary.count()
    parts = max(1, -(-n // SHARD))
    spark, best = parsed.sparkSession, parsed.withColumns({"model": F.lit(None).cast("string"), "weight": F.lit(0)})
    for i in range(parts):
        part = dictionary.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == i) if parts > 1 else dictionary
        best = _scan(best, spark.sparkContext.broadcast([(r["phrase"], frozenset(r["brands"])) for r in part.toLocalIterator()]))
        if i + 1 < parts:
            best = materialize(best)  # one automaton in a task
    return best.withColumn("model", F.coalesce("model", "slug_model", "name_model")).select(key, *ATTRIBUTES)


def _scan(best: DataFrame, shared) -> DataFrame:
    """model and weight, where a phrase of this part beats those of the parts before."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = automaton((p, (p, b)) for p, b in shared.value)
        for f in frames:
            models, weights = [], []
            for text, brand, model, weight in zip(f["text"], f["brand"], f["model"], f["weight"]):
                top = (weight, model or "")
                for at, part in enumerate(text.split("|") if len(a) else ()):
                    for _, (n, (phrase, brands)) in a.iter(part):  # all matches: a longer one of another brand hides none
                        if brand is None or not brands or brand in brands:
                            top = max(top, (4 * n + 3 - at, phrase))
                models.append(top[1] or None)
                weights.append(top[0])
            yield f.assign(model=models, weight=weights)

    return best.mapInPandas(run, best.schema)


def signature(alias: str = "") -> Column:
    """The attributes as one key; null and text never clash."""
    return F.concat_ws("|", *[F.coalesce(F.col(alias + c), F.lit("")) for c in ATTRIBUTES])


def mined_kinds(parsed: DataFrame, least: int = 3) -> dict[str, str]:
    """Wordings of kinds that the fixed list lacks, with the kind they name, mined from listings of no known kind.

    Where slug and name agree but for a word or two, these word one thing in two ways; such a pair counts if at
    least `least` phrases of brand and rest show it, as chance and slips do not repeat. Pairs that share a
    wording name one kind, its least wording. At most WORDINGS pairs are fetched; more is an error, as no
    shop's language has as many.
    """
    a, b = F.split("slug_model", " "), F.split("name_model", " ")
    left, right, rest = F.array_except(a, b), F.array_except(b, a), F.array_sort(F.array_intersect(a, b))
    odd = parsed.filter("kind is null and slug_model <> name_model").filter(F.size(left).between(1, 2) & F.size(right).between(1, 2) & (F.size(rest) >= 1))
    x, y = F.array_join(left, " "), F.array_join(right, " ")
    seen = odd.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), F.concat_ws("|", F.coalesce("brand", F.lit("")), F.array_join(rest, " ")).alias("of")).distinct()
    pairs = seen.groupBy("x", "y").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    if not fits(pairs, WORDINGS):
        raise ValueError(f"more than {WORDINGS} pairs of wordings")
    kind: dict[str, str] = {}
    for r in pairs.orderBy("x", "y").toLocalIterator():
        old = {kind.get(r["x"], r["x"]), kind.get(r["y"], r["y"])}
        new = min(old)
        kind.update({w: new for w, k in kind.items() if k in old})
        kind[r["x"]] = kind[r["y"]] = new
    return kind


def listings(products: DataFrame, brands: list[str]) -> DataFrame:
    """(meta_id, attributes) of all listings, as a written table."""
    return listings_and_kinds(products, brands)[0]


def listings_and_kinds(products: DataFrame, brands: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """As listings(), with the wordings of kinds mined from them; where there are any, the listings are read again with them."""
    read = lambda kinds: materialize(parse(products, "meta_id", brands, slug="slug", description="description", season="era", kinds=kinds))
    parsed = read(None)
    kinds = mined_kinds(parsed)
    parsed = read(kinds) if kinds else parsed
    return materialize(with_model(parsed, "meta_id", materialize(reference_dictionary(parsed)))), kinds


def compatible(a: str, b: str, attributes: Iterable[str] = ("brand", "color", "season", "measure")) -> Column:
    """No attribute of both sides differs."""
    cond = F.lit(True)
    for c in attributes:
        cond = cond & (F.col(f"{a}.{c}").isNull() | F.col(f"{b}.{c}").isNull() | (F.col(f"{a}.{c}") == F.col(f"{b}.{c}")))
    return cond


def same_sizes(*tables: DataFrame) -> list[DataFrame]:
    """The tables with one wording of each measure: a model's sizes with no gap over NEAR between them are the least of them.

    The comparison runs over the distinct sizes of a model.
    """
    each = [t.filter("model is not null and measure is not null").select("model", "measure") for t in tables]
    sizes = each[0]
    for e in each[1:]:
        sizes = sizes.unionByName(e)
    value, dim = F.regexp_extract("measure", r"^(.*\d)[a-z]+$", 1).cast("double"), F.regexp_extract("measure", "([a-z]+)$", 1)
    sizes = sizes.distinct().withColumns({"value": value, "dim": dim})
    w = Window.partitionBy("model", "dim").orderBy("value", "measure")
    apart = F.coalesce(F.col("value") > F.lag("value").over(w) * NEAR, F.lit(True))
    runs = sizes.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(w))
    least = runs.withColumn("size", F.first("measure").over(Window.partitionBy("model", "dim", "run").orderBy("value", "measure"))).select("model", "measure", "size")
    return [t.join(least, ["model", "measure"], "left").withColumn("measure", F.coalesce("size", "measure")).select(*t.columns) for t in tables]


def grouped(rows: DataFrame) -> DataFrame:
    """(meta_id, product): the product's key. Rows with missing attributes join the one full signature they fit, if it is one.

    The comparison runs over distinct signatures of one model, never over rows.
    """
    rows = same_sizes(rows)[0].filter("model is not null").withColumn("sig", signature())
    sigs = rows.select(*ATTRIBUTES, "sig").distinct()
    full = sigs.filter("brand is not null and color is not null and season is not null").alias("f")
    part = sigs.filter("brand is null or kind is null or color is null or season is null or measure is null").alias("p")
    kinds = F.col("p.kind").isNull() | (F.col("p.kind") == F.col("f.kind"))
    pairs = part.join(full, (F.col("p.model") == F.col("f.model")) & kinds & (F.col("p.sig") != F.col("f.sig")) & compatible("p", "f"))
    # of full signatures that differ only in a missing kind or measure, that with both counts
    order = F.struct(F.col("f.kind").isNotNull(), F.col("f.measure").isNotNull(), F.col("f.sig"))
    fit = pairs.groupBy(F.col("p.sig").alias("sig"), F.col("p.measure").alias("measure")).agg(F.countDistinct("f.brand", "f.color", "f.season").alias("n"), F.countDistinct("f.kind").alias("k"), F.countDistinct("f.measure").alias("m"), F.max_by("f.sig", order).alias("to")).filter("n = 1 and k <= 1 and m <= 1")
    moved = fit.select("sig", "to", "measure")
    # a row may first gain its brand, then its measure, but not another one
    then = moved.join(sigs.select(F.col("sig").alias("to"), F.col("measure").alias("_m")), "to").select(F.col("sig").alias("_s"), F.col("to").alias("_t"), "_m")
    again = moved.join(then, (F.col("to") == F.col("_s")) & (F.col("measure").isNull() | F.col("_m").isNull() | (F.col("measure") == F.col("_m"))), "left").select("sig", F.coalesce("_t", "to").alias("to"))
    return rows.join(again, "sig", "left").select("meta_id", F.coalesce("to", "sig").alias("product"))


def pairs_of(groups: DataFrame) -> DataFrame:
    """(meta_id_a, meta_id_b): all pairs of a product's rows, as asked for; adaptive execution splits large groups."""
    a, b = groups.select(F.col("meta_id").alias("meta_id_a"), "product"), groups.select(F.col("meta_id").alias("meta_id_b"), "product")
    return a.join(b, "product").filter("meta_id_a < meta_id_b").select("meta_id_a", "meta_id_b")
