"""Nested product documents, candidate renditions and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions import urls

NO_DOMINANCE = ("png-indexed", "png-grayscale")


def shared_values(df: DataFrame, owner: str, key: str, value: str) -> DataFrame:
    """Values of a key that more than one owner has, with the owners sorted."""
    g = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.array_sort(F.collect_set(owner)).alias("owners"), F.count("*").alias("occurrences"))
    return g.filter(F.size("owners") > 1)


def exploded_citations(docs: DataFrame, owner: str, citations: str) -> DataFrame:
    """AR1: (owner, key, value) of a map of JSON values, each a scalar or a list."""
    e = docs.select(owner, F.explode(citations).alias("key", "v"))
    as_list = F.coalesce(F.from_json("v", "array<string>"), F.array(F.regexp_replace("v", '^"|"$', "")))
    return e.select(owner, "key", F.explode(F.when(F.trim("v").startswith("["), as_list).otherwise(F.array(F.regexp_replace("v", '^"|"$', "")))).alias("value"))


def admit(candidates: DataFrame, least: int = 1024) -> DataFrame:
    """known formats, and sizes that are unknown (0) or large enough."""
    return candidates.withColumn("priority", urls.format_priority(F.col("fmt"))).filter((F.col("priority") != 99) & ((F.coalesce("size", F.lit(0)) == 0) | (F.col("size") >= least)))


def select_best(candidates: DataFrame, key: str, ratio: int = 4) -> DataFrame:
    """Per key the best format, then the largest; a candidate ratio times larger wins over it, but for palette images and transcodes.

    Demotions (O10) are columns set before the choice, so one pass gives the fixed point. The smaller ordinal wins ties.
    """
    c = admit(candidates).withColumn("size", F.coalesce("size", F.lit(0)))
    row = F.struct("fmt", "size", "url", "source")
    g = c.groupBy(key).agg(F.min(F.struct(F.col("priority"), (-F.col("size")).alias("s"), F.col("ordinal"), row.alias("r"))).alias("b"), F.min(F.struct((-F.col("size")).alias("s"), F.col("ordinal"), row.alias("r"))).alias("l"))
    best, large = F.col("b.r"), F.col("l.r")
    wins = (best["size"] > 0) & (large["size"] >= ratio * best["size"]) & ~large["fmt"].isin(*NO_DOMINANCE) & ~large["fmt"].endswith("-transcode")
    return g.select(key, F.when(wins, large).otherwise(best).alias("w")).select(key, "w.fmt", "w.size", "w.url", "w.source")


def pick_rendition(files: DataFrame, key: str, prefer_source: bool = True) -> DataFrame:
    """The source if preferred and there, else the greatest height, else the source, else the first."""
    h = F.coalesce(F.replace(F.col("rendition"), F.lit("p"), F.lit("")).try_cast("int"), F.lit(0))
    src = (F.col("quality") == "source") | (F.col("rendition") == "source")
    f = files.withColumn("_h", h).withColumn("_s", F.coalesce(src, F.lit(False)))
    g = f.groupBy(key).agg(F.max_by("link", F.when(F.col("_s"), F.col("ordinal"))).alias("source"), F.min(F.when(~F.col("_s"), F.struct((-F.col("_h")).alias("h"), F.col("ordinal"), F.col("link")))).alias("t"))
    order = [F.col("source"), F.col("t.link")] if prefer_source else [F.col("t.link"), F.col("source")]
    return g.select(key, F.coalesce(*order).alias("link"))


def image_order(name: Column) -> list[Column]:
    """O12."""
    a, m = urls.image_angle(name), urls.image_model(name)
    return [F.when(a.isNotNull() & m.isNotNull(), 0).when(a.isNotNull(), 1).otherwise(2), F.lower(name)]


def semantic_names(files: DataFrame, group: str, name: str) -> DataFrame:
    """New names by angle and model, numbered from -2 on where they collide."""
    stem, ext = F.regexp_replace(name, r"\.\w+$", ""), F.lower(F.regexp_extract(name, r"(\.\w+)$", 1))
    a, m = urls.image_angle(stem), urls.image_model(stem)
    base = F.when(a.isNotNull() & m.isNotNull(), F.concat(a, F.lit("-"), m)).when(a.isNotNull(), a).otherwise("detail")
    w = Window.partitionBy(group, "_base", "_ext").orderBy(*image_order(stem))
    f = files.withColumn("_base", base).withColumn("_ext", ext).withColumn("_n", F.row_number().over(w))
    return f.withColumn("new_name", F.concat("_base", F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise(F.lit("")), "_ext")).drop("_base", "_ext", "_n")


def evidence(attestations: DataFrame, trusted: tuple[str, ...] = ("cdx", "dns", "ct", "myshopify-alias")) -> DataFrame:
    """Hosts with their evidence, and whether any of it is trusted."""
    g = attestations.groupBy("host").agg(F.array_sort(F.collect_set("evidence")).alias("evidence"))
    return g.withColumn("trusted", F.arrays_overlap("evidence", F.array(*[F.lit(t) for t in trusted])))


def commerce_platform(urls_: DataFrame, url: str) -> DataFrame:
    """Pattern counts of an address list and the platform they show; later platforms override earlier ones."""
    u = F.lower(F.col(url))  # fixed values: the patterns below
    c = lambda p: F.count_if(u.rlike(p))
    g = urls_.agg(c("/products?/").alias("products"), c("/collections?/").alias("collections"), c(r"/(cart|checkout)(/|\?|$)").alias("carts"), c(r"cdn\.shopify\.com|/cdn/shop/").alias("shopify"), c(r"cdn\.swell\.store").alias("swell"), c(r"imgproxy\.fourthwall\.com").alias("fourthwall"))
    return g.withColumn("platform", F.when(F.col("fourthwall") > 0, "fourthwall").when(F.col("swell") > 0, "swell").when(F.col("shopify") > 0, "shopify").when(F.col("products") + F.col("collections") + F.col("carts") >= 5, "generic"))


def signature_score(body: Column, signatures: dict[str, tuple[str, ...]]) -> Column:
    """struct(platform, confidence): the most signatures, the first platform of equals; min(1, 0.4 + 0.25 n)."""
    items = F.array(*[F.struct(sum((body.rlike(p).cast("int") for p in ps), F.lit(0)).alias("n"), F.lit(-i).alias("rank"), F.lit(k).alias("platform")) for i, (k, ps) in enumerate(signatures.items())])
    best = F.array_max(items)
    return F.when(best["n"] > 0, F.struct(best["platform"].alias("platform"), F.least(F.lit(1.0), 0.4 + 0.25 * best["n"]).alias("confidence"))).otherwise(F.struct(F.lit("unknown").alias("platform"), F.lit(0.0).alias("confidence")))


def front_door(body: Column, location: Column, code: Column, domain: Column) -> Column:
    """X51."""
    target = F.regexp_replace(F.substring_index(F.regexp_replace(location, "^[a-zA-Z]+://", ""), "/", 1), r"^www\.", "")
    # fixed values: texts of parked pages, marks of pages built in the browser
    return (
        F.when(body.rlike(r"(?i)godaddy|sedoparking|afternic|hugedomains|dan\.com|parkingcrew|bodis|domain (is )?for sale|buy this domain|this domain (may be|is) for sale"), "PARKED")
        .when((F.coalesce(target, F.lit("")) != "") & (target != domain), "REDIRECTED")
        .when(body.rlike(r'(?i)id="(app|root|__next|__nuxt)"|__NEXT_DATA__|/_next/|/page-data/|prerender\.io|netlify|vercel|cloudflare-pages|window\.__NUXT__'), "SPA")
        .when(code.between(200, 299), "LIVE").when(code.between(300, 399), "REDIRECTED").when(code >= 400, "DEAD").otherwise("UNKNOWN")
    )


def required(doc: Column, keys: tuple[str, ...]) -> Column:
    """Messages of missing or empty keys in a JSON document; unreadable documents have one message."""
    each = F.array(*[F.when(F.coalesce(F.get_json_object(doc, f"$.{k}"), F.lit("")) == "", F.lit(f"{k} is required")) for k in keys])
    return F.when(F.try_parse_json(doc).isNull(), F.array(F.lit("unreadable"))).otherwise(F.array_compact(each))


def unknown_keys(m: Column, allowed: tuple[str, ...]) -> Column:
    """V15."""
    return F.array_sort(F.array_except(F.map_keys(m), F.array(*[F.lit(a) for a in allowed])))


def truthy(m: Column) -> Column:
    """A map without null, blank, zero and empty values."""
    return F.map_filter(m, lambda _, v: v.isNotNull() & ~v.isin("", "0", "[]"))


def idempotency_key(df: DataFrame, group: str, order: str, part: str) -> DataFrame:
    """One hash over a group's parts in order."""
    g = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, part))).alias("p"))
    return g.select(group, F.sha2(F.array_join(F.transform("p", lambda x: x[part].cast("string")), "\n"), 256).alias("key"))


def sequences_equal(a: DataFrame, b: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Per group whether two lists are equal in order, and as multisets."""
    def g(d: DataFrame, n: str) -> DataFrame:
        h = d.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("l"))
        v = F.transform("l", lambda x: x[value].cast("string"))
        return h.select(group, F.md5(F.array_join(v, "\n")).alias(f"o{n}"), F.md5(F.array_join(F.array_sort(v), "\n")).alias(f"m{n}"))

    return g(a, "1").join(g(b, "2"), group).select(group, (F.col("o1") == F.col("o2")).alias("same_order"), (F.col("m1") == F.col("m2")).alias("same_multiset"))


def nested_children(parents: DataFrame, children: DataFrame, key: str, foreign: str, order: list[str], name: str) -> DataFrame:
    """Children as an ordered array of structs; parents without any have an empty one."""
    cols = [c for c in children.columns if c != foreign]
    g = children.groupBy(foreign).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in cols if c not in order]))).alias(name))
    joined = parents.join(g, F.col(key) == F.col(foreign), "left").drop(foreign)
    return joined.withColumn(name, F.coalesce(name, F.array().cast(g.schema[name].dataType)))


def full_text(docs: DataFrame, key: str, text: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Documents that hold every term, with a BM25 score over an inverted index; statistics cover all documents."""
    t = docs.select(F.col(key).alias("id"), F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("w"))
    stats = t.agg(F.count("*").alias("n_docs"), F.avg(F.size("w")).alias("avg_len"))  # one row
    hit = t.select("id", F.size("w").alias("len"), F.explode(F.filter("w", lambda w: w.isin(*[x.lower() for x in terms]))).alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    s = hit.join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = s.withColumn("s", idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))))
    return s.groupBy("id").agg(F.countDistinct("term").alias("n"), F.round(F.sum("s"), 6).alias("score")).filter(F.col("n") == len({x.lower() for x in terms})).select(F.col("id").alias(key), "score")
