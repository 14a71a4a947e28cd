"""Raw capture rows to a clean, deduplicated, ranked index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions import urls

REASONS = ("status", "mime", "junk_path", "static_ext", "variant_noise")
# Marks of broken addresses; types by preference.
DEFAULT_JUNK = r"%22|%3[CcEe]|%7[Bb]|%5[Bb]|\[insert|:productId"
TYPE_PRIORITY = ("api", "slug", "collection", "sku")


def has_junk(c: Column, junk: str = DEFAULT_JUNK) -> Column:
    """asked of an address and again of the slug made of it."""
    return c.rlike(junk)


def valid_slug(slug: Column) -> Column:
    """no '.', no '/', not blank."""
    return ~slug.contains(".") & ~slug.contains("/") & (F.trim(slug) != "")


def meets(url_type: Column, status: Column, mime: Column, rules: list[dict]) -> Column:
    """the status and type demanded by the first rule of the row's type."""
    ok = F.lit(True)
    for t in dict.fromkeys(r["url_type"] for r in rules):
        rule = next(r for r in rules if r["url_type"] == t)
        if rule.get("require_status"):
            ok = ok & ((url_type != t) | (status == rule["require_status"]))
        if rule.get("require_ctype"):
            wanted = rule["require_ctype"] if isinstance(rule["require_ctype"], list) else [rule["require_ctype"]]
            ok = ok & ((url_type != t) | mime.isin(*wanted))
    return ok


def parse_lines(lines: DataFrame, column: str = "value", whitespace_fallback: bool = True) -> DataFrame:
    """Capture lines of five fields by tab, or by white space where tabs give fewer; shorter lines drop out."""
    tab = F.split(F.col(column), "\t")
    parts = F.when(F.size(tab) >= 5, tab).otherwise(F.split(F.trim(F.col(column)), r"\s+")) if whitespace_fallback else tab
    names = ("replay_url", "ts", "original_url", "status", "mime")
    return lines.select(parts.alias("p")).filter(F.size("p") >= 5).select(*[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def good_status(status: Column, wanted: tuple[str, ...] = ("200",)) -> Column:
    """F01; a null status is none of them."""
    return F.coalesce(status, F.lit("")).isin(*wanted)


def is_junk(url: Column) -> Column:
    """any of the marks, letter case aside."""
    return url.rlike("(?i)" + "|".join(urls.JUNK))


def is_static(url: Column) -> Column:
    """F04, on the address without its query; data files are not in the pattern, so need no exemption."""
    return F.substring_index(url, "?", 1).rlike(urls.STATIC)


def reject_reason(status: Column, mime: Column, url: Column) -> Column:
    """the first layer a capture fails, or null. Cheap layers come first and regular expressions last."""
    return (
        F.when(~good_status(status), "status")
        .when(F.lower(F.coalesce(mime, F.lit(""))).isin(*urls.BAD_MIMES), "mime")
        .when(is_junk(url), "junk_path").when(is_static(url), "static_ext").when(url.rlike(urls.VARIANT_NOISE), "variant_noise")
    )


def filter_captures(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept captures, with their clean address, path and tier, and the counts of rejections by reason."""
    judged = captures.withColumn("reason", reject_reason(F.col("status"), F.col("mime"), F.col("original_url")))
    clean = urls.strip_query(F.col("original_url"))
    kept = judged.filter("reason is null").drop("reason").withColumn("clean_url", clean).withColumn("path", urls.canonical_path(F.col("clean_url"))).withColumn("tier", urls.value_tier(F.col("path")))
    return kept, judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def best_per_path(kept: DataFrame) -> DataFrame:
    """One capture per path, the best tier and then the latest; ties go to the smaller address.

    An aggregation, not a window: maps combine it before the shuffle, so a path that holds a third of all
    captures sends one row per task.
    """
    late = F.struct(F.col("tier"), (-F.col("ts").try_cast("bigint")).alias("age"), F.col("clean_url"))
    return kept.groupBy("path").agg(F.min(late).alias("b"), F.count("*").alias("n_captures")).select("path", F.col("b.tier").alias("tier"), (-F.col("b.age")).cast("string").alias("ts"), F.col("b.clean_url").alias("clean_url"), "n_captures")


def product_index(captures: DataFrame, url_rules: list[dict], era_rules: list[dict], junk: str = DEFAULT_JUNK, type_priority: tuple[str, ...] = TYPE_PRIORITY) -> DataFrame:
    """A10: one row per slug, the best type and then the earliest capture, with all types and the number of captures.

    F07-F09 apply: junk in address or slug, slugs with '.', '/' or nothing in them, and the status and type
    demanded by the first rule of the row's type.
    """
    path = _decoded_path()
    typed = captures.filter(~has_junk(F.col("original_url"), junk)).withColumn("_p", path).withColumn("_c", urls.classify(F.col("_p"), url_rules)).filter("_c.slug is not null").withColumn("slug", F.trim("_c.slug")).withColumn("url_type", F.col("_c.url_type")).drop("_c", "_p")
    ok = valid_slug(F.col("slug")) & ~has_junk(F.col("slug"), junk) & meets(F.col("url_type"), F.col("status"), F.col("mime"), url_rules)
    rank = F.lit(99)
    for i, t in reversed(list(enumerate(type_priority))):
        rank = F.when(F.col("url_type") == t, i).otherwise(rank)
    first = F.struct(rank.alias("rank"), F.col("ts"), F.col("original_url"), F.col("url_type"), F.col("replay_url"), F.col("mime"))
    g = typed.filter(ok).groupBy("slug").agg(F.min(first).alias("b"), F.array_sort(F.collect_set("url_type")).alias("all_types"), F.count("*").alias("snapshot_count"))
    return g.select("slug", F.col("b.url_type").alias("url_type"), urls.era(F.col("b.url_type"), F.col("b.ts"), era_rules).alias("era"), F.col("b.replay_url").alias("replay_url"), urls.canonical_original(F.col("b.original_url")).alias("original_url"), F.col("b.ts").alias("ts"), F.col("b.mime").alias("content_type"), "all_types", "snapshot_count")


def _decoded_path() -> Column:
    return F.regexp_replace(urls.percent_decoded(F.substring_index(F.substring_index(F.regexp_replace("original_url", "^[A-Za-z]+://[^/?#]*", ""), "#", 1), "?", 1)), r"/+\z", "")


def all_snapshots(captures: DataFrame, slugs: DataFrame, mimes: tuple[str, ...] = ("text/html",)) -> DataFrame:
    """(slug, nth, ts, replay_url), oldest first, of the wanted slugs.

    One row per snapshot instead of one list per slug, so a slug that holds a third of all captures is never
    gathered: ranges of (slug, ts) are ranked apart and offset by the counts of the ranges before.
    """
    p = F.col("_p")
    slug = F.when(p.startswith("/products/"), F.substring(p, 11, 1 << 30)).when(p.startswith("/product/"), F.substring(p, 10, 1 << 30)).when(p.contains("/collections/") & p.contains("/products/"), F.substring_index(p, "/products/", -1))
    rows = captures.filter(good_status(F.col("status")) & F.col("mime").isin(*mimes)).withColumn("_p", _decoded_path()).withColumn("slug", slug).filter("slug <> '' and not contains(slug, '.') and not contains(slug, '/')").withColumn("slug", F.trim("slug"))
    return numbered(rows.join(slugs.select("slug").distinct(), "slug", "left_semi").select("slug", "ts", "replay_url"), "slug", "ts", "replay_url")


def numbered(rows: DataFrame, key: str, at: str, by: str) -> DataFrame:
    """rows with nth: the place within the key in order of (at, by), from 1; a key's years are counted first and ranked in tasks of their own."""
    part = F.substring(F.coalesce(F.col(at).cast("string"), F.lit("")), 1, 6)
    r = rows.withColumn("_part", part)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = r.groupBy(key, "_part").agg(F.count("*").alias("_n")).withColumn("_before", before).drop("_n")
    inside = F.row_number().over(Window.partitionBy(key, "_part").orderBy(at, by))
    ranked = r.withColumn("_i", inside).alias("r").join(counts.alias("c"), F.col(f"r.{key}").eqNullSafe(F.col(f"c.{key}")) & (F.col("r._part") == F.col("c._part")))
    return ranked.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("_before") + F.col("_i")).alias("nth"))


def content_pages(captures: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """(page, nth, ts, replay_url) of the captures of pages that hold product data without being product pages."""
    path = _decoded_path()
    rows = captures.filter(good_status(F.col("status")) & (F.col("mime").contains("html") | F.col("mime").contains("json"))).withColumn("host", urls.host(F.col("original_url"))).withColumn("path", F.when(path == "", "/").otherwise(path))
    if domains:
        rows = rows.filter(F.col("host").isin(*domains))
    p = F.col("path")
    rows = rows.filter(~(p.contains("/products/") & ~p.contains("products.json")) & ~p.rlike(r"wpm@|cdn-cgi|\.well-known/shopify/monorail"))
    # fixed values: paths of pages with products
    wanted = p.isin("/", "/live", "/rave", "/shop", "/us") | p.contains("/collections/") | p.endswith("__data.json") | p.endswith("products.json")
    return numbered(rows.filter(wanted).select(F.concat("host", "path").alias("page"), "ts", "replay_url"), "page", "ts", "replay_url")


def api_captures(captures: DataFrame, patterns: list[str]) -> DataFrame:
    """captures of catalogue interfaces, labelled by the first pattern that fits."""
    label = F.lit(None).cast("string")
    for p in reversed(patterns):
        label = F.when(F.col("original_url").contains(p), p.rstrip("/").split("/")[-1]).otherwise(label)
    return captures.filter("status = '200'").withColumn("label", label).filter("label is not null").select("replay_url", "ts", "label")


def largest_variant(images: DataFrame) -> DataFrame:
    """Per image key the variant of the largest size x scale; the first row (ordinal) wins ties."""
    size = F.coalesce(F.regexp_extract("url", r"_(\d+)x(?:@(\d)x)?", 1).try_cast("int"), F.lit(1)) * F.coalesce(F.regexp_extract("url", r"_(\d+)x(?:@(\d)x)?", 2).try_cast("int"), F.lit(1))
    return images.withColumn("key", urls.image_key(F.col("url"))).groupBy("key").agg(F.max_by("url", F.struct(size, -F.col("ordinal"))).alias("url"), F.max(size).alias("size"))


def merged(parts: list[DataFrame], key: str = "slug", rank: str = "rank") -> DataFrame:
    """Union of several indexes; the smaller rank wins and, at equal rank, the earlier part."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    cols = [c for c in out.columns if c not in (key, "_part")]
    return out.groupBy(key).agg(F.min(F.struct(F.col(rank).alias("_r"), F.col("_part"), *cols)).alias("b")).select(key, *[F.col(f"b.{c}").alias(c) for c in cols])
