"""Fields of saved pages and feeds as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named entities that pages of shops use.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&eacute;", "é"), ("&egrave;", "è"), ("&ndash;", "–"), ("&mdash;", "—"), ("&rsquo;", "’"), ("&amp;", "&"))


def _numeric(c: Column) -> Column:
    """Numeric entities of the basic plane as characters."""
    code = lambda x: F.when(x.rlike("^&#[xX]"), F.conv(F.regexp_extract(x, "([0-9A-Fa-f]+);", 1), 16, 10)).otherwise(F.regexp_extract(x, r"(\d+);", 1)).try_cast("int")
    char = lambda x: F.decode(F.unhex(F.lpad(F.hex(code(x)), 4, "0")), "UTF-16BE")
    parts = F.regexp_extract_all(c, F.lit(r"(&#\d{1,7};|&#[xX][0-9A-Fa-f]{1,6};|[^&]+|&)"), F.lit(1))
    known = lambda x: x.rlike(r"^&#.*;$") & (code(x).between(1, 0xD7FF) | code(x).between(0xE000, 0xFFFF))
    return F.array_join(F.transform(parts, lambda x: F.when(known(x), char(x)).otherwise(x)), "")


def unescaped(c: Column) -> Column:
    """The named entities above and numeric ones as characters; others stay."""
    for a, b in ENTITIES[:-1]:
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.when(c.contains("&#"), _numeric(c)).otherwise(c)
    for a, b in ENTITIES[-1:]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _some(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def og_meta(page: Column, prop: str) -> Column:
    """X36."""
    return _some(unescaped(F.regexp_extract(page, rf'<meta\s+property="og:{prop}"\s+content="([^"]*)"', 1)))


def analytics_field(page: Column, field: str) -> Column:
    """A field of the viewed product's JSON island."""
    island = F.replace(F.regexp_extract(page, r'"Viewed Product",\s*(\{[^}]+\})', 1), F.lit("\\/"), F.lit("/"))
    return _some(F.get_json_object(island, f"$.{field}"))


def description(page: Column) -> Column:
    """The first of three blocks that has text; lines trimmed, empty ones dropped."""
    def block(p: str) -> Column:
        raw = F.regexp_replace(F.regexp_replace(F.regexp_extract(page, p, 1), r"<br\s*/?>", "\n"), r"<[^>]+>", "")
        lines = F.filter(F.transform(F.split(unescaped(raw), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
        return F.nullif(F.array_join(lines, "\n"), F.lit(""))

    return F.coalesce(*[block(p) for p in (r'(?s)<div\s+class="product-single__description\s+rte">\s*(.*?)</div>', r'(?s)<div\s+class="product__description[^"]*"[^>]*>\s*(.*?)</div>', r'(?s)<div\s+class="rte"[^>]*>\s*(.*?)</div>')])


def color(page: Column) -> Column:
    """X39."""
    return F.coalesce(*[_some(F.regexp_extract(page, p, 1)) for p in (r"Color\s+([A-Z][A-Z /\-]+)", r"COLOR\s+([A-Z][A-Z /\-]+)", r'"color"\s*:\s*"([^"]+)"')])


def sizes(page: Column) -> Column:
    """Option labels, distinct in order."""
    o = F.transform(F.regexp_extract_all(page, F.lit(r"<option\s[^>]*>\s*([A-Z0-9./\- ]+?)\s*</option>"), F.lit(1)), lambda x: F.trim(x))
    return F.array_distinct(F.filter(o, lambda x: ~x.isin("", "---")))


def shop_metadata(page: Column) -> Column:
    """X41."""
    price = og_meta(page, "price:amount")
    return F.struct(
        F.coalesce(og_meta(page, "title"), analytics_field(page, "name")).alias("name"), price.alias("price"), F.coalesce(og_meta(page, "price:currency"), F.when(price.isNotNull(), "USD")).alias("currency"),
        *[analytics_field(page, f).alias(f) for f in ("brand", "category", "sku")], F.coalesce(og_meta(page, "description"), description(page)).alias("description"), color(page).alias("color"), F.nullif(F.array_join(sizes(page), ", "), F.lit("")).alias("sizes"),
    )


def api_metadata(doc: Column) -> Column:
    """One object or a list with one; parts of a wrong shape count as missing."""
    d = F.when(F.trim(doc).startswith("["), F.get_json_object(doc, "$[0]")).otherwise(doc)
    g = lambda p: F.get_json_object(d, p)
    price = g("$.pricing_information.standard_price")
    sport = F.from_json(g("$.attribute_list.sport"), "array<string>")
    return F.when(
        F.trim(d).startswith("{"),
        F.struct(F.coalesce(g("$.name"), g("$.product_description.title")).alias("name"), g("$.id").alias("sku"), F.when(~price.isin("0", ""), price).alias("price"), F.lit("USD").alias("currency"), g("$.attribute_list.brand").alias("brand"), g("$.attribute_list.category").alias("category"), F.coalesce(g("$.attribute_list.color"), g("$.attribute_list.search_color_raw")).alias("color"), g("$.attribute_list.gender").alias("gender"), g("$.product_description.text").alias("description"), F.nullif(F.array_join(sport, ", "), F.lit("")).alias("sport")),
    )


def catalog_product(doc: Column) -> Column:
    """X43."""
    g = lambda p: F.get_json_object(doc, p)
    return F.struct(g("$.product_id").alias("sku"), F.coalesce(g("$.product_name"), F.lit("")).alias("name"), g("$.price").alias("price"), g("$.color").alias("color"), F.nullif(F.regexp_extract(g("$.image.link"), r"(https?://assets\.[a-zA-Z0-9.-]+\.com/[^\s\"']+)", 1), F.lit("")).alias("image_url"))


def titles(page: Column) -> Column:
    return _some(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(page: Column) -> Column:
    """Product links of the usual attributes."""
    found = F.regexp_extract_all(page, F.lit(r"(?i)(?:href|data-href|data-url|data-product-url|data-product-handle-url)=[\"']([^\"']+)[\"']"), F.lit(1))
    return F.filter(found, lambda u: F.lower(u).contains("/products/"))


def sitemap_locs(body: Column) -> Column:
    """X46/S25."""
    return F.transform(F.regexp_extract_all(body, F.lit(r"(?i)<(?:image:)?loc>([^<]+)</(?:image:)?loc>"), F.lit(1)), lambda x: F.trim(x))


def feed_body(body: Column) -> Column:
    """From the first mark of a feed that does not stand at the start."""
    at = [F.instr(body, m) for m in ("<?xml", "<feed", "<rss")]
    first = F.coalesce(*[F.when(a > 1, a) for a in at])
    return F.when(first.isNotNull(), F.substring(body, first, F.length(body))).otherwise(body)


def feed_links(body: Column) -> Column:
    """Links of entries to pages; all links where no entry has one."""
    b = feed_body(body)
    entries = F.regexp_extract_all(b, F.lit(r"(?s)<entry\b.*?</entry>"), F.lit(0))
    tags = F.flatten(F.transform(entries, lambda e: F.regexp_extract_all(e, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0))))
    page = F.filter(tags, lambda t: (~t.rlike(r"(?i)\brel=") | t.rlike(r"(?i)\brel=[\"']alternate[\"']")) & (~t.rlike(r"(?i)\btype=") | t.rlike(r"(?i)\btype=[\"'][^\"']*html")))
    href = lambda t: F.regexp_extract(t, r"(?i)\bhref=[\"']([^\"']+)[\"']", 1)
    found = F.filter(F.transform(page, href), lambda u: u != "")
    return F.when(F.size(found) > 0, found).otherwise(F.regexp_extract_all(b, F.lit(r"(?i)<link[^>]*\bhref=[\"']([^\"']+)[\"']"), F.lit(1)))


def canonical_link(page: Column) -> Column:
    """From the first 65,536 characters."""
    head = F.substring(page, 1, 65536)
    return _some(F.coalesce(F.nullif(F.regexp_extract(head, r"(?i)<link[^>]+rel=[\"']canonical[\"'][^>]+href=[\"']([^\"']+)", 1), F.lit("")), F.regexp_extract(head, r"(?i)<link[^>]+href=[\"']([^\"']+)[\"'][^>]+rel=[\"']canonical", 1)))


# Parts of addresses that are a site's own furniture, and of images that show no product.
CHROME = ("favicon", "apple-touch", "browser-bar", "cdn-cgi", "consent-tracking", "wpm@", "shopify_pay", "load_feature", "challenge-platform", "shop_events")
NO_PRODUCT = ("favicon", "logo", "icon-", "spinner", "placeholder", "loading")


def is_chrome(url: Column, parts: tuple[str, ...] = CHROME) -> Column:
    """whether an image address holds one of the parts, letter case aside."""
    return F.lower(url).rlike("|".join(re.escape(p) for p in parts))


def image_urls(page: Column, patterns: tuple[str, ...] = (r"(?:https?:)?//cdn\.shopify\.com/[^\s\"'<>\\)]+", r"https?://cdn\.swell\.store/[^\s\"'<>]+", r"https?://imgproxy\.fourthwall\.com/[^\s\"'<>]+")) -> Column:
    """Image addresses of attributes, source sets, scripts and meta tags alike, normalised, filtered and sorted."""
    text = F.replace(page, F.lit("\\/"), F.lit("/"))
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)) for p in patterns]))

    def norm(u: Column) -> Column:
        u = F.regexp_replace(u, r"^https?://[^/]+/web/\d+(?:(?:id|im|if)_)?/", "")
        u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(F.regexp_replace(u, "^http://", "https://"))
        return F.regexp_replace(F.regexp_replace(u, r"_(?:\d+|\{width\})x\d*(?:@\dx)?(?=\.\w+)", ""), r"_(?:grande|medium|small|large|compact|master|pico|icon|thumb)(?=\.\w+)", "")

    return F.array_sort(F.array_distinct(F.filter(F.transform(found, norm), lambda u: ~is_chrome(u))))


def products_json(doc: Column) -> Column:
    """JS1: (handle, images) of a product list; images as objects or strings."""
    items = F.from_json(F.get_json_object(doc, "$.products"), "array<struct<handle:string,images:array<string>>>")
    src = lambda i: F.when(F.trim(i).startswith("{"), F.get_json_object(i, "$.src")).otherwise(i)
    each = F.transform(items, lambda p: F.struct(F.regexp_replace(F.lower(p["handle"]), "^/+|/+$", "").alias("handle"), F.filter(F.transform(F.coalesce(p["images"], F.array().cast("array<string>")), src), lambda u: F.coalesce(u, F.lit("")) != "").alias("images")))
    return F.filter(each, lambda p: F.coalesce(p["handle"], F.lit("")) != "")


def valid_content(content: Column, tier: Column) -> Column:
    """sizes by tier, no block page in the first 5,000 characters, no replay wrapper."""
    head = F.substring(content, 1, 5000)
    # fixed values: texts of block pages
    block = head.rlike(r"Access Denied|Akamai Technologies|akamaized\.net|cf-browser-verification|challenge-platform|Checking your browser|Just a moment|Enable JavaScript and cookies")
    n = F.octet_length(content)
    return (n > 0) & F.when(tier == "structured", n >= 50).otherwise((n >= 1000) & ~block) & ~(head.contains("_wm.wombat") & (n < 10000))


def stripped_comments(code: Column) -> Column:
    """X55."""
    return F.regexp_replace(code, r"(?s)/\*.*?\*/", "")


def fenced_blocks(markdown: Column, language: str) -> Column:
    """S28."""
    return F.regexp_extract_all(markdown, F.lit(rf"(?sm)^```{language}[^\n]*\n(.*?)^```"), F.lit(1))


# Constructs that put style into components, and the names of their findings.
STYLE_RULES = (
    ("style_object_type", r"React\.CSSProperties"), ("styled_tag", r"styled\.[A-Za-z]"), ("styled_call", r"styled\("), ("css_template", "[^A-Za-z]css`"), ("style_library", r"from [\"'](styled-components|@emotion|@stitches|goober|@linaria)"),
    ("runtime_style", r"<style[^>]*>[ \t\r\n\f]*\{"), ("styled_jsx", "<style jsx"), ("arbitrary_value", r"(class|className)[^=]*=[^>]*-\[[^\]]+\]"), ("multi_line_style", r"style=\{\{[^}]*$"),
)


def style_findings(line: Column) -> Column:
    """Findings of one source line: a rule's name, or 'key ' and each key of an inline style object that is no custom property."""
    rules = F.array_compact(F.array(*[F.when(line.rlike(p), F.lit(n)) for n, p in STYLE_RULES]))
    objects = F.concat(F.regexp_extract_all(line, F.lit(r"style=\{\{([^}]*)\}\}"), F.lit(1)), F.regexp_extract_all(line, F.lit(r':style=\"\{([^}]*)\}\"'), F.lit(1)))
    keys = F.transform(F.flatten(F.transform(objects, lambda o: F.split(o, ","))), lambda x: F.regexp_replace(F.regexp_replace(x, "(?s):.*", ""), r"[\s\"`\[\]']", ""))
    bad = F.filter(keys, lambda k: (k != "") & ~k.startswith("...") & ~k.startswith("--"))
    return F.concat(rules, F.transform(bad, lambda k: F.concat(F.lit("key "), k)))
