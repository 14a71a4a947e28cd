"""Addresses, file names and keys of a web archive as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters without content. Three are upper case and so never match a lower-cased name.
TRACKING = ("variant", "slide", "_pos", "_sid", "_ss", "tid", "mi_u", "EV", "DI", "CD", "cvosrc", "kwid", "ap", "gbraid", "gclid", "gclsrc", "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "ref", "mc_cid", "mc_eid")
# Content types that hold no page.
BAD_MIMES = ("application/javascript", "text/javascript", "text/css", "image/png", "image/jpeg", "image/gif", "image/webp", "image/vnd.microsoft.icon", "image/x-icon", "font/woff", "font/woff2", "application/font-woff", "video/mp4", "audio/mpeg", "warc/revisit", "unk", "application/octet-stream")
# Marks of addresses without content.
JUNK = (r"/robots\.txt", r"/favicon\.ico", "/apple-touch-icon", r"/\.well-known/", r"/manifest\.json", "/cdn-cgi/", "/__cf_chl_", "/checkouts", "/checkout/", "/cart$", "/account/", "/admin/", "/wpm@", "/sandbox/", "/monorail/", "/web-pixels", "/gtag/", "/analytics", "/_vercel/", "/shopifycloud/", "/password$", "/payments/", "/csp-report", "/apple-app-site", r"/search(\?|$)", "%22", "%3[CcEe]", "%7[Bb]", "%5[Bb]", "%0[Aa]", "undefined", ":productId", r"\[insert")
STATIC = r"(?i)\.(js|css|map|woff2?|ttf|eot|svg|png|jpe?g|gif|webp|ico|mp4|mp3|avif|bmp)(\?|$)"
VARIANT_NOISE = r"/variants/\d+/?\?section_id=store-availability"
# Endings of several parts under which names are registered.
MULTIPART = ("co.uk", "co.jp", "co.nz", "co.za", "co.kr", "com.au", "com.br", "com.mx", "com.cn", "com.sg", "com.hk", "com.tr", "myshopify.com")
UUID = r"_[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"
NAMED = r"_(?:grande|medium|small|large|compact|master|pico|icon|thumb)"


def _rest(c: Column, sep: str) -> Column:
    """What follows the first sep; '' without one."""
    return F.when(F.instr(c, sep) > 0, F.substring(c, F.instr(c, sep) + F.lit(len(sep)), F.lit(1 << 30))).otherwise(F.lit(""))


def strip_params(url: Column, names: tuple[str, ...], fold: bool = False) -> Column:
    """Without the named parameters; a query that loses all of them loses its mark too."""
    key = lambda p: F.lower(F.substring_index(p, "=", 1)) if fold else F.substring_index(p, "=", 1)
    kept = F.array_join(F.filter(F.split(_rest(url, "?"), "&"), lambda p: ~key(p).isin(*names)), "&")
    base = F.substring_index(url, "?", 1)
    return F.when(F.instr(url, "?") == 0, url).when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept))


def strip_query(url: Column) -> Column:
    """X01. Names are compared in lower case, so the three upper-case ones stay (compatible behaviour)."""
    return strip_params(url, TRACKING, fold=True)


def canonical_path(url: Column) -> Column:
    """X02."""
    path = F.regexp_replace(F.substring_index(F.regexp_replace(url, "https?://[^/]+", ""), "?", 1), r"/+\z", "")
    return F.lower(F.when(path == "", "/").otherwise(path))


def value_tier(path: Column) -> Column:
    """0 is the most valuable."""
    return F.when(path.endswith(".oembed"), 0).when(path.endswith(".atom"), 1).when(path.endswith(".json"), 2).when(path.contains("/collections/"), 3).when(path.contains("/products/"), 4).otherwise(5)


def classify(path: Column, rules: list[dict]) -> Column:
    """struct(slug, url_type) of the first rule that holds; a suffix rule is ignored and '*' deleted (compatible)."""
    out = F.lit(None).cast("struct<slug:string,url_type:string>")
    for r in reversed(rules):
        kind = F.lit(r["url_type"])
        after = F.regexp_replace(F.substring_index(path, "/products/", -1), r"/+\z", "")
        inner = out
        if r.get("path_contains"):
            hit = path.contains(r["path_contains"].replace("*", "")) & path.contains("/products/")
            inner = F.when(hit, F.struct(after.alias("slug"), kind.alias("url_type"))).otherwise(inner)
        if r.get("path_prefix"):
            tail = F.regexp_replace(F.substring(path, len(r["path_prefix"]) + 1, 1 << 30), r"/+\z", "")
            inner = F.when(path.startswith(r["path_prefix"]), F.struct(tail.alias("slug"), kind.alias("url_type"))).otherwise(inner)
        out = inner
    return out


def era(url_type: Column, ts: Column, rules: list[dict]) -> Column:
    """The first condition that holds names the era; a timestamp of fewer than four digits counts as 2020."""
    year = F.when(F.length(ts) >= 4, F.substring(ts, 1, 4).try_cast("int")).otherwise(2020)
    out = F.lit("unknown")
    for r in reversed(rules):
        cond, name = r["condition"], F.lit(r["era"])
        if cond == "default":
            out = name
        elif "url_type ==" in cond:
            out = F.when(url_type == cond.split("==")[1].strip().strip("'\""), name).otherwise(out)
        elif "timestamp_year" in cond:
            limit = F.lit(int(cond.split("=")[1]))
            out = F.when((year <= limit) if "<=" in cond else (year >= limit), name).otherwise(out)
    return out


def canonical_original(url: Column) -> Column:
    """No query, https, no port 80."""
    c = F.regexp_replace(F.regexp_replace(url, r"\?.*", ""), r"/+\z", "")
    return F.regexp_replace(F.regexp_replace(c, "^http://", "https://"), r":80(/|$)", "$1")


def percent_decoded(c: Column) -> Column:
    """As in path decoding '+' stays, and so does what is no escape; bytes that are no UTF-8 become U+FFFD."""
    whole = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(whole), c)).otherwise(c)  # most have nothing to decode


def host(url: Column) -> Column:
    """Lower case, no user, port or trailing dot."""
    h = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(h), r"\.+$", "")


def valid_host(raw: Column) -> Column:
    """A bare host name, else null."""
    s = F.trim(raw)
    h = host(F.when(s.contains("://"), s).otherwise(F.concat(F.lit("http://"), s)))
    return F.when(h.rlike(r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*$"), h)


def apex(h: Column, multipart: tuple[str, ...] = MULTIPART) -> Column:
    """The registrable domain."""
    out = F.substring_index(h, ".", -2)
    for t in reversed(multipart):
        out = F.when(h.endswith("." + t), F.substring_index(h, ".", -(t.count(".") + 2))).otherwise(out)
    return F.when(F.size(F.split(h, r"\.")) <= 2, h).otherwise(out)


def handle(url: Column) -> Column:
    """X11: product handle, 'collection:x', or null."""
    path = F.regexp_replace(F.substring_index(F.regexp_replace(url, "https?://[^/]+", ""), "?", 1), r"/+\z", "")
    p = F.regexp_extract(path, "/products/([^/]+)", 1)
    for ext in ("json", "atom", "oembed", "xml"):
        p = F.regexp_replace(p, rf"\.{ext}$", "")
    c = F.regexp_extract(path, "/collections/([^/]+)", 1)
    return F.when(path.rlike("/products/[^/]+"), F.lower(p)).when(c != "", F.concat(F.lit("collection:"), F.lower(c)))


def handle_type(url: Column) -> Column:
    """X12."""
    p = F.lower(F.regexp_replace(url, "https?://[^/]+", ""))
    return F.when(p.endswith(".oembed"), "oembed").when(p.endswith(".atom"), "atom_feed").when(p.endswith(".json"), "json_api").when(p.contains("/collections/"), "collection").when(p.contains("/products/"), "slug").otherwise("page")


def surface_class(filename: Column) -> Column:
    """What a saved file is a surface of."""
    n = F.lower(F.regexp_replace(filename, r"\.html$", ""))
    tail = F.regexp_extract(n, r"_products_([^/]+?)\.(atom|oembed)$", 1)
    return (
        F.when(n.rlike(r"_sitemap[_.-].*\.xml$|_sitemap\.xml$"), "sitemap")
        .when((tail != "") & ~tail.rlike(r"^(\d+|page[-_]?\d+)$"), "unknown")
        .when(n.endswith(".atom"), "atom").when(n.endswith(".oembed"), "oembed").when(n.endswith("_products.json"), "json_api")
        .when(n.rlike(r"_collections?_.+$"), "collection").when(~F.substring_index(n, "/", -1).contains("_"), "home").otherwise("unknown")
    )


def is_surface(filename: Column) -> Column:
    """The other surface test; it differs from X13 on paginated product feeds."""
    n = F.lower(F.regexp_replace(filename, r"\.html$", ""))
    return n.rlike(r"_sitemap[_.-].*\.xml$|_sitemap\.xml$") | (~n.contains("_products_") & n.rlike(r"\.atom$|\.oembed$|_products\.json$|_collections?_[^_]+$"))


def slug_of_file(filename: Column) -> Column:
    """X15."""
    slug = F.regexp_extract(F.regexp_replace(filename, r"\.html$", ""), r"_products_(.+?)(?:\.json|\.oembed|\.atom)?$", 1)
    slug = F.when(slug.contains("/"), F.substring_index(slug, "_", -1)).otherwise(F.substring_index(slug, "_", 1))
    return F.when(~is_surface(filename) & (slug != ""), slug)


def replay_parts(url: Column) -> Column:
    """struct(ts, original, tier) of a replay address of any archive host."""
    pattern = r"^https?://[^/]+/web/(\d+)(?:id_|im_|if_)?/(https?://.+)"
    original = F.regexp_extract(url, pattern, 2)
    return F.when(url.rlike(pattern), F.struct(F.regexp_extract(url, pattern, 1).alias("ts"), original.alias("original"), fetch_tier(original).alias("tier")))


def fetch_tier(original: Column) -> Column:
    """X50."""
    p = F.lower(F.substring_index(F.regexp_replace(original, "https?://[^/]+", ""), "?", 1))
    return F.when(p.rlike(r"\.(oembed|atom|json)$"), "structured").when(p.contains("/products/"), "html").when(p.contains("/collections/"), "collection").otherwise("homepage")


def safe_filename(url: Column, most: int = 200) -> Column:
    """Long names end in eight digits of the address's hash."""
    s = F.regexp_replace(F.regexp_replace(url, "https?://", ""), r'[<>:"/\\|?*]', "_")
    return F.concat(F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 9), F.lit("_"), F.substring(F.md5(url), 1, 8))).otherwise(s), F.lit(".html"))


def url_of_file(filename: Column) -> Column:
    """Host, then the path with '_' for '/'."""
    n = F.regexp_replace(filename, r"\.html$", "")
    return F.concat(F.lit("https://"), F.substring_index(n, "_", 1), F.lit("/"), F.replace(_rest(n, "_"), F.lit("_"), F.lit("/")))


def unwrapped(url: Column) -> Column:
    """Without a replay prefix."""
    return F.regexp_replace(F.regexp_replace(url, r"^https?://[^/]+/web/\d+(?:id_|im_|if_)?/", ""), r"^/web/\d+(?:id_|im_|if_)?/", "")


def product_ref(url: Column, base_host: Column) -> Column:
    """struct(canonical_url, host, slug) of a product address, absolute or relative; else null."""
    raw = unwrapped(url)
    h = F.coalesce(F.nullif(host(raw), F.lit("")), F.nullif(base_host, F.lit("")))
    path = F.substring_index(F.substring_index(F.regexp_replace(raw, "^[A-Za-z]+://[^/?#]*", ""), "#", 1), "?", 1)
    slug = F.lower(F.regexp_extract(path, r"(?i)/products/([a-z0-9][a-z0-9\-_.%]*)", 1))
    scheme = F.coalesce(F.nullif(F.regexp_extract(raw, "^([A-Za-z]+)://", 1), F.lit("")), F.lit("https"))
    lead = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    for ext in ("atom", "oembed", "json"):
        slug = F.regexp_replace(slug, rf"\.{ext}$", "")
    return F.when(h.isNotNull() & path.rlike(r"(?i)/products/[a-z0-9]"), F.struct(F.concat(scheme, F.lit("://"), h, lead).alias("canonical_url"), h.alias("host"), slug.alias("slug")))


def image_key(url: Column) -> Column:
    """One key for all renditions of an image."""
    c = F.substring_index(url, "?", 1)
    for pattern in (r"_(?:\d+|\{width\})x(?:@\dx)?(?=\.\w+)", NAMED + r"(?=\.\w+)", UUID + r"(?=\.\w+)"):
        c = F.regexp_replace(c, pattern, "")
    return F.regexp_replace(F.regexp_replace(c, "^http://", "https://"), r":80(/|$)", "$1")


def clean_filename(url: Column) -> Column:
    """X21."""
    return F.regexp_replace(F.substring_index(percent_decoded(image_key(url)), "/", -1), r'[/:*?"<>|]', "_")


def shop_size_stripped(url: Column) -> Column:
    """X22."""
    c = F.regexp_replace(url, r"_(?:\d+x\d*|x\d+)(?:_crop_\w+)?(?:@\dx)?(?=\.\w+(?:\?|$))", "")
    return F.regexp_replace(c, NAMED + r"(?=\.\w+(?:\?|$))", "")


def flat_filename(url: Column) -> Column:
    """The path from 'products' or 'files' on, joined by '__'."""
    parts = F.filter(F.split(F.substring_index(F.regexp_replace(url, "https?://[^/]+", ""), "?", 1), "/"), lambda p: p != "")
    at = F.greatest(F.array_position(parts, "products"), F.array_position(parts, "files")).cast("int")
    return F.array_join(F.when(at > 0, F.slice(parts, at, F.size(parts))).otherwise(F.slice(parts, F.greatest(F.size(parts), F.lit(1)), F.lit(1))), "__")


def image_stem(url: Column) -> Column:
    """Lower-cased base name without rendition marks and extension."""
    n = F.lower(F.substring_index(F.when(url.contains("://"), percent_decoded(F.substring_index(url, "?", 1))).otherwise(F.trim(url)), "/", -1))
    for pattern in (UUID + r"(?=\.\w+)?", r"_(?:\d+|\{width\})x\d*(?:@\dx)?(?=\.\w+|$)", NAMED + r"(?=\.\w+|$)"):
        n = F.regexp_replace(n, pattern, "")
    return F.regexp_replace(n, r"\.\w+$", "")


def dashed(c: Column) -> Column:
    """Lower case with '-' for all else."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def match_key(c: Column) -> Column:
    """Names."""
    return F.regexp_replace(dashed(F.trim(c)), "^adidas-", "")


def slug_match_key(c: Column) -> Column:
    """Slugs, without a year or copy number at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "^adidas-", ""), r"-\d{4}$", ""), r"-\d$", "")


def api_match_key(name: Column, color: Column) -> Column:
    """Name and colour."""
    k = F.regexp_replace(dashed(F.concat_ws(" ", name, F.nullif(color, F.lit("")))), "^adidas-", "")
    for tail in ("adults?", "infants?", "kids?"):
        k = F.regexp_replace(k, f"-{tail}$", "")
    return k


def tokens(c: Column) -> Column:
    """X26."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))


def core_name(c: Column) -> Column:
    """What stands before the first bracket."""
    return F.split(c, r"\s*[\(\[]")[0]


def dirname(name: Column, date: Column, slug: Column) -> Column:
    """[date ]name[ [tail of the slug]], without characters that file systems forbid."""
    ns = dashed(name)
    tail = F.when((ns != "") & slug.startswith(ns), F.regexp_replace(F.substring(slug, F.length(ns) + 1, F.lit(1 << 30)), "^-+", "")).otherwise(slug)
    base = F.concat(F.when(F.coalesce(date, F.lit("")) != "", F.concat(date, F.lit(" "))).otherwise(F.lit("")), name)
    return F.trim(F.regexp_replace(F.concat(base, F.when(F.coalesce(tail, F.lit("")) != "", F.concat(F.lit(" ["), tail, F.lit("]"))).otherwise(F.lit(""))), r'[/:*?"<>|]', ""))


def image_angle(stem: Column) -> Column:
    """Front, back, side or null."""
    n = F.upper(stem)
    return F.when(n.contains("FRONT"), "front").when(n.contains("BACK"), "back").when(n.contains("SIDE") | n.contains("RIGHT"), "side")


def image_model(stem: Column) -> Column:
    """Female, male or null; '-M-BLACK' and the like name a cut, not a model."""
    n = F.upper(stem)
    # fixed values: the words after which M is a cut
    male = n.rlike(r"(?:FRONT|BACK)[-_]M(?:[-_.]|$)") | (n.rlike(r"[-_]M[-_.]") & ~n.rlike(r"[-_]M[-_](?:BLACK|BLUE|GREEN|GREY|LS|SS)"))
    return F.when(n.rlike("[-_ ]FEMALE"), "female").when(n.rlike("[-_ ]MALE"), "male").when(n.rlike(r"[-_]F[-_.]") | n.endswith("-F"), "female").when((n.rlike(r"[-_]M[-_.]") | n.endswith("-M")) & male, "male")


# Stem classes and the words that name them, in order; words of released masters; generated names.
STEM_CLASSES = (
    ("vocal", r"\b(?:vox|vocal|lead|bg|chorus|adlib|harm|hook|rap|verse)\b"), ("drums", r"\b(?:drum|kick|snare|hat|tom|perc|cymbal|ride|crash|clap|shaker|conga|808kit)\b"), ("bass", r"\b(?:bass|sub|808)\b"),
    ("guitar", r"\b(?:gtr|guitar|acoustic|elec)\b"), ("keys", r"\b(?:key|keys|piano|rhodes|synth|pad|organ|wurli|wurlitzer)\b"), ("fx", r"\b(?:fx|riser|impact|sweep|noise|whoosh|stinger)\b"),
)
MASTER_WORDS = r"(?i)\b(?:master(?:ed|ing)?|final(?:_?mix)?|released?|reference|bounce_final)\b"
GENERIC_NAMES = r"(?i)^(?:audio\s*track\s*\d+|(?:audio|track|region|bounce|mix|stem|clip)\s*\d+|untitled\s*\d*|new\s+audio\s+file\s*\d*)"


def _separated(name: Column) -> Column:
    return F.regexp_replace(name, r"[_\-.]+", " ")


def stem_class(name: Column, classes: tuple = STEM_CLASSES) -> Column:
    """Separators count as blanks; whole words only, so plurals miss."""
    out = F.lit("other")
    for c, words in reversed(classes):
        out = F.when(_separated(name).rlike("(?iU)" + words), c).otherwise(out)
    return out


def looks_like_master(stem: Column) -> Column:
    """A master's word in a name that is no stem's."""
    return _separated(stem).rlike(MASTER_WORDS) & (stem_class(stem) == "other")


def name_score(stem: Column) -> Column:
    """X33."""
    return F.when(F.trim(_separated(stem)).rlike(GENERIC_NAMES), "generic").when(stem_class(stem) != "other", "informative").otherwise("ambiguous")


def fetch_failure(error: Column) -> Column:
    """struct(failure_class, code); 'rate' is sought anywhere in the message (compatible)."""
    e = F.lower(F.coalesce(error, F.lit("")))
    has = lambda *w: e.rlike("|".join(w))
    name = F.when(has("429", "rate", "throttle"), "throttle").when(has("404", "not found"), "http_404").when(has("503", "502", "500", "5xx"), "http_5xx").when(has("timeout", "timed out", "dns", "connection"), "network").when(has("parse", "invalid", "corrupt"), "parse").otherwise("network")
    code = F.when(name == "throttle", 429).when(name == "http_404", 404).when(name == "http_5xx", 500).otherwise(0)
    return F.struct(name.alias("failure_class"), code.alias("code"))


def ellipsis(c: Column, most: int = 500) -> Column:
    """X56."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def slugify(c: Column) -> Column:
    """X27."""
    return dashed(c)


# Format of a content type, priority of a format.
FORMATS = {"image/png": "png", "image/jpeg": "jpg", "image/tiff": "tif", "image/webp": "webp", "image/gif": "gif", "video/mp4": "mp4", "video/webm": "webm", "video/quicktime": "mov", "audio/flac": "flac", "audio/wav": "wav", "audio/mpeg": "mp3", "audio/aac": "aac", "audio/ogg": "ogg"}
PRIORITY = {"tif": 1, "png": 2, "jpg": 3, "png-indexed": 4, "png-grayscale": 4, "webp": 5, "gif": 6, "mp4": 10, "webm": 11, "mov": 12, "flac": 20, "wav": 21, "mp3": 22, "aac": 23, "ogg": 24}


def _lookup(c: Column, table: dict, default) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), F.lit(default))


def format_of(content_type: Column) -> Column:
    """X52."""
    return _lookup(F.lower(F.trim(F.substring_index(content_type, ";", 1))), FORMATS, "unknown")


def format_priority(fmt: Column) -> Column:
    return _lookup(fmt, PRIORITY, 99)


def append_param(url: Column, name: str, value: str) -> Column:
    """X53."""
    return F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit(f"{name}={value}"))


# Formats and the first bytes (hex) that show them, in order.
MAGIC = (("png", "89504E47"), ("jpg", "FFD8FF"), ("gif", "47494638"), ("tif", "49492A00"), ("tif", "4D4D002A"), ("webm", "1A45DFA3"), ("flac", "664C6143"), ("ogg", "4F676753"), ("aac", "FFF1"), ("aac", "FFF9"), ("mp3", "FFFB"), ("mp3", "FFF3"), ("mp3", "494433"))


def magic_format(content: Column) -> Column:
    """The format that a file's first 16 bytes show, else null; RIFF files by their subtype, MP4 by 'ftyp' anywhere in them."""
    h = F.hex(F.substring(content, 1, 16))
    out = F.when(h.contains("66747970"), "mp4").when(h.contains("FFFB") | h.contains("FFF3"), "mp3")
    riff = F.when(h.contains("57454250"), "webp").when(h.contains("57415645"), "wav")
    out = F.when(h.startswith("52494646"), riff).otherwise(out)
    for name, lead in reversed(MAGIC):
        out = F.when(h.startswith(lead), name).otherwise(out)
    return out


def png_color_type(content: Column) -> Column:
    """X58."""
    t = F.conv(F.hex(F.substring(content, 26, 1)), 16, 10).cast("int")
    return F.when(magic_format(content) == "png", F.when(t == 0, "grayscale").when(t == 2, "rgb").when(t == 3, "indexed").when(t == 4, "grayscale-alpha").when(t == 6, "rgba"))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """Placeholders {name} replaced."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), v)
    return template


def archive_name(c: Column) -> Column:
    """The name of the archive an address belongs to, else its host, else 'unknown'. Compatible: the names are looked for anywhere in the address."""
    named = F.when(c.contains("archive.org"), "internet_archive").when(c.contains("archive.ph") | c.contains("archive.today"), "archive_today").when(c.contains("commoncrawl"), "commoncrawl").when(c.contains("perma.cc"), "perma_cc").when(c.contains("webcitation.org"), "webcitation")
    return named.otherwise(F.coalesce(F.nullif(F.regexp_extract(c, "^https?://([^/]+)", 1), F.lit("")), F.lit("unknown")))


# Hosts of archives.
ARCHIVE_HOSTS = ("web.archive.org", "archive.org", "archive.ph", "archive.today")


def live_cdn(addresses: Column, patterns: tuple[str, ...]) -> Column:
    """F16: whether any address of the array is a live one: not of an archive's host or one below it, and of a pattern."""
    archived = lambda h: h.isin(*ARCHIVE_HOSTS) | h.rlike("[.](?:" + "|".join(a.replace(".", "[.]") for a in ARCHIVE_HOSTS) + ")$")
    return F.exists(F.array_compact(addresses), lambda u: (host(u) != "") & ~archived(host(u)) & u.rlike("|".join(f"(?:{p})" for p in patterns)))


def hidden_name(name: Column) -> Column:
    """F25."""
    return name.rlike("^[_.]")


def proxied_source(url: Column) -> Column:
    """The file behind a signed image proxy's address (its path ends in the base64 of a bucket address, cut into segments), else null."""
    path = F.substring_index(_rest(url, "//i.discogs.com/"), "?", 1)
    joined = F.replace(F.regexp_replace(path, "^[^/]*/(?:[^/]*:[^/]*/)*", ""), F.lit("/"), F.lit(""))
    payload = F.translate(F.regexp_replace(joined, r"[.][^.]*$", ""), "_-", "/+")
    padded = F.rpad(payload, (F.ceil(F.length(payload) / 4) * 4).cast("int"), "=")
    bucket = "s3://discogs-database-images/"
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when(path.contains("/") & (payload != "") & ~payload.contains(":") & F.is_valid_utf8(text) & text.startswith(bucket), F.substring(text, len(bucket) + 1, 1 << 30))


def source_reference(url: Column) -> Column:
    """struct(kind, id) of the release, artist, label or master that a proxied image shows; else null."""
    f = proxied_source(url)
    kinds = F.create_map(*[F.lit(x) for x in ("R", "releases", "A", "artists", "L", "labels", "M", "masters")])
    return F.when(f.rlike(r"^[RALM]-\d+(-|$)"), F.struct(kinds[F.substring(f, 1, 1)].alias("kind"), F.regexp_extract(f, r"^.-(\d+)", 1).alias("id")))


def larger_suffixes(url: Column) -> Column:
    """The addresses of larger renditions to try, in order; null where the name has no suffix. The query stays."""
    stem = r"^(.+)_[a-z][.]([a-z]+)$"
    bare, query = F.substring_index(url, "?", 1), F.when(url.contains("?"), F.concat(F.lit("?"), _rest(url, "?"))).otherwise(F.lit(""))
    each = F.transform(F.array(*[F.lit(x) for x in "okb"]), lambda x: F.concat(F.regexp_extract(bare, stem, 1), F.lit("_"), x, F.lit("."), F.regexp_extract(bare, stem, 2), query))
    return F.when(url.contains("staticflickr.com") & bare.rlike(stem), each)


def legacy_shop(url: Column) -> Column:
    """Without the first size and the first name of a size; null where the host is another one or nothing changes."""
    c = F.regexp_replace(url, r"^(.*?)_\d+x\d+(?:_crop_[a-z]+)?([.][a-z]+)", "$1$2")
    c = F.regexp_replace(c, r"^(.*?)_(?:pico|icon|thumb|small|compact|medium|large|grande|original|master)([.][a-z]+)", "$1$2")
    return F.when(url.contains("cdn.shopify.com") & (c != url), c)


# Extensions that leave a name, in the order in which they do.
MEDIA_EXTENSIONS = ("tif", "tiff", "png", "jpg", "jpeg", "webp", "gif", "mp4", "webm", "mov", "mp3", "aac", "flac", "wav", "ogg", "m3u8")


def output_stem(url: Column) -> Column:
    """The name an address's file is stored under, without media extension.

    Three hosts keep the name elsewhere: before a size segment, in the photo's number, in the proxied source.
    Where nothing is left the stem is 'media_' and eight digits of the address's hash (a clock would not repeat).
    """
    c = F.substring_index(url, "?", 1)
    sized = r"^https?://is[0-9]+(?:-ssl)?[.]mzstatic[.]com/image/thumb/.+/[0-9]+x[0-9]+[a-z]*(?:-[0-9]+)?[.](?:jpe?g|png|tiff?|webp|bmp)$"
    photo = r"^https?://s[.]hdnux[.]com/photos/(?:[0-9]+/){4}([0-9]+)/[0-9]+/[^/]+$"
    c = F.when(c.rlike(sized), F.regexp_replace(c, "/[^/]*$", "")).when(c.rlike(photo), F.concat(F.lit("hdnux_"), F.regexp_extract(c, photo, 1))).otherwise(F.coalesce(proxied_source(c), c))
    c = F.substring_index(c, "/", -1)
    for ext in MEDIA_EXTENSIONS:
        c = F.regexp_replace(c, rf"(?i)[.]{ext}$", "")
    return F.when(c == "", F.concat(F.lit("media_"), F.substring(F.md5(url), 1, 8))).otherwise(c)


# Parameters, formats and extensions that are probed, and formats a shop only pretends to give.
PROBE_PARAMS, PROBE_FORMATS, PROBE_EXTENSIONS = ("fm", "format", "f", "output"), ("tif", "png", "jpg", "webp"), ("tif", "tiff", "png", "jpg", "jpeg")
TRAP_FORMATS = ("tif", "tiff", "avif", "heic")


def _shop_image(url: Column) -> Column:
    return url.contains("cdn.shopify.com/s/files/") | url.contains("/cdn/shop/products/") | url.contains("/cdn/shop/files/")


def _bare_master(url: Column) -> Column:
    return url.contains("skims.imgix.net/") | url.contains("skims-sanity.imgix.net/")


def param_probes(url: Column) -> Column:
    """AR7: the addresses to ask for other formats by parameter, parameter by parameter; without formats that are traps on the host."""
    mark = F.when(url.contains("?"), "&").otherwise("?")
    all_ = F.array(*[F.struct(F.lit(f).alias("fmt"), F.concat(url, mark, F.lit(f"{p}={f}")).alias("url")) for p in PROBE_PARAMS for f in PROBE_FORMATS])
    kept = F.filter(all_, lambda x: ~(_shop_image(url) & x["fmt"].isin(*TRAP_FORMATS)))
    return F.transform(F.when(_bare_master(url), F.slice(kept, 1, 0)).otherwise(kept), lambda x: x["url"])


def path_probes(url: Column) -> Column:
    """AR7: the addresses with other extensions; none for hosts whose names are fixed or that have no image extension."""
    base, query = F.substring_index(url, "?", 1), F.when(url.contains("?"), F.concat(F.lit("?"), _rest(url, "?"))).otherwise(F.lit(""))
    stem = F.regexp_replace(base, "[.][^.]*$", "")
    all_ = F.filter(F.array(*[F.lit(e) for e in PROBE_EXTENSIONS]), lambda e: ~(base.contains("/image/upload/") & e.isin("tif", "tiff")))
    ok = base.rlike(r"(?i)[.](tif|tiff|png|jpg|jpeg|webp)$") & ~_shop_image(base) & ~_bare_master(url)
    return F.transform(F.when(ok, all_).otherwise(F.slice(all_, 1, 0)), lambda e: F.concat(stem, F.lit("."), e, query))
