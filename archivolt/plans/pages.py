"""Page, feed and file-name functions on pages made of the catalogue's own values: what went in must come out."""

from pyspark.sql import functions as F

from archivolt.functions import pages, scalars, urls
from archivolt.operators import capture, catalog, groups, resolve
from archivolt.plans._base import Registry
from archivolt.sources import readers
from archivolt.tables import table

R = Registry()
L = F.lit


def listings(s, d):
    """All listings, null texts as empty ones; k varies the shape of what is made of a row."""
    p = table(s, d, "product_metadata", "meta_id", "slug", "name", "brand", "color")
    return p.select("meta_id", "slug", *[F.coalesce(c, L("")).alias(c) for c in ("name", "brand", "color")], (F.col("meta_id") % 4).alias("k"))


BASE = "(select meta_id, slug, coalesce(name, '') as name, coalesce(brand, '') as brand, coalesce(color, '') as color, meta_id % 4 as k from product_metadata)"


def made(name: str, expected: str, f) -> None:
    """A query of an operator on texts made of each listing; expected computes what went in."""
    @R.query(name, f"select meta_id, {expected} as value from {BASE} p")
    def q(s, d):
        return listings(s, d).select("meta_id", f(*[F.col(c) for c in ("slug", "name", "brand", "k")]).alias("value"))


def t(*parts):
    return F.concat(*[L(x) if isinstance(x, str) else x for x in parts])


def esc(c):
    """As a page's author writes it."""
    for x, y in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, L(x), L(y))
    return c


def by(k, *cases):
    """The case of number k; the last for all others."""
    out = cases[-1] if not isinstance(cases[-1], str) else L(cases[-1])
    for i, c in reversed(list(enumerate(cases[:-1]))):
        out = F.when(k == i, L(c) if isinstance(c, str) else c).otherwise(out)
    return out


def json(**fields):
    return F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))


def island(n, b):
    return t('track("Viewed Product",\n ', json(brand=b, name=n), ");")


ISLAND = "case when contains(name, '}}') or contains(brand, '}}') then null else nullif(trim({0}), '') end"
made("x36_og_meta", "case when k >= 2 then nullif(trim(name || ' & more'), '') end", lambda g, n, b, k: pages.og_meta(by(k, '<meta property="og:name" content="x">', '<meta property="og:title" content="  ">', t('<p>"</p><meta\n property="og:title"  content="', esc(n), ' &amp; more">')), "title"))
made("x36_titles", "nullif(trim(case when k = 0 then '' when k = 1 then name || chr(10) || brand else name end), '')", lambda g, n, b, k: pages.titles(by(k, "<html></html>", t("<TITLE> ", n, "\n", b, " </TITLE><title>no</title>"), t('<title lang="en"> ', n, "</title>"))))
made("x36_entities", "name || ' é–ß' || chr(9731) || '&zz; &#;'", lambda g, n, b, k: pages.unescaped(t(esc(n), " &eacute;&ndash;&#223;&#x2603;&zz; &#;")))
made("x37_analytics_field", f"case when k > 0 then {ISLAND.format('brand')} end", lambda g, n, b, k: pages.analytics_field(by(k, json(brand=b), island(n, b)), "brand"))
made("x38_description", "case when k < 3 then nullif(array_to_string(list_filter(list_transform(regexp_split_to_array(name || chr(10) || 'by ' || brand, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> ''), chr(10)), '') end", lambda g, n, b, k: pages.description(t(by(k, '<div class="product-single__description rte">', '<div class="rte" >  </div><div class="product__description x">', '<div  class="rte">', "<div>"), " ", esc(n), "<br/><b>by</b> ", esc(b), "\n\n</div>")))
made("x39_color", "case when k = 3 then null when k < 2 and regexp_matches(color, '^[A-Za-z][A-Za-z /-]+$') then trim(upper(color)) else nullif(trim(color), '') end", lambda g, n, b, k: pages.color(F.when(k == 3, "<p>no colour</p>").when((k < 2) & F.col("color").rlike("^[A-Za-z][A-Za-z /-]+$"), t(by(k, "<b>Color  ", "COLOR "), F.upper(F.col("color")), "<i>")).otherwise(t('{"color" : "', F.col("color"), '"}'))))
made("x40_sizes", "case when k = 0 then '' else 'XL,' || case when upper(substr(slug, 1, 3)) in ('XL', 'M/L') then '' else upper(substr(slug, 1, 3)) || ',' end || 'M/L 4.5' end", lambda g, n, b, k: F.array_join(pages.sizes(by(k, "<option>S</option>", t('<option value="1"> XL </option><option v>', F.upper(F.substring(g, 1, 3)), '</option><option v>---</option><option v="2">XL</option><option v>M/L 4.5</option><option v>small</option>'))), ","))
made("x41_shop_metadata", f"coalesce(nullif(trim(case when k = 0 then '' else name end), ''), {ISLAND.format('name')}, '-') || '|' || case when k = 1 then '-' else (meta_id % 50) || '.50' end || '|' || case when k = 1 then '-' when k = 2 then 'EUR' else 'USD' end || '|' || coalesce({ISLAND.format('brand')}, '-')", lambda g, n, b, k: (lambda m: F.concat_ws("|", *[F.coalesce(m[c], L("-")) for c in ("name", "price", "currency", "brand")]))(pages.shop_metadata(t(by(k, "", t('<meta property="og:title" content="', esc(n), '">')), F.when(k != 1, t('<meta property="og:price:amount" content="', (F.col("meta_id") % 50).cast("string"), '.50">')).otherwise(""), F.when(k == 2, '<meta property="og:price:currency" content="EUR">').otherwise(""), island(n, b)))))
made("x42_api_metadata", "name || '|' || brand || '|' || case when k = 1 then '-' else cast(meta_id as varchar) end || '|' || case when k = 2 then 'run, walk' else '-' end", lambda g, n, b, k: (lambda doc: (lambda m: F.concat_ws("|", *[F.coalesce(m[c], L("-")) for c in ("name", "brand", "price", "sport")]))(pages.api_metadata(F.when(k % 2 == 0, t(" [", doc, "]")).otherwise(doc))))(F.to_json(F.struct(F.when(k != 3, n).alias("name"), F.when(k == 3, F.struct(n.alias("title"))).alias("product_description"), F.struct(b.alias("brand"), F.when(k == 2, F.array(L("run"), L("walk"))).alias("sport")).alias("attribute_list"), F.struct(F.when(k == 1, L(0)).otherwise(F.col("meta_id")).alias("standard_price")).alias("pricing_information")))))
made("x43_catalog_product", "slug || '|' || case when k = 0 then '' else name end || '|' || case when k = 2 then 'https://assets.shop-1.com/a/' || slug || '.jpg' else '-' end", lambda g, n, b, k: (lambda m: F.concat_ws("|", m["sku"], m["name"], F.coalesce(m["image_url"], L("-"))))(pages.catalog_product(F.to_json(F.struct(g.alias("product_id"), F.when(k != 0, n).alias("product_name"), F.when(k == 2, F.struct(t("see https://assets.shop-1.com/a/", g, ".jpg now").alias("link"))).alias("image"))))))
made("x44_image_urls", "'https://cdn.shopify.com/s/files/' || slug || '.jpg?v=1,' || case when k = 0 then '' else 'https://cdn.shopify.com/s/files/' || slug || '.png,' end || 'https://cdn.swell.store/x/' || slug || '.webp'", lambda g, n, b, k: F.array_join(pages.image_urls(t('<img src="//cdn.shopify.com/s/files/', g, '_300x.jpg?v=1">', by(k, "", t('{"src":"https:\\/\\/cdn.shopify.com\\/s\\/files\\/', g, '_grande.png"}')), "<a href='http://cdn.swell.store/x/", g, "_{width}x.webp'><img src=\"https://cdn.shopify.com/s/files/Favicon.png\"><img src=\"https://replay.example/web/2019im_/https://cdn.shopify.com/s/files/", g, '_100x100@2x.jpg?v=1">', n)), ","))
made("x45_feed_links", "case when k = 3 then '/self' else 'https://a.example/products/' || slug end", lambda g, n, b, k: F.array_join(pages.feed_links(t('<div>bar</div><feed><link href="/self"/>', F.when(k < 3, t('<entry><link rel="alternate" type="text/html" href="https://a.example/products/', g, '"/><link rel="enclosure" href="/no"/><link rel=\'alternate\' type="application/json" href="/no2"/></entry>')).otherwise(""), "</feed>")), ","))
made("x46_sitemap_locs", "case when k = 0 then '' else 'https://a.example/products/' || slug || ',https://a.example/' || k || '.png' end", lambda g, n, b, k: F.array_join(pages.sitemap_locs(by(k, t("<url>", g, "</url>"), t("<url><loc> https://a.example/products/", g, " </loc><IMAGE:LOC>https://a.example/", k.cast("string"), ".png</IMAGE:LOC></url>"))), ","))
made("x47_product_links", "'/products/' || slug || ',/Products/' || slug || '?x=1' || case when k = 2 then ',/products/' || slug || '-2' else '' end", lambda g, n, b, k: F.array_join(pages.links(t('<a href="/products/', g, '">', "<a HREF='/Products/", g, "?x=1'><a data-url=\"/collections/x\"><a title=\"/products/no\">", F.when(k == 2, t('<i data-product-url="/products/', g, '-2">')).otherwise(""))), ","))
made("x48_feed_body", "case k when 0 then '<feed>' || name when 1 then '<?xml ?><feed>' || name when 2 then '<rss>' || name else 'no feed ' || name end", lambda g, n, b, k: pages.feed_body(by(k, t("<feed>", n), t("<script>bar</script><?xml ?><feed>", n), t("junk\n<rss>", n), t("no feed ", n))))
made("x49_canonical_link", "case when meta_id % 64 = 2 or k = 3 then null else 'https://a.example/products/' || slug end", lambda g, n, b, k: pages.canonical_link(t(F.when(F.col("meta_id") % 64 == 2, F.repeat(L(" "), 65536)).otherwise(""), by(k, t('<link rel="canonical" href="https://a.example/products/', g, '">'), t("<LINK data-x href='https://a.example/products/", g, "' rel='canonical'>"), t('<link media="all" rel="canonical" id="c" href="https://a.example/products/', g, '">'), '<link rel="alternate" href="/no">'))))
made("x51_front_door", "case when k = 0 then 'PARKED' when k = 1 and meta_id % 3 = 0 then 'REDIRECTED' when k = 2 then 'SPA' when meta_id // 4 % 4 = 0 then 'LIVE' when meta_id // 4 % 4 = 1 then 'REDIRECTED' when meta_id // 4 % 4 = 2 then 'DEAD' else 'UNKNOWN' end", lambda g, n, b, k: catalog.front_door(by(k, t(g, " This DOMAIN may be FOR SALE"), "hello", '<div id="app">', "hello"), F.when(k == 1, F.when(F.col("meta_id") % 3 == 0, "https://www.other.example/x").when(F.col("meta_id") % 3 == 1, "https://www.a.example/")), by(F.floor(F.col("meta_id") / 4) % 4, L(200), L(301), L(404), L(None).cast("int")), L("a.example")))
made("f14_valid_content", "case k when 0 then 24 + meta_id % 3 >= 25 when 1 then 999 + meta_id % 3 >= 1000 when 2 then meta_id % 3 > 0 else meta_id % 3 > 0 end", lambda g, n, b, k: pages.valid_content(by(k, F.repeat(L("é"), (24 + F.col("meta_id") % 3).cast("int")), F.repeat(L("a"), (999 + F.col("meta_id") % 3).cast("int")), F.when(F.col("meta_id") % 3 == 0, t("Just a moment", F.repeat(L("b"), 5000))).otherwise(t(F.repeat(L("b"), 5000), "Just a moment")), t("_wm.wombat", F.repeat(L("c"), F.when(F.col("meta_id") % 3 == 0, 9000).otherwise(9990)))), by(k, "structured", "html")))
_FILES = ("sitemap.xml.html", "products_{}.atom.html", "products_4.ATOM.html", "collections_{}.html", "home", "products.json.html", "products_{}.html", "SITEMAP_products_1.XML", "collection_{}_page.html")


def _file(g):
    return by(F.col("meta_id") % 9, *[t("a.example_", *x.split("{}")[:1], g, *x.split("{}")[1:]) if "{}" in x else "a.example.html" if x == "home" else "a.example_" + x for x in _FILES])


made("x13_surface_class", "case meta_id % 9 when 0 then 'sitemap' when 1 then 'unknown' when 2 then 'atom' when 3 then 'collection' when 4 then 'home' when 5 then 'json_api' when 6 then 'unknown' when 7 then 'sitemap' else 'collection' end", lambda g, n, b, k: urls.surface_class(_file(g)))
made("x14_is_surface", "meta_id % 9 in (0, 3, 5, 7)", lambda g, n, b, k: urls.is_surface(_file(g)))
made("x15_slug_of_file", "case when k = 3 then null else slug end", lambda g, n, b, k: urls.slug_of_file(by(k, t("a.example_products_", g, ".html"), t("a.example_products_", g, ".json.html"), t("a.example_products_", g, "_extra.html"), t("a.example_collections_", g, ".html"))))
made("x18_url_of_file", "case k when 0 then 'https://a.example/' when 1 then 'https://a.example/products/' || slug else 'https://a.example/collections/c/products/' || slug end", lambda g, n, b, k: urls.url_of_file(by(k, "a.example.html", t("a.example_products_", g), t("a.example_collections_c_products_", g, ".html"))))
made("x19_product_ref", "case k when 0 then 'https://h.example/products/' || slug || '|' || slug when 1 then 'http://shop.example/collections/c/products/' || slug || '.json|' || slug when 2 then 'https://b.example/products/' || upper(slug) || '|' || slug end", lambda g, n, b, k: (lambda r: F.when(r.isNotNull(), t(r["canonical_url"], "|", r["slug"])))(urls.product_ref(by(k, t("/products/", g, "?variant=1"), t("http://Shop.Example:80/collections/c/products/", g, ".json?x=1#y"), t("https://replay.example/web/2020id_/https://b.example/products/", F.upper(g)), t("https://h.example/pages/", g)), L("h.example"))))
made("x21_clean_filename", "slug || case k when 0 then '.jpg' when 1 then ' a_b.jpg' else '.png' end", lambda g, n, b, k: urls.clean_filename(by(k, t("https://a.example/i/", g, "_400x.jpg?v=1"), t("http://a.example/i/", g, "%20a%3Fb_400x@2x.jpg"), t("https://a.example:80/i/", g, "_grande.png"))))
made("x22_size_stripped", "'https://a.example/' || slug || case k when 0 then '.jpg?v=1' when 1 then '.png' when 2 then '.webp' else '_v2.jpg' end", lambda g, n, b, k: urls.shop_size_stripped(t("https://a.example/", g, by(k, "_1024x1024.jpg?v=1", "_x300.png", "_400x_crop_center@2x.webp", "_v2_grande.jpg"))))
made("x23_flat_filename", "case k when 0 then 'products__' || slug || '.jpg' when 1 then 'files__a__' || slug || '.jpg' when 2 then slug || '.jpg' else '' end", lambda g, n, b, k: urls.flat_filename(by(k, t("https://cdn.example/s/1/products/", g, ".jpg?v=1"), t("https://cdn.example//s//files/a/", g, ".jpg"), t("https://cdn.example/x/", g, ".jpg"), "https://cdn.example/")))
_STEM = "regexp_replace(slug || case meta_id % 6 when 0 then '_Mastered' when 1 then '-final_mix' when 2 then ' vocal master' when 3 then '_finals' when 4 then '.RELEASED' else '' end, '[_.-]+', ' ', 'g')"
_PARTS = " or ".join("regexp_matches(" + _STEM + ", '(?i)" + w + "')" for _, w in urls.STEM_CLASSES)
_stem = lambda g: t(g, by(F.col("meta_id") % 6, "_Mastered", "-final_mix", " vocal master", "_finals", ".RELEASED", ""))
made("x32_master_name", f"regexp_matches({_STEM}, '{urls.MASTER_WORDS}') and not ({_PARTS})", lambda g, n, b, k: urls.looks_like_master(_stem(g)))
_NAMES = ("Audio_01", "Track 3", "untitled", "New.Audio.File-2", "kick-in", "LEAD_vox", "bounce")
made("x33_name_score", f"case meta_id % 8 when 0 then 'generic' when 1 then 'generic' when 2 then 'generic' when 3 then 'generic' when 4 then 'informative' when 5 then 'informative' when 6 then 'ambiguous' else case when {_PARTS.replace(_STEM, 'replace(slug, chr(45), chr(32))')} then 'informative' else 'ambiguous' end end", lambda g, n, b, k: urls.name_score(by(F.col("meta_id") % 8, *_NAMES, g)))
made("x35_archive_name", "case meta_id % 7 when 0 then 'internet_archive' when 1 then 'archive_today' when 2 then 'commoncrawl' when 3 then 'perma_cc' when 4 then 'webcitation' when 5 then slug || '.example' else 'unknown' end", lambda g, n, b, k: urls.archive_name(by(F.col("meta_id") % 7, t("https://web.archive.org/web/1/http://", g), t("http://archive.ph/", g), t("https://index.commoncrawl.org/", g), t("https://perma.cc/", g), t("http://www.webcitation.org/", g), t("https://", g, ".example/web/2020/"), g)))
_HEADS = (("89504E470D0A1A0A", "png"), ("FFD8FFE0", "jpg"), ("474946383961", "gif"), ("49492A00", "tif"), ("4D4D002A", "tif"), ("52494646AAAAAAAA57454250", "webp"), ("52494646AAAAAAAA57415645", "wav"), ("52494646AAAAAAAA00000000", None), ("664C6143", "flac"), ("1A45DFA3", "webm"), ("0000002066747970", "mp4"), ("AA00000000AA66747970", "mp4"), ("4F676753", "ogg"), ("FFF1", "aac"), ("494433", "mp3"), ("3C68746D6C", None))


def _headed(g):
    return F.concat(F.unhex(by(F.col("meta_id") % len(_HEADS), *[h for h, _ in _HEADS])), F.encode(g, "utf-8"))


_OF = f"case meta_id % {len(_HEADS)} " + " ".join(f"when {i} then {repr(f) if f else 'null'}" for i, (_, f) in enumerate(_HEADS)) + " end"
made("x57_magic_format", _OF, lambda g, n, b, k: urls.magic_format(_headed(g)))
made("f15_magic_bytes", f"({_OF}) is not null", lambda g, n, b, k: urls.magic_format(_headed(g)).isNotNull())
made("x58_png_color", "case meta_id % 7 when 0 then 'grayscale' when 2 then 'rgb' when 3 then 'indexed' when 4 then 'grayscale-alpha' when 6 then 'rgba' end", lambda g, n, b, k: urls.png_color_type(F.concat(F.unhex(F.concat(F.when(F.col("meta_id") % 7 == 1, "FFD8FFE000000000").otherwise("89504E470D0A1A0A"), L("0000000D494844520000000000000000080"), (F.col("meta_id") % 7).cast("string"))), F.encode(g, "utf-8"))))
made("x59_output_stem", "case meta_id % 7 when 0 then slug when 1 then slug when 2 then 'hdnux_' || (100 + meta_id) when 3 then 'R-' || meta_id || '-1-2' when 4 then 'media_' || substr(md5('https://a.example/' || slug || '/'), 1, 8) when 5 then slug || '.v2' else 'payload' end", lambda g, n, b, k: urls.output_stem(by(F.col("meta_id") % 7, t("https://a.example/p/", g, ".JPG?x=a/b.png"), t("https://is1-ssl.mzstatic.com/image/thumb/v4/a/", g, ".jpg/10000x10000.png"), t("https://s.hdnux.com/photos/1/2/3/4/", (100 + F.col("meta_id")).cast("string"), "/6/rawImage.jpg"), t("https://i.discogs.com/sig/rs:fit/g:sm/", F.regexp_replace(F.translate(F.base64(F.encode(t("s3://discogs-database-images/R-", F.col("meta_id").cast("string"), "-1-2.jpeg"), "utf-8")), "+/=", "-_"), "^(.{16})(.{16})", "$1/$2/"), ".jpeg?x=1"), t("https://a.example/", g, "/"), t("https://a.example/", g, ".v2.mp4.TIFF"), "https://i.discogs.com/sig/rs:fit/payload.jpeg")))
made("x60_style_keys", "case k when 0 then 'key margin' when 1 then '' when 2 then 'styled_tag,css_template' else 'multi_line_style,key color,key ' || replace(slug, '-', '') end", lambda g, n, b, k: F.array_join(pages.style_findings(by(k, t("<Box style={{ '--space': 1, \"margin\": '", g, "' }}/>"), t("<Box style={{ ...rest, '--", g, "': 1 }} class=\"", g, "\"/>"), t("const B = styled.div`a`; const C = x css`", g, "`"), t("<p :style=\"{ ", F.replace(g, L("-"), L("")), ": 1, --x: 2 }\" style={{[`color`]: 1}}> <b style={{ a: 1,"))), ","))
made("f07_slug_junk", "k in (1, 2) or k = 3 and meta_id % 3 = 0", lambda g, n, b, k: capture.has_junk(by(k, g, t(g, "%22"), t(g, "%3c", n), F.when(F.col("meta_id") % 3 == 0, t(g, "[insert x]")).otherwise(t(g, "%2F")))))
made("f08_slug_valid", "k = 0", lambda g, n, b, k: capture.valid_slug(by(k, g, t(g, ".json"), t("a/", g), "  ")))
made("f12_product_image", "k = 0", lambda g, n, b, k: ~pages.is_chrome(by(k, t(g, "_1.jpg"), t(g, "/Favicon.ico"), t("icon-", g), t(g, "-PLACEHOLDER.png")), pages.NO_PRODUCT))
made("f16_live_cdn", "k in (0, 3)", lambda g, n, b, k: urls.live_cdn(by(k, F.array(L("x"), t("https://cdn.shopify.com/s/", g)), F.array(t("https://web.archive.org/web/1/https://cdn.shopify.com/s/", g), t("https://b.archive.ph/cdn.shopify.com/", g)), F.array(t("https://a.example/", g), L(None).cast("string")), F.array(t("https://notarchive.org/cdn.shopify.com/", g))), (r"cdn[.]shopify[.]com",)))
made("f24_non_master", "case meta_id % 6 when 0 then true when 1 then false when 2 then true when 3 then false when 4 then true end", lambda g, n, b, k: resolve.recipe_of(by(F.col("meta_id") % 6, t("https://i.ebayimg.com/", g, "/s-l500.jpg"), t("https://i.ebayimg.com/", g, "/s-l1600.jpg"), t("https://i.etsystatic.com/", g, "/il_794xN.1.jpg"), t("https://i.etsystatic.com/", g, "/il_fullxfull.1.jpg"), t("https://media-photos.depop.com/", g, "/P1.jpg"), t("https://i.ebayimg.com.evil.example/", g, "/s-l500.jpg")))["non_master"])
made("x54_master_rewrite", "case k when 0 then 'https://i.ebayimg.com/' || slug || '/s-l1600.jpg' when 1 then 'https://i.etsystatic.com/' || slug || '/il_fullxfull.1.jpg' when 2 then 'https://u-mercari-images.mercdn.net/' || slug end", lambda g, n, b, k: resolve.recipe_of(by(k, t("https://i.ebayimg.com/", g, "/s-l500.jpg"), t("https://i.etsystatic.com/", g, "/il_794xN.1.jpg"), t("https://u-mercari-images.mercdn.net/", g, "?1"), t("https://i.ebayimg.com/", g, "/s-l1600.jpg")))["master"])
made("f25_hidden_name", "k in (1, 2)", lambda g, n, b, k: urls.hidden_name(by(k, g, t("_", g), t(".", g), t(g, "_."))))
made("s22_graph_nodes", "name || ',' || brand || case when k = 0 then '' else ',' || slug end", lambda g, n, b, k: F.array_join(F.transform(scalars.graph_nodes(F.from_json(t('{"edges":[{"node":', json(v=n), '},{"node":', json(v=b), "}", by(k, "", t(',{"node":', json(v=g), "}")), "]}"), "edges array<struct<node:struct<v:string>>>")["edges"]), lambda x: x["v"]), ","))
made("s24_schema_enum", "case when k = 0 then null else name || ',' || brand end", lambda g, n, b, k: F.array_join(readers.schema_enum(t('{"properties":{"', by(k, "other", "verdict"), '":{"enum":', F.to_json(F.array(n, b)), "}}}"), "verdict"), ","))
made("s28_fenced_blocks", "case k when 0 then '' when 1 then name || chr(10) else name || chr(10) || brand || chr(10) || '|' || slug || chr(10) end", lambda g, n, b, k: F.array_join(pages.fenced_blocks(by(k, t("```py\n", n, "\n```\n"), t("text\n```sql\n", n, "\n```\n```py\nx\n```\n"), t("```sql title=x\n", n, "\n", b, "\n```\nmore\n```sql\n", g, "\n```")), "sql"), "|"))
made("js3_products_json", "case k when 0 then '' when 1 then slug || '|u,v' else slug || '|;' || slug || '-2|w' end", lambda g, n, b, k: F.array_join(F.transform(pages.products_json(by(k, '{"products":[{"handle":""},{"title":"x"}]}', t('{"products":[{"handle":"/', F.upper(g), '/","images":[{"src":"u"},"v",{"id":1}]}]}'), t('{"products":[{"handle":"', g, '"},{"handle":"', g, '-2","images":["w",""]}]}'))), lambda p: t(p["handle"], "|", F.array_join(p["images"], ","))), ";"))
made("js4_json_escape", "name || chr(34) || chr(92) || chr(10) || brand", lambda g, n, b, k: F.get_json_object(scalars.canonical_json(v=t(n, '"\\\n', b)), "$.v"))
made("ar5_line_ranges", "length(slug) || '-' || length(slug) || ' ' || (length(slug) + 1) || '-' || (length(slug) + 20) || case when k = 0 then ' ?-?' else '' end", lambda g, n, b, k: F.array_join(F.transform(scalars.line_ranges(t(F.length(g).cast("string"), ", ", (F.length(g) + 1).cast("string"), " - ", (F.length(g) + 20).cast("string"), by(k, ",x", ""))), lambda x: t(F.coalesce(x["lo"].cast("string"), L("?")), "-", F.coalesce(x["hi"].cast("string"), L("?")))), " "))
_U = "case k when 0 then 'https://a.example/' || slug || '.jpg' when 1 then 'https://cdn.shopify.com/s/files/' || slug || '.png?v=1' when 2 then 'https://skims.imgix.net/' || slug || '.webp' else 'https://a.example/image/upload/' || slug || '.TIF?x=.y' end"
_probed = lambda g, k: by(k, t("https://a.example/", g, ".jpg"), t("https://cdn.shopify.com/s/files/", g, ".png?v=1"), t("https://skims.imgix.net/", g, ".webp"), t("https://a.example/image/upload/", g, ".TIF?x=.y"))


@R.query("ar7_probe_matrix", f"""with u as (select meta_id, slug, k, {_U} as url from {BASE} p)
 select meta_id, url || case when strpos(url, '?') > 0 then '&' else '?' end || p || '=' || f as probe from u, (values ('fm'), ('format'), ('f'), ('output')) a(p), (values ('tif'), ('png'), ('jpg'), ('webp')) b(f) where k <> 2 and not (k = 1 and f = 'tif')
 union all select meta_id, case k when 0 then 'https://a.example/' || slug || '.' || e else 'https://a.example/image/upload/' || slug || '.' || e || '?x=.y' end from u, (values ('tif'), ('tiff'), ('png'), ('jpg'), ('jpeg')) c(e) where k = 0 or k = 3 and e not in ('tif', 'tiff')""")
def ar7(s, d):
    u = listings(s, d).select("meta_id", _probed(F.col("slug"), F.col("k")).alias("url"))
    return u.select("meta_id", F.explode(F.concat(urls.param_probes(F.col("url")), urls.path_probes(F.col("url")))).alias("probe"))


made("d07_retry_after", "case k when 0 then cast(length(slug) as double) when 1 then 12.0 when 2 then 0.0 end", lambda g, n, b, k: scalars.retry_after(by(k, t(" ", F.length(g).cast("string"), " "), F.date_format(F.timestamp_seconds(F.length(g) * 90_000 + 12), "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.when(F.col("meta_id") % 8 < 4, "-5").otherwise(F.date_format(F.timestamp_seconds(F.length(g) * 90_000 - 12), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")), t("soon ", g)), F.timestamp_seconds(F.length(g) * 90_000)))
made("mp2_lower_keys", "name || '|' || brand", lambda g, n, b, k: (lambda m: t(m[F.lower(t("k", g))], "|", m["other"]))(scalars.lower_keys(F.create_map(F.upper(t("k", g)), L("w"), L("OTHER"), b, F.lower(t("K", g)), n))))


@R.query("f27_expiry", "select cat_id, date_seen < '2020-01-01' as expired from catalog_entry where date_seen is not null")
def f27(s, d):
    return table(s, d, "catalog_entry", "cat_id", "date_seen").filter("date_seen is not null").select("cat_id", (L("2020-01-01") > F.col("date_seen")).alias("expired"))


@R.query("f28_minimum_size", "select fetch_id from fetch_result where size = 0 or size >= 10000")
def f28(s, d):
    return table(s, d, "fetch_result", "fetch_id", "size").filter((F.col("size") == 0) | (F.col("size") >= 10000)).select("fetch_id")


@R.query("f29_catch_all_guard", "select fetch_id from fetch_result where success and size = (select min(size) from fetch_result where success)")
def f29(s, d):
    f = table(s, d, "fetch_result", "fetch_id", "success", "size").filter("success")
    guard = f.agg(F.min("size").alias("g"))  # one row
    return f.crossJoin(F.broadcast(guard)).filter("size = g").select("fetch_id")


@R.query("f30_same_set_as_guard", "select slug, array_to_string(list_sort(list(distinct url_type)), ',') = (select array_to_string(list_sort(list(distinct url_type)), ',') from index_entry where slug = 'gift-card') as same from index_entry where slug is not null group by slug")
def f30(s, d):
    sets = table(s, d, "index_entry", "slug", "url_type").filter("slug is not null").groupBy("slug").agg(F.array_sort(F.collect_set("url_type")).alias("v"))
    guard = sets.filter("slug = 'gift-card'").agg(F.first("v").alias("g"))  # one row
    return sets.crossJoin(F.broadcast(guard)).select("slug", (F.col("v") == F.col("g")).alias("same"))


@R.query("f09_rule_conditions", "select entry_id from index_entry where (url_type <> 'api' or content_type = 'application/json') and (url_type <> 'slug' or content_type in ('text/html', 'TEXT/HTML'))")
def f09(s, d):
    rules = [{"url_type": "api", "require_ctype": "application/json"}, {"url_type": "slug", "require_ctype": ["text/html", "TEXT/HTML"]}, {"url_type": "api", "require_status": "404"}]
    return table(s, d, "index_entry", "entry_id", "url_type", "content_type").filter(capture.meets(F.col("url_type"), L("200"), F.col("content_type"), rules)).select("entry_id")


@R.query("f13_site_chrome", "select cat_id, len(list_filter(images, lambda x: not regexp_matches(lower(x), '_1\\.jpg'))) as n from catalog_entry where images is not null")
def f13(s, d):
    return table(s, d, "catalog_entry", "cat_id", "images").filter("images is not null").select("cat_id", F.size(F.filter("images", lambda x: ~pages.is_chrome(x, ("_1.jpg",)))).alias("n"))


@R.query("j32_sole_owner", "select i as file, min(slug) as owner from (select unnest(images) as i, slug from catalog_entry where slug is not null) t group by i having count(distinct slug) = 1")
def j32(s, d):
    links = table(s, d, "catalog_entry", "images", "slug").filter("slug is not null").select(F.explode("images").alias("url"), F.col("slug").alias("owner"))
    return resolve.sole_owner(links.select(F.col("url").alias("file")).distinct(), links)


@R.query("a36_publish_date", "select cat_id, strftime(to_timestamp(1500000000 + cat_id * 86400) at time zone 'UTC', '%Y-%m-%d') as day from catalog_entry")
def a36(s, d):
    from archivolt.functions.scalars import publish_date

    stamp = lambda k: F.concat(L("https://c.example/a.jpg?v="), (1500000000 + F.col("cat_id") * 86400 + k).cast("string"))
    return table(s, d, "catalog_entry", "cat_id").select("cat_id", publish_date(F.array(stamp(500000), stamp(0), L("https://c.example/b.jpg"))).alias("day"))


@R.query("a32_output_format", "select s_nationkey as g, case when bool_or(s_suppkey % 7 = 0) then 44100 else max(case when s_suppkey % 2 = 0 then 48000 else 96000 end) end as rate, case when bool_or(s_suppkey % 7 = 0) then 16 else least(min(case when s_suppkey % 3 = 0 then 32 else 24 end), 24) end as depth from supplier group by s_nationkey")
def a32(s, d):
    k = F.col("s_suppkey")
    stems = table(s, d, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_nationkey").alias("g"), (k % 7 == 0).alias("is_lossy"), F.when(k % 2 == 0, 48000).otherwise(96000).alias("sample_rate"), F.when(k % 3 == 0, 32).otherwise(24).alias("bit_depth"))
    return groups.output_format(stems, "g").select("g", "rate", "depth")


@R.query("s17_sniffed_columns", "select event_id, event_id % 2 as key_frame from events")
def s17(s, d):
    k = (F.col("event_id") % 2).cast("string")
    lines = table(s, d, "events", "event_id").select(F.when(F.col("event_id") % 3 == 0, F.concat(k, L(",I,"), F.col("event_id").cast("string"), L(".5"))).otherwise(F.concat(F.col("event_id").cast("string"), L(".5,P,"), k)).alias("value"))
    return readers.sniffed_frames(lines).select(F.floor("ts").alias("event_id"), F.col("key_frame").cast("long").alias("key_frame"))


@R.query("s19_sections", "select o_orderkey, o_orderpriority as section from orders")
def s19(s, d):
    o = table(s, d, "orders", "o_orderkey", "o_orderpriority")
    lines = o.select(F.col("o_orderkey").cast("string").alias("path"), F.explode(F.array(F.struct(L(0).alias("n"), F.concat("o_orderpriority", L(":")).alias("v")), F.struct(L(1).alias("n"), F.col("o_orderkey").cast("string").alias("v")))).alias("x")).select("path", "x.n", F.col("x.v").alias("value"))
    return readers.sections(lines, "n", header=r":\s*$").select(F.col("value").cast("long").alias("o_orderkey"), "section")


@R.query("s20_pipe_table", "select 'e' || n_nationkey as esc_id, n_name as target from nation where n_nationkey % 12 + 1 between 1 and 12")
def s20(s, d):
    n = table(s, d, "nation")
    return readers.escape_table(n.select(F.concat(L("| e"), F.col("n_nationkey").cast("string"), L(" | `"), "n_name", L("` | ELA_001 | - | 2030-"), F.lpad((F.col("n_nationkey") % 12 + 1).cast("string"), 2, "0"), L("-01 | why |")).alias("value"))).select("esc_id", "target")


QUERIES, SQL = R.queries, R.sql
