import pytest
from pyspark.sql import functions as F

from archivolt.functions import pages, resolvers, scalars, urls

UUID = "0a1b2c3d-0000-1111-2222-333344445555"


def value(spark, c):
    v = spark.range(1).select(c.alias("v")).head()["v"]
    return v.asDict(recursive=True) if hasattr(v, "asDict") else v


@pytest.mark.parametrize("f, given, wanted", [
    (urls.strip_query, "http://a/b?variant=1&x=2", "http://a/b?x=2"), (urls.strip_query, "http://a/b?ref=1", "http://a/b"), (urls.strip_query, "http://a/b?EV=1&ref=2", "http://a/b?EV=1"), (urls.strip_query, "http://a/b", "http://a/b"),
    (urls.canonical_path, "https://a.com/Products/X/?q=1", "/products/x"), (urls.canonical_path, "https://a.com", "/"), (urls.canonical_original, "http://a.com:80/x/?y", "https://a.com/x"),
    (urls.host, "https://u@Shop.A.com.:443/x", "shop.a.com"), (urls.valid_host, "Shop.A.com/x", "shop.a.com"), (urls.valid_host, "bad_host", None), (urls.valid_host, "", None),
    (urls.apex, "shop.a.co.uk", "a.co.uk"), (urls.apex, "x.y.a.com", "a.com"), (urls.apex, "b.myshopify.com", "b.myshopify.com"), (urls.apex, "a.com", "a.com"),
    (urls.handle, "https://a.com/products/Tee.json?x", "tee"), (urls.handle, "https://a.com/collections/All/", "collection:all"), (urls.handle, "https://a.com/about", None),
    (urls.handle_type, "https://a.com/collections/x/products/y.atom", "atom_feed"), (urls.surface_class, "a.com_products_2.atom", "atom"), (urls.surface_class, "a.com_products_tee.atom.html", "unknown"), (urls.surface_class, "a.com_sitemap_products_1.xml", "sitemap"),
    (urls.surface_class, "a.com_products.json", "json_api"), (urls.surface_class, "a.com_collections_all", "collection"), (urls.surface_class, "a.com.html", "home"), (urls.slug_of_file, "a.com_products_tee.html", "tee"), (urls.slug_of_file, "a.com_collections_all.atom.html", None),
    (urls.safe_filename, "https://a.com/x?y", "a.com_x_y.html"), (urls.image_key, f"http://a/b_400x.jpg?v=1", "https://a/b.jpg"), (urls.image_key, f"https://a/b_grande_{UUID}.jpg", "https://a/b_grande.jpg"), (urls.image_key, "https://a:80/b_large.jpg", "https://a/b.jpg"),
    (urls.image_stem, f"https://a/C_{UUID}_800x600@2x.JPG", "c"), (urls.match_key, " Adidas Super Star! ", "super-star"), (urls.slug_match_key, "tee-black-2", "tee-black"), (urls.slug_match_key, "tee-2019", "tee"),
    (urls.image_angle, "X-FRONT-M", "front"), (urls.image_model, "471-FRONT-M.png", "male"), (urls.image_model, "471_M-BLACK", None), (urls.image_model, "x-FEMALE", "female"), (urls.image_model, "FLEECE", None),
    (urls.stem_class, "Lead_Vox-2", "vocal"), (urls.stem_class, "guitars", "other"), (urls.looks_like_master, "Song_Final_Mix", True), (urls.looks_like_master, "vocal_master", False), (urls.name_score, "Audio 01", "generic"), (urls.name_score, "kick in", "informative"), (urls.name_score, "thing", "ambiguous"),
    (urls.percent_decoded, "a%2Fb+c", "a/b+c"), (urls.percent_decoded, "a%zz", "a%zz"), (urls.core_name, "Tee (black) [x]", "Tee"), (urls.format_of, "IMAGE/PNG; q=1", "png"), (urls.url_of_file, "a.com_x_y.html", "https://a.com/x/y"), (urls.slugify, "A b", "a-b"), (urls.apex, "x.shop.com.br", "shop.com.br"),
])
def test_urls(spark, f, given, wanted):
    assert value(spark, f(F.lit(given))) == wanted


def test_more_urls(spark):
    assert value(spark, urls.replay_parts(F.lit("https://r.example/web/2020id_/https://a.com/products/x"))) == {"ts": "2020", "original": "https://a.com/products/x", "tier": "html"}
    assert value(spark, urls.product_ref(F.lit("/products/Foo.json"), F.lit("h.com"))) == {"canonical_url": "https://h.com/products/Foo.json", "host": "h.com", "slug": "foo"}
    assert value(spark, urls.product_ref(F.lit("/products/foo"), F.lit(None).cast("string"))) is None
    assert value(spark, urls.dirname(F.lit("Red Tee"), F.lit("2019"), F.lit("red-tee-xl"))) == "2019 Red Tee [xl]"
    assert value(spark, urls.api_match_key(F.lit("Tee Kids"), F.lit(None).cast("string"))) == "tee"
    assert value(spark, urls.fetch_failure(F.lit("separate issue"))) == {"failure_class": "throttle", "code": 429}
    rules = [{"path_prefix": "/products/", "url_type": "slug"}, {"path_contains": "/collections/*", "url_type": "collection"}]
    assert value(spark, urls.classify(F.lit("/collections/a/products/x/"), rules)) == {"slug": "x", "url_type": "collection"}
    assert value(spark, urls.era(F.lit("slug"), F.lit("20"), [{"condition": "timestamp_year >= 2020", "era": "new"}])) == "new"
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + bytes(9) + b"\x03"
    assert value(spark, urls.magic_format(F.lit(png))) == "png" and value(spark, urls.png_color_type(F.lit(png))) == "indexed"


@pytest.mark.parametrize("given, name, wanted", [
    ("https://a.com/_next/image?url=%2Fi%2Fx.jpg&w=1", "r01", "https://a.com/i/x.jpg"), ("https://i0.wp.com/a.com/x.jpg?w=1", "r05", "https://a.com/x.jpg"), ("https://a.com/wp-content/uploads/x-300x200.jpg", "r07", "https://a.com/wp-content/uploads/x.jpg"), ("https://a.com/cdn-cgi/image/w=1/x.jpg", "r08", "https://a.com/x.jpg"),
    ("https://lh3.googleusercontent.com/ab=w20", "r13", "https://lh3.googleusercontent.com/ab=s0"), ("https://pbs.twimg.com/media/a?format=jpg&name=small", "r14", "https://pbs.twimg.com/media/a?format=jpg&name=orig"), ("https://i.pinimg.com/236x/a/b.jpg", "r15", "https://i.pinimg.com/originals/a/b.jpg"), ("https://preview.redd.it/some-title-v0-abcdefgh1.jpg?w=1", "r16", "https://i.redd.it/abcdefgh1.jpg"),
    ("https://res.x/image/upload/w_200,c_fill/v1/a", "r20", "https://res.x/image/upload/v1/a.png"), ("https://ucarecdn.com/u/-/resize/", "r21", "https://ucarecdn.com/u"), ("https://x.imgix.net/a.jpg?w=1", "r29", "https://x.imgix.net/a.jpg"), ("https://cdn.shopify.com/s/files/1/a_20x20.jpg?v=3", "r35", "https://cdn.shopify.com/s/files/1/a.jpg?v=3&format=png"),
    ("https://static1.squarespace.com/a?format=100w", "r46", "https://static1.squarespace.com/a?format=original"), ("https://a.com/x.jpg?q=1", "r49", "https://a.com/x.jpg"), ("https://a.com/x.jpg", None, None), ("https://i.imgur.com/abcs.jpg", "r25", "https://i.imgur.com/abc.jpg"),
])
def test_resolvers(spark, given, name, wanted):
    v = value(spark, resolvers.resolved(F.lit(given)))
    assert v == (None if name is None else {"resolver": name, "master": wanted})


def test_scalars(spark):
    assert value(spark, scalars.retry_after(F.lit("-5"), F.current_timestamp())) == 0.0
    assert value(spark, scalars.retry_after(F.lit("Wed, 21 Oct 2015 07:28:10 GMT"), F.lit("2015-10-21 07:28:00").cast("timestamp"))) == 10.0
    assert value(spark, scalars.sane_month_day(F.lit("2020-02-30"))) and not value(spark, scalars.sane_month_day(F.lit("2020-13-01")))
    assert value(spark, scalars.standard_rate(scalars.rational(F.lit("60000/1001")))) == "60000/1001"
    assert value(spark, scalars.hex_channels(F.lit("#0aff10"))) == [10, 255, 16]
    assert value(spark, scalars.publish_date(F.array(F.lit("x?v=1500000000"), F.lit("y")))) == "2017-07-14"
    assert [tuple(r) for r in value(spark, scalars.line_ranges(F.lit("9, 10-12")))] == [(9, 9), (10, 12)]
    assert value(spark, scalars.lower_keys(F.create_map(F.lit("A"), F.lit(1), F.lit("a"), F.lit(2)))) == {"a": 2}
    assert value(spark, scalars.merged_maps(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2)))) == {"a": 2}
    left, right = (value(spark, F.round(c, 3)) for c in scalars.pan_coefficients(F.lit(5.0)))
    assert (left, right) == (0.0, 1.001)


PAGE = '<title>T</title><meta property="og:title" content="Tee &amp; Co"><meta property="og:price:amount" content="9"><div class="rte">a<br/> b&eacute; <b>c</b>\n\n</div><option value="1"> XL </option><option v="2">XL</option><option v="3">---</option><a href="/products/x">x</a><link rel="canonical" href="https://a/p"><img src="//cdn.shopify.com/s/a_200x.jpg?v=1"><img src="https://cdn.shopify.com/s/favicon.png">'


def test_pages(spark):
    m = value(spark, pages.shop_metadata(F.lit(PAGE)))
    assert (m["name"], m["price"], m["currency"], m["description"], m["sizes"]) == ("Tee & Co", "9", "USD", "a\nbé c", "XL")
    assert value(spark, pages.links(F.lit(PAGE))) == ["/products/x"] and value(spark, pages.canonical_link(F.lit(PAGE))) == "https://a/p"
    assert value(spark, pages.image_urls(F.lit(PAGE))) == ["https://cdn.shopify.com/s/a.jpg?v=1"]
    feed = '<div>bar</div><?xml version="1.0"?><feed><link href="/self"/><entry><link rel="alternate" type="text/html" href="/products/a"/><link rel="self" href="/no"/></entry></feed>'
    assert value(spark, pages.feed_links(F.lit(feed))) == ["/products/a"]
    assert value(spark, pages.feed_links(F.lit('<link href="/products/z">'))) == ["/products/z"]
    assert value(spark, pages.sitemap_locs(F.lit("<loc> a </loc><image:loc>b</image:loc>"))) == ["a", "b"]
    doc = '{"products":[{"handle":"/A/","images":[{"src":"u"},"v"]},{"handle":""}]}'
    assert [tuple(r) for r in value(spark, pages.products_json(F.lit(doc)))] == [("a", ["u", "v"])]
    assert value(spark, pages.api_metadata(F.lit('[{"id":"K1","attribute_list":{"color":"red","sport":["run","gym"]},"pricing_information":{"standard_price":5}}]')))["sport"] == "run, gym"
    assert value(spark, pages.api_metadata(F.lit('"text"'))) is None
    assert not value(spark, pages.valid_content(F.lit("x" * 999), F.lit("html"))) and value(spark, pages.valid_content(F.lit("x" * 60), F.lit("structured")))
    assert value(spark, pages.fenced_blocks(F.lit("```sql\nselect 1\n```\n"), "sql")) == ["select 1\n"]


@pytest.mark.parametrize("query, module, function", [("ar5_line_ranges", scalars, "line_ranges"), ("d07_retry_after", scalars, "retry_after"), ("mp2_lower_keys", scalars, "lower_keys"), ("x35_archive_name", urls, "archive_name")])
def test_queries_reach_their_function(spark, monkeypatch, query, module, function):
    from archivolt.plans.pages import QUERIES

    got = QUERIES[query](spark, "/root/testdata/sf0.001")
    assert len({r["value"] for r in got.collect()}) > 1  # the values vary by row; the SQL says what each must be
    monkeypatch.setattr(module, function, lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        QUERIES[query](spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("given, wanted", [("https://web.archive.org/web/1/http://x", "internet_archive"), ("http://archive.ph/a", "archive_today"), ("https://archive.today/a", "archive_today"), ("https://data.commoncrawl.org/x", "commoncrawl"), ("https://perma.cc/A", "perma_cc"), ("https://www.webcitation.org/5", "webcitation"), ("https://a.example:80/x", "a.example:80"), ("ftp://a.example", "unknown"), ("", "unknown")])
def test_archive_name(spark, given, wanted):
    assert value(spark, urls.archive_name(F.lit(given))) == wanted


def test_more_functions(spark):
    one = spark.range(1)
    first = lambda c: one.select(c).first()[0]
    assert first(pages.unescaped(F.lit("&amp;lt; &#233;&#xE9; &#0; &#x110000; &zz;"))) == "&lt; éé &#0; &#x110000; &zz;"
    assert first(scalars.retry_after(F.lit("soon"), F.current_timestamp())) is None and first(scalars.retry_after(F.lit("-3"), F.current_timestamp())) == 0
    assert first(urls.output_stem(F.lit("https://a.example/x.png.JPG"))) == "x.png" and first(urls.output_stem(F.lit("https://a.example/x.jpg.png"))) == "x"
    assert first(urls.output_stem(F.lit("https://i.discogs.com/s/rs:fit/broken.jpeg"))) == "broken.jpeg".removesuffix(".jpeg")
    assert first(pages.style_findings(F.lit("<p class=\"a w-[3px]\" style={{ \"--a\": 1, b: 2, ...c }}>"))) == ["arbitrary_value", "key b"]
    assert first(urls.live_cdn(F.array(F.lit(None).cast("string")), ("x",))) is False
    assert first(urls.percent_decoded(F.lit("%41%zz%"))) == "A%zz%"
    nothing = F.lit(None).cast("string")
    assert first(urls.output_stem(nothing)) is None and first(pages.style_findings(nothing)) is None and first(urls.proxied_source(nothing)) is None
