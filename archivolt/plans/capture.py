"""Queries over capture rows; index and fetch log together serve as the raw capture list."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions import resolvers, urls
from archivolt.operators import capture as C
from archivolt.plans._base import Registry, sql
from archivolt.tables import table

R = Registry()
CAPTURES = """(select wayback_url as replay_url, capture_ts as ts, original_url, '200' as status, content_type as mime from index_entry
 union all select wayback_url, capture_ts, original_url, case when success then '200' else coalesce(nullif(regexp_extract(error, '([1-5][0-9][0-9])', 1), ''), '-') end, 'text/html' from fetch_result)"""
BAD = ", ".join(f"'{m}'" for m in urls.BAD_MIMES)
JUNK = "|".join(urls.JUNK)
STATIC = urls.STATIC.replace("(?i)", "")
RULES = [{"path_prefix": "/products/", "url_type": "slug", "require_status": "200", "require_ctype": ["text/html", "application/json"]}, {"path_contains": "/collections/", "url_type": "collection"}]
ERAS = [{"condition": "timestamp_year <= 2012", "era": "early"}, {"condition": "url_type == 'collection'", "era": "grid"}, {"condition": "default", "era": "late"}]


def captures(s: SparkSession, d: str) -> DataFrame:
    return sql(s, d, f"select * from {CAPTURES} c")


@R.query("f01_status_whitelist", f"select replay_url, status from {CAPTURES} c where status in ('200', '404')")
def f01(s, d):
    return captures(s, d).filter(C.good_status(F.col("status"), ("200", "404"))).select("replay_url", "status")


@R.query("f02_mime_blacklist", f"select entry_id, content_type from index_entry where lower(content_type) not in ({BAD}) and lower(content_type) <> 'application/json'")
def f02(s, d):
    return table(s, d, "index_entry", "entry_id", "content_type").filter(~F.lower("content_type").isin(*urls.BAD_MIMES, "application/json"))


@R.query("f03_junk_path", f"select entry_id from index_entry where regexp_matches(original_url, '{JUNK}', 'i')")
def f03(s, d):
    return table(s, d, "index_entry", "entry_id", "original_url").filter(C.is_junk(F.col("original_url"))).select("entry_id")


@R.query("f04_static_extension", f"select entry_id, regexp_matches(split_part(original_url, '?', 1), '{STATIC}', 'i') as static from index_entry where not regexp_matches(split_part(original_url, '?', 1), '{STATIC}', 'i') and original_url like '%.json%'")
def f04(s, d):
    st = C.is_static(F.col("original_url"))
    return table(s, d, "index_entry", "entry_id", "original_url").filter(~st & F.col("original_url").contains(".json")).select("entry_id", st.alias("static"))


@R.query("f05_variant_noise", "select count(*) as n from index_entry where not regexp_matches(original_url, '/variants/[0-9]+/?\\?section_id=store-availability')")
def f05(s, d):
    return table(s, d, "index_entry", "original_url").filter(~F.col("original_url").rlike(urls.VARIANT_NOISE)).agg(F.count("*").alias("n"))


_REASON = f"case when status <> '200' then 'status' when lower(mime) in ({BAD}) then 'mime' when regexp_matches(original_url, '{JUNK}', 'i') then 'junk_path' when regexp_matches(split_part(original_url, '?', 1), '{STATIC}', 'i') then 'static_ext' when regexp_matches(original_url, '/variants/[0-9]+/?\\?section_id=store-availability') then 'variant_noise' end"
_LIST = ", ".join(f"'{p}'" for p in urls.TRACKING)
_QUERY = "array_to_string(list_filter(string_split(substr(original_url, strpos(original_url, '?') + 1), '&'), lambda x: lower(split_part(x, '=', 1)) not in (" + _LIST + ")), '&')"
STRIPPED = f"case when strpos(original_url, '?') = 0 then original_url when {_QUERY} = '' then split_part(original_url, '?', 1) else split_part(original_url, '?', 1) || '?' || {_QUERY} end"
PATH = "lower(coalesce(nullif(regexp_replace(split_part(regexp_replace(original_url, 'https?://[^/]+', '', 'g'), '?', 1), '/+$', ''), ''), '/'))"
TIER = "case when path like '%.oembed' then 0 when path like '%.atom' then 1 when path like '%.json' then 2 when path like '%/collections/%' then 3 when path like '%/products/%' then 4 else 5 end"


@R.query("f06_rejections", f"select coalesce({_REASON}, 'kept') as reason, count(*) as n from {CAPTURES} c group by 1")
def f06(s, d):
    return C.filter_captures(captures(s, d))[1]


@R.query("x01_strip_query", f"select entry_id, {STRIPPED} as clean_url from index_entry")
def x01(s, d):
    return table(s, d, "index_entry", "entry_id", "original_url").select("entry_id", urls.strip_query(F.col("original_url")).alias("clean_url"))


@R.query("x02_canonical_path", f"select entry_id, {PATH} as path from index_entry")
def x02(s, d):
    return table(s, d, "index_entry", "entry_id", "original_url").select("entry_id", urls.canonical_path(F.col("original_url")).alias("path"))


@R.query("x03_value_tier", f"select tier, count(*) as n from (select {TIER} as tier from (select {PATH} as path from index_entry) p) t group by tier")
def x03(s, d):
    p = urls.canonical_path(F.col("original_url"))
    return table(s, d, "index_entry", "original_url").select(urls.value_tier(p).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


_KEPT = f"(select ts, {STRIPPED} as clean_url from {CAPTURES} c where {_REASON} is null)"
_PATHED = f"(select ts, clean_url, {PATH.replace('original_url', 'clean_url')} as path from {_KEPT} k)"


@R.query("a09_best_capture", f"select path, tier, ts, clean_url, n_captures from (select path, {TIER} as tier, ts, clean_url, count(*) over (partition by path) as n_captures, row_number() over (partition by path order by {TIER}, cast(ts as bigint) desc, clean_url) as rn from {_PATHED} p) r where rn = 1")
def a09(s, d):
    return C.best_per_path(C.filter_captures(captures(s, d))[0])


@R.query("o03_tier_then_time", f"select path, tier, ts from (select path, {TIER} as tier, ts, row_number() over (partition by path order by {TIER}, cast(ts as bigint) desc, clean_url) as rn from {_PATHED} p) r where rn = 1 order by tier, ts, path")
def o03(s, d):
    return a09(s, d).select("path", "tier", "ts").orderBy("tier", "ts", "path")


@R.query("m11_reduction", f"select count(*) as total, count(distinct case when {_REASON} is null then {PATH} end) as paths, round(100.0 * (1 - count(distinct case when {_REASON} is null then {PATH} end) / count(*)), 1) as reduction from {CAPTURES} c")
def m11(s, d):
    kept, stats = C.filter_captures(captures(s, d))
    total, paths = stats.agg(F.sum("n").alias("total")), kept.agg(F.countDistinct("path").alias("paths"))
    return total.crossJoin(paths).select("total", "paths", F.round(100 * (1 - F.try_divide(F.col("paths"), F.col("total"))), 1).alias("reduction"))  # one row each


_DECODED = "regexp_replace(coalesce(url_decode(split_part(regexp_replace(original_url, '^[A-Za-z]+://[^/?#]*', ''), '?', 1)), ''), '/+$', '')"


_TYPED = f"""(select replay_url, ts, original_url, status, mime, case when p like '/products/%' then 'slug' when strpos(p, '/collections/') > 0 and strpos(p, '/products/') > 0 then 'collection' end as url_type, trim(case when p like '/products/%' then substr(p, 11) when strpos(p, '/collections/') > 0 and strpos(p, '/products/') > 0 then string_split(p, '/products/')[-1] end) as slug
 from (select *, regexp_replace(url_decode(split_part(split_part(regexp_replace(original_url, '^[A-Za-z]+://[^/?#]*', ''), '#', 1), '?', 1)), '/+$', '') as p from {CAPTURES} c where not regexp_matches(original_url, '{C.DEFAULT_JUNK}')) t)"""


@R.query("a10_product_index", f"""with t as (select * from {_TYPED} x where url_type is not null and slug <> '' and strpos(slug, '.') = 0 and strpos(slug, '/') = 0 and not regexp_matches(slug, '{C.DEFAULT_JUNK}') and (url_type <> 'slug' or status = '200' and mime in ('text/html', 'application/json'))),
 r as (select *, row_number() over (partition by slug order by case url_type when 'slug' then 1 else 2 end, ts, original_url, replay_url, mime) as rn, count(*) over (partition by slug) as n from t)
 select slug, url_type, case when cast(substr(ts, 1, 4) as int) <= 2012 then 'early' when url_type = 'collection' then 'grid' else 'late' end as era, replay_url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(original_url, '\\?.*', '', 'g'), '/+$', ''), '^http://', 'https://'), ':80(/|(\\n?)$)', '\\1', 'g') as original_url, ts, mime as content_type, (select list_sort(list(distinct t.url_type)) from t where t.slug = r.slug) as all_types, n as snapshot_count from r where rn = 1""")
def a10(s, d):
    return C.product_index(captures(s, d), RULES, ERAS)


@R.query("x04_classify", "select entry_id, case when p like '/products/%' then substr(p, 11) when p like '%/collections/%' and p like '%/products/%' then string_split(p, '/products/')[-1] end as slug from (select entry_id, regexp_replace(split_part(regexp_replace(original_url, '^[A-Za-z]+://[^/?#]*', ''), '?', 1), '/+$', '') as p from index_entry) t")
def x04(s, d):
    p = F.regexp_replace(F.substring_index(F.regexp_replace("original_url", "^[A-Za-z]+://[^/?#]*", ""), "?", 1), r"/+\z", "")
    return table(s, d, "index_entry", "entry_id", "original_url").select("entry_id", urls.classify(p, RULES)["slug"].alias("slug"))


@R.query("x05_era", "select entry_id, case when cast(substr(capture_ts, 1, 4) as int) <= 2012 then 'early' when url_type = 'collection' then 'grid' else 'late' end as era from index_entry")
def x05(s, d):
    return table(s, d, "index_entry", "entry_id", "url_type", "capture_ts").select("entry_id", urls.era(F.col("url_type"), F.col("capture_ts"), ERAS).alias("era"))


@R.query("x06_canonical_original", "select entry_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(original_url, '\\?.*', '', 'g'), '/+$', ''), '^http://', 'https://'), ':80(/|(\\n?)$)', '\\1', 'g') as url from index_entry")
def x06(s, d):
    return table(s, d, "index_entry", "entry_id", "original_url").select("entry_id", urls.canonical_original(F.col("original_url")).alias("url"))


@R.query("x07_percent_decode", "select entry_id, url_decode(original_url) || '+%zz' || chr(233) || '/%' as url from index_entry")
def x07(s, d):
    return table(s, d, "index_entry", "entry_id", "original_url").select("entry_id", urls.percent_decoded(F.concat("original_url", F.lit("+%zz%C3%A9%2F%"))).alias("url"))


_HOST = "regexp_replace(lower(regexp_extract(original_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\\.+$', '')"


@R.query("x08_host", f"select {_HOST} as host, count(*) as n from index_entry group by 1")
def x08(s, d):
    return table(s, d, "index_entry", "original_url").groupBy(urls.host(F.col("original_url")).alias("host")).agg(F.count("*").alias("n"))


@R.query("x09_valid_host", "select entity_id, case when regexp_matches(lower(host), '^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*$') then lower(host) end as host from entities")
def x09(s, d):
    return table(s, d, "entities", "entity_id", "host").select("entity_id", urls.valid_host(F.col("host")).alias("host"))


@R.query("x10_apex", "select distinct host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as apex from entities")
def x10(s, d):
    return table(s, d, "entities", "host").distinct().select("host", urls.apex(F.col("host")).alias("apex"))


_HPATH = "regexp_replace(split_part(regexp_replace(original_url, 'https?://[^/]+', '', 'g'), '?', 1), '/+$', '')"


_TAILS = "{0}"
for _x in ("json", "atom", "oembed", "xml"):
    _TAILS = f"regexp_replace({_TAILS}, '\\.{_x}(\\n?)$', '\\1')"


@R.query("x11_handle", f"select entry_id, case when regexp_matches({_HPATH}, '/products/[^/]+') then lower({_TAILS.format(f"regexp_extract({_HPATH}, '/products/([^/]+)', 1)")}) when regexp_matches({_HPATH}, '/collections/[^/]+') then 'collection:' || lower(regexp_extract({_HPATH}, '/collections/([^/]+)', 1)) end as handle from index_entry")
def x11(s, d):
    return table(s, d, "index_entry", "entry_id", "original_url").select("entry_id", urls.handle(F.col("original_url")).alias("handle"))


_LOW = "lower(regexp_replace(original_url, 'https?://[^/]+', '', 'g'))"


@R.query("x12_handle_type", f"select entry_id, case when {_LOW} like '%.oembed' then 'oembed' when {_LOW} like '%.atom' then 'atom_feed' when {_LOW} like '%.json' then 'json_api' when {_LOW} like '%/collections/%' then 'collection' when {_LOW} like '%/products/%' then 'slug' else 'page' end as kind from index_entry")
def x12(s, d):
    return table(s, d, "index_entry", "entry_id", "original_url").select("entry_id", urls.handle_type(F.col("original_url")).alias("kind"))


@R.query("x16_replay_parts", "select entry_id, regexp_extract(wayback_url, '^https?://[^/]+/web/([0-9]+)(?:id_|im_|if_)?/(https?://.+)', 1) as ts, regexp_extract(wayback_url, '^https?://[^/]+/web/([0-9]+)(?:id_|im_|if_)?/(https?://.+)', 2) as original from index_entry where regexp_matches(wayback_url, '^https?://[^/]+/web/[0-9]+(?:id_|im_|if_)?/https?://.+')")
def x16(s, d):
    return table(s, d, "index_entry", "entry_id", "wayback_url").select("entry_id", urls.replay_parts(F.col("wayback_url")).alias("p")).filter("p is not null").select("entry_id", "p.ts", "p.original")


_S = "regexp_replace(regexp_replace(original_url, 'https?://', '', 'g'), '[<>:\"/\\\\|?*]', '_', 'g')"


@R.query("x17_safe_filename", f"select entry_id, case when length({_S}) > 60 then substr({_S}, 1, 51) || '_' || substr(md5(original_url), 1, 8) else {_S} end || '.html' as name from index_entry")
def x17(s, d):
    return table(s, d, "index_entry", "entry_id", "original_url").select("entry_id", urls.safe_filename(F.col("original_url"), 60).alias("name"))


@R.query("x50_fetch_tier", "select fetch_id, case when regexp_matches(p, '\\.(oembed|atom|json)$') then 'structured' when p like '%/products/%' then 'html' when p like '%/collections/%' then 'collection' else 'homepage' end as tier from (select fetch_id, lower(split_part(regexp_replace(original_url, 'https?://[^/]+', '', 'g'), '?', 1)) as p from fetch_result) t")
def x50(s, d):
    return table(s, d, "fetch_result", "fetch_id", "original_url").select("fetch_id", urls.fetch_tier(F.col("original_url")).alias("tier"))


@R.query("x53_strip_params", "select entry_id, case when strpos(original_url, '?') = 0 then original_url when q = '' then split_part(original_url, '?', 1) else split_part(original_url, '?', 1) || '?' || q end as url from (select entry_id, original_url, array_to_string(list_filter(string_split(substr(original_url, strpos(original_url, '?') + 1), '&'), lambda x: split_part(x, '=', 1) not in ('page', 'size')), '&') as q from index_entry) t")
def x53(s, d):
    return table(s, d, "index_entry", "entry_id", "original_url").select("entry_id", urls.strip_params(F.col("original_url"), ("page", "size")).alias("url"))


@R.query("a11_all_snapshots", f"select slug, row_number() over (partition by slug order by ts, replay_url) as nth, ts, replay_url from (select trim(slug) as slug, ts, replay_url from (select case when p like '/products/%' then substr(p, 11) when p like '/product/%' then substr(p, 10) when strpos(p, '/collections/') > 0 and strpos(p, '/products/') > 0 then string_split(p, '/products/')[-1] end as slug, ts, replay_url from (select *, regexp_replace(url_decode(split_part(split_part(regexp_replace(original_url, '^[A-Za-z]+://[^/?#]*', ''), '#', 1), '?', 1)), '/+$', '') as p from {CAPTURES} c where status = '200' and mime = 'text/html') t) u where slug <> '' and strpos(slug, '.') = 0 and strpos(slug, '/') = 0) v where slug in (select slug from product_metadata)")
def a11(s, d):
    return C.all_snapshots(captures(s, d), table(s, d, "product_metadata", "slug"))


@R.query("a12_latest_wins", "select original_url, capture_ts, fetch_id from fetch_result qualify row_number() over (partition by original_url order by capture_ts desc, fetch_id) = 1")
def a12(s, d):
    from archivolt.operators.ledger import last_per_key

    f = table(s, d, "fetch_result", "original_url", "capture_ts", "fetch_id")
    return last_per_key(f, ["original_url"], [F.col("capture_ts"), -F.col("fetch_id")])


@R.query("a14_sorted_set", "select slug, array_to_string(list_sort(list(distinct url_type)), ',') as types from index_entry group by slug")
def a14(s, d):
    return table(s, d, "index_entry", "slug", "url_type").groupBy("slug").agg(F.array_join(F.array_sort(F.collect_set("url_type")), ",").alias("types"))


@R.query("a25_two_level_census", "select seg, count(*) as n from (select unnest([list_slice(p, 1, 1), list_slice(p, 1, 2)]) as l, array_to_string(l, '/') as seg from (select list_filter(string_split(" + _HPATH + ", '/'), lambda x: x <> '') as p from index_entry) t) u group by seg")
def a25(s, d):
    parts = F.filter(F.split(F.regexp_replace(F.substring_index(F.regexp_replace("original_url", "https?://[^/]+", ""), "?", 1), r"/+\z", ""), "/"), lambda x: x != "")
    return table(s, d, "index_entry", "original_url").select(F.explode(F.array(F.array_join(F.slice(parts, 1, 1), "/"), F.array_join(F.slice(parts, 1, 2), "/"))).alias("seg")).groupBy("seg").agg(F.count("*").alias("n"))


# pages of each ledger host, as captures
_HOSTED = """(select 'w' || entity_id as replay_url, cast(20100000 + entity_id as varchar) as ts, 'https://' || host || case entity_id % 8 when 0 then '' when 1 then '/collections/c%20' || entity_id % 50 || '/?page=' || entity_id when 2 then '/products.json?limit=250' when 3 then '/live//' when 4 then '/products/x' when 5 then '/collections/wpm@1' when 6 then '/a/__data.json#top' else '/about' end as original_url,
 '200' as status, case when entity_id % 5 = 0 then 'image/png' when entity_id % 2 = 0 then 'text/html; charset=utf-8' else 'application/json' end as mime from entities)"""


@R.query("f10_content_pages", f"select page, row_number() over (partition by page order by ts, replay_url) as nth, ts, replay_url from (select lower(regexp_extract(original_url, '^https://([^/?#]*)', 1)) || p as page, ts, replay_url from (select *, coalesce(nullif(regexp_replace(replace(split_part(split_part(regexp_replace(original_url, '^https://[^/?#]*', ''), '#', 1), '?', 1), '%20', ' '), '/+$', ''), ''), '/') as p from {_HOSTED} h) t where mime <> 'image/png' and (p in ('/', '/live') or p like '/collections/c %' or p in ('/products.json', '/a/__data.json'))) u")
def f10(s, d):
    return C.content_pages(sql(s, d, f"select * from {_HOSTED.replace('varchar', 'string')} h"))


@R.query("f11_labelled", "select label, count(*) as n from (select case when original_url like '%/collections/all%' then 'all' when original_url like '%/collections/outlet%' then 'outlet' end as label from index_entry) t where label is not null group by label")
def f11(s, d):
    rows = sql(s, d, "select wayback_url as replay_url, capture_ts as ts, original_url, '200' as status from index_entry")
    return C.api_captures(rows, ["/collections/all", "/collections/outlet"]).groupBy("label").agg(F.count("*").alias("n"))


@R.query("r00_resolver_dispatch", """with i as (select cat_id, unnest(images) as i from catalog_entry), u as (select cat_id, i, unnest(['https://cdn.shopify.com/s/files/1/0001/products/', 'https://x.imgix.net/', 'https://media.shop.com/photos/1/master/w_1/', 'https://i0.wp.com/a.com/wp-content/uploads/', 'https://res.cloudinary.com/d/image/upload/w_200,c_fill/', 'https://ucarecdn.com/u/-/resize/']) as h from i)
 select cat_id, h || i || '?w=200&h=100' as url, case when h like '%shopify%' then 'r35' when h like '%imgix%' then 'r29' when h like '%media.shop%' then 'r12' when h like '%wp.com%' then 'r05' when h like '%cloudinary%' then 'r20' else 'r21' end as resolver,
 case when h like '%shopify%' then h || i || '?format=png' when h like '%imgix%' then h || i when h like '%media.shop%' then 'https://media.shop.com/photos/1/master/pass/' || i || '?w=200&h=100' when h like '%wp.com%' then 'https://a.com/wp-content/uploads/' || i when h like '%cloudinary%' then 'https://res.cloudinary.com/d/image/upload/' || i || case when regexp_matches(lower(i), '[.](jpg|jpeg|png|tif|tiff|webp|gif|avif|heic)$') then '' else '.png' end || '?w=200&h=100' else 'https://ucarecdn.com/u' end as master from u""")
def r00(s, d):
    """All resolvers over the image addresses that the catalogue's file names make under the services' paths."""
    hosts = F.array(*[F.lit(h) for h in ("https://cdn.shopify.com/s/files/1/0001/products/", "https://x.imgix.net/", "https://media.shop.com/photos/1/master/w_1/", "https://i0.wp.com/a.com/wp-content/uploads/", "https://res.cloudinary.com/d/image/upload/w_200,c_fill/", "https://ucarecdn.com/u/-/resize/")])
    rows = table(s, d, "catalog_entry", "cat_id", "images").select("cat_id", F.explode("images").alias("image")).select("cat_id", F.explode(F.transform(hosts, lambda h: F.concat(h, F.col("image"), F.lit("?w=200&h=100")))).alias("url"))
    return rows.select("cat_id", "url", resolvers.resolved(F.col("url")).alias("r")).select("cat_id", "url", "r.resolver", "r.master")


QUERIES, SQL = R.queries, R.sql
