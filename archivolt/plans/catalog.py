"""Queries of resolution, catalogue integrity, group rules and rankings on the driver's tables."""

from pyspark.sql import functions as F

from archivolt.functions import urls
from archivolt.operators import capture as C
from archivolt.operators import catalog as K
from archivolt.operators import groups as G
from archivolt.operators import resolve as V
from archivolt.plans._base import Registry, sql
from archivolt.plans.functions import DIRNAME, _TAIL
from archivolt.tables import table

R = Registry()
both = R.both


def _keys(s, d):
    """Slugs of the catalogue and brand products as keyed rows."""
    slugs = table(s, d, "product_metadata", "meta_id", "slug").select("slug", F.col("meta_id").alias("ordinal"))
    skus = table(s, d, "sku_product", "sku", "name", "color")
    return slugs, skus


_MK = "regexp_replace(trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-'), '^adidas-', '')"
_SK = "regexp_replace(regexp_replace(regexp_replace(lower(slug), '^adidas-', ''), '-[0-9]{4}$', ''), '-[0-9]$', '')"
_AK = "regexp_replace(regexp_replace(regexp_replace(" + _MK.format("concat_ws(' ', name, nullif(color, ''))") + ", '-adults?$', ''), '-infants?$', ''), '-kids?$', '')"


@R.query("x25_match_keys", f"select sku, {_AK} as key from sku_product")
def x25(s, d):
    return table(s, d, "sku_product", "sku", "name", "color").select("sku", urls.api_match_key(F.col("name"), F.col("color")).alias("key"))


@R.query("j14_exact_key", f"select slug, max(sku) as sku from (select {_SK.replace('slug', 'case_slug')} as key, arg_max(case_slug, id) as slug from (select regexp_replace(slug, '-[a-z0-9]+$', '') as case_slug, meta_id as id from product_metadata) p group by 1) l join (select sku, {_AK} as key from sku_product) r using (key) group by slug")
def j14(s, d):
    slugs, skus = _keys(s, d)
    return V.exact_keys(slugs.withColumn("slug", F.regexp_replace("slug", "-[a-z0-9]+$", "")), skus)


@R.query("j15_containment", f"select p.slug as lid, s.sku as rid from (select slug, {_SK} as key from product_metadata where slug is not null group by slug) p join (select sku, {_AK} as key from sku_product) s on s.key <> '' and p.key <> '' and (strpos(p.key, s.key) > 0 or strpos(s.key, p.key) > 0)")
def j15(s, d):
    slugs, skus = _keys(s, d)
    left = slugs.select("slug").distinct().select(F.col("slug").alias("id"), urls.slug_match_key(F.col("slug")).alias("key"))
    right = skus.select(F.col("sku").alias("id"), urls.api_match_key(F.col("name"), F.col("color")).alias("key"))
    return V.contained(left, right)


@R.query("j16_name_and_color", f"select distinct p.slug, s.sku from product_metadata p join (select sku, color, {_MK.format('trim(name)')} as n, {_MK.format('trim(color)')} as c from sku_product) s on s.n <> '' and s.color <> '' and strpos({_SK.replace('slug', 'p.slug')}, s.n) > 0 and strpos({_SK.replace('slug', 'p.slug')}, s.c) > 0")
def j16(s, d):
    slugs, skus = _keys(s, d)
    return V.name_and_color(slugs.select("slug").distinct(), skus)


# a serial loop over the products, as a recursive query
_SERIAL = f"""with recursive f as (select slug, min(meta_id) as pos from product_metadata where slug <> '' group by slug), k as (select {_SK} as key, arg_max(slug, pos) as slug, min(pos) as pos from f group by 1),
 p as (select sku, {_AK} as api, {_MK.format("trim(coalesce(name, ''))")} as n, {_MK.format("trim(coalesce(color, ''))")} as c, coalesce(color, '') <> '' as colored from sku_product),
 fits as (select p.sku, k.slug, k.pos, case when p.api = k.key then 1 when p.api <> '' and k.key <> '' and (strpos(k.key, p.api) > 0 or strpos(p.api, k.key) > 0) then 2 when p.colored and p.n <> '' and strpos(k.key, p.n) > 0 and strpos(k.key, p.c) > 0 then 3 end as strategy from p, k),
 pairs as (select *, strategy * 1000000000000 + pos as rank from fits where strategy is not null and (strategy = 1 or sku not in (select sku from fits where strategy = 1))),
 s as (select sku, row_number() over (order by sku) as i from p),
 step as (select 0::bigint as i, ''::varchar as sku, null::varchar as slug, 0::bigint as rank, []::varchar[] as taken
  union all select st.i + 1, any_value(s.sku), arg_min(q.slug, q.rank), min(q.rank), list_append(any_value(st.taken), coalesce(arg_min(q.slug, q.rank), '')) from step st join s on s.i = st.i + 1 left join pairs q on q.sku = s.sku and (q.strategy = 1 or not list_contains(st.taken, q.slug)) group by st.i)
 select slug, arg_max(sku, i) as sku, cast(arg_max(rank, i) // 1000000000000 as int) as strategy from step where slug is not null group by slug"""


@R.query("j17_greedy_assignment", _SERIAL)
def j17(s, d):
    return V.match_products(*_keys(s, d))


@R.query("j18_token_match", """with l as (select sku as lid, unnest(list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+'))) as t from sku_product), r as (select slug as rid, unnest(list_distinct(regexp_extract_all(lower(slug), '[a-z0-9]+'))) as t from (select distinct slug from catalog_entry where slug is not null) c),
 nl as (select lid, count(*) as n from l group by lid), nr as (select rid, count(*) as n from r group by rid),
 g as (select l.lid, r.rid, count(*) as shared, max(length(l.t)) as longest from l join r on l.t = r.t group by l.lid, r.rid),
 sc as (select g.lid, g.rid, shared / (nl.n + nr.n - shared) as score, longest from g join nl using (lid) join nr using (rid))
 select lid, rid, round(score, 6) as score from (select *, row_number() over (partition by lid order by score desc, rid) as rn from sc where longest >= 5 or score >= 0.6) z where rn = 1""")
def j18(s, d):
    left = table(s, d, "sku_product", "sku", "name").select(F.col("sku").alias("id"), F.col("name").alias("key"))
    right = table(s, d, "catalog_entry", "slug").filter("slug is not null").distinct().select(F.col("slug").alias("id"), F.col("slug").alias("key"))
    return V.token_matches(left, right)


@R.query("j19_edit_ratio")
def j19(s, d):
    """Brands in one spelling against brands in another."""
    b = table(s, d, "catalog_entry", "brand").filter("brand is not null").distinct()
    good = table(s, d, "sku_product", "brand").filter("brand is not null").distinct()
    return V.close_matches(b.select(F.col("brand").alias("id"), F.lower("brand").alias("key")), good.select(F.col("brand").alias("id"), F.lower("brand").alias("key")))


@R.query("j20_attribution_cascade")
def j20(s, d):
    """All six stages: the catalogue's images against its slugs, with the codes that the listings give."""
    images = table(s, d, "catalog_entry", "images").select(F.explode("images").alias("image")).distinct()
    codes = V.sku_to_slug(table(s, d, "product_metadata").select("sku", "matched_sku", "slug", F.col("meta_id").alias("ordinal")))
    return V.attribute_images(images, table(s, d, "catalog_entry", "slug").filter("slug is not null"), codes)


@R.query("j38_attribution_counts")
def j38(s, d):
    return j20(s, d).groupBy("stage").agg(F.count("*").alias("n"))


@R.query("j21_first_wins", "select upper(trim(coalesce(nullif(sku, ''), matched_sku))) as sku, arg_min(slug, meta_id) as slug from product_metadata where upper(trim(coalesce(nullif(sku, ''), matched_sku))) <> '' group by 1")
def j21(s, d):
    return V.sku_to_slug(table(s, d, "product_metadata").select("sku", "matched_sku", "slug", F.col("meta_id").alias("ordinal")))


@R.query("j12_directory_map", f"select dir, arg_max(slug, meta_id) as slug from (select meta_id, slug, {DIRNAME} as dir from {_TAIL} product_metadata m) t where slug is not null) x where dir is not null group by dir")
def j12(s, d):
    return V.directory_map(table(s, d, "product_metadata").select("name", "slug", F.col("date_seen").alias("date"), F.col("meta_id").alias("ordinal")).filter("slug is not null"))


@R.query("j22_shared_citation", "select key, value, array_to_string(list_sort(list(distinct slug)), ',') as owners from (select slug, 'matched_sku' as key, matched_sku as value from product_metadata union all select slug, 'sku', sku from product_metadata union all select slug, 'tag', unnest(tags) from product_metadata) t where value is not null group by key, value having count(distinct slug) > 1")
def j22(s, d):
    m = table(s, d, "product_metadata", "slug", "sku", "matched_sku", "tags")
    each = F.concat(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in ("sku", "matched_sku")]), F.coalesce(F.transform("tags", lambda t: F.struct(F.lit("tag").alias("key"), t.alias("value"))), F.array().cast("array<struct<key:string,value:string>>")))
    rows = m.select("slug", F.explode(each).alias("c")).select("slug", "c.key", "c.value")
    return K.shared_values(rows, "slug", "key", "value").select("key", "value", F.array_join("owners", ",").alias("owners"))


@R.query("j23_identical_content", "select md5(text) as value, array_to_string(list_sort(list(distinct doc_id)), ',') as owners from documents where text is not null group by 1 having count(distinct doc_id) > 1")
def j23(s, d):
    t = table(s, d, "documents", "doc_id", "text").select("doc_id", F.lit("md5").alias("key"), F.md5("text").alias("value"))
    return K.shared_values(t, "doc_id", "key", "value").select("value", F.array_join(F.transform("owners", lambda x: x.cast("string")), ",").alias("owners"))


@R.query("a15_distinct_owners", "select category, count(distinct slug) as slugs, count(*) as n from catalog_entry where category is not null group by category having count(distinct slug) > 1")
def a15(s, d):
    g = K.shared_values(table(s, d, "catalog_entry", "slug", "category").withColumn("key", F.lit("category")), "slug", "key", "category")
    return g.select("category", F.size("owners").alias("slugs"), F.col("occurrences").alias("n"))


_ENC = "replace(url_encode(slug), '%20', '+')"


@R.query("a13_largest_variant", f"select key, arg_max(url, size * 100000000 - ordinal) as url, max(size) as size from (select cat_id as ordinal, 'https://cdn.x/' || {_ENC} || '_' || (cat_id % 5 * 100 + 100) || 'x' || case when cat_id % 2 = 0 then '@2x' else '' end || '.jpg' as url, 'https://cdn.x/' || {_ENC} || '.jpg' as key, (cat_id % 5 * 100 + 100) * case when cat_id % 2 = 0 then 2 else 1 end as size from catalog_entry where slug is not null) t group by key")
def a13(s, d):
    c = table(s, d, "catalog_entry", "cat_id", "slug").filter("slug is not null")
    rows = c.select(F.col("cat_id").alias("ordinal"), F.concat(F.lit("http://cdn.x/"), F.url_encode("slug"), F.lit("_"), (F.col("cat_id") % 5 * 100 + 100).cast("string"), F.when(F.col("cat_id") % 2 == 0, "x@2x.jpg").otherwise("x.jpg")).alias("url"))
    best = C.largest_variant(rows)
    return best.withColumn("url", F.regexp_replace("url", "^http:", "https:"))


@R.query("u06_priority_merge", "select slug, arg_min(origin, rank * 10 + part) as origin, min(rank) as rank from (select slug, 'index' as origin, case url_type when 'api' then 0 when 'slug' then 1 when 'collection' then 2 when 'sku' then 3 else 99 end as rank, 0 as part from index_entry where slug is not null union all select slug, 'ledger', 1, 1 from entities where slug is not null) t group by slug")
def u06(s, d):
    rank = F.when(F.col("url_type") == "api", 0).when(F.col("url_type") == "slug", 1).when(F.col("url_type") == "collection", 2).when(F.col("url_type") == "sku", 3).otherwise(99)
    index = table(s, d, "index_entry", "slug", "url_type").filter("slug is not null").select("slug", F.lit("index").alias("origin"), rank.alias("rank"))
    return C.merged([index, table(s, d, "entities", "slug").filter("slug is not null").select("slug", F.lit("ledger").alias("origin"), F.lit(1).alias("rank"))])


_CAND = "(select o_custkey as asset, o_orderkey as ordinal, case o_orderpriority when '1-URGENT' then 'png' when '2-HIGH' then 'jpg' when '3-MEDIUM' then 'webp' when '4-NOT SPECIFIED' then 'png-indexed' else 'bmp' end as fmt, cast(floor(o_totalprice) as bigint) as size from orders)"
_PRI = "case fmt when 'png' then 2 when 'jpg' then 3 when 'png-indexed' then 4 when 'webp' then 5 end"


def _candidates(s, d):
    return sql(s, d, f"select *, cast(ordinal as string) as url, 'a' as source from {_CAND} c")


@R.query("f26_admission", f"select ordinal, fmt, size, {_PRI} as priority from {_CAND} c where {_PRI} is not null and (size = 0 or size >= 1024)")
def f26(s, d):
    return K.admit(_candidates(s, d)).select("ordinal", "fmt", "size", "priority")


@R.query("o09_select_best", f"select b.asset, case when w then l.fmt else b.fmt end as fmt, case when w then l.size else b.size end as size, cast(case when w then l.ordinal else b.ordinal end as varchar) as url from (select *, row_number() over (partition by asset order by p, size desc, ordinal) as rn from (select *, {_PRI} as p from {_CAND} c) x where p is not null and (size = 0 or size >= 1024)) b join (select *, row_number() over (partition by asset order by size desc, ordinal) as rn from {_CAND} c where {_PRI} is not null and (size = 0 or size >= 1024)) l on l.asset = b.asset and b.rn = 1 and l.rn = 1, lateral (select b.size > 0 and l.size >= 4 * b.size and l.fmt not in ('png-indexed', 'png-grayscale') as w) z")
def o09(s, d):
    return K.select_best(_candidates(s, d), "asset").select("asset", "fmt", "size", "url")


@R.query("o13_rendition", "select l_orderkey, coalesce(max(case when l_returnflag = 'R' and l_linenumber = m then l_linenumber end), arg_max(l_linenumber, case when l_returnflag <> 'R' then l_partkey * 10 - l_linenumber end)) as link from (select *, max(case when l_returnflag = 'R' then l_linenumber end) over (partition by l_orderkey) as m from lineitem) t group by l_orderkey")
def o13(s, d):
    f = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    f = f.select("l_orderkey", F.col("l_linenumber").alias("link"), F.col("l_linenumber").alias("ordinal"), F.when(F.col("l_returnflag") == "R", "source").otherwise("hd").alias("quality"), F.concat(F.col("l_partkey").cast("string"), F.lit("p")).alias("rendition"))
    return K.pick_rendition(f, "l_orderkey")


@R.query("w14_keep_best", "select o_orderkey, case when rn = 1 then 'KEEP' else 'DROP' end as verdict from (select o_orderkey, row_number() over (partition by o_custkey, o_orderstatus order by case when c like 'pcm%' then 3 when c = 'aac' then 2 when c = 'mp3' then 1 else 0 end desc, o_orderkey) as rn from (select *, case when o_orderpriority like '1%' then 'pcm_s16le' when o_orderpriority like '2%' then 'aac' when o_orderpriority like '3%' then 'mp3' else 'other' end as c from orders) t) u")
def w14(s, d):
    o = table(s, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    p = F.substring("o_orderpriority", 1, 1)
    t = o.select("o_custkey", F.col("o_orderstatus").alias("layout"), F.col("o_orderkey").alias("ordinal"), F.when(p == "1", "pcm_s16le").when(p == "2", "aac").when(p == "3", "mp3").otherwise("other").alias("codec"))
    return G.keep_best_layout(t, "o_custkey").select(F.col("ordinal").alias("o_orderkey"), "verdict")


@R.query("w15_even_spread", "select s_suppkey, round(case when n = 1 then 0.0 when n = 2 then case when i = 0 then -0.5 else 0.5 end else (2.0 * i / (n - 1) - 1) * 0.7 end, 8) as pan from (select s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as i, count(*) over (partition by s_nationkey) as n from supplier) t")
def w15(s, d):
    t = table(s, d, "supplier", "s_suppkey", "s_nationkey").withColumn("channels", F.lit(1)).withColumn("classification", F.lit("other"))
    return G.auto_pan(t, "s_nationkey", "s_suppkey").select("s_suppkey", F.round("pan", 8).alias("pan"))


@R.query("a26_evidence", "select host, array_to_string(list_sort(list(distinct first_seen_in)), ',') as evidence, bool_or(first_seen_in = 'cdx') as trusted from entities where first_seen_in is not null group by host")
def a26(s, d):
    e = table(s, d, "entities").select("host", F.col("first_seen_in").alias("evidence")).filter("evidence is not null")
    return K.evidence(e).select("host", F.array_join("evidence", ",").alias("evidence"), "trusted")


@R.query("a27_commerce_platform", "select count(*) filter (where regexp_matches(original_url, '/products?/', 'i')) as products, count(*) filter (where regexp_matches(original_url, '/collections?/', 'i')) as collections, count(*) filter (where regexp_matches(original_url, '/(cart|checkout)(/|\\?|$)', 'i')) as carts, 0 as shopify, 0 as swell, 0 as fourthwall, 'generic' as platform from index_entry")
def a27(s, d):
    return K.commerce_platform(table(s, d, "index_entry", "original_url"), "original_url")


@R.query("a28_signature_score", "select source, platform, count(*) as n from (select source, case when a = 0 and b = 0 then 'unknown' when a >= b then 'garment' else 'home' end as platform from (select source, cast(regexp_matches(lower(text), 'parka|hoodie|jacket') as int) + cast(regexp_matches(lower(text), 'wear|worn') as int) as a, cast(regexp_matches(lower(text), 'rug|candle|poster') as int) + cast(regexp_matches(lower(text), 'mug|bottle') as int) as b from documents) t) u group by source, platform")
def a28(s, d):
    sig = {"garment": ("parka|hoodie|jacket", "wear|worn"), "home": ("rug|candle|poster", "mug|bottle")}
    return table(s, d, "documents", "source", "text").select("source", K.signature_score(F.lower("text"), sig)["platform"].alias("platform")).groupBy("source", "platform").agg(F.count("*").alias("n"))


@R.query("a39_nested", "select c_custkey, coalesce(n, 0) as n, first from customer left join (select o_custkey, count(*) as n, min(o_orderkey) as first from orders group by o_custkey) o on o_custkey = c_custkey")
def a39(s, d):
    n = K.nested_children(table(s, d, "customer", "c_custkey"), table(s, d, "orders", "o_custkey", "o_orderkey", "o_totalprice"), "c_custkey", "o_custkey", ["o_orderkey"], "orders")
    return n.select("c_custkey", F.size("orders").alias("n"), F.try_element_at("orders", F.lit(1))["o_orderkey"].alias("first"))


@R.query("a43_idempotency_key", "select l_orderkey, sha256(string_agg(cast(l_partkey as varchar), chr(10) order by l_linenumber, l_partkey)) as key from lineitem group by l_orderkey")
def a43(s, d):
    return K.idempotency_key(table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber", "l_partkey")


@R.query("a45_replicas", "select doc_id from documents where sha256(text) in (select sha256(text) from documents group by 1 having count(*) > 1)")
def a45(s, d):
    t = table(s, d, "documents", "doc_id", "text").withColumn("h", F.sha2("text", 256))
    many = t.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    return t.join(many, "h", "left_semi").select("doc_id")


both("a46_top_two", "select event_type, count(*) as n from events group by event_type order by n desc, event_type limit 2")
both("a47_preflight", "select bool_or(blocking and failed) as blocked, count(*) filter (where failed and not blocking) as warnings from (select price is null as failed, true as blocking from catalog_entry union all select color is null, false from catalog_entry) c")


@R.query("j36_sequence_equality", "select l_orderkey, list(l_returnflag order by l_linenumber, l_returnflag) = list(l_returnflag order by l_partkey, l_suppkey, l_linenumber, l_returnflag) as same_order, list_sort(list(l_returnflag)) = list_sort(list(l_returnflag)) as same_multiset from lineitem group by l_orderkey")
def j36(s, d):
    a = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").withColumn("o", F.struct("l_linenumber"))
    b = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").withColumn("o", F.struct("l_partkey", "l_suppkey", "l_linenumber"))
    return K.sequences_equal(a, b, "l_orderkey", "o", "l_returnflag")


@R.query("j07_full_text", """with t as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as w from documents), st as (select count(*) as n, avg(len(w)) as a from t),
 tf as (select doc_id, len(w) as l, term, len(list_filter(w, lambda x: x = term)) as tf from t, (select unnest(['sample', 'rug']) as term) q), df as (select term, count(*) as df from tf where tf > 0 group by term)
 select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) as score from tf join df using (term), st where tf > 0 group by doc_id having count(*) = 2""")
def j07(s, d):
    return K.full_text(table(s, d, "documents", "doc_id", "text"), "doc_id", "text", ["sample", "rug"])


@R.query("j30_host_suffix", "select entry_id, case when h like '%goods.example' then 'goods' when h like '%trading.example' then 'trading' end as recipe from (select entry_id, regexp_replace(lower(regexp_extract(original_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\\.+$', '') as h from index_entry) t")
def j30(s, d):
    h = urls.host(F.col("original_url"))
    return table(s, d, "index_entry", "entry_id", "original_url").select("entry_id", F.when(h.endswith("goods.example"), "goods").when(h.endswith("trading.example"), "trading").alias("recipe"))


@R.query("j31_longest_prefix", "select name, max(domain) as domain from (select distinct n.name, first_value(d.domain) over (partition by n.name order by length(d.domain) desc) as domain from (select distinct replace(host, '.', '_') || '_products_x' as name from entities) n join (select distinct replace(host, '.', '_') as domain from entities) d on starts_with(n.name, d.domain) and substr(n.name, length(d.domain) + 1, 1) in ('_', '')) t group by name")
def j31(s, d):
    h = table(s, d, "entities", "host").distinct().select(F.replace(F.col("host"), F.lit("."), F.lit("_")).alias("domain"))
    return V.longest_prefix(h.select(F.concat("domain", F.lit("_products_x")).alias("name")).distinct(), h)


both("j29_correlated_existence", "select p.slug from product_metadata p where p.matched_sku is not null and not exists (select 1 from catalog_entry c where c.slug = p.slug)")
both("j11_lookup_default", "select i.entry_id, coalesce(m.brand, 'unknown') as brand from index_entry i left join (select slug, min(brand) as brand from product_metadata group by slug) m on i.slug = m.slug")
both("u13_ordered_dedup", "select original_url, min(fetch_id) as first_id from fetch_result group by original_url order by first_id")
both("u11_first_occurrence", "select slug, min(entry_id) as first_id from index_entry group by slug")
both("v14_typed_rows", "select cat_id, currency in ('USD', 'EUR', 'GBP') as currency_ok, coalesce(gender, 'unisex') as gender, price between 0 and 10000 as price_ok from catalog_entry")


@R.query("v13_required_keys", "select meta_id from product_metadata where coalesce(sku, '') = '' or coalesce(brand, '') = ''")
def v13(s, d):
    m = table(s, d, "product_metadata", "meta_id", "sku", "brand")
    return m.select("meta_id", K.required(F.to_json(F.struct("sku", "brand")), ("sku", "brand")).alias("e")).filter(F.size("e") > 0).select("meta_id")


@R.query("v15_allow_list", "select count(*) as n from events where json_keys(props)[1] <> 'k'")
def v15(s, d):
    return table(s, d, "events", "props").filter(F.size(K.unknown_keys(F.from_json("props", "map<string,string>"), ("k",))) > 0).agg(F.count("*").alias("n"))


# the lines of an order as the stems of a mix
_STEMS = """(select l_orderkey as g, l_orderkey || '-' || l_linenumber || case l_partkey % 4 when 0 then '.mp3' else '.WAV' end as filename, case when l_suppkey % 9 = 0 then 96000 when l_suppkey % 9 = 1 then 0 else 48000 end as sample_rate, case l_partkey % 3 when 0 then 16 else 24 end as bit_depth, l_partkey % 4 = 0 as is_lossy, 1 + l_partkey % 3 as channels, 1000 + (case when l_linenumber > 3 then l_suppkey % 3 else 0 end) as duration_samples, cast(l_quantity as double) - 45 as true_peak_dbtp, cast(l_discount as double) / 50 as dc_offset_max, l_quantity < 2 as fully_silent, l_tax > 0.06 as dead, case when l_suppkey % 2 = 0 then 'ffprobe_sample_fmt' else 'wav' end as src, case when l_partkey % 5 = 0 then 's32' else 's16' end as sample_fmt, case when l_linenumber % 2 = 0 then l_suppkey % 4 end as time_reference, case when l_linenumber = 1 then 0.5 end as pan from lineitem)"""
_FLAGS = """select g, severity, code, array_to_string(list_sort(list(filename)), ' ') as affected from (select g, filename, unnest([case when true_peak_dbtp > 0 then ['warn', 'input_clipping'] end, case when dc_offset_max > 0.001 then ['warn', 'dc_offset'] end, case when fully_silent then ['warn', 'silent_file'] end, case when not fully_silent and channels = 2 and dead then ['warn', 'dead_channel'] end, case when channels > 2 then ['error', 'multichannel_input'] end, case when is_lossy then ['warn', 'lossy_input'] end,
 case when top - duration_samples > 1 then ['warn', 'length_drift'] end, case when src = 'ffprobe_sample_fmt' and sample_fmt = 's32' and filename like '%.WAV' and not is_lossy then ['warn', 'bit_depth_uncertain'] end]) as f, f[1] as severity, f[2] as code from (select *, max(duration_samples) over (partition by g) as top from """ + _STEMS + """ s) t) u where f is not null group by g, severity, code
 union all select g, f[1], f[2], array_to_string(list_sort(f[3:]), ' ') from (select g, unnest([case when count(distinct nullif(sample_rate, 0)) > 1 then ['error', 'rate_mismatch'] || list(filename) end, case when count(distinct case when not is_lossy then bit_depth end) > 1 then ['warn', 'depth_mismatch'] || list(filename) filter (where not is_lossy) end, case when max(time_reference) - min(time_reference) > 1 then ['warn', 'stems_unanchored'] || list(filename) filter (where time_reference is not null) end,
 case when count(*) filter (where channels = 1) > 0 then ['warn', 'pan_law_default_assumed'] || list(filename) filter (where channels = 1) end, case when count(*) filter (where channels = 1 and pan is null) >= 3 then ['warn', 'mono_pile_at_center'] || list(filename) filter (where channels = 1) end]) as f from """ + _STEMS + """ s group by g) v where f is not null"""


def stems(s, d):
    t = sql(s, d, "select * from " + _STEMS.replace("l_orderkey || '-' || l_linenumber ||", "cast(l_orderkey as string) || '-' || cast(l_linenumber as string) ||") + " s")
    return t.withColumn("silent_channels", F.when(F.col("dead"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))).withColumnRenamed("src", "bit_depth_source")


def flags(s, d):
    return G.stem_flags(stems(s, d), "g").select("g", "severity", "code", F.array_join("affected", " ").alias("affected"))


@R.query("v16_flag_rules", _FLAGS)
def v16(s, d):
    return flags(s, d)


@R.query("a33_consistency", f"select * from ({_FLAGS}) f where code in ('rate_mismatch', 'depth_mismatch', 'stems_unanchored')")
def a33(s, d):
    return flags(s, d).filter(F.col("code").isin("rate_mismatch", "depth_mismatch", "stems_unanchored"))


@R.query("a34_deviation", f"select * from ({_FLAGS}) f where code = 'length_drift'")
def a34(s, d):
    return flags(s, d).filter("code = 'length_drift'")


_MIX = f"(select g, bool_or(is_lossy) as lossy, case when bool_or(is_lossy) then 44100 else coalesce(max(nullif(sample_rate, 0)), 44100) end as rate, case when bool_or(is_lossy) then 16 else least(coalesce(min(bit_depth), 16), 24) end as depth, max(duration_samples) as longest from {_STEMS} s group by g)"
_MASTERS = "(select o_orderkey as g, o_orderkey % 11 = 0 as missing, case o_custkey % 3 when 0 then 44100 else 48000 end as sample_rate, o_custkey % 4 = 0 as is_lossy, case o_custkey % 5 when 0 then 24 else 16 end as bit_depth, 1 + o_custkey % 3 as channels, 999 + o_custkey % 4 as duration_samples, case when o_custkey % 7 = 0 then 2 end as tolerance from orders)"


@R.query("v16_master_flags", f"select g, f[1] as severity, f[2] as code from (select m.g, unnest([case when missing then ['error', 'master_missing'] end, case when not missing and sample_rate <> rate then ['error', 'master_rate_mismatch'] end, case when not missing and not is_lossy and bit_depth <> depth then ['error', 'master_depth_mismatch'] end, case when not missing and channels <> 2 then ['error', 'master_channels_mismatch'] end, case when not missing and channels > 2 then ['error', 'master_multichannel'] end, case when not missing and abs(duration_samples - longest) > coalesce(tolerance, 1) then ['error', 'master_duration_mismatch'] end, case when not missing and is_lossy and not lossy then ['warn', 'master_lossy_with_lossless_stems'] end]) as f from {_MASTERS} m join {_MIX} x on x.g = m.g) t where f is not null")
def v16_masters(s, d):
    return G.master_flags(sql(s, d, f"select * from {_MASTERS} m"), stems(s, d), "g")


@R.query("j33_clips", "select distinct slug as track, i as file, i in (select unnest(images) from catalog_entry where cat_id % 3 = 0) as on_disk from (select slug, unnest(images) as i from catalog_entry) t")
def j33(s, d):
    c = table(s, d, "catalog_entry", "cat_id", "slug", "images")
    here, gone = G.track_files(c.select(F.col("slug").alias("track"), F.col("images").alias("clips")), c.filter("cat_id % 3 = 0").select(F.explode("images").alias("file")))
    return here.withColumn("on_disk", F.lit(True)).unionByName(gone.withColumn("on_disk", F.lit(False)))


@R.query("j34_missing_members", "select slug, i as member from (select slug, unnest(images) as i from catalog_entry) t where i not in (select unnest(images) from catalog_entry where cat_id % 3 = 0)")
def j34(s, d):
    c = table(s, d, "catalog_entry", "cat_id", "slug", "images")
    return G.missing_members(c, "slug", "images", c.filter("cat_id % 3 = 0").select(F.explode("images").alias("i")), "i")


@R.query("v21_five_per_file", "select doc_id, hit from (select doc_id, hit, row_number() over (partition by doc_id order by hit) as rn from (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[a-z.]+\\.example'))) as hit from documents) t) u where rn <= 5")
def v21(s, d):
    from pyspark.sql import Window

    t = table(s, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([a-z.]+\.example)"), F.lit(1)))).alias("hit"))
    return t.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("hit"))).filter("rn <= 5").drop("rn")


both("v24_routes", "select cat_id, concat_ws(',', case when price = 0 then 'price' end, case when image_count = 0 then 'images' end, case when date_seen is null then 'date' end) as routes from catalog_entry")
both("v23_ledger_status", "select first_seen_in, count(*) as n, count(resolved_at) as resolved from entities group by first_seen_in")

QUERIES, SQL = R.queries, R.sql
