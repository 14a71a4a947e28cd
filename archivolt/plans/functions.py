"""Queries of scalar functions, nested values, sources, sinks and streams on the driver's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions import pages, scalars, urls
from archivolt.plans._base import Registry
from archivolt.session import shared_folder
from archivolt.sources import readers, writers
from archivolt.streaming import stateful
from archivolt.tables import table

R = Registry()
both = R.both


def folder(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    import uuid

    return f"{shared_folder(spark)}/archivolt/{uuid.uuid4().hex}"


# ---- scalar functions
both("p03_defaults", "select meta_id, coalesce(nullif(name, ''), replace(slug, '-', ' ')) as name, coalesce(nullif(currency, ''), 'USD') as currency from product_metadata")
both("p04_safe_cast", "select meta_id, try_cast(price as double) as price from product_metadata")


@R.query("m10_aspect", "select l_orderkey, l_linenumber, abs(cast(l_quantity as bigint) * 3 - 2 * l_linenumber) * 100 <= greatest(cast(l_quantity as bigint) * 3, 2 * l_linenumber) * 5 as same from lineitem")
def m10(s, d):
    li = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return li.select("l_orderkey", "l_linenumber", scalars.same_aspect(F.col("l_quantity").cast("long"), F.lit(2), F.col("l_linenumber"), F.lit(3)).alias("same"))


@R.query("p02_truthy", "select cat_id, (name is not null and name not in ('', '0', '[]'))::int + (brand is not null and brand not in ('', '0', '[]'))::int + (color is not null and color not in ('', '0', '[]'))::int as n from catalog_entry")
def p02(s, d):
    from archivolt.operators.catalog import truthy

    m = F.create_map(F.lit("name"), "name", F.lit("brand"), "brand", F.lit("color"), "color")
    return table(s, d, "catalog_entry", "cat_id", "name", "brand", "color").select("cat_id", F.size(truthy(m)).alias("n"))


@R.query("p06_product_ref", "select entry_id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(p, '(?i)/products/([a-z0-9][a-z0-9\\-_.%]*)', 1)), '\\.atom$', ''), '\\.oembed$', ''), '\\.json$', '') as slug from (select entry_id, split_part(split_part(regexp_replace(original_url, '^[A-Za-z]+://[^/?#]*', ''), '#', 1), '?', 1) as p, original_url from index_entry) t where regexp_extract(original_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) <> '' and regexp_matches(p, '(?i)/products/[a-z0-9]')")
def p06(s, d):
    return table(s, d, "index_entry", "entry_id", "original_url").select("entry_id", urls.product_ref(F.col("original_url"), F.lit(None).cast("string"))["slug"].alias("slug")).filter("slug is not null")


@R.query("x26_tokens", "select slug, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(slug), '[a-z0-9]+'))), ' ') as tokens from (select distinct slug from catalog_entry where slug is not null) t")
def x26(s, d):
    return table(s, d, "catalog_entry", "slug").filter("slug is not null").distinct().select("slug", F.array_join(F.array_sort(urls.tokens(F.col("slug"))), " ").alias("tokens"))


@R.query("x27_slugify", "select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug from part")
def x27(s, d):
    return table(s, d, "part", "p_partkey", "p_name").select("p_partkey", urls.slugify(F.col("p_name")).alias("slug"))


@R.query("x28_core_name", "select meta_id, regexp_split_to_array(name, '\\s*[\\(\\[]')[1] as core from product_metadata where name is not null")
def x28(s, d):
    return table(s, d, "product_metadata", "meta_id", "name").filter("name is not null").select("meta_id", urls.core_name(F.col("name")).alias("core"))


_NS = "regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_TAIL = f"(select *, coalesce(case when {_NS} <> '' and starts_with(slug, {_NS}) then regexp_replace(substr(slug, length({_NS}) + 1), '^-+', '') else slug end, '') as tail from"
DIRNAME = "trim(regexp_replace(case when coalesce(date_seen, '') <> '' then date_seen || ' ' else '' end || name || case when tail <> '' then ' [' || tail || ']' else '' end, '[/:*?\"<>|]', '', 'g'))"


@R.query("x29_dirname", f"select cat_id, {DIRNAME} as dir from {_TAIL} catalog_entry c) t")
def x29(s, d):
    return table(s, d, "catalog_entry", "cat_id", "name", "date_seen", "slug").select("cat_id", urls.dirname(F.col("name"), F.col("date_seen"), F.col("slug")).alias("dir"))


_SHOTS = "(select cat_id, slug, u, upper(u) as n from (select cat_id, slug, unnest([i || '-FRONT', i || '_back-M', i || '-side-F', i || '-right_M-BLACK', i || '-m-', i || '-M-blue', i || '_female', i || '-front_m.x']) as u from (select cat_id, slug, unnest(images) as i from catalog_entry) a) b)"
_ANGLE = "case when n like '%FRONT%' then 'front' when n like '%BACK%' then 'back' when n like '%SIDE%' or n like '%RIGHT%' then 'side' end"
_MALE = "(regexp_matches(n, '(FRONT|BACK)[-_]M([-_.]|$)') or regexp_matches(n, '[-_]M[-_.]') and not regexp_matches(n, '[-_]M[-_](BLACK|BLUE|GREEN|GREY|LS|SS)'))"
_MODEL = f"case when regexp_matches(n, '[-_ ]FEMALE') then 'female' when regexp_matches(n, '[-_ ]MALE') then 'male' when regexp_matches(n, '[-_]F[-_.]') or n like '%-F' then 'female' when (regexp_matches(n, '[-_]M[-_.]') or n like '%-M') and {_MALE} then 'male' end"


def shots(s, d):
    """Image names with angles and models in them."""
    i = table(s, d, "catalog_entry", "cat_id", "images").select("cat_id", F.explode("images").alias("i"))
    return i.select("cat_id", F.explode(F.array(*[F.concat("i", F.lit(x)) for x in ("-FRONT", "_back-M", "-side-F", "-right_M-BLACK", "-m-", "-M-blue", "_female", "-front_m.x")])).alias("image"))


@R.query("x30_image_class", f"select cat_id, u as image, {_ANGLE} as angle, {_MODEL} as model from {_SHOTS} t")
def x30(s, d):
    return shots(s, d).select("cat_id", "image", urls.image_angle(F.col("image")).alias("angle"), urls.image_model(F.col("image")).alias("model"))


@R.query("o12_image_order", f"select cat_id, u as image, case when a is not null and m is not null then 0 when a is not null then 1 else 2 end as o0, lower(u) as o1 from (select *, {_ANGLE} as a, {_MODEL} as m from {_SHOTS} t) x")
def o12(s, d):
    from archivolt.operators.catalog import image_order

    return shots(s, d).select("cat_id", "image", *[c.alias(f"o{i}") for i, c in enumerate(image_order(F.col("image")))])


@R.query("w13_numbering", f"""with f as (select distinct cat_id, u, case when a is not null and m is not null then a || '-' || m when a is not null then a else 'detail' end as base, case when a is not null and m is not null then 0 when a is not null then 1 else 2 end as o from (select *, {_ANGLE} as a, {_MODEL} as m from {_SHOTS} t) x)
 select cat_id, u || '.JPG' as file, base || case when rn > 1 then '-' || rn else '' end || '.jpg' as new_name from (select *, row_number() over (partition by cat_id, base order by o, lower(u)) as rn from f) t""")
def w13(s, d):
    from archivolt.operators.catalog import semantic_names

    f = shots(s, d).distinct().select("cat_id", F.concat("image", F.lit(".JPG")).alias("file"))
    return semantic_names(f, "cat_id", "file").select("cat_id", "file", "new_name")


@R.query("x20_image_key", "select distinct image, regexp_replace(regexp_replace(split_part(image, '?', 1), '_[0-9]+x(@[0-9]x)?(\\.\\w+)', '\\2', 'g'), '^http://', 'https://') as key from (select unnest(images) as image from catalog_entry) t")
def x20(s, d):
    return table(s, d, "catalog_entry", "images").select(F.explode("images").alias("image")).distinct().select("image", urls.image_key(F.col("image")).alias("key"))


@R.query("x24_image_stem", "select distinct image, regexp_replace(lower(image), '\\.\\w+$', '') as stem from (select unnest(images) as image from catalog_entry) t")
def x24(s, d):
    return table(s, d, "catalog_entry", "images").select(F.explode("images").alias("image")).distinct().select("image", urls.image_stem(F.col("image")).alias("stem"))


@R.query("x31_word_class", "select p_partkey, case when regexp_matches(p_name, '(?i)\\b(blue|green)\\b') then 'cool' when regexp_matches(p_name, '(?i)\\b(red|orange)\\b') then 'warm' else 'other' end as class from part")
def x31(s, d):
    return table(s, d, "part", "p_partkey", "p_name").select("p_partkey", urls.stem_class(F.col("p_name"), (("cool", r"\b(?:blue|green)\b"), ("warm", r"\b(?:red|orange)\b"))).alias("class"))


@R.query("x52_format", "select distinct content_type, case lower(trim(split_part(content_type, ';', 1))) when 'image/png' then 'png' when 'image/jpeg' then 'jpg' else 'unknown' end as fmt from index_entry")
def x52(s, d):
    return table(s, d, "index_entry", "content_type").distinct().select("content_type", urls.format_of(F.col("content_type")).alias("fmt"))


@R.query("x55_comments", "select doc_id, 'a' || replace(text, '/*', '/ *') || 'b' || replace(text, '/*', '/ *') || ' /* open' as text from documents")
def x55(s, d):
    t = F.replace("text", F.lit("/*"), F.lit("/ *"))
    code = F.concat(F.lit("a/* "), F.replace(t, F.lit("*/"), F.lit("* /")), F.lit("\n * x **/"), t, F.lit("b/**/"), t, F.lit(" /* open"))
    return table(s, d, "documents", "doc_id", "text").select("doc_id", pages.stripped_comments(code).alias("text"))


@R.query("x56_ellipsis", "select doc_id, case when length(text) > 500 then substr(text, 1, 497) || '...' else text end as text from documents")
def x56(s, d):
    return table(s, d, "documents", "doc_id", "text").select("doc_id", urls.ellipsis(F.col("text")).alias("text"))


@R.query("x61_template", "select p_partkey, 'Part ' || p_name || ' of ' || p_brand as line from part")
def x61(s, d):
    return table(s, d, "part", "p_partkey", "p_name", "p_brand").select("p_partkey", urls.filled(F.lit("Part {name} of {brand}"), {"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("line"))


@R.query("d01_iso_seconds", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at from events")
def d01(s, d):
    return table(s, d, "events", "event_id", "ts").select("event_id", scalars.iso_seconds(F.col("ts")).alias("at"))


@R.query("d02_epoch_date", "select event_id, strftime(to_timestamp(1500000000 + event_id * 3600) at time zone 'UTC', '%Y-%m-%d') as day from events")
def d02(s, d):
    return table(s, d, "events", "event_id").select("event_id", scalars.epoch_date(1500000000 + F.col("event_id") * 3600).alias("day"))


@R.query("d03_stamp_year", "select entry_id, cast(substr(capture_ts, 1, 4) as int) as year from index_entry")
def d03(s, d):
    return table(s, d, "index_entry", "entry_id", "capture_ts").select("entry_id", scalars.stamp_year(F.col("capture_ts")).alias("year"))


@R.query("d04_partial_date", "select meta_id, case when regexp_matches(date_seen, '^\\d{4}-\\d{2}-\\d{2}$') then 'day' when regexp_matches(date_seen, '^\\d{4}-\\d{2}$') then 'month' when regexp_matches(date_seen, '^\\d{4}$') then 'year' end as precision from product_metadata")
def d04(s, d):
    return table(s, d, "product_metadata", "meta_id", "date_seen").select("meta_id", scalars.partial_date(F.col("date_seen")).alias("precision"))


@R.query("d05_sane_date", "select cat_id, regexp_matches(date_seen, '^\\d{4}-\\d\\d-\\d\\d$') and cast(substr(date_seen, 6, 2) as int) between 1 and 12 and cast(substr(date_seen, 9, 2) as int) between 1 and 31 as sane from catalog_entry where date_seen is not null")
def d05(s, d):
    return table(s, d, "catalog_entry", "cat_id", "date_seen").filter("date_seen is not null").select("cat_id", scalars.sane_month_day(F.col("date_seen")).alias("sane"))


@R.query("m01_gain", "select s_suppkey, round(power(10.0, (s_suppkey % 40 - 30) / 20.0), 9) as gain, round(cos((least(1, greatest(-1, s_acctbal / 5000)) + 1) * pi() / 4) * power(10, -0.15) * sqrt(2), 9) as left_gain from supplier")
def m01(s, d):
    left, _ = scalars.pan_coefficients(F.col("s_acctbal") / 5000)
    return table(s, d, "supplier", "s_suppkey", "s_acctbal").select("s_suppkey", F.round(scalars.decibel_gain(F.col("s_suppkey") % 40 - 30), 9).alias("gain"), F.round(left, 9).alias("left_gain"))


@R.query("m02_ladders", "select s_suppkey, cast(case when x < -3 then 0.0 when x <= -1 then -1.0 else -(x + 3) end as double) as attenuation, case when x * 10 <= -90 then 'pass' when x * 10 <= -60 then 'smell' else 'fail' end as residual, case when x + 6 <= 3 then 'mono_compatible' when x + 6 <= 6 then 'mono_partial_cancellation' when x + 6 <= 12 then 'mono_phase_warning' else 'mono_phase_severe' end as fold from (select s_suppkey, s_suppkey % 20 - 10 as x from supplier) t")
def m02(s, d):
    x = F.col("s_suppkey") % 20 - 10
    return table(s, d, "supplier", "s_suppkey").select("s_suppkey", scalars.pre_attenuation(x).alias("attenuation"), scalars.residual_verdict(x * 10).alias("residual"), scalars.mono_fold(x + 6).alias("fold"))


@R.query("m05_loudness", "select s_suppkey, p.name as platform, round(s_acctbal / 1000 - p.lufs, 2) as lufs_delta from supplier, (values ('Spotify', -14.0), ('Apple Music', -16.0), ('EBU R128', -23.0)) p(name, lufs)")
def m05(s, d):
    e = table(s, d, "supplier", "s_suppkey", "s_acctbal").select("s_suppkey", F.explode(scalars.loudness_deltas(F.col("s_acctbal") / 1000, F.lit(-1.0))).alias("x"))
    return e.select("s_suppkey", "x.platform", "x.lufs_delta")


@R.query("m06_rational", "select p_partkey, round(p_size * 1000 / 1001.0, 8) as rate from part")
def m06(s, d):
    return table(s, d, "part", "p_partkey", "p_size").select("p_partkey", F.round(scalars.rational(F.concat((F.col("p_size") * 1000).cast("string"), F.lit("/1001"))), 8).alias("rate"))


@R.query("m07_bands", "select p_partkey, p_size / 20.0 between 1.7 and 2.3 as fields, p_size / 50.0 between 0.35 and 0.65 as half from part")
def m07(s, d):
    return table(s, d, "part", "p_partkey", "p_size").select("p_partkey", scalars.field_ratio(F.col("p_size") / 20).alias("fields"), scalars.half_fraction(F.col("p_size") / 50).alias("half"))


@R.query("m08_hex", "select p_partkey, p_size * 5 % 256 as red, p_size * 3 % 256 as green from part")
def m08(s, d):
    c = F.concat(F.lit("#"), F.lpad(F.hex(F.col("p_size") * 5 % 256), 2, "0"), F.lpad(F.hex(F.col("p_size") * 3 % 256), 2, "0"), F.lit("00"))
    return table(s, d, "part", "p_partkey", "p_size").select("p_partkey", scalars.hex_channels(c).alias("c")).select("p_partkey", F.col("c")[0].alias("red"), F.col("c")[1].alias("green"))


@R.query("m09_backoff", "select p_partkey, least(60.0, power(2.0, p_size % 10)) as pause from part")
def m09(s, d):
    return table(s, d, "part", "p_partkey", "p_size").select("p_partkey", scalars.backoff(F.col("p_size") % 10).alias("pause"))


both("m12_layered", "select meta_id, coalesce(nullif(trim(color), ''), nullif(trim(gender), ''), 'none') as value from product_metadata")


@R.query("m13_bit_depth", "select p_partkey, coalesce(nullif(p_size % 3, 0), case when p_size % 2 = 0 then 16 else 32 end) as depth from part")
def m13(s, d):
    return table(s, d, "part", "p_partkey", "p_size").select("p_partkey", scalars.bit_depth(F.col("p_size") % 3, F.lit(0), F.when(F.col("p_size") % 2 == 0, "s16").otherwise("fltp")).alias("depth"))


# ---- nested values
@R.query("ar2_nested", "select meta_id, v.title as title, v.sku as sku from (select meta_id, unnest(variants) as v from product_metadata) t")
def ar2(s, d):
    return table(s, d, "product_metadata", "meta_id", "variants").select("meta_id", F.explode("variants").alias("v")).select("meta_id", "v.title", "v.sku")


both("ar3_distinct_tags", "select distinct tag from (select explode(tags) as tag from product_metadata) t", "select distinct tag from (select unnest(tags) as tag from product_metadata) t")


@R.query("ar4_set_algebra", "select entry_id, len(list_intersect(all_types, ['atom', 'api'])) as common, len(list_distinct(list_concat(all_types, ['atom', 'api']))) as total from index_entry")
def ar4(s, d):
    x = F.array(F.lit("atom"), F.lit("api"))
    return table(s, d, "index_entry", "entry_id", "all_types").select("entry_id", F.size(F.array_intersect("all_types", x)).alias("common"), F.size(F.array_union("all_types", x)).alias("total"))


@R.query("ar6_ladder", "select p_partkey, len(list_filter([96, 128, 160, 192, 256, 320], lambda x: x > p_size * 6)) as steps from part")
def ar6(s, d):
    return table(s, d, "part", "p_partkey", "p_size").select("p_partkey", F.size(scalars.ladder(F.col("p_size") * 6)).alias("steps"))


@R.query("mp1_last_writer", "select currency, arg_max(slug, cat_id) as slug from catalog_entry where currency is not null group by currency")
def mp1(s, d):
    from archivolt.operators.ledger import last_per_key

    return last_per_key(table(s, d, "catalog_entry", "currency", "slug", "cat_id").filter("currency is not null"), ["currency"], [F.col("cat_id")]).select("currency", "slug")


@R.query("mp3_merge", "select cat_id, coalesce(color, 'none') || '/' || coalesce(brand, 'none') as v from catalog_entry")
def mp3(s, d):
    base = F.create_map(F.lit("color"), F.lit("none"), F.lit("brand"), F.lit("none"))
    own = F.map_filter(F.create_map(F.lit("color"), "color", F.lit("brand"), "brand"), lambda _, v: v.isNotNull())
    m = scalars.merged_maps(base, own)
    return table(s, d, "catalog_entry", "cat_id", "color", "brand").select("cat_id", F.concat(m["color"], F.lit("/"), m["brand"]).alias("v"))


@R.query("js1_json_path", "select event_id, cast(json_extract(props, '$.k') as int) as k from events")
def js1(s, d):
    return table(s, d, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@R.query("js2_canonical_json", "select s_suppkey, sha256('{\"a\":' || s_nationkey || ',\"b\":' || s_suppkey || '}') as digest from supplier")
def js2(s, d):
    return table(s, d, "supplier", "s_suppkey", "s_nationkey").select("s_suppkey", F.sha2(scalars.canonical_json(b=F.col("s_suppkey"), a=F.col("s_nationkey")), 256).alias("digest"))


# ---- sources and sinks, as round trips through the shared folder
_CAP = "(select unnest(regexp_split_to_array('https://replay.example/web/' || capture_ts || '/' || original_url || chr(9) || capture_ts || chr(9) || original_url || chr(9) || '200' || chr(9) || coalesce(content_type, ''), '\\r\\n|\\n|\\r')) as v from index_entry)"


@R.query("k01_capture_lines", f"select p[2] as ts, p[3] as original_url, p[4] as status, p[5] as mime from (select case when len(string_split(v, chr(9))) >= 5 then string_split(v, chr(9)) else regexp_split_to_array(trim(v), '\\s+') end as p from {_CAP} x) t where len(p) >= 5")
def k01(s, d):
    i = table(s, d, "index_entry", "capture_ts", "original_url", "content_type")
    path = folder(s)
    writers.write_lines(i.select(writers.capture_line(F.col("capture_ts"), F.col("original_url"), F.lit("200"), F.col("content_type"), "https://replay.example").alias("line")), "line", path)
    return readers.capture_lines(s, path).drop("replay_url")


@R.query("k03_json_rows", "select slug, host, canonical_url from entities")
def k03(s, d):
    e, path = table(s, d, "entities", "slug", "host", "canonical_url"), folder(s)
    writers.write_json(e, path)
    return readers.json_lines(s, path, "slug string, host string, canonical_url string")


@R.query("k06_links_per_key", "select host, array_to_string(list_sort(list(distinct slug)), ' ') as links from entities where host is not null and slug is not null group by host")
def k06(s, d):
    e = table(s, d, "entities", "host", "slug").filter("host is not null and slug is not null")
    return writers.merged_links(e.filter(F.col("slug") < "m"), e.filter(F.col("slug") >= "m"), "host", "slug").select("host", F.array_join("links", " ").alias("links"))


@R.query("k07_atomic_replace", "select n_nationkey, n_name from nation")
def k07(s, d):
    n, path = table(s, d, "nation", "n_nationkey", "n_name"), folder(s)
    writers.replace_table(n.filter("n_nationkey < 3"), path)
    writers.replace_table(n, path)
    return s.read.parquet(path)


@R.query("k09_keyed_store", "select cast(r_regionkey as varchar) as id, '{\"r_name\":\"' || r_name || '\"}' as data, sha256('{\"r_name\":\"' || r_name || '\"}') as digest from region")
def k09(s, d):
    return writers.with_digest(table(s, d, "region", "r_regionkey", "r_name"), "r_regionkey")


@R.query("k12_dossier", "select (select count(*) from region) as regions, (select count(*) from nation) as nations")
def k12(s, d):
    j = writers.dossier(regions=table(s, d, "region"), nations=table(s, d, "nation"))
    return j.select(F.json_array_length("regions").cast("long").alias("regions"), F.json_array_length("nations").cast("long").alias("nations"))


@R.query("k13_url_dump", "select unnest(regexp_split_to_array(u, '\\r\\n|\\n|\\r')) as value from (select distinct canonical_url as u from entities where canonical_url is not null) t")
def k13(s, d):
    e, path = table(s, d, "entities", "canonical_url").filter("canonical_url is not null").distinct(), folder(s)
    writers.write_lines(e, "canonical_url", path, ordered=True)
    return s.read.text(path)


@R.query("s12_sql_source", "select cast(n_nationkey as varchar) as id, '{\"n_name\":\"' || n_name || '\"}' as data from nation where n_regionkey = 1")
def s12(s, d):
    table(s, d, "nation").createOrReplaceTempView("nation")
    return readers.sql_source(s, "select n_nationkey, n_name from nation where n_regionkey = 1", "n_nationkey").drop("digest")


@R.query("s16_key_values", "select n_nationkey, n_name from nation")
def s16(s, d):
    lines = table(s, d, "nation").select(F.concat(F.lit("name="), "n_name", F.lit("|key="), F.col("n_nationkey").cast("string")).alias("value"))
    return readers.key_values(lines).select(F.col("kv")["key"].cast("int").alias("n_nationkey"), F.col("kv")["name"].alias("n_name"))


@R.query("s18_url_list", "select x as url from (select regexp_replace(unnest(string_split('  ' || original_url || chr(10) || '# note' || chr(10), chr(10))), '^\\s+|\\s+$', '', 'g') as x from index_entry) t where x <> '' and x not like '#%'")
def s18(s, d):
    lines = table(s, d, "index_entry", "original_url").select(F.explode(F.split(F.concat(F.lit("  "), "original_url", F.lit("\n# note\n")), "\n")).alias("value"))
    return readers.url_list(lines)


# ---- streams, drained over all that is there
def _events_folder(s, d) -> tuple[str, DataFrame]:
    e = table(s, d, "events")
    path = folder(s)
    e.repartition(4).write.parquet(path)
    return path, e


@R.query("t01_stream_dedup", "select distinct user_id, event_type from events")
def t01(s, d):
    path, e = _events_folder(s, d)
    out = folder(s)
    stateful.drain(stateful.first_seen(stateful.read_stream(s, path, e, 2), ["user_id", "event_type"]).select("user_id", "event_type"), out, out + "-state")
    return s.read.parquet(out)


@R.query("t03_worklist_batches", "select event_type, count(*) as n from events group by event_type")
def t03(s, d):
    path, e = _events_folder(s, d)
    out = folder(s)
    stateful.drain_batches(stateful.read_stream(s, path, e, 2), lambda b, i: b.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("append").parquet(out), out + "-state", "append")
    return s.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"))


@R.query("t06_stream_breaker", """with r as (select *, sum(success::int) over (partition by tier order by logged_at, fetch_id) as run from fetch_result where tier is not null), n as (select *, count(*) filter (where not success) over (partition by tier, run order by logged_at, fetch_id) as bad from r),
 t as (select tier, arg_max(bad, (logged_at, fetch_id)) as failures, max(bad) >= 10 as tripped from n group by tier)
 select tier, failures, case when tripped or failures < 3 then 0 when failures < 6 then 120 else 300 end as pause_s, case when tripped then 'TRIPPED' when failures >= 3 then 'OPEN' else 'CLOSED' end as state from t""")
def t06(s, d):
    f, path, out = table(s, d, "fetch_result", "fetch_id", "tier", "success", "logged_at").filter("tier is not null"), folder(s), folder(s)
    f.repartition(4).write.parquet(path)  # rows arrive in no order
    stateful.drain_batches(stateful.breaker(stateful.read_stream(s, path, s.read.parquet(path), 100), "tier", "success", ["logged_at", "fetch_id"]), lambda b, i: b.write.mode("append").parquet(out), out + "-state")
    return s.read.parquet(out)


@R.query("t13_stage_durations", "select user_id, min(ts) filter (where event_type = 'click') as started, max(ts) filter (where event_type = 'purchase') as ended, cast(floor(epoch(max(ts) filter (where event_type = 'purchase'))) - floor(epoch(min(ts) filter (where event_type = 'click'))) as bigint) as seconds from events group by user_id")
def t13(s, d):
    path, e = _events_folder(s, d)
    out = folder(s)
    marks = stateful.read_stream(s, path, e, 2).withColumn("event", F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "end"))
    stateful.drain_batches(stateful.stage_durations(marks, "user_id", "event", "ts"), lambda b, i: b.write.mode("overwrite").parquet(out), out + "-state", "complete")
    return s.read.parquet(out)


@R.query("t15_stream_windows", "select event_type, count(*) as n from events group by event_type")
def t15(s, d):
    path, e = _events_folder(s, d)
    out = folder(s)
    windows = stateful.windowed_counts(stateful.read_stream(s, path, e.withColumn("ts", F.col("ts").cast("timestamp")), 4), "ts", "1 hour", ["event_type"], "3650 days")
    stateful.drain_batches(windows, lambda b, i: b.write.mode("overwrite").parquet(out), out + "-state", "complete")
    return s.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"))


QUERIES, SQL = R.queries, R.sql
