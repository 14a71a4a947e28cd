"""Queries of the remaining sources, sinks, merges and control operators; files go through the shared folder and back."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions import pages, scalars, urls
from archivolt.operators import catalog, ledger
from archivolt.plans._base import Registry
from archivolt.plans.functions import folder
from archivolt.sources import readers, writers
from archivolt.streaming import stateful
from archivolt.tables import table

R = Registry()
L = F.lit
# what a text file makes of values with tabs and line ends, computed line by line
_ROW = "'w' || {0} || capture_ts || {0} || original_url || {0} || '200' || {0} || regexp_replace(coalesce(content_type, 'unk'), '\\s', '', 'g')"
_LINES = f"(select unnest(regexp_split_to_array({_ROW}, '\\r\\n|\\n|\\r')) as v from index_entry)"
_TABS = f"select p[2] as ts, p[3] as original_url, p[5] as mime from (select string_split(v, chr(9)) as p from {_LINES.format('chr(9)')} x) t where len(p) >= 5"
_BLANKS = "select p[2] as ts, p[3] as original_url, p[5] as mime from (select case when len(string_split(v, chr(9))) >= 5 then string_split(v, chr(9)) else regexp_split_to_array(trim(v), '\\s+') end as p from " + _LINES.format("'  '") + " x) t where len(p) >= 5"


def index(s, d) -> DataFrame:
    return table(s, d, "index_entry", "entry_id", "capture_ts", "original_url", "content_type").select("entry_id", "capture_ts", "original_url", F.coalesce("content_type", L("unk")).alias("mime"))


def captures_file(s, d, sep: str = "\t") -> str:
    path = folder(s)
    writers.write_lines(index(s, d).select(F.concat_ws(sep, L("w"), "capture_ts", "original_url", L("200"), F.regexp_replace("mime", r"\s", "")).alias("line")).unionByName(s.createDataFrame([("a\tshort",)], "line string")), "line", path)
    return path


@R.query("s01_capture_lines", _TABS)
def s01(s, d):
    return readers.capture_lines(s, captures_file(s, d), whitespace_fallback=False).select("ts", "original_url", "mime")


@R.query("s02_whitespace_fallback", _BLANKS)
def s02(s, d):
    return readers.capture_lines(s, captures_file(s, d, "  ")).select("ts", "original_url", "mime")


@R.query("s06_several_files", _TABS + " union all " + _TABS)
def s06(s, d):
    return readers.capture_lines(s, [captures_file(s, d), captures_file(s, d)], whitespace_fallback=False).select("ts", "original_url", "mime")


def pages_folder(s, d) -> str:
    """The index as a server's pages: JSON with a header, JSON without, plain lines; and an empty page."""
    i = index(s, d).withColumn("mime", F.regexp_replace("mime", r"\s", ""))
    i = i.withColumn("kind", F.col("entry_id") % 3).withColumn("page", readers.paged(i, "entry_id"))
    row = F.when(F.col("kind") < 2, F.to_json(F.array("capture_ts", "original_url", L("200"), "mime"))).otherwise(F.concat_ws(" ", "capture_ts", "original_url", L("200"), "mime"))
    body = i.groupBy("kind", "page").agg(F.when(F.first("kind") < 2, F.array_join(F.collect_list(row), ",")).otherwise(F.array_join(F.collect_list(row), "\n")).alias("b"))
    text = F.when(F.col("kind") == 0, F.concat(L('[["timestamp","original","statuscode","mimetype"],'), "b", L("]"))).when(F.col("kind") == 1, F.concat(L("["), "b", L("]"))).otherwise(F.col("b"))
    path = folder(s)
    out = body.select(text.alias("value")).unionByName(s.createDataFrame([("",), ("[]",), ('{"error":1}',)], "value string"))
    out.repartition(8).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    return path


_PAGES = """(select capture_ts as timestamp, original_url as original, regexp_replace(coalesce(content_type, 'unk'), '\\s', '', 'g') as mimetype from index_entry where entry_id % 3 < 2
 union all select p[1], p[2], p[4] from (select regexp_split_to_array(trim(v, chr(9) || chr(10) || ' '), '\\s+') as p from (select unnest(string_split(capture_ts || ' ' || original_url || ' 200 ' || regexp_replace(coalesce(content_type, 'unk'), '\\s', '', 'g'), chr(10))) as v from index_entry where entry_id % 3 = 2) l) t where len(p) >= 4 and regexp_matches(p[1], '^[0-9]+$'))"""


def paged_source(s, d, **options: str) -> DataFrame:
    return readers.paged_captures(s, pages_folder(s, d), **options)


@R.query("s03_index_pages", f"select timestamp, original, mimetype from {_PAGES} p")
def s03(s, d):
    return paged_source(s, d).select("timestamp", "original", "mimetype")


@R.query("s04_scan_plan", "select entity_id, case entity_id % 4 when 0 then host || '/*' when 1 then host || '/shop' when 2 then 'https://' || host || '/*' else 'https://' || host || '/' end as url, case when entity_id % 2 = 0 then 'domain' else 'prefix' end as kind, case when entity_id % 7 > 0 then entity_id % 7 end as pages from entities")
def s04(s, d):
    k, n = F.col("entity_id") % 4, F.col("entity_id") % 7
    address = F.concat(F.when(k >= 2, "https://").otherwise(""), "host", F.when(k == 1, "/shop").when(k == 3, "/").otherwise(""))
    answer = F.when(n > 0, F.concat(L(" "), n.cast("string"), L(" pages of 9\n"))).otherwise("none")
    return table(s, d, "entities", "entity_id", "host").select("entity_id", readers.scan_query(address).alias("q"), readers.page_count(answer).alias("pages")).select("entity_id", "q.url", "q.kind", "pages")


@R.query("s05_time_window", f"select timestamp, original from {_PAGES} p where timestamp >= '2014' and substr(timestamp, 1, 6) <= '201806' and timestamp >= '201501'")
def s05(s, d):
    return paged_source(s, d, **{"from": "2014", "to": "201806"}).filter("timestamp >= '201501'").select("timestamp", "original")


@R.query("s07_collapsed_pages", "select urlkey, count(*) as n from (select distinct 'k' || c_nationkey as urlkey from customer) t group by urlkey")
def s07(s, d):
    path, c = folder(s), table(s, d, "customer", "c_custkey", "c_nationkey")
    rows = c.select(readers.paged(c, "c_custkey").alias("p"), F.concat(L('["k'), F.col("c_nationkey").cast("string"), L('","1","o","m","200","d","1"]')).alias("r"))
    page = rows.groupBy("p").agg(F.concat(L('[["urlkey","timestamp","original","mimetype","statuscode","digest","length"],'), F.array_join(F.collect_list("r"), ","), L("]")).alias("value"))
    page.select("value").repartition(4).write.option("maxRecordsPerFile", 1).text(path)
    return readers.extended_captures(s, path).groupBy("urlkey").agg(F.count("*").alias("n"))


@R.query("s08_status_lines", "select fetch_id, tier from fetch_result where success")
def s08(s, d):
    path = folder(s)
    f = table(s, d, "fetch_result", "fetch_id", "tier", "success").select(F.to_json(F.struct("fetch_id", "tier", F.when(F.col("success"), "200").otherwise("500").alias("status"))).alias("value"))
    f.unionByName(s.createDataFrame([("{broken",)], "value string")).write.text(path)
    return readers.json_lines(s, path, "fetch_id long, tier string, status string").filter("status = '200'").select("fetch_id", "tier")


@R.query("s09_fetch_lines", "select fetch_id, success, size from fetch_result")
def s09(s, d):
    path = folder(s)
    writers.write_json(table(s, d, "fetch_result", "fetch_id", "success", "size"), path)
    return readers.json_lines(s, path, "fetch_id long, success boolean, size long")


@R.query("s10_product_documents", "select 'level' || n_regionkey as level, 'n' || n_nationkey as product, n_name as name from nation where n_nationkey % 5 < 3")
def s10(s, d):
    path = folder(s)
    jvm = s.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    for r in table(s, d, "nation").collect():  # 25 rows
        level = ("", "", "", "_skip/", ".hidden/")[r["n_nationkey"] % 5] + f"level{r['n_regionkey']}"
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{level}/n{r['n_nationkey']}/canonical.json"))
        out.write(bytearray(("{\n \"name\": \"" + r["n_name"] + "\"\n}").encode()))
        out.close()
    return readers.product_documents(s, path, "name string").select("level", "product", "name")


@R.query("s11_binary_files", "select count(*) as n, sum(length(r_name) + 1) as bytes from region")
def s11(s, d):
    path = folder(s)
    table(s, d, "region", "r_regionkey", "r_name").repartition(1).select(F.col("r_name").alias("value")).write.text(path)
    f = readers.binary_files(s, path, "part-*.txt").select(F.explode(F.split(F.decode("content", "utf-8"), "\n")).alias("line")).filter("line <> ''")
    return f.agg(F.count("*").alias("n"), F.sum(F.length("line") + 1).alias("bytes"))


@R.query("s14_seed_rows", "select n_nationkey as id, n_name as v from nation union all select * from (values (100, 'a'), (101, 'b')) t(id, v)")
def s14(s, d):
    rows = table(s, d, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("v"))
    return ledger.insert_ignore(rows, s.sql("select * from values (100, 'a'), (101, 'b'), (101, 'b'), (3, 'taken') as t(id, v)"), ["id"])


@R.query("s15_packets", "select l_orderkey as pts, case when l_linenumber > 1 then l_partkey end as dts, cast(l_suppkey as bigint) as duration from lineitem")
def s15(s, d):
    path = folder(s)
    li = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    writers.write_lines(li.select(F.concat_ws(",", L("0"), F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") > 1, F.col("l_partkey").cast("string")).otherwise("N/A"), F.col("l_suppkey").cast("string"), L("K")).alias("line")), "line", path)
    return readers.packets(s, path).select("pts", "dts", "duration")


@R.query("s21_rule_config", "select p_partkey, case when p_size <= 10 then 'small' when p_type = 'PROMO' then 'promo' else 'late' end as era from part")
def s21(s, d):
    config = {"era_rules": [{"condition": "timestamp_year <= 10", "era": "small"}, {"condition": "url_type == 'PROMO'", "era": "promo"}, {"condition": "default", "era": "late"}]}
    return table(s, d, "part", "p_partkey", "p_size", "p_type").select("p_partkey", urls.era(F.col("p_type"), F.lpad(F.col("p_size").cast("string"), 4, "0"), config["era_rules"]).alias("era"))


@R.query("s23_archive_records", "select 'n' || n_nationkey as path, case when n_nationkey % 4 > 0 then 'HTTP/1.1 200 ' || n_name end as http_header, case when n_nationkey % 4 > 0 then repeat(n_name, 3) end as body from nation")
def s23(s, d):
    import gzip

    def packed(frames):
        for f in frames:
            made = [gzip.compress(f"WARC/1.0\r\nA: b\r\n\r\nHTTP/1.1 200 {n}\r\n\r\n{n * 3}".encode()) if k % 4 else b"broken" for k, n in zip(f["k"], f["n"])]
            yield f.assign(path="n" + f["k"].astype(str), content=made)[["path", "content"]]

    files = table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_name").alias("n")).mapInPandas(packed, "path string, content binary")
    return readers.record_bodies(files).select("path", "http_header", F.col("body").cast("string").alias("body"))


@R.query("s25_sitemap_union", "select distinct host, 'https://' || host || '/p' as loc from entities where host is not null")
def s25(s, d):
    h = table(s, d, "entities", "host").filter("host is not null").distinct()
    body = F.concat(L("<loc>https://"), "host", L("/p</loc><image:loc>https://"), F.col("host"), L("/p</image:loc>"))
    return h.select("host", F.explode(F.array_distinct(pages.sitemap_locs(body))).alias("loc"))


@R.query("s26_product_pages", "select trim(lower(slug), '/') as slug, count(*) as n from catalog_entry where trim(lower(slug), '/') <> '' group by 1")
def s26(s, d):
    path, c = folder(s), table(s, d, "catalog_entry", "slug", "cat_id")
    page = c.groupBy(readers.paged(c, "cat_id", 250).alias("p")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("slug").alias("handle"))).alias("products"))).alias("value"))
    page.select("value").write.text(path)
    return s.read.text(path).select(F.explode(pages.products_json(F.col("value"))).alias("p")).groupBy(F.col("p.handle").alias("slug")).agg(F.count("*").alias("n"))


_SAFE = "regexp_replace(replace(u, 'https://', ''), '[<>:\"/\\\\|?*]', '_', 'g') || '.html'"


@R.query("s27_cached_import", f"""with c as (select cat_id, cat_id % 4 as k, url, regexp_extract(url, '^https://([^/]+)/', 1) as host from catalog_entry), u as (select *, case when k = 0 then url when k = 1 then 'https://' || host || '/' || replace(regexp_replace(url, '^https://[^/]+/', ''), '_', '/') when k = 2 then url || '?c' end as u from c),
 n as (select *, case k when 0 then 'page' || cat_id || '.html' when 1 then replace(replace(url, 'https://', ''), '/', '_') || '.html' else 'unknown_' || cat_id || '.html' end as name, {_SAFE} as safe from u where u is not null),
 have as (select {_SAFE.replace('u,', 'url,')} as safe, max(case when cat_id % 2 = 0 then 10 else 1000000 end) as size from c where cat_id % 5 = 0 group by 1)
 select cat_id, u as original_url, case when k = 1 then 'filename' else 'canonical' end as found_by from n left join have using (safe) where coalesce(have.size, 0) < 11""")
def s27(s, d):
    c = table(s, d, "catalog_entry", "cat_id", "url").withColumn("k", F.col("cat_id") % 4)
    name = F.when(F.col("k") == 0, F.concat(L("page"), F.col("cat_id").cast("string"), L(".html"))).when(F.col("k") == 1, F.concat(F.replace(F.replace("url", L("https://"), L("")), L("/"), L("_")), L(".html"))).otherwise(F.concat(L("unknown_"), F.col("cat_id").cast("string"), L(".html")))
    page = F.when(F.col("k") == 0, F.concat(L('<html><LINK rel="canonical" href="https://web.archive.org/web/2019id_/'), "url", L('">'))).when(F.col("k") == 2, F.concat(L("<link media=x rel=canonical href='"), "url", L("?c'>"))).otherwise("<html></html>")
    files = c.select("cat_id", name.alias("name"), F.encode(page, "utf-8").alias("content"))
    hosts = c.select(urls.host(F.col("url")).alias("domain")).distinct()
    short = hosts.select(F.substring_index("domain", ".", -2).alias("domain"))
    have = c.filter("cat_id % 5 = 0").select(urls.safe_filename(F.col("url")).alias("name"), F.when(F.col("cat_id") % 2 == 0, 10).otherwise(1_000_000).alias("size"))
    got = readers.cached_import(files, hosts.unionByName(short), have)
    return files.select("cat_id", "name").join(got, "name").select("cat_id", "original_url", "found_by").distinct()


# ---- sinks
@R.query("k02_sorted_list", "select unnest(regexp_split_to_array(slug, '\\r\\n|\\n|\\r')) as value from (select distinct slug from catalog_entry where slug is not null) t")
def k02(s, d):
    path = folder(s)
    writers.write_lines(table(s, d, "catalog_entry", "slug").filter("slug is not null").distinct(), "slug", path, one_file=True, ordered=True)
    return s.read.text(path)


@R.query("k04_catalog_json", "select cat_id, price, len(images) as n from catalog_entry")
def k04(s, d):
    path = folder(s)
    writers.write_json(table(s, d, "catalog_entry", "cat_id", "price", "images"), path)
    return readers.json_lines(s, path, "cat_id long, price double, images array<string>").select("cat_id", "price", F.size("images").alias("n"))


@R.query("k05_append_log", "select event_type, count(*) * 2 as n from events group by event_type")
def k05(s, d):
    path, e = folder(s), table(s, d, "events", "event_id", "event_type")
    writers.write_json(e, path, mode="append")
    writers.write_json(e, path, mode="append")
    return readers.json_lines(s, path, "event_id long, event_type string").groupBy("event_type").agg(F.count("*").alias("n"))


@R.query("k08_report", "select '| ' || r_regionkey || ' | ' || r_name || ' |' as line from region")
def k08(s, d):
    text = writers.markdown(table(s, d, "region", "r_regionkey", "r_name"))
    return s.createDataFrame([(x,) for x in text.split("\n")[2:]], "line string")


@R.query("k10_provenance", "select 'archivolt' as tool, '1' as version, '2024-01-01' as written_at, (select count(*) from (describe select * from supplier)) as fields")
def k10(s, d):
    p = writers.provenance(table(s, d, "supplier"), "archivolt", "1", "2024-01-01")
    return p.select("tool", "version", "written_at", F.json_array_length(F.get_json_object("schema", "$.fields")).cast("long").alias("fields"))


@R.query("k11_export", "select n_name from nation order by n_name")
def k11(s, d):
    path = folder(s)
    writers.write_json(table(s, d, "nation", "n_name").orderBy("n_name"), path)
    return readers.json_lines(s, path, "n_name string")


@R.query("k14_manifest", "select (select count(*) from region) as regions, 'run' as label")
def k14(s, d):
    m = writers.dossier(regions=table(s, d, "region")).select(F.to_json(F.struct(F.from_json("regions", "array<struct<r_name:string>>").alias("regions"), L("run").alias("label"))).alias("doc"))
    return m.select(F.json_array_length(F.get_json_object("doc", "$.regions")).cast("long").alias("regions"), F.get_json_object("doc", "$.label").alias("label"))


# ---- ladders and precedence
@R.query("m03_residual", "select s_suppkey, case when x <= -90 then 'pass' when x <= -60 then 'smell' else 'fail' end as verdict from (select s_suppkey, -(s_suppkey % 120) as x from supplier) t")
def m03(s, d):
    return table(s, d, "supplier", "s_suppkey").select("s_suppkey", scalars.residual_verdict(-(F.col("s_suppkey") % 120)).alias("verdict"))


@R.query("m04_mono_fold", "select s_suppkey, case when x <= 3 then 'mono_compatible' when x <= 6 then 'mono_partial_cancellation' when x <= 12 then 'mono_phase_warning' else 'mono_phase_severe' end as verdict from (select s_suppkey, s_suppkey % 15 as x from supplier) t")
def m04(s, d):
    return table(s, d, "supplier", "s_suppkey").select("s_suppkey", scalars.mono_fold(F.col("s_suppkey") % 15).alias("verdict"))


@R.query("m14_pan_precedence", "select s_suppkey, greatest(-1, least(1, coalesce(case when s_suppkey % 3 = 0 then s_acctbal / 100 end, case when s_suppkey % 3 = 1 then 0.5 end, 0))) as pan from supplier")
def m14(s, d):
    k = F.col("s_suppkey") % 3
    v = scalars.layered(F.when(k == 0, F.col("s_acctbal") / 100), F.when(k == 1, 0.5), L(0.0))
    return table(s, d, "supplier", "s_suppkey", "s_acctbal").select("s_suppkey", F.greatest(L(-1.0), F.least(L(1.0), v)).alias("pan"))


@R.query("o10_demotion", "select o_custkey, arg_min(o_orderkey, p * 1e15 - floor(o_totalprice) * 1e6 + o_orderkey) as url from (select *, case when o_orderstatus = 'F' then 5 when o_orderpriority like '1%' then 2 else 3 end as p from orders where o_totalprice >= 1024) t group by o_custkey")
def o10(s, d):
    o = table(s, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    fmt = F.when(F.col("o_orderstatus") == "F", "webp").when(F.col("o_orderpriority").startswith("1"), "png").otherwise("jpg")  # demoted first, then chosen once
    c = o.select("o_custkey", F.col("o_orderkey").alias("ordinal"), fmt.alias("fmt"), F.floor("o_totalprice").alias("size"), F.col("o_orderkey").alias("url"), L("a").alias("source"))
    return catalog.select_best(c, "o_custkey", ratio=1 << 40).select("o_custkey", "url")


@R.query("o11_healthy_pick", "select tier from (select tier, avg(case when success then 0.0 else 1.0 end) as rate, max(case when success then 1 else 0 end) as closed from fetch_result where tier is not null group by tier) t order by closed desc, rate, tier limit 1")
def o11(s, d):
    return ledger.healthiest(table(s, d, "fetch_result", "tier", "success"), "tier", "success").limit(1).select("tier")


# ---- state, merges, guards
@R.query("t02_resumed_stream", "select count(*) as n from events")
def t02(s, d):
    path, out = folder(s), folder(s)
    e = table(s, d, "events", "event_id", "event_type")
    e.filter("event_id % 2 = 0").write.parquet(path)
    for _ in range(2):  # the second run takes only what is new
        stateful.drain(stateful.read_stream(s, path, e), out, out + "-state")
        e.filter("event_id % 2 = 1").write.mode("ignore" if _ else "append").parquet(path)
    return s.read.parquet(out).agg(F.count("*").alias("n"))


@R.query("t07_half_open", "select fetch_id, case when prev_bad >= 3 then 'HALF_OPEN' else 'CLOSED' end as state from (select fetch_id, coalesce(sum(case when success then 0 else 1 end) over (partition by tier order by logged_at, fetch_id rows between 3 preceding and 1 preceding), 0) as prev_bad from fetch_result) t")
def t07(s, d):
    w = Window.partitionBy("tier").orderBy("logged_at", "fetch_id").rowsBetween(-3, -1)
    bad = F.coalesce(F.sum((~F.col("success")).cast("int")).over(w), L(0))
    return table(s, d, "fetch_result", "fetch_id", "tier", "logged_at", "success").select("fetch_id", F.when(bad >= 3, "HALF_OPEN").otherwise("CLOSED").alias("state"))


@R.query("t12_lifecycle", "select case when resolved_at is null then 'open' else 'resolved' end as state, count(*) as n from entities group by 1")
def t12(s, d):
    return table(s, d, "entities", "resolved_at").groupBy(F.when(F.col("resolved_at").isNull(), "open").otherwise("resolved").alias("state")).agg(F.count("*").alias("n"))


@R.query("u09_link_union", "select host, count(distinct slug) as n from entities where host is not null and slug is not null group by host")
def u09(s, d):
    e = table(s, d, "entities", "host", "slug", "entity_id").filter("host is not null and slug is not null")
    m = writers.merged_links(e.filter("entity_id % 2 = 0"), e, "host", "slug")
    return m.select("host", F.size("links").cast("long").alias("n"))


@R.query("v08_swapped_version", "select count(*) as n from customer where c_acctbal > 0")
def v08(s, d):
    path, c = folder(s), table(s, d, "customer", "c_custkey", "c_acctbal")
    writers.replace_table(c, path)
    writers.replace_table(c.filter("c_acctbal > 0"), path)
    return s.read.parquet(path).agg(F.count("*").alias("n"))


@R.query("v22_write_guard", "select * from (values ('itself', true), ('below', true), ('beside', false), ('longer name', false)) t(place, refused)")
def v22(s, d):
    def refused(path: str) -> bool:
        try:
            return writers.guarded(path, (d,)) != path
        except PermissionError:
            return True

    return s.createDataFrame([(n, refused(p)) for n, p in (("itself", d), ("below", f"{d}/region.parquet"), ("beside", f"{folder(s)}/x"), ("longer name", f"{d}-copy/x"))], "place string, refused boolean")


@R.query("w18_first_seen", "select slug, arg_min(first_seen_in, entity_id) as first_seen_in from entities where first_seen_in is not null group by slug")
def w18(s, d):
    return ledger.first_known(table(s, d, "entities", "slug", "entity_id", "first_seen_in"), "slug", "entity_id", "first_seen_in")


@R.query("ar1_scalar_or_list", "select cat_id, unnest(case when cat_id % 2 = 0 then ['a', 'b'] else ['a'] end) as value from catalog_entry")
def ar1(s, d):
    c = table(s, d, "catalog_entry", "cat_id").withColumn("c", F.create_map(L("k"), F.when(F.col("cat_id") % 2 == 0, L('["a","b"]')).otherwise(L("a"))))
    return catalog.exploded_citations(c, "cat_id", "c").select("cat_id", "value")


@R.query("j37_already_present", "select distinct image from (select unnest(images) as image, cat_id from catalog_entry) t where image not in (select image from (select unnest(images) as image, cat_id from catalog_entry) u where cat_id % 3 = 0)")
def j37(s, d):
    i = table(s, d, "catalog_entry", "cat_id", "images").select("cat_id", F.explode("images").alias("image"))
    return i.join(i.filter("cat_id % 3 = 0").select("image"), "image", "left_anti").select("image").distinct()


# ---- extension points: rules as data
@R.query("g02_rules_as_data", "select slug, case when slug like 'a%' then 'first' when slug like '%mug%' then 'second' else 'rest' end as label from (select distinct slug from catalog_entry where slug is not null) t")
def g02(s, d):
    rules = (("^a", "first"), ("mug", "second"))  # ordered data, compiled to one expression
    label = L("rest")
    for pattern, name in reversed(rules):
        label = F.when(F.col("slug").rlike(pattern), name).otherwise(label)
    return table(s, d, "catalog_entry", "slug").filter("slug is not null").distinct().select("slug", label.alias("label"))


@R.query("g03_strategy_cascade", "select cat_id, coalesce(nullif(sku, ''), nullif(slug, ''), cast(cat_id as varchar)) as key from catalog_entry")
def g03(s, d):
    known = {"sku": F.nullif(F.col("sku"), L("")), "slug": F.nullif(F.col("slug"), L("")), "id": F.col("cat_id").cast("string")}
    wanted = [n for n in ("sku", "unheard-of", "slug", "id") if n in known]  # unknown names drop out
    return table(s, d, "catalog_entry", "cat_id", "sku", "slug").select("cat_id", F.coalesce(*[known[n] for n in wanted]).alias("key"))


@R.query("g07_paged_source", f"select mimetype, count(*) as n from {_PAGES} p where timestamp >= '2016' group by mimetype")
def g07(s, d):
    return paged_source(s, d, **{"from": "2016"}).groupBy("mimetype").agg(F.count("*").alias("n"))


QUERIES, SQL = R.queries, R.sql
