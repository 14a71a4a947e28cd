"""Queries over ordered events, ledger merges and audits."""

from pyspark.sql import functions as F

from archivolt.functions import urls
from archivolt.operators import ledger as L
from archivolt.operators import series as S
from archivolt.plans._base import Registry
from archivolt.tables import table

R = Registry()
both = R.both


def events(s, d):
    return table(s, d, "events").withColumn("sec", F.unix_timestamp("ts"))


E = "(select *, cast(floor(epoch(ts)) as bigint) as sec from events)"


@R.query("w03_delta_classes", f"select kind, count(*) as n from (select case when d < -4294967296 then 'wrap' when d < 0 then 'backward' when d = 0 then 'duplicate' when d > 0 then 'forward' end as kind from (select sec - lag(sec) over (partition by user_id order by value, event_id) as d from {E} e) t) u group by kind")
def w03(s, d):
    e = events(s, d).withColumn("o", F.struct("value", "event_id"))
    return S.delta_classes(e, "user_id", "o", "sec").groupBy("kind").agg(F.count("*").alias("n"))


@R.query("w04_gaps", f"select user_id, count(*) filter (where dd > 1.5 * f) as n_gaps, round(coalesce(sum(case when dd > 1.5 * f then dd - f end), 0), 4) as missing, min(case when dd > 1.5 * f then prev end) as first_gap from (select *, avg(dd) over (partition by user_id) as f from (select user_id, sec - lag(sec) over (partition by user_id order by event_id) as dd, lag(sec) over (partition by user_id order by event_id) as prev from {E} e) t) u group by user_id")
def w04(s, d):
    return S.gaps(events(s, d), "user_id", "event_id", "sec").withColumn("missing", F.round("missing", 4))


@R.query("w05_max_gap", f"select user_id, max(dd) as max_gap from (select user_id, sec - lag(sec) over (partition by user_id order by event_id) as dd from {E} e where event_type = 'click') t group by user_id")
def w05(s, d):
    return S.max_gap(events(s, d).filter("event_type = 'click'"), "user_id", "event_id", "sec")


@R.query("w06_rows_before", "select user_id, coalesce(min(case when event_type = 'purchase' then n end) - 1, count(*)) as before from (select *, row_number() over (partition by user_id order by event_id) as n from events) t group by user_id")
def w06(s, d):
    return S.rows_before(events(s, d), "user_id", "event_id", F.col("event_type") == "purchase")


@R.query("w07_longest_run", "select user_id, coalesce(max(case when f then n end), 0) as longest from (select user_id, f, i, count(*) as n from (select user_id, event_type = 'click' as f, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, event_type = 'click' order by event_id) as i from events) t group by user_id, f, i) u group by user_id")
def w07(s, d):
    return S.longest_run(events(s, d), "user_id", "event_id", F.col("event_type") == "click")


@R.query("w08_ramp_excursion", f"select user_id, round(max(x) - min(x), 6) as excursion from (select user_id, sec - (first_value(sec) over (partition by user_id order by event_id) + (row_number() over (partition by user_id order by event_id) - 1) * 60.0e0) as x from {E} e) t group by user_id")
def w08(s, d):
    return S.ramp_excursion(events(s, d), "user_id", "event_id", "sec", 60.0)


@R.query("w09_lookahead", "select a.event_id, exists(select 1 from (select *, row_number() over (partition by user_id order by event_id) as n from events) b where b.user_id = a.user_id and b.n between a.n + 1 and a.n + 6 and b.event_type = 'click' and b.value < a.value) as open from (select *, row_number() over (partition by user_id order by event_id) as n from events) a where a.event_type = 'purchase'")
def w09(s, d):
    return S.open_frames(events(s, d), "user_id", "event_id", "value", F.col("event_type") == "purchase", F.col("event_type") == "click").select("event_id", "open")


@R.query("w10_reorder", f"select user_id, count(*) filter (where b) as backward, count(*) filter (where sec <> event_id) as differ, max(abs(sec - event_id)) as max_offset from (select user_id, event_id, sec, sec < lag(sec) over (partition by user_id order by value, event_id) as b from {E} e) t group by user_id")
def w10(s, d):
    return S.reorder_scan(events(s, d).withColumn("o", F.struct("value", "event_id")), "user_id", "o", "sec", "event_id")


@R.query("w11_even_samples", f"select event_id, midpoint from (select event_id, (sec + lead(sec) over (partition by user_id order by event_id)) / 2.0 as midpoint, row_number() over (partition by user_id order by event_id) - 1 as i, greatest(cast(floor(count(*) over (partition by user_id) / 4.0) as bigint), 1) as step from {E} e) t where i % step = 0 and floor(i / step) < 4")
def w11(s, d):
    return S.evenly(events(s, d), "user_id", "event_id", "sec", 4).select("event_id", "midpoint")


@R.query("w12_span_skew", f"select user_id, max(sec) - min(sec) as span_a, max(event_id) - min(event_id) as span_b, (max(sec) - min(sec)) - (max(event_id) - min(event_id)) as skew, round((count(sec) - 1) / nullif(max(sec) - min(sec), 0), 8) as rate, count(*) filter (where sec is null) as missing from {E} e group by user_id")
def w12(s, d):
    return S.spans(events(s, d), "user_id", "sec", "event_id").withColumn("rate", F.round("rate", 8))


@R.query("w16_peak_neighbours", "select user_id, event_id, value as score, before, after from (select *, lag(value) over w as before, lead(value) over w as after, row_number() over (partition by user_id order by value desc, event_id) as r from events window w as (partition by user_id order by event_id)) t where r = 1")
def w16(s, d):
    return S.around_peak(events(s, d), "user_id", "event_id", "value")


@R.query("w17_blocks", "select event_id, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id) as block from events")
def w17(s, d):
    return S.blocks(events(s, d), "user_id", "event_id", F.col("event_type") == "purchase").select("event_id", "block")


@R.query("w20_adjacent", "select count(*) filter (where d = 0) as duplicates, count(*) filter (where d < 0) as backward from (select v - lag(v) over (partition by user_id order by event_id) as d from (select user_id, event_id, case when event_id % 7 = 0 then null else floor(value) end as v, row_number() over (partition by user_id order by event_id) as n from events) t where n <= 50) u")
def w20(s, d):
    e = events(s, d).withColumn("v", F.when(F.col("event_id") % 7 != 0, F.floor("value")))
    return S.adjacent_flags(e, "user_id", "event_id", "v", 50).agg(F.count_if(F.col("delta") == 0).alias("duplicates"), F.count_if(F.col("delta") < 0).alias("backward"))


@R.query("j24_as_of_backward", "select a.event_id, b.event_id as matched from (select * from events where event_type = 'purchase') a asof left join (select user_id, ts, max(event_id) as event_id from events where event_type = 'click' group by user_id, ts) b on a.user_id = b.user_id and a.ts >= b.ts")
def j24(s, d):
    e = table(s, d, "events")
    clicks = e.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return S.as_of(e.filter("event_type = 'purchase'"), clicks, "user_id", "ts", "event_id").select("event_id", "matched")


@R.query("j25_as_of_forward", "select a.event_id, b.event_id as matched from (select * from events where event_type = 'purchase') a asof left join (select user_id, ts, max(event_id) as event_id from events where event_type = 'click' group by user_id, ts) b on a.user_id = b.user_id and a.ts <= b.ts")
def j25(s, d):
    e = table(s, d, "events")
    clicks = e.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return S.as_of(e.filter("event_type = 'purchase'"), clicks, "user_id", "ts", "event_id", forward=True).select("event_id", "matched")


@R.query("j26_range_join", "select p_partkey, l.lo from part join (select n * 5 as lo, n * 5 + 2 as hi from (select unnest(range(0, 12)) as n) r) l on p_size between l.lo and l.hi")
def j26(s, d):
    i = s.range(12).select((F.col("id") * 5).alias("lo"), (F.col("id") * 5 + 2).alias("hi"))
    return S.range_join(table(s, d, "part", "p_partkey", "p_size"), i, "p_size", "lo", "hi", 8).select("p_partkey", "lo")


@R.query("j27_band_pairs", "select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_suppkey < b.s_suppkey and abs(a.s_acctbal - b.s_acctbal) <= 16")
def j27(s, d):
    return S.band_pairs(table(s, d, "supplier", "s_suppkey", "s_acctbal"), "s_suppkey", "s_acctbal", 16.0)


@R.query("j28_band_sizes", "select a.p as a, b.p as b from (select distinct p_size as p from part) a join (select distinct p_size as p from part) b on a.p < b.p and b.p - a.p <= 2")
def j28(s, d):
    return S.band_pairs(table(s, d, "part", "p_size").distinct().select(F.col("p_size").alias("k"), F.col("p_size").cast("double").alias("v")), "k", "v", 2.0)


@R.query("a20_histogram", "select event_type, value, n, rank from (select event_type, cast(floor(value) as bigint) as value, count(*) as n, row_number() over (partition by event_type order by count(*) desc, floor(value)) as rank from events group by event_type, floor(value)) t where rank <= 3")
def a20(s, d):
    return S.histogram(events(s, d), F.floor("value"), ["event_type"])


@R.query("a21_frequent_lines", "select event_type as value, count(*) as n, row_number() over (order by count(*) desc, event_type) as rank from events group by event_type qualify rank <= 3")
def a21(s, d):
    c = table(s, d, "events").groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(3)
    return S.histogram(c.select("value", F.explode(F.sequence(F.lit(1), F.lit(1))), "n").drop("col"), F.col("value")).drop("n").join(c, "value").select("value", "n", F.row_number().over(S.Window.orderBy(F.desc("n"), "value")).alias("rank"))


@R.query("a22_span_rate", f"select event_type, min(sec) as first, max(sec) as last, round((count(*) - 1) / nullif(max(sec) - min(sec), 0), 8) as rate from {E} e group by event_type")
def a22(s, d):
    return events(s, d).groupBy("event_type").agg(F.min("sec").alias("first"), F.max("sec").alias("last"), F.round(F.try_divide(F.count("*") - 1, F.max("sec") - F.min("sec")), 8).alias("rate"))


@R.query("a23_missing_ratio", "select tier, count(*) filter (where error is null or error = '') as missing, count(*) as n, round(count(*) filter (where error is null or error = '') / count(*), 6) as ratio from fetch_result group by tier")
def a23(s, d):
    m = F.count_if(F.coalesce(F.col("error"), F.lit("")) == "")
    return table(s, d, "fetch_result", "tier", "error").groupBy("tier").agg(m.alias("missing"), F.count("*").alias("n"), F.round(m / F.count("*"), 6).alias("ratio"))


@R.query("a29_index_percentiles", "select event_type, list_sort(list(value))[cast(least(floor(count(*) * 0.5), count(*) - 1) as bigint) + 1] as p50, list_sort(list(value))[cast(least(floor(count(*) * 0.95), count(*) - 1) as bigint) + 1] as p95, list_sort(list(value))[cast(least(floor(count(*) * 0.99), count(*) - 1) as bigint) + 1] as p99 from events group by event_type")
def a29(s, d):
    return S.index_percentile(table(s, d, "events", "event_type", "value"), "event_type", "value")


@R.query("a30_counter_map", "select tier, string_agg(method || '=' || n, ',' order by method) as counts from (select tier, method, count(*) as n from fetch_result group by tier, method) t group by tier")
def a30(s, d):
    c = table(s, d, "fetch_result", "tier", "method").groupBy("tier", "method").agg(F.count("*").alias("n"))
    m = c.filter("method is not null").groupBy("tier").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "n")))).alias("m"))
    return m.select("tier", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


both("a31_success_share", "select method, count(*) as n, count(*) filter (where success) as ok, round(100.0e0 * count(*) filter (where success) / count(*), 2) as pct from fetch_result group by method")
both("d06_age", "select fetch_id, datediff(date '2024-06-01', cast(logged_at as date)) as days from fetch_result", "select fetch_id, date_diff('day', cast(logged_at as date), date '2024-06-01') as days from fetch_result")

# ---- ledger
ATTEMPT = "(select original_url as url, logged_at as attempted_at, case when success then 'ok' when e like '%429%' or e like '%rate%' or e like '%throttle%' then 'throttle' when e like '%404%' or e like '%not found%' then 'http_404' when e like '%503%' or e like '%502%' or e like '%500%' or e like '%5xx%' then 'http_5xx' when e like '%timeout%' or e like '%timed out%' or e like '%dns%' or e like '%connection%' then 'network' when e like '%parse%' or e like '%invalid%' or e like '%corrupt%' then 'parse' else 'network' end as failure_class from (select *, lower(coalesce(error, '')) as e from fetch_result) f)"


def attempts(s, d):
    f = table(s, d, "fetch_result", "original_url", "logged_at", "success", "error")
    return f.select(F.col("original_url").alias("url"), F.col("logged_at").alias("attempted_at"), F.when(F.col("success"), "ok").otherwise(urls.fetch_failure(F.col("error"))["failure_class"]).alias("failure_class"))


@R.query("x34_failure_class", f"select failure_class, count(*) as n from {ATTEMPT} a group by failure_class")
def x34(s, d):
    return attempts(s, d).groupBy("failure_class").agg(F.count("*").alias("n"))


_LATEST = f"(select * from (select *, row_number() over (partition by url order by attempted_at desc, failure_class) as rn from {ATTEMPT} a) t where rn = 1)"


@R.query("w01_latest_attempt", f"select url, attempted_at, failure_class from {_LATEST} l")
def w01(s, d):
    return L.latest(attempts(s, d))


@R.query("w02_retry_exemplars", f"select url from {_LATEST} l where failure_class in ('throttle', 'network', 'http_5xx') order by url limit 20")
def w02(s, d):
    return L.retry_queue(attempts(s, d)).select("url").orderBy("url").limit(20)


@R.query("t05_breaker_batch", "select fetch_id, failures, pause_s from (select fetch_id, success, sum(case when success then 0 else 1 end) over (partition by tier, run order by logged_at, fetch_id) as failures, case when success then 0 when sum(case when success then 0 else 1 end) over (partition by tier, run order by logged_at, fetch_id) = 3 then 120 when sum(case when success then 0 else 1 end) over (partition by tier, run order by logged_at, fetch_id) = 6 then 300 else 0 end as pause_s from (select *, sum(case when success then 1 else 0 end) over (partition by tier order by logged_at, fetch_id) as run from fetch_result) r) t")
def t05(s, d):
    return L.breaker(table(s, d, "fetch_result", "fetch_id", "tier", "logged_at", "success"), "tier", ["logged_at", "fetch_id"], "success").select("fetch_id", "failures", "pause_s")


@R.query("t08_trailing_rate", """select fetch_id, len(r) as samples, case when len(r) >= 10 then round(len(list_filter(r, lambda x: not x.ok)) / len(r), 6) end as rate from (select fetch_id, list_filter(l, lambda x: x.sec >= sec - 120) as r from (select fetch_id, sec, list({'sec': sec, 'ok': success}) over (partition by tier order by sec, fetch_id rows between 49 preceding and current row) as l from (select *, epoch(logged_at) as sec from fetch_result) f) t) u""")
def t08(s, d):
    f = table(s, d, "fetch_result", "fetch_id", "tier", "logged_at", "success").withColumn("sec", F.unix_micros(F.col("logged_at").cast("timestamp")) / 1e6)
    return L.error_rate(f, "tier", "sec", "success", 120, 10, 50, "fetch_id").select("fetch_id", "samples", F.round("rate", 6).alias("rate"))


def _halves(s, d):
    c = table(s, d, "customer")
    old = c.filter("c_custkey % 3 <> 0").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")
    new = c.filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.lit("renamed")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.upper(F.lit("new")).alias("c_mktsegment"))
    return old, new


OLD = "(select c_custkey, c_name, case when c_custkey % 2 = 0 then c_acctbal end as c_acctbal, c_mktsegment from customer where c_custkey % 3 <> 0)"
NEW = "(select c_custkey, case when c_custkey % 4 = 0 then 'renamed' end as c_name, c_acctbal + 1 as c_acctbal, 'NEW' as c_mktsegment from customer where c_custkey % 2 = 0)"


@R.query("v01_upsert", f"select coalesce(o.c_custkey, n.c_custkey) as c_custkey, coalesce(n.c_name, o.c_name) as c_name, coalesce(n.c_acctbal, o.c_acctbal) as c_acctbal, coalesce(n.c_mktsegment, o.c_mktsegment) as c_mktsegment from {OLD} o full join {NEW} n on o.c_custkey = n.c_custkey")
def v01(s, d):
    return L.upsert(*_halves(s, d), ["c_custkey"])


@R.query("v02_upsert_mixed", f"select coalesce(o.c_custkey, n.c_custkey) as c_custkey, coalesce(n.c_name, o.c_name) as c_name, coalesce(o.c_acctbal, n.c_acctbal) as c_acctbal, coalesce(o.c_mktsegment, n.c_mktsegment) as c_mktsegment from {OLD} o full join {NEW} n on o.c_custkey = n.c_custkey")
def v02(s, d):
    return L.upsert(*_halves(s, d), ["c_custkey"], prefer_old=("c_acctbal", "c_mktsegment"))


@R.query("v03_upsert_overwrite", f"select coalesce(o.c_custkey, n.c_custkey) as c_custkey, case when n.c_custkey is not null then n.c_name else o.c_name end as c_name, case when n.c_custkey is not null then n.c_acctbal else o.c_acctbal end as c_acctbal, case when n.c_custkey is not null then n.c_mktsegment else o.c_mktsegment end as c_mktsegment from {OLD} o full join {NEW} n on o.c_custkey = n.c_custkey")
def v03(s, d):
    return L.upsert(*_halves(s, d), ["c_custkey"], overwrite=("c_name", "c_acctbal", "c_mktsegment"))


@R.query("v04_insert_ignore", f"select * from {OLD} o union all select * from {NEW} n where c_custkey not in (select c_custkey from {OLD} o)")
def v04(s, d):
    return L.insert_ignore(*_halves(s, d), ["c_custkey"])


@R.query("v05_insert_replace", "select url, \"at\", failure_class from (select original_url as url, date_trunc('second', logged_at) as \"at\", coalesce(error, '') as failure_class, row_number() over (partition by original_url, date_trunc('second', logged_at) order by fetch_id desc) as rn from fetch_result) t where rn = 1")
def v05(s, d):
    f = table(s, d, "fetch_result", "fetch_id", "original_url", "logged_at", "error").select(F.col("original_url").alias("url"), F.date_trunc("second", "logged_at").alias("at"), "fetch_id", F.coalesce("error", F.lit("")).alias("failure_class"))
    return L.last_per_key(f, ["url", "at"], [F.col("fetch_id")]).drop("fetch_id")


@R.query("v06_update", "select entity_id, coalesce(m.mark, resolved_at) as resolved_at from entities left join (select slug, max(date_seen) as mark from catalog_entry where date_seen is not null group by slug) m using (slug)")
def v06(s, d):
    marks = table(s, d, "catalog_entry", "slug", "date_seen").filter("date_seen is not null").withColumnRenamed("date_seen", "resolved_at")
    return L.update(table(s, d, "entities", "entity_id", "slug", "resolved_at"), marks, ["slug"], "resolved_at").select("entity_id", "resolved_at")


@R.query("v07_delete", "select entity_id from entities where host not in (select host from entities where first_seen_in = 'sitemap')")
def v07(s, d):
    e = table(s, d, "entities", "entity_id", "host", "first_seen_in")
    return L.delete(e, e.filter("first_seen_in = 'sitemap'"), ["host"]).select("entity_id")


_AUDIT = f"(select (select count(*) from entities where resolved_at is null) as unresolved_slugs, (select count(distinct host) from entities) - (select count(distinct host) from entities where first_seen_in = 'cdx') as unenumerated_hosts, (select count(*) from fetch_result where tier = 'collection' and not success) as unexpanded_surfaces, (select count(*) from {_LATEST} l where failure_class in ('throttle', 'network', 'http_5xx')) as retry_queue_depth)"


def _audit(s, d):
    e = table(s, d, "entities", "slug", "host", "resolved_at", "first_seen_in")
    hosts = e.groupBy("host").agg(F.max(F.when(F.col("first_seen_in") == "cdx", "x")).alias("cdx_dumped_at"))
    surfaces = table(s, d, "fetch_result", "tier", "success").filter("tier = 'collection'").withColumn("parsed_at", F.when(F.col("success"), "x"))
    return L.audit(e, hosts, surfaces, attempts(s, d))


@R.query("a18_audit", f"select *, unresolved_slugs + unenumerated_hosts + unexpanded_surfaces + retry_queue_depth as residual, case when unresolved_slugs + unenumerated_hosts + unexpanded_surfaces + retry_queue_depth = 0 then 'complete' else 'open' end as status from {_AUDIT} a")
def a18(s, d):
    return _audit(s, d)


@R.query("a19_next_stage", f"select bucket, value, stage from (select 'unenumerated_hosts' as bucket, unenumerated_hosts as value, 'cdx_dump' as stage, 0 as o from {_AUDIT} a union all select 'unresolved_slugs', unresolved_slugs, 'fetch', 1 from {_AUDIT} a union all select 'retry_queue_depth', retry_queue_depth, 'fetch', 2 from {_AUDIT} a) t where value > 0 order by value desc, o limit 1")
def a19(s, d):
    return L.next_stage(_audit(s, d))


both("t11_negative_cache", "select fetch_id, sum(case when success then 0 else 1 end) over (partition by tier order by logged_at, fetch_id rows between unbounded preceding and current row) as misses from fetch_result")
both("t14_unchanged", "select i.entry_id from index_entry i left anti join (select original_url as u, capture_ts as t from fetch_result where success) f on i.original_url = u and i.capture_ts = t", "select i.entry_id from index_entry i where not exists (select 1 from fetch_result f where success and f.original_url = i.original_url and f.capture_ts = i.capture_ts)")
both("t10_abandonment", "select tier, max(n) >= 3 as abandoned from (select tier, run, count(*) filter (where not success) as n from (select *, sum(case when success then 1 else 0 end) over (partition by tier order by logged_at, fetch_id) as run from fetch_result) r group by tier, run) t group by tier")

QUERIES, SQL = R.queries, R.sql
