"""Relational core: filters, joins, groupings, set operations, sorting and paging."""

from archivolt.plans._base import Registry

R = Registry()
both = R.both

# filters and projections
both("f17_comparisons", "select o_orderkey, o_totalprice from orders where (o_totalprice >= 1000 and o_totalprice < 200000 and o_orderstatus <> 'P') or o_orderkey = 7")
both("f18_like", "select p_partkey, p_name from part where p_name ilike '%AB%' or p_name like '%z%'")
both("f19_in_list", "select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
both("f20_blank", "select meta_id, color from product_metadata where color is null or trim(color) = ''")
both("f21_date_shape", "select cat_id, date_seen from catalog_entry where date_seen rlike '^....-..-..$'", "select cat_id, date_seen from catalog_entry where date_seen glob '????-??-??'")
both("f22_predicate", "select cat_id, name from catalog_entry where price > 100 and currency = 'EUR'")
both("f23_array_contains", "select entry_id from index_entry where array_contains(all_types, 'atom')", "select entry_id from index_entry where list_contains(all_types, 'atom')")
both("p01_select", "select c_custkey as id, c_name as title, c_acctbal as balance from customer")
both("p05_drop_id", "select c_name, c_nationkey, c_acctbal, c_mktsegment from customer")

# joins
both("j01_inner", "select n_name, r_name from nation join region on n_regionkey = r_regionkey")
both("j02_left", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey")
both("j03_fan_out", "select o_orderkey, count(l.l_linenumber) as n, count(e.event_id) as m from orders left join lineitem l on l.l_orderkey = o_orderkey and l.l_returnflag = 'R' left join events e on e.user_id = o_custkey and e.event_type = 'purchase' group by o_orderkey")
both("j04_left_anti", "select c_custkey from customer left anti join orders on c_custkey = o_custkey and o_totalprice > 350000", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 350000)")
both("j05_inner_null", "select m.meta_id, s.sku from product_metadata m join sku_product s on m.matched_sku = s.sku where s.season is null")
both("j06_optional_link", "select c.cat_id, i.capture_ts from catalog_entry c left join index_entry i on c.entry_id = i.entry_id order by c.cat_id")
both("j08_semi", "select s_suppkey from supplier left semi join lineitem on l_suppkey = s_suppkey and l_quantity > 49", "select s_suppkey from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity > 49)")
both("j09_anti_slug", "select distinct i.slug from index_entry i left anti join product_metadata m on m.slug = i.slug", "select distinct i.slug from index_entry i where not exists (select 1 from product_metadata m where m.slug = i.slug)")
both("j10_promoted", """with missing as (select slug, min(canonical_url) as url from entities where slug not in (select slug from index_entry where slug is not null) group by slug)
 select slug, 'index' as origin, min(original_url) as url from index_entry group by slug union all select slug, 'ledger', url from missing""")
both("j13_full_outer", """select coalesce(a.k, b.k) as nationkey, case when a.k is null then 'supplier only' when b.k is null then 'customer only' when a.n <> b.n then 'differs' else 'same' end as drift, a.n as customers, b.n as suppliers
 from (select c_nationkey as k, count(*) as n from customer where c_acctbal > 9000 group by c_nationkey) a full outer join (select s_nationkey as k, count(*) as n from supplier group by s_nationkey) b on a.k = b.k""")
both("j35_metric_delta", "select a.k as segment, a.s - b.s as delta, case when abs(a.s - b.s) <= 10 then 'ok' else 'off' end as verdict from (select o_orderpriority as k, count(*) as s from orders group by o_orderpriority) a join (select o_orderpriority as k, count(*) as s from orders where o_orderstatus = 'F' group by o_orderpriority) b on a.k = b.k")

# aggregation
both("a01_filtered_counts", "select count(*) as entities, count(*) filter (where resolved_at is null) as unresolved, count(*) filter (where canonical_url is null) as without_url, count(distinct host) as hosts from entities")
both("a02_group_count", "select url_type, count(*) as n from index_entry group by url_type order by n desc, url_type")
both("a03_group_count", "select p_type, count(*) as n from part group by p_type")
both("a04_nullable_count", "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by c_custkey")
both("a05_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
both("a06_duplicates", "select slug, count(*) as n from product_metadata group by slug having count(*) > 1")
both("a07_distinct_list", "select slug, listagg(distinct currency, ',') within group (order by currency) as currencies from catalog_entry where currency is not null group by slug", "select slug, string_agg(distinct currency, ',' order by currency) as currencies from catalog_entry where currency is not null group by slug")
both("a08_distinct", "select distinct currency, gender from catalog_entry")
both("a16_tagged_counts", "select count(*) filter (where error is null) as ok, count(*) filter (where error = '') as blank, count(*) filter (where error <> '') as failed from fetch_result")
both("a17_completeness", "select count(*) as n, count(nullif(trim(name), '')) as name, count(nullif(trim(color), '')) as color, count(nullif(trim(era), '')) as era, count(nullif(trim(price), '')) as price, count(nullif(trim(description), '')) as description from product_metadata")
both("a24_host_census", "select host, count(*) as n from entities group by host order by n desc, host")
both("a32_group_rule", "select o_custkey, max(o_totalprice) as most, min(o_totalprice) filter (where o_orderstatus <> 'F') as least_open, bool_or(o_orderstatus = 'P') as any_pending from orders group by o_custkey")
both("a35_share", "select source, round(avg(case when n_chars >= 500 then 1.0e0 else 0.0e0 end), 6) as share, case when avg(case when n_chars >= 500 then 1.0 else 0.0 end) >= 0.5 then 'long' else 'short' end as kind from documents group by source")
both("a37_budget", "select source, sum(n_chars) as total, case when sum(n_chars) > 20000 then 'over' else 'within' end as verdict from documents group by source")
both("a38_year_summary", "select year(o_orderdate) as y, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by year(o_orderdate) order by y desc")
both("a40_pages", "select count(*) as total, cast(ceil(count(*) / 25.0) as bigint) as pages from part")
both("a41_worst_delta", "select round(max(abs(l_extendedprice - l_quantity * 1000)), 2) as worst from lineitem")
both("a42_verdicts", "select case when success then 'ok' when error = '' or error is null then 'unknown' else 'failed' end as verdict, count(*) as n from fetch_result group by 1")

both("a44_grouping_sets", "select url_type, era, count(*) as n, grouping(url_type) + 2 * grouping(era) as level from index_entry group by grouping sets ((url_type, era), (url_type), ())")

# sorting, limits
both("o01_multi_sort", "select p_partkey, p_brand, p_size from part order by p_brand desc, p_size asc, p_partkey")
both("o02_page", "select p_partkey, p_name from part order by p_name, p_partkey limit 25 offset 50")
both("o04_exemplars", "select slug, host from entities where resolved_at is null order by slug, host, entity_id limit 20")
both("o05_category_order", "select fetch_id, tier from fetch_result order by case tier when 'structured' then 0 when 'html' then 1 when 'collection' then 2 when 'homepage' then 3 else 4 end, fetch_id")
both("o06_head", "select fetch_id, original_url from fetch_result order by fetch_id limit 10")
both("o07_top_k", "select slug, count(*) as n from index_entry group by slug order by n desc, slug limit 10")
both("o08_recent_excluding", "select event_id, event_type from events where event_type not in ('error', 'view') order by ts desc, event_id limit 3")

# set operations
both("u01_union", "select host from entities where first_seen_in = 'cdx' union select host from entities where first_seen_in = 'sitemap'")
both("u02_except", "select host from entities where first_seen_in = 'cdx' except select host from entities where first_seen_in = 'sitemap'")
both("u03_intersect", "select host from entities where first_seen_in = 'cdx' intersect select host from entities where first_seen_in = 'sitemap'")
both("u04_worklist", "select distinct original_url from index_entry left anti join (select original_url as done from fetch_result where success) on original_url = done", "select distinct original_url from index_entry where original_url not in (select original_url from fetch_result where success)")
both("u05_new_hosts", "select host from entities except select host from entities where resolved_at is not null")
both("u07_layers", "select original_url as url, 'index' as layer from index_entry union all select original_url, 'log' from fetch_result union all select canonical_url, 'ledger' from entities where canonical_url is not null")
both("u08_gaps", "select slug from catalog_entry where image_count = 0 union select slug from product_metadata where slug not in (select slug from catalog_entry where slug is not null)")
both("u10_distinct_rows", "select distinct original_url, capture_ts, tier, success from fetch_result")
both("u12_sorted_union", "select slug from (select slug from catalog_entry union select slug from product_metadata) order by slug", "select slug from (select slug from catalog_entry union select slug from product_metadata) u order by slug")

# ranks and frames
both("w19_ranks", "select o_orderkey, rank() over w as r, dense_rank() over w as d, ntile(4) over (partition by o_orderpriority order by o_totalprice, o_orderkey) as q, round(cume_dist() over w, 8) as c, sum(o_totalprice) over (partition by o_orderpriority order by floor(o_totalprice) range between 1000 preceding and current row) as near from orders window w as (partition by o_orderpriority order by floor(o_totalprice / 1000))", "select o_orderkey, rank() over w as r, dense_rank() over w as d, ntile(4) over (partition by o_orderpriority order by o_totalprice, o_orderkey) as q, round(cume_dist() over w, 8) as c, sum(o_totalprice) over (partition by o_orderpriority order by floor(o_totalprice) range between 1000 preceding and current row) as near from orders window w as (partition by o_orderpriority order by floor(o_totalprice / 1000))")

# quality and constraints
both("v09_constraints", """select 'price not null' as rule, count(*) as n from catalog_entry where price is null union all select 'price positive', count(*) from catalog_entry where price <= 0 union all select 'currency known', count(*) from catalog_entry where currency not in ('USD', 'EUR', 'GBP')
 union all select 'slug unique', count(*) from (select slug from catalog_entry group by slug having count(*) > 1) t""")
both("v10_foreign_keys", "select 'catalog_entry.entry_id' as fk, count(*) as n from catalog_entry c left join index_entry i on c.entry_id = i.entry_id where i.entry_id is null union all select 'orders.o_custkey', count(*) from orders left join customer on o_custkey = c_custkey where c_custkey is null")
both("v11_quality_suite", """select 'orders without lines' as check_name, count(*) as n from orders left join lineitem on l_orderkey = o_orderkey where l_orderkey is null union all select 'lines without orders', count(*) from lineitem left join orders on l_orderkey = o_orderkey where o_orderkey is null
 union all select 'duplicate names', count(*) from (select c_name from customer group by c_name having count(*) > 1) d union all select 'missing names', count(*) from catalog_entry where name is null union all select 'blank names', count(*) from catalog_entry where trim(name) = ''
 union all select 'bad dates', count(*) from catalog_entry where date_seen is not null and length(date_seen) <> 10 union all select 'unlinked listings', count(*) from product_metadata where matched_sku is null""")
both("v12_check_status", "select check_name, n, case when n > 0 then 'warn' else 'ok' end as status from (select 'zero price' as check_name, count(*) as n from catalog_entry where price = 0 union all select 'no images', count(*) from catalog_entry where image_count = 0 union all select 'negative quantity', count(*) from lineitem where l_quantity < 0) c")
both("v17_coverage", "select p.cat_id, concat_ws(',', case when not (p.name <=> a.name) then 'name' end, case when not (p.brand <=> a.brand) then 'brand' end, case when not (p.color <=> a.color) then 'color' end) as mismatches from catalog_entry p join product_metadata a on a.meta_id = p.cat_id where not (p.name <=> a.name and p.brand <=> a.brand and p.color <=> a.color)", "select p.cat_id, concat_ws(',', case when p.name is distinct from a.name then 'name' end, case when p.brand is distinct from a.brand then 'brand' end, case when p.color is distinct from a.color then 'color' end) as mismatches from catalog_entry p join product_metadata a on a.meta_id = p.cat_id where p.name is distinct from a.name or p.brand is distinct from a.brand or p.color is distinct from a.color")
both("v18_date_proposal", "select c.cat_id, min(e.resolved_at) as proposed from catalog_entry c join entities e on e.slug = c.slug where c.date_seen is null and e.resolved_at is not null group by c.cat_id")
both("v19_changes", "select c.cat_id, case when m.color is null then 'drop' else 'set' end as change, m.color from catalog_entry c join product_metadata m on m.meta_id = c.cat_id where not (c.color <=> m.color)", "select c.cat_id, case when m.color is null then 'drop' else 'set' end as change, m.color from catalog_entry c join product_metadata m on m.meta_id = c.cat_id where c.color is distinct from m.color")
both("v20_verdict", "select tier, case when max(case when error rlike '^5|timed out' then 2 when error is not null and error <> '' then 1 else 0 end) = 2 then 'DAMAGED' when max(case when error is not null and error <> '' then 1 else 0 end) = 1 then 'FINDINGS' else 'CLEAN' end as verdict from fetch_result group by tier", "select tier, case when max(case when regexp_matches(error, '^5|timed out') then 2 when error is not null and error <> '' then 1 else 0 end) = 2 then 'DAMAGED' when max(case when error is not null and error <> '' then 1 else 0 end) = 1 then 'FINDINGS' else 'CLEAN' end as verdict from fetch_result group by tier")

QUERIES, SQL = R.queries, R.sql
