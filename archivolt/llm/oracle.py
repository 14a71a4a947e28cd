"""SQL of the operators that SQL can express over whole tables."""

_WORDS = "trim(regexp_replace(lower(url_decode(replace({}, '+', ' '))), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g'))"
_NO_SCHEME = "regexp_replace({}, '^[^\\p{{L}}\\p{{N}}]*https?\\s*(:|%3a)', '', 'i')"


def words(c: str) -> str:
    return _WORDS.format(c)


def address(c: str) -> str:
    path = words(f"split_part({_NO_SCHEME.format(c)}, '?', 1)")
    query = f"case when strpos({c}, '?') > 0 then substr({c}, strpos({c}, '?') + 1) else '' end"
    name, value = words("split_part(f, '=', 1)"), words("case when strpos(f, '=') > 0 then substr(f, strpos(f, '=') + 1) else '' end")
    fields = f"list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array({query}, '[&;?]'), lambda f: {name} || '=' || {value}), lambda x: x <> '=')))"
    return f"{path} || '?' || array_to_string({fields}, '&')"


def _copies(table: str, key: str, url: str, more: str = "''") -> str:
    return f"select '{table}' as src_table, first_id, {key} as copy_id from (select {key}, min({key}) over (partition by k) as first_id from (select {key}, {address(url)} || '|' || {more} as k from {table} where trim({url}, ' \t\n\r') <> '') a) b where {key} <> first_id"


def _counts(table: str, key: str, url: str, more: str = "''") -> str:
    return f"select '{table}' as src_table, min({key}) as first_id, count(*) as n_copies from {table} where trim({url}, ' \t\n\r') <> '' group by {address(url)} || '|' || {more} having count(*) > 1"


P5_COUNTS = _counts("index_entry", "entry_id", "original_url", words("coalesce(slug, '')")) + " union all " + _counts("entities", "entity_id", "canonical_url")
P5 = _copies("index_entry", "entry_id", "original_url", words("coalesce(slug, '')")) + " union all " + _copies("entities", "entity_id", "canonical_url")

_ROWS = f"select cat_id, {words('slug')} as g, coalesce(trim(date_seen), '') as seen, coalesce((select max(snapshot_count) from index_entry i where i.entry_id = c.entry_id), -1) as trust, trim(coalesce(name, '')) <> '' as has_name, coalesce(price <> 0 and not isnan(price), false) as has_price, coalesce(len(images), 0) as n_images from catalog_entry c where {words('slug')} <> ''"
_GROUPED = f"select *, min(cat_id) over (partition by g) as first_id, count(*) over (partition by g) as size from ({_ROWS}) r"
_FIELDS = " union all ".join(f"select first_id, '{f}' as field_name, cat_id, seen, trust, {n} as n from ({_GROUPED}) g where size > 1 and {ok}" for f, ok, n in (("name", "has_name", "0"), ("price", "has_price", "0"), ("images", "n_images > 0", "n_images")))
P7 = f"with e as ({_FIELDS}) select first_id, field_name, cat_id from e a where not exists (select 1 from e b where b.first_id = a.first_id and b.field_name = a.field_name and b.cat_id <> a.cat_id and (b.seen > a.seen or b.trust > a.trust or b.n > a.n or (b.seen = a.seen and b.trust = a.trust and b.n = a.n)))"
_PICK = "max(case when field_name = '{0}' then e.cat_id end) as {0}_from, max(case when field_name = '{0}' then c.{0} end) as {0}"
P7_SURVIVORS = f"with e as (select first_id, field_name, cat_id from ({_FIELDS}) f qualify row_number() over (partition by first_id, field_name order by seen desc, trust desc, n desc, cat_id) = 1) select first_id, {', '.join(_PICK.format(f) for f in ('name', 'price', 'images'))} from e join catalog_entry c on c.cat_id = e.cat_id group by first_id"

_GRAMS = "select {id}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(list_slice(w, i, i + 11), ' '))) as g from (select {id}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+') as w from {table} where {text} is not null) t where len(w) >= 12"
P8 = f"select distinct doc_id, item_id from ({_GRAMS.format(id='doc_id', text='text', table='documents')}) d join ({_GRAMS.format(id='item_id', text='item_text', table='eval_item')}) i using (g)"
P8_LEAKS = P8.replace("select distinct doc_id, item_id", "select doc_id, item_id, count(distinct g) as n_shared") + " group by doc_id, item_id"

SQL = {"p5_found": P5, "p5_counts": P5_COUNTS, "p7_found": P7, "p7_survivors": P7_SURVIVORS, "p8_found": P8, "p8_leaks": P8_LEAKS}
