"""Readers with explicit schemas; records of a wrong shape are skipped, not failed on."""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from archivolt.functions import urls
from archivolt.operators.capture import parse_lines

FETCH_RESULT = "original_url string, wayback_url string, timestamp string, tier string, success boolean, method string, size long, error string"


def capture_lines(spark: SparkSession, paths: str | list[str], whitespace_fallback: bool = True) -> DataFrame:
    """Capture lists; several paths or patterns, each file once, empty ones skipped."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    return parse_lines(lines.filter("size > 0"), "value", whitespace_fallback)


def extended_captures(spark: SparkSession, path: str) -> DataFrame:
    """Pages of JSON rows with a header row; one row per key."""
    names = ("urlkey", "timestamp", "original", "mimetype", "statuscode", "digest", "length")
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("r"))
    rows = rows.filter((F.size("r") >= 7) & (F.col("r")[0] != "urlkey")).select(*[F.col("r")[i].alias(n) for i, n in enumerate(names)])
    return rows.dropDuplicates(["urlkey"])


def json_lines(spark: SparkSession, path: str, schema: str = FETCH_RESULT) -> DataFrame:
    """Malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def product_documents(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Canonical.json files under root with the level and product of their path; folders with '_' or '.' first are pruned."""
    d = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "canonical.json").json(root)
    path = F.regexp_replace(F.col("_metadata.file_path"), "/canonical\\.json$", "")
    return d.withColumn("_path", path).filter(~F.regexp_replace("_path", "^.*" + root.rstrip("/").rsplit("/", 1)[-1], "").rlike("/[_.]")).withColumn("product", F.substring_index("_path", "/", -1)).withColumn("level", F.element_at(F.split("_path", "/"), -2))


def binary_files(spark: SparkSession, root: str, pattern: str = "*.{png,jpg,jpeg,tif,tiff,webp}") -> DataFrame:
    """Name, size and content of files by extension."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select(F.substring_index("path", "/", -1).alias("name"), "path", "length", "content")


def sql_source(spark: SparkSession, query: str, id_column: str) -> DataFrame:
    """A query as a keyed store: id, the row as JSON, and its digest."""
    d = spark.sql(query)
    rest = [c for c in d.columns if c != id_column]
    data = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    return d.select(F.col(id_column).cast("string").alias("id"), data.alias("data"), F.sha2(data, 256).alias("digest"))


def jdbc_source(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Needs the database's driver on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def packets(spark: SparkSession, path: str) -> DataFrame:
    """Packet rows with their order; N/A is null."""
    schema = "stream_index int, pts long, dts long, duration long, flags string"
    d = spark.read.schema(schema).option("nullValue", "N/A").csv(path)
    return d.withColumn("seq", F.monotonically_increasing_id())


def key_values(lines: DataFrame, column: str = "value") -> DataFrame:
    """S16: 'a=1|b=2' records as maps, in any order of fields."""
    return lines.select(F.expr(f"str_to_map({column}, '[|]', '=')").alias("kv"))


def sniffed_frames(lines: DataFrame, column: str = "value") -> DataFrame:
    """Fields found by what they look like: one number with a point, one letter I, P or B, one 0/1."""
    parts = F.split(column, ",")
    first = lambda p: F.try_element_at(F.filter(parts, lambda x: x.rlike(p)), F.lit(1))
    return lines.select(first(r"^-?\d+\.\d+$").try_cast("double").alias("ts"), first("^[IPB]$").alias("pict_type"), first("^[01]$").try_cast("int").alias("key_frame"))


def url_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trimmed, without blank lines and comments."""
    return lines.select(F.regexp_replace(column, r"^\s+|\s+$", "").alias("url")).filter("url <> '' and not startswith(url, '#')")


def sections(lines: DataFrame, order: str, column: str = "value", header: str = r"^[A-Z][A-Z ]+:\s*$") -> DataFrame:
    """Lines of a report with the section they stand in; lines before the first have none. One report per `path`."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy(order)
    is_head = F.col(column).rlike(header)
    s = lines.withColumn("section_no", F.sum(is_head.cast("int")).over(w)).withColumn("section", F.last(F.when(is_head, F.regexp_replace(column, r":\s*$", "")), True).over(w))
    return s.filter(~is_head)


def escape_table(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a pipe table with a rule name and a possible date; all others are ignored."""
    p = F.transform(F.split(column, r"\|"), lambda x: F.trim(x))
    t = lines.filter(F.size(p) >= 7).select(p[1].alias("esc_id"), F.replace(p[2], F.lit("`"), F.lit("")).alias("target"), p[3].alias("axiom"), p[4].alias("lines"), p[5].alias("expires"))
    ok = F.col("axiom").rlike("^ELA_[0-9]{3}$") & F.col("expires").rlike(r"^\d{4}-\d\d-\d\d$") & F.substring("expires", 6, 2).try_cast("int").between(1, 12) & F.substring("expires", 9, 2).try_cast("int").between(1, 31)
    return t.filter(ok)


def record_bodies(files: DataFrame) -> DataFrame:
    """(path, archive_header, http_header, body) of compressed archive records."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, c in zip(f["path"], f["content"]):
                try:
                    raw = gzip.decompress(c)
                except (OSError, EOFError):
                    rows.append((path, None, None, None))
                    continue
                head, _, rest = raw.partition(b"\r\n\r\n")
                http, _, body = rest.partition(b"\r\n\r\n")
                rows.append((path, head.decode("latin-1"), http.decode("latin-1"), body))
            yield pd.DataFrame(rows, columns=["path", "archive_header", "http_header", "body"])

    return files.select("path", "content").mapInPandas(run, "path string, archive_header string, http_header string, body binary")


def schema_enum(schema_text, field: str):
    """The allowed values of a property of a JSON schema."""
    return F.from_json(F.get_json_object(schema_text, f"$.properties.{field}.enum"), "array<string>")


def cached_import(files: DataFrame, domains: DataFrame, existing: DataFrame) -> DataFrame:
    """(name, original_url, tier, method, size, found_by) of saved pages to take over.

    files: (name, content), domains: (domain), existing: (name, size). The address is that of the page's
    canonical tag (a replay prefix goes), else that which a name 'domain_path' stands for (the longest domain,
    letter case aside), else the page is skipped; so is one that is there at no smaller size. Null content
    counts as empty; a file given twice comes out twice.
    """
    head = F.substring("content", 1, 65536).cast("string")
    tag = F.regexp_extract(head, r"(?i)<link[^>]*\brel\s*=\s*[\"']?canonical[\"']?[^>]*\bhref\s*=\s*[\"']?([^\"'>\s]+)", 1)
    f = files.select("name", F.octet_length(F.coalesce("content", F.lit(b""))).cast("long").alias("size"), F.regexp_replace(F.coalesce(tag, F.lit("")), r"^https?://web[.]archive[.]org/web/\d+(?:id_|im_|if_)?/", "").alias("canonical"), F.regexp_replace("name", r"[.]html$", "").alias("stem"))
    each = F.transform(F.filter(F.sequence(F.lit(1), F.length("stem")), lambda i: F.substring("stem", i, F.lit(1)) == "_"), lambda i: F.substring("stem", F.lit(1), i - 1))
    d = domains.select(F.lower("domain").alias("_d"), "domain").distinct()
    known = f.filter("canonical = '' and length(stem) > 0").select("stem", F.explode(each).alias("_p")).distinct().withColumn("_d", F.lower("_p")).join(d, "_d").groupBy("stem").agg(F.max_by("domain", F.struct(F.length("domain"), F.col("domain"))).alias("domain"))
    j = f.join(known, "stem", "left")
    path = F.replace(F.substring("stem", F.length("domain") + 2, F.lit(1 << 30)), F.lit("_"), F.lit("/"))
    j = j.withColumn("original_url", F.when(F.col("canonical") != "", F.col("canonical")).when(F.col("domain").isNotNull(), F.concat(F.lit("https://"), "domain", F.lit("/"), path))).filter("original_url is not null")
    j = j.withColumn("found_by", F.when(F.col("canonical") != "", "canonical").otherwise("filename")).withColumn("_safe", urls.safe_filename(F.col("original_url")))
    have = existing.groupBy(F.col("name").alias("_safe")).agg(F.max("size").alias("_have"))
    new = j.join(have, "_safe", "left").filter("_have is null or _have < size")
    return new.select("name", "original_url", urls.fetch_tier(F.col("original_url")).alias("tier"), F.lit("local_cache").alias("method"), "size", "found_by")


def paged(df: DataFrame, by: str, rows: int = 1000) -> Column:
    """A page number for each row, by hash, of about `rows` rows a page."""
    return F.pmod(F.xxhash64(by), F.lit(max(1, -(-df.count() // rows))))


def scan_query(address: Column) -> Column:
    """struct(url, kind) of an index query: by prefix below a path, else all of a domain."""
    path = F.regexp_replace(address, "^https?://", "").contains("/")
    return F.when(path, F.struct(address.alias("url"), F.lit("prefix").alias("kind"))).otherwise(F.struct(F.concat(address, F.lit("/*")).alias("url"), F.lit("domain").alias("kind")))


def page_count(answer: Column) -> Column:
    """The first number of an index server's answer, else null."""
    return F.regexp_extract(answer, r"(\d+)", 1).try_cast("int")


def page_rows(text: str) -> list[tuple[str, str, str, str]]:
    """(timestamp, original, status, type) of a page: JSON rows with or without a header, else lines of four fields or more that begin with digits."""
    text = text.strip()
    if not text:
        return []
    try:
        data = json.loads(text)
    except json.JSONDecodeError:
        return [tuple(p[:4]) for p in (line.split() for line in text.splitlines()) if len(p) >= 4 and p[0].isdigit()]
    if not isinstance(data, list) or not data:
        return []
    head = isinstance(data[0], list) and data[0][:2] == ["timestamp", "original"]
    rows = [tuple(str(x) for x in r[:4]) for r in data[head:] if isinstance(r, list) and len(r) >= 4]
    return [r for r in rows if r[0] and r[1]]


def paged_captures(spark: SparkSession, folder: str, **limits: str) -> DataFrame:
    """The pages under a folder as a table; turns on the push-down of filters to Python sources, which this one needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedCaptures)
    return spark.read.format("paged_captures").options(folder=folder, **limits).load()


class PagedCaptures(DataSource):
    """A paged capture index as a source, one partition per page.

    Pages are the files of a folder that all executors see, each as an index server answers; options 'from' and
    'to' limit the time, and comparisons of the timestamp that Spark pushes down (spark.sql.python.filterPushdown.enabled)
    limit it further, so no row beyond them leaves the reader.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_captures"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n in ("timestamp", "original", "statuscode", "mimetype")])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = re.sub("^file:/+", "/", options["folder"])
        self.low, self.high = options.get("from", ""), options.get("to", "")

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("timestamp",):
                self.low = max(self.low, str(f.value))
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("timestamp",) and not self.high:
                self.high = str(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = self._files()
        found = [i.path for i in files.get_file_info(fs.FileSelector(root)) if i.is_file and i.size and not i.base_name.startswith(("_", "."))]
        return [InputPartition(p) for p in sorted(found)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, _ = self._files()
        with files.open_input_stream(partition.value) as f:
            text = f.read().decode("utf-8", "replace")
        for r in page_rows(text):
            if r[0] >= self.low and (not self.high or r[0][: len(self.high)] <= self.high):
                yield r
