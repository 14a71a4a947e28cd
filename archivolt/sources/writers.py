"""Sinks. Spark's commit protocol makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def capture_line(ts: Column, original: Column, status: Column, mime: Column, archive: str) -> Column:
    """Five fields by tab, the replay address derived; null fields are empty."""
    ts, original, status, mime = (F.coalesce(c, F.lit("")) for c in (ts, original, status, mime))
    return F.concat_ws("\t", F.concat(F.lit(archive.rstrip("/") + "/web/"), ts, F.lit("/"), original), ts, original, status, mime)


def write_lines(df: DataFrame, column: str, path: str, one_file: bool = False, ordered: bool = False, mode: str = "overwrite") -> None:
    """Text lines; one file only for lists that a reader wants whole."""
    d = df.select(F.col(column).cast("string").alias("value"))
    d = d.orderBy("value") if ordered else d
    (d.coalesce(1) if one_file else d).write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, partition: str | None = None, mode: str = "overwrite") -> None:
    """K03-K05/K11."""
    w = df.write.mode(mode)
    (w.partitionBy(partition) if partition else w).json(path)


def merged_links(old: DataFrame, new: DataFrame, key: str, link: str) -> DataFrame:
    """(key, links) old and new together, sorted, each once."""
    return old.select(key, link).unionByName(new.select(key, link)).groupBy(key).agg(F.array_sort(F.collect_set(link)).alias("links"))


def write_per_key(links: DataFrame, key: str, path: str) -> None:
    """One folder per key with one link a line."""
    links.select(key, F.array_join("links", "\n").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def with_digest(df: DataFrame, id_column: str) -> DataFrame:
    """K09."""
    data = F.to_json(F.struct(*[c for c in df.columns if c != id_column]), {"ignoreNullFields": "false"})
    return df.select(F.col(id_column).cast("string").alias("id"), data.alias("data"), F.sha2(data, 256).alias("digest"))


def provenance(df: DataFrame, tool: str, version: str, at: str) -> DataFrame:
    """A row that says what wrote a table; the time is an argument."""
    return df.sparkSession.createDataFrame([(tool, version, at, df.schema.json())], "tool string, version string, written_at string, schema string")


def replace_table(df: DataFrame, path: str) -> None:
    """Written beside the old version, which then makes way and is deleted last.

    At every moment a whole version lies under path, path.next or path.old; recovered() puts it back after a crash.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path + ".next")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(path + ".next"), jvm.org.apache.hadoop.fs.Path(path)
    fs, aside = old.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path(path + ".old")
    recovered(spark, path)
    fs.delete(aside, True)
    if fs.exists(old) and not fs.rename(old, aside):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(new, old):
        fs.rename(aside, old)
        raise OSError(f"{path}.next could not be moved to {path}")
    fs.delete(aside, True)


def recovered(spark: SparkSession, path: str) -> str:
    """The path; where a crash left nothing under it, the version that had made way is put back."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    here, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".old")
    fs = here.getFileSystem(conf)
    if not fs.exists(here) and fs.exists(aside):
        fs.rename(aside, here)
    return path


def guarded(path: str, read_only: tuple[str, ...]) -> str:
    """The path, unless it lies under one that must not be written."""
    if any(path == r or path.startswith(r.rstrip("/") + "/") for r in read_only):
        raise PermissionError(f"{path} is read-only")
    return path


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small table as text; at most `most` rows are fetched."""
    rows = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in df.limit(most).collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def dossier(**parts: DataFrame) -> DataFrame:
    """One row with each part's rows as a JSON array; for report-sized parts."""
    out = None
    for name, d in parts.items():
        one = d.agg(F.to_json(F.array_sort(F.collect_list(F.struct("*")))).alias(name))  # one row each
        out = one if out is None else out.crossJoin(one)
    return out
