"""Canonical form of addresses and slugs as Column expressions (no Python per row)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded(c: Column) -> Column:
    """Percent-decoding, twice as some addresses were encoded twice; stray percent signs stay."""
    for _ in range(2):
        c = F.coalesce(F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")), c)
    return c


def words(c: Column) -> Column:
    """The words and numbers in order, lower-cased, one blank between."""
    return F.trim(F.regexp_replace(F.lower(decoded(c)), r"[^\p{L}\p{N}\p{M}]+", " "))


def _without_scheme(url: Column) -> Column:
    return F.regexp_replace(url, r"(?i)^[^\p{L}\p{N}]*https?\s*(:|%3a)", "")


def path_words(url: Column) -> Column:
    """Words and numbers of host and path."""
    return words(F.substring_index(_without_scheme(url), "?", 1))


def query_fields(url: Column) -> Column:
    """The query's fields as sorted 'name=value' strings, both sides reduced to words and numbers."""
    query = F.substring(url, F.instr(url, "?") + 1, F.lit(1 << 30))
    fields = F.split(F.when(F.instr(url, "?") > 0, query).otherwise(F.lit("")), r"[&;?]")
    named = F.transform(fields, lambda f: F.concat(words(F.substring_index(f, "=", 1)), F.lit("="), words(F.when(F.instr(f, "=") > 0, F.substring(f, F.instr(f, "=") + 1, F.lit(1 << 30))).otherwise(F.lit("")))))
    return F.array_sort(F.array_distinct(F.filter(named, lambda f: f != "=")))
