"""Records that differ only in spacing, case, punctuation or field order.

Dictionary encoding: every distinct value of a column is canonicalised once, its parts (host and path, each
query field) get integer identifiers, records are rewritten as integer tuples, and the tuples are grouped.
An identifier is two 64-bit hashes of the part, so no driver and no global counter assigns it; for 10^10
distinct parts the chance of any clash is about 10^-19. Group sizes and first ids come from a map-side
combined aggregation; members find their group in a join whose hot keys adaptive execution splits, so no
group is ever gathered in one task. Texts are shuffled once, by distinct value; all else is numbers.

Defined results: null and blank addresses have no copies; a null slug equals a blank one; exact repeats are
copies; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm.canonical import path_words, query_fields, words
from archivolt.session import materialize


def identifier(part: Column) -> Column:
    return F.array(F.xxhash64(part), F.xxhash64(F.lit("second"), part))


def address_tuple(url: Column) -> Column:
    """Integer tuple of an address: its host and path, then its query fields in sorted order."""
    fields = F.sort_array(F.transform(query_fields(url), identifier))
    return F.flatten(F.concat(F.array(identifier(path_words(url))), fields))


def slug_tuple(slug: Column) -> Column:
    return identifier(words(F.coalesce(slug, F.lit(""))))


def encode(df: DataFrame, key: str, columns: dict[str, object]) -> DataFrame:
    """(key, code): columns maps a column's name to the function that makes its distinct values tuples.

    A value is known by two 64-bit hashes, so only the distinct values travel as text, once each; rows meet
    their dictionary entries by the hashes. A value's null is a value of its own.
    """
    value = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit(""))
    hashes = [h for i, c in enumerate(columns) for h in (F.xxhash64(value(c)).alias(f"_a{i}"), F.xxhash64(F.lit("second"), value(c)).alias(f"_b{i}"))]
    out = df.select(key, *hashes)
    for i, (c, make) in enumerate(columns.items()):
        distinct = df.select(F.xxhash64(value(c)).alias(f"_a{i}"), F.xxhash64(F.lit("second"), value(c)).alias(f"_b{i}"), F.col(c).alias("_value")).groupBy(f"_a{i}", f"_b{i}").agg(F.first("_value").alias("_value"))
        dictionary = distinct.select(f"_a{i}", f"_b{i}", make(F.col("_value")).alias(f"_code{i}"))
        out = out.join(dictionary, [f"_a{i}", f"_b{i}"], "left").drop(f"_a{i}", f"_b{i}")
    return out.select(F.col(key), F.concat(*[f"_code{i}" for i in range(len(columns))]).alias("code"))


def groups(encoded: DataFrame, key: str) -> DataFrame:
    """(code, first_id, n) of the tuples that occur twice or more."""
    return encoded.groupBy("code").agg(F.min(key).alias("first_id"), F.count("*").alias("n")).filter("n > 1")


def copies(df: DataFrame, key: str, columns: dict[str, object], address: str) -> tuple[DataFrame, DataFrame]:
    """(first_id, copy_id) for each member but the first, and (first_id, n_copies) for each group."""
    known = df.select(key, *columns).filter(F.trim(F.regexp_replace(F.col(address), r"[\s\u00a0]+", " ")) != "")
    encoded = materialize(encode(known, key, columns))
    g = groups(encoded, key)
    members = encoded.join(g.drop("n"), "code").filter(F.col(key) != F.col("first_id"))
    return members.select("first_id", F.col(key).alias("copy_id")), g.select("first_id", F.col("n").alias("n_copies"))
