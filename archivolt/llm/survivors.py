"""One surviving record per duplicate group, built field by field.

Records of a group are ranked per field by completeness (only rows with a value compete), recency
(date_seen), trust (snapshot_count of the index entry) and, for images, their number, in a window with the
row id as the last, deterministic tie-break. Ranks below three are cut inside each map task before the
shuffle (Spark's window group limit), so a group that holds a third of all rows sends two rows per task.
The group's maxima come from a map-side combined aggregation.

A field's winner is a case only if no other row beats or equals it in any measure; survivors() falls back on
the top-ranked row where no such winner exists, so that each group yields one whole record.

Defined results: groups of one row are none; null, blank, zero, NaN values and empty lists are no value; a
missing date or count is the lowest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.llm.canonical import words
from archivolt.session import materialize

FIELDS = ("name", "price", "images")


def _date_rank(c: Column) -> Column:
    """A date as comparable text; blank and missing are lowest."""
    return F.coalesce(F.trim(c), F.lit(""))


def candidates(catalog: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of groups of two or more: first_id, cat_id, date, trust and the sizes of their values."""
    trust = index.groupBy("entry_id").agg(F.max("snapshot_count").alias("trust"))
    rows = catalog.select(
        "cat_id",
        "entry_id",
        F.nullif(words(F.col("slug")), F.lit("")).alias("group_key"),
        _date_rank(F.col("date_seen")).alias("seen"),
        (F.trim(F.regexp_replace(F.coalesce("name", F.lit("")), r"[\s ]+", " ")) != "").alias("has_name"),
        F.coalesce((F.col("price") != 0) & ~F.isnan("price"), F.lit(False)).alias("has_price"),
        F.coalesce(F.size("images"), F.lit(0)).alias("n_images"),
    ).filter("group_key is not null")
    g = rows.groupBy("group_key").agg(F.min("cat_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(g.drop("n"), "group_key").join(trust, "entry_id", "left").select("first_id", "cat_id", "seen", F.coalesce("trust", F.lit(-1)).alias("trust"), "has_name", "has_price", "n_images")


def ranked(rows: DataFrame) -> DataFrame:
    """The two best rows of each group and field, with the group's maxima."""
    fields = F.filter(
        F.array(
            F.struct(F.lit("name").alias("field_name"), F.col("has_name").alias("ok"), F.lit(0).alias("n")),
            F.struct(F.lit("price").alias("field_name"), F.col("has_price").alias("ok"), F.lit(0).alias("n")),
            F.struct(F.lit("images").alias("field_name"), (F.col("n_images") > 0).alias("ok"), F.col("n_images").alias("n")),
        ),
        lambda x: x["ok"],
    )
    each = rows.select("first_id", "cat_id", "seen", "trust", F.explode(fields).alias("f")).select("first_id", "f.field_name", "cat_id", "seen", "trust", "f.n")
    w = Window.partitionBy("first_id", "field_name").orderBy(F.desc("seen"), F.desc("trust"), F.desc("n"), "cat_id")
    top = each.withColumn("rank", F.row_number().over(w)).filter("rank <= 2")
    best = each.groupBy("first_id", "field_name").agg(F.max("seen").alias("max_seen"), F.max("trust").alias("max_trust"), F.max("n").alias("max_n"))
    return top.join(best, ["first_id", "field_name"])


def winners(rows: DataFrame) -> DataFrame:
    """first_id, field_name, cat_id (top-ranked) and whether no other row equals or beats it."""
    rows = materialize(rows)  # read by the ranks and by the maxima
    at_max = (F.col("seen") == F.col("max_seen")) & (F.col("trust") == F.col("max_trust")) & (F.col("n") == F.col("max_n"))
    return (
        ranked(rows)
        .groupBy("first_id", "field_name")
        .agg(F.min_by("cat_id", "rank").alias("cat_id"), F.count_if(at_max).alias("n_max"))
        .select("first_id", "field_name", "cat_id", (F.col("n_max") == 1).alias("unbeaten"))
    )


def survivors(catalog: DataFrame, index: DataFrame) -> DataFrame:
    """One record per group: first_id, the chosen row of each field and its value."""
    w = materialize(winners(candidates(catalog, index)))
    value = catalog.select("cat_id", "name", "price", "images")
    joined = w.join(value, "cat_id")
    pick = lambda f: F.max(F.when(F.col("field_name") == f, F.col("cat_id"))).alias(f"{f}_from")
    take = lambda f: F.max_by(f, F.when(F.col("field_name") == f, F.lit(1))).alias(f)
    return joined.groupBy("first_id").agg(*[pick(f) for f in FIELDS], *[take(f) for f in FIELDS])
