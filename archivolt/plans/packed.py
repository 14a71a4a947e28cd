"""Queries of the packed-field splitter."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators.packed import unpack
from archivolt.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack(table(spark, sf_dir, "product_metadata", "meta_id", "sizes", "category"), "meta_id", ["sizes", "category"])


def p2_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each value occurs, by field."""
    return p2_found(spark, sf_dir).groupBy("field_name", "item").agg(F.count("*").alias("n"))


QUERIES = {"p2_found": p2_found, "p2_items": p2_items}
SQL: dict[str, str] = {}
