"""Helpers of the query modules."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "product_metadata", "sku_product", "match_result", "index_entry", "entities", "catalog_entry", "fetch_result")


class Registry:
    """Queries of a module and the SQL they are checked with."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None):
        def add(f):
            self.queries[name] = f
            if oracle:
                self.sql[name] = oracle
            return f

        return add

    def both(self, name: str, text: str, oracle: str | None = None) -> None:
        """A query given as SQL text; oracle where the other engine spells it differently."""
        self.queries[name] = lambda spark, sf_dir: sql(spark, sf_dir, text)
        self.sql[name] = oracle or text


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs a SQL text over the tables it names; each is a view of its parquet file, so filters and columns reach the scan."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)
