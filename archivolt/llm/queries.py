"""Queries of the training-data operators; each covers its whole tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm import copies as _copies
from archivolt.llm import oracle as _oracle
from archivolt.llm import leakage, linkage, mixing, mojibake, products, residue, survivors, truncation
from archivolt.session import materialize
from archivolt.tables import table


def _p1(s: SparkSession, d: str):
    fields = mojibake.text_fields(table(s, d, "product_metadata", "meta_id", "name", "description"), table(s, d, "catalog_entry", "cat_id", "brand"))
    return fields, mojibake.damaged(fields)


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return _p1(s, d)[1].select("src_table", "row_id", "field_name")


def p1_restored(s: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(*_p1(s, d))


def _residue_rows(s: SparkSession, d: str) -> DataFrame:
    return residue.fields(table(s, d, "product_metadata", "meta_id", "url", "name", "description"), table(s, d, "fetch_result", "fetch_id", "original_url", "error"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return residue.found(residue.scores(_residue_rows(s, d)))


def p3_validation(s: SparkSession, d: str) -> DataFrame:
    """Of classifiers that saw neither the measured hosts nor the held phrases."""
    rows = _residue_rows(s, d)
    return residue.validate(rows, residue.scores(rows, held=residue.HELD))


def _listings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "product_metadata", "meta_id", "slug", "era", "name", "brand", "description", "color")


def p4_links(s: SparkSession, d: str) -> DataFrame:
    """With the confidence of each link."""
    return linkage.link(_listings(s, d), table(s, d, "sku_product", "sku", "name", "color", "brand", "season"))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return p4_links(s, d).select("meta_id", "sku")


def p6_groups(s: SparkSession, d: str) -> DataFrame:
    """One row per listing with the key of its product."""
    rows = _listings(s, d)
    return products.grouped(products.listings(rows, products.brands_of(rows)))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return products.pairs_of(materialize(p6_groups(s, d)))


def _p5(s: SparkSession, d: str):
    index = _copies.copies(table(s, d, "index_entry", "entry_id", "original_url", "slug"), "entry_id", {"original_url": _copies.address_tuple, "slug": _copies.slug_tuple}, "original_url")
    entities = _copies.copies(table(s, d, "entities", "entity_id", "canonical_url"), "entity_id", {"canonical_url": _copies.address_tuple}, "canonical_url")
    return index, entities


def _named(index: DataFrame, entities: DataFrame) -> DataFrame:
    return index.withColumn("src_table", F.lit("index_entry")).unionByName(entities.withColumn("src_table", F.lit("entities")))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    (index, _), (entities, _) = _p5(s, d)
    return _named(index, entities).select("src_table", "first_id", "copy_id")


def p5_counts(s: SparkSession, d: str) -> DataFrame:
    (_, index), (_, entities) = _p5(s, d)
    return _named(index, entities).select("src_table", "first_id", "n_copies")


def _p7(s: SparkSession, d: str) -> DataFrame:
    return survivors.candidates(table(s, d, "catalog_entry", "cat_id", "slug", "name", "date_seen", "price", "images", "entry_id"), table(s, d, "index_entry", "entry_id", "snapshot_count"))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return survivors.winners(_p7(s, d)).filter("unbeaten").drop("unbeaten")


def p7_survivors(s: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(s, d, "catalog_entry"), table(s, d, "index_entry", "entry_id", "snapshot_count"))


def p8_leaks(s: SparkSession, d: str) -> DataFrame:
    """With the number of shared windows."""
    return leakage.leaks(table(s, d, "documents", "doc_id", "text"), table(s, d, "eval_item", "item_id", "item_text"))


def p8_found(s: SparkSession, d: str) -> DataFrame:
    return p8_leaks(s, d).select("doc_id", "item_id")


def p9_selection(s: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(s, d, "documents", "doc_id", "source", "text"), table(s, d, "mix_target"))


def p9_shares(s: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_selection(s, d), table(s, d, "mix_target"))


def _p10(s: SparkSession, d: str) -> DataFrame:
    return truncation.scores(table(s, d, "documents", "doc_id", "source", "text"))


def p10_found(s: SparkSession, d: str) -> DataFrame:
    return _p10(s, d).filter("p_cut >= 0.5").select("doc_id")


def p10_rates(s: SparkSession, d: str) -> DataFrame:
    return truncation.rates(_p10(s, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p3_found, p3_validation, p4_found, p4_links, p6_found, p6_groups, p5_found, p5_counts, p7_found, p7_survivors, p8_found, p8_leaks, p9_selection, p9_shares, p10_found, p10_rates)}
SQL = _oracle.SQL
