"""Catalog build: filter and validate records, derive the catalog and statistics.

Every step before the aggregations is narrow and stays in the scan stage. The
statistics are taken per record, before records with the same key are merged.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import constants as K
from shelfmark.functions import text as X
from shelfmark.schemas import CATALOG


def filter_lang(df: DataFrame, lang: str = K.CATALOG_LANGUAGE) -> DataFrame:
    """Records of one language; a plain equality, so the scan can skip data."""
    return df.filter(F.col("lang") == lang)


def valid_products(records: DataFrame) -> DataFrame:
    return records.filter(X.is_valid_product())


def rejected_products(records: DataFrame) -> DataFrame:
    return records.filter(~X.is_valid_product())


def reject_sample(records: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rejected records in arrival order."""
    return rejected_products(records).orderBy("seq").limit(n)


def ingest_counts(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count_if(X.is_valid_product()).alias("processed"),
        F.count_if(~X.is_valid_product()).alias("skipped"),
    )


def catalog_project(records: DataFrame) -> DataFrame:
    """The catalog document of each record, with ``seq`` kept for merging."""
    derived = {
        "_id": F.col("code"),
        "categories": X.split_list("categories"),
        "labels": X.split_list("labels"),
        "search_string": X.search_text(),
    }
    return records.select(
        "seq", *[derived.get(f.name, F.col(f.name)).alias(f.name) for f in CATALOG.fields]
    )


def lang_distribution(records: DataFrame) -> DataFrame:
    return records.groupBy("lang").agg(F.count("*").alias("n_records"))


def distinct_tags(records: DataFrame, column: str = "food_groups_tags") -> DataFrame:
    tags = records.select(F.explode(column).alias("value"))
    return tags.distinct().orderBy("value")


def distinct_categories(records: DataFrame) -> DataFrame:
    names = records.select(F.explode(X.list_items("categories")).alias("value"))
    return names.distinct().orderBy("value")


def category_paths(records: DataFrame) -> DataFrame:
    """Path of plain categories by its last entry; the latest record wins."""
    plain = F.filter(X.list_items("categories"), X.is_plain_category)
    return (
        records.select("seq", plain.alias("path"))
        .filter(F.size("path") > 0)
        .groupBy(F.element_at("path", -1).alias("name"))
        .agg(F.max_by(F.array_join("path", K.PATH_SEPARATOR), "seq").alias("path"))
    )


def category_tree(paths: DataFrame) -> DataFrame:
    """(name, ancestors) from paths; a path that does not end in its name is dropped.

    The joined path is split again on purpose: a category that contains the
    separator itself does not survive, as in the stored tree.
    """
    parts = X.non_blank(F.split("path", K.PATH_SEPARATOR))
    return (
        paths.filter(X.is_set("name") & X.is_set("path"))
        .withColumn("parts", parts)
        .filter((F.size("parts") == 0) | (F.try_element_at("parts", F.lit(-1)) == F.col("name")))
        .select(
            "name",
            F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(0))).alias(
                "ancestors"
            ),
        )
    )
