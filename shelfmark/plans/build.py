"""The catalog build as one pipeline."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from shelfmark import constants as K
from shelfmark.operators import ingest as I
from shelfmark.operators.postings import PostingsIndex, text_index
from shelfmark.operators.upsert import latest_by_key
from shelfmark.schemas import CATALOG, CATEGORIES
from shelfmark.sources.writers import upsert_table, write_paths, write_values


@dataclass
class CatalogBuild:
    """Everything a build computes; nothing is stored until a sink is called."""

    documents: DataFrame
    rejected: DataFrame
    counts: DataFrame
    languages: DataFrame
    food_groups: DataFrame
    categories: DataFrame
    category_paths: DataFrame
    category_tree: DataFrame

    def catalog(self) -> DataFrame:
        """The catalog of this build alone, one document per key."""
        return latest_by_key(self.documents, "_id").select(*CATALOG.fieldNames())

    def store(self, catalog_root: str, categories_root: str, index_root: str | None = None) -> None:
        """Upsert the catalog, the category tree and, where one is kept, the search index."""
        upsert_table(self.documents, catalog_root, CATALOG, "_id", "seq")
        upsert_table(self.category_tree, categories_root, CATEGORIES, "name")
        if index_root is not None:
            PostingsIndex(self.documents.sparkSession, index_root).update(text_index(self.catalog()))

    def write_side_outputs(self, path: str) -> None:
        write_values(self.food_groups, f"{path}/unique_food_groups")
        write_values(self.categories, f"{path}/unique_categories")
        write_paths(self.category_paths, f"{path}/unique_last_categories")


def build_catalog(source: DataFrame, lang: str | None = K.CATALOG_LANGUAGE) -> CatalogBuild:
    """Derive catalog and statistics from source records (``schemas.SRC``).

    The outputs share the source scan's narrow steps only; a caller that runs
    many of them may persist ``source`` or pass a table already reduced to the
    language.
    """
    records = source if lang is None else I.filter_lang(source, lang)
    valid = I.valid_products(records)
    paths = I.category_paths(valid)
    return CatalogBuild(
        documents=I.catalog_project(valid),
        rejected=I.rejected_products(records),
        counts=I.ingest_counts(records),
        languages=I.lang_distribution(valid),
        food_groups=I.distinct_tags(valid),
        categories=I.distinct_categories(valid),
        category_paths=paths,
        category_tree=I.category_tree(paths),
    )
