"""The flat batch report: two to four rows per query."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shelfmark import constants as K
from shelfmark.functions import text as X
from shelfmark.plans.search import SearchResult

NUMBER, INPUT, GIVEN_NAME, SCORE, ID, CATEGORIES, NAMES = K.REPORT_COLUMNS


@F.pandas_udf(StringType())
def two_decimals(score: pd.Series) -> pd.Series:
    """Score text. Ties round on the exact binary value, unlike ``format_string``."""
    return score.map("{:.2f}".format, na_action="ignore")


def _row(df: DataFrame, order: int, label: str, **columns: Column) -> DataFrame:
    return df.select(
        "query_no",
        F.lit(order).alias("type_order"),
        F.concat_ws(".", F.col("query_no").cast("string"), F.lit(label)).alias(NUMBER),
        F.col("input_string").alias(INPUT),
        *[
            F.coalesce(columns[key], F.lit("")).alias(name)
            for key, name in (
                ("given_name", GIVEN_NAME),
                ("score", SCORE),
                ("id", ID),
                ("categories", CATEGORIES),
                ("names", NAMES),
            )
        ],
    )


def _hit_rows(queries: DataFrame, hits: DataFrame, order, label, rank, score) -> DataFrame:
    """The first hit under one ranking; an empty row where there is none."""
    texts = X.non_blank(F.transform("product_name", lambda n: n["text"]))
    top = hits.filter(F.col(rank) == 1).select(
        "query_no",
        two_decimals(F.col(score)).alias("score"),
        F.col("_id"),
        "given_name",
        F.array_join("categories", ",").alias("categories"),
        F.array_join(texts, "; ").alias("names"),
    )
    return _row(
        queries.join(top, "query_no", "left"),
        order,
        label,
        given_name=F.col("given_name"),
        score=F.coalesce("score", F.lit("0")),
        id=F.col("_id"),
        categories=F.col("categories"),
        names=F.col("names"),
    )


def _rewrite_rows(result: SearchResult, order: int, level: int) -> DataFrame:
    decision, query = F.col(f"level{level}_decision"), F.col(f"level{level}_rephrased_query")
    asked = result.queries.filter(F.col(f"level{level}_model").isNotNull())
    return _row(
        asked,
        order,
        K.LEVEL_ROWS[level],
        given_name=F.concat_ws(": ", decision, F.nullif(query, F.lit(""))),
        score=F.lit("0"),
        id=F.lit(K.REWRITE_ROW_ID),
        categories=decision,
        names=query,
    )


def report_rows(result: SearchResult) -> DataFrame:
    """Report rows with ``query_no`` and ``type_order`` to sort by."""
    queries = result.queries.select("query_no", "input_string")
    rows = [
        _hit_rows(queries, result.hits, 1, K.TEXT_ROW, "text_rank", "score"),
        _hit_rows(queries, result.hits, 2, K.FUZZY_ROW, "fuzzy_rank", "rapidfuzz_score"),
        _rewrite_rows(result, 3, 1),
        _rewrite_rows(result, 4, 2),
    ]
    report = rows[0]
    for more in rows[1:]:
        report = report.unionByName(more)
    return report


def batch_report(result: SearchResult) -> DataFrame:
    return report_rows(result).orderBy("query_no", "type_order").select(*K.REPORT_COLUMNS)


def report_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total_rows"), F.count_distinct("query_no").alias("products_processed")
    )
