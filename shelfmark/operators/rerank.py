"""Fuzzy re-ranking of the retrieved candidates, and views of both rankings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfmark import constants as K
from shelfmark.functions import text as X
from shelfmark.functions.similarity import with_field_scores
from shelfmark.session import materialize

# Catalog fields carried along with a hit: scoring needs all but the last.
HIT_FIELDS = [
    "product_name",
    "brands",
    "categories",
    "categories_tags",
    "labels",
    "quantity",
    "search_string",
]


def fuzzy_rerank(hits: DataFrame, queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Score every hit on five fields and rank by the total; ties keep text order.

    The raw query is scored, not the formatted one. Of the catalog only the hit documents
    move: their ids, written first so that their size is known when the join is planned, are
    broadcast if few, and the wide rows meet the hits after that cut. A pair of query text and
    document is scored once, however many queries have that text. Rows are distributed
    by query before scoring, which is the expensive step: no query has more than ``k`` hits,
    so the work is even however popular a document is. (Ranking shuffles once more,
    because Spark does not carry a distribution through Python evaluation.)
    """
    tasks = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = queries.select("query_no", "input_string")
    # the first query of a text is scored for all of them
    first = texts.groupBy(F.col("input_string").alias("_text")).agg(F.min("query_no").alias("_first"))
    texts = texts.join(first, F.col("input_string").eqNullSafe(F.col("_text"))).drop("_text")
    asked = hits.join(texts, "query_no")
    wanted = materialize(hits.select(F.col("_id").alias("_doc")).distinct(), "hit_ids")
    documents = catalog.select("_id", *HIT_FIELDS).join(
        wanted, F.col("_id").eqNullSafe(F.col("_doc")), "left_semi"
    )
    documents = documents.withColumnRenamed("_id", "_doc")
    candidates = (
        asked.filter(F.col("query_no") == F.col("_first"))
        .join(documents, F.col("_id").eqNullSafe(F.col("_doc")))
        .drop("_doc", "query_no", "score", "text_rank")
        .repartition(tasks, "_first")  # a fixed number: rows are few but costly
    )
    scored = with_field_scores(candidates).withColumn(
        "given_name", X.given_name("categories", "product_name")
    )
    scored = scored.withColumnsRenamed({"_first": "_text", "_id": "_doc"}).drop("input_string")
    same = (F.col("_first") == F.col("_text")) & F.col("_id").eqNullSafe(F.col("_doc"))
    best_first = W.partitionBy("query_no").orderBy(F.desc("rapidfuzz_score"), "text_rank")
    return (
        asked.join(scored, same)
        .drop("_first", "_text", "_doc")
        .withColumn("fuzzy_rank", F.row_number().over(best_first))
    )


def hit_counts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits per query under both rankings, zero where nothing was found."""
    counts = hits.groupBy("query_no").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return queries.join(counts, "query_no", "left").select(
        "query_no", n.alias("direct_count"), n.alias("rapidfuzz_count")
    )


def best_match(ranked: DataFrame) -> DataFrame:
    """The best fuzzy hit of every query that has one."""
    return ranked.filter(F.col("fuzzy_rank") == 1).select(
        "query_no", "_id", "given_name", F.col("rapidfuzz_score").alias("best_score")
    )


def top_results(ranked: DataFrame) -> DataFrame:
    """First hit of each ranking side by side."""
    rank_one = {"text": F.col("text_rank") == 1, "fuzzy": F.col("fuzzy_rank") == 1}
    columns = {
        f"{name}_{field}": F.max(F.when(first, F.col(source)))
        for name, first in rank_one.items()
        for field, source in (
            ("id", "_id"),
            ("given_name", "given_name"),
            ("score", "score" if name == "text" else "rapidfuzz_score"),
        )
    }
    return (
        ranked.filter(rank_one["text"] | rank_one["fuzzy"])
        .groupBy("query_no")
        .agg(*[c.alias(name) for name, c in columns.items()])
    )


def top_summary(ranked: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` hits of each ranking, one row each, with display fields."""

    def shown(c):
        return F.when(X.is_set(c), c).otherwise("N/A")

    rankings = F.array(
        F.struct(F.lit("text").alias("ranking"), F.col("text_rank").alias("rank")),
        F.struct(F.lit("fuzzy").alias("ranking"), F.col("fuzzy_rank").alias("rank")),
    )
    return (
        ranked.filter((F.col("text_rank") <= n) | (F.col("fuzzy_rank") <= n))
        .withColumn("_r", F.explode(rankings))
        .filter(F.col("_r.rank") <= n)
        .select(
            "query_no",
            "_r.ranking",
            "_r.rank",
            "_id",
            "score",
            "rapidfuzz_score",
            "given_name",
            shown(F.array_join(X.product_names("product_name"), ", ")).alias("product_names"),
            shown(F.col("quantity")).alias("quantity"),
            shown(F.col("brands")).alias("brands"),
            shown(F.array_join("categories", ", ")).alias("categories"),
            shown(F.array_join("labels", ", ")).alias("labels"),
            F.coalesce("search_string", F.lit("")).alias("text"),
        )
    )


def match_status(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """Classify every query by its best fuzzy score."""
    joined = queries.select("query_no", "input_string").join(best_match(ranked), "query_no", "left")
    score = F.col("best_score")

    def graded(high, low, none):
        return F.when(score >= K.SCORE_THRESHOLD, high).when(score.isNotNull(), low).otherwise(none)

    return joined.select(
        "query_no",
        "input_string",
        graded("successful", "low_confidence", "no_match").alias("match_status"),
        graded("high", "low", "none").alias("match_confidence"),
        "best_score",
        F.when(score.isNotNull(), F.lit(K.SCORE_THRESHOLD)).alias("threshold"),
        "_id",
        "given_name",
    )
