"""The batch search: retrieve, re-rank, route, rewrite, search once more.

A batch of queries is one job from end to end; there is no loop over queries and
exactly two passes, because a second pass is never followed by a third.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import text as X
from shelfmark.operators.rerank import fuzzy_rerank, match_status
from shelfmark.operators.postings import PostingsIndex, text_index
from shelfmark.operators.retrieve import store_index, text_search
from shelfmark.operators.rewrite import Rewriter, offline_rewriter, rewrite_queries, route_queries
from shelfmark.session import materialize


def search_pass(queries: DataFrame, catalog: DataFrame, index: PostingsIndex | None = None) -> DataFrame:
    """One pass: both rankings of the candidates of every query.

    ``index`` is the stored index of ``catalog``; without one it is built for this call.
    """
    index = store_index(text_index(catalog)) if index is None else index
    hits = materialize(text_search(queries, index), "text_hits")
    return fuzzy_rerank(hits, queries, catalog)


@dataclass
class SearchResult:
    """``queries`` with their rewrites, and the ``hits`` of each query's last pass."""

    queries: DataFrame
    hits: DataFrame


def two_pass_search(
    queries: DataFrame,
    catalog: DataFrame,
    rewriter: Rewriter = offline_rewriter,
    index: PostingsIndex | None = None,
    answer_root: str | None = None,
) -> SearchResult:
    """Search all queries; search the rewritten ones again with their new text.

    ``index`` is the catalog's stored index, ``answer_root`` the table of kept answers; without
    them, an index is built and answers are forgotten after the batch.

    The last pass of a query is its result even if it found less. Each pass is
    written once because routing, rewriting and reporting all read it.
    """
    index = store_index(text_index(catalog)) if index is None else index
    first = materialize(search_pass(queries, catalog, index), "first_pass")
    # An answer from a service must not be asked for again by a later step.
    answered = materialize(rewrite_queries(route_queries(queries, first), rewriter, answer_root), "rewrites")

    again = answered.filter(F.col("next_query").isNotNull())
    second = search_pass(
        again.select("query_no", F.col("next_query").alias("input_string")), catalog, index
    )
    kept = first.join(again.select("query_no"), "query_no", "left_anti")
    hits = materialize(kept.unionByName(second), "hits")
    return SearchResult(answered, hits)


def _rewrite_struct(prefix: str):
    fields = ("model", "decision", "rephrased_query", "error")
    answer = F.struct(*[F.col(f"{prefix}_{f}").alias(f) for f in fields])
    return F.when(F.col(f"{prefix}_model").isNotNull(), answer)


def search_documents(result: SearchResult, timestamp=None) -> DataFrame:
    """One nested result per query: both rankings, rewrites and classification.

    A query has at most ``TOP_K`` hits, which bounds the lists. Absent parts are
    null and do not show up when written as JSON.
    """
    fields = [c for c in result.hits.columns if c not in ("query_no", "input_string")]
    hit = F.struct(*fields)
    by_rank = {
        name: F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), hit.alias("hit")))),
            lambda x: x["hit"],
        )
        for name, rank in (("direct", "text_rank"), ("fuzzy", "fuzzy_rank"))
    }
    lists = result.hits.groupBy("query_no").agg(*[c.alias(n) for n, c in by_rank.items()])
    queries = result.queries.select("query_no", "input_string")
    status = match_status(queries, result.hits).select(
        "query_no", "match_status", "match_confidence", "best_score", "threshold"
    )
    none = F.array().cast(T.ArrayType(lists.schema["direct"].dataType.elementType))
    stamp = F.current_timestamp() if timestamp is None else timestamp

    def ranking(name):
        found = F.coalesce(F.col(name), none)
        return F.struct(F.size(found).alias("count"), found.alias("results"))

    best = F.struct(
        F.col("best_score").alias("score"), "threshold", F.col("fuzzy")[0].alias("product")
    )
    return (
        result.queries.drop("best_score")
        .join(lists, "query_no", "left")
        .join(status, "query_no")
        .select(
            "query_no",
            stamp.alias("timestamp"),
            "input_string",
            X.format_query("input_string").alias("formatted_string"),
            ranking("direct").alias("direct_search"),
            ranking("fuzzy").alias("rapidfuzz_search"),
            _rewrite_struct("level1").alias("openai_level1"),
            _rewrite_struct("level2").alias("openai_level2"),
            "match_status",
            "match_confidence",
            F.when(F.col("best_score").isNotNull(), best).alias("best_match"),
        )
    )
