"""Routing of weak queries and the pluggable query rewriter.

A rewriter is a function from a DataFrame of requests to a DataFrame of answers:

* request: ``query_no, level, input_string, top_name, decision, rephrased_query``
  (the last two are the level-1 answer when level 2 is asked);
* answer: the columns of ``schemas.REWRITE``, one row per request.

Three are provided: none at hand, a table of answers, and a service. Requests of one level, string
and context are asked once, under the smallest of their query numbers, and with a store of answers
(``answer_root``) only if no earlier batch got their answer. A request that
a rewriter leaves out counts as answered with "no match found", and of several answers
to one request the smallest counts, so no query is lost or multiplied.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import constants as K
from shelfmark.functions.decision import parse_decision, rewrite_prompt
from shelfmark.functions.text import is_set
from shelfmark.schemas import ANSWERS, REWRITE
from shelfmark.session import materialize
from shelfmark.sources.tables import read_table, upsert_table

Rewriter = Callable[[DataFrame], DataFrame]

DONE, ASK, ASK_WITHOUT_HITS = "done", "level-1", "level-1, no hits"


def _model():
    models = [x for level, name in K.LEVEL_MODELS.items() for x in (F.lit(level), F.lit(name))]
    return F.create_map(*models)[F.col("level")]


def _answers(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REWRITE.fields])


def offline_rewriter(requests: DataFrame) -> DataFrame:
    """No service at hand: every request is answered with "no match found"."""
    return _answers(
        requests.select(
            "query_no",
            "level",
            _model().alias("model"),
            F.lit(K.NO_MATCH_FOUND).alias("decision"),
            F.lit(None).alias("rephrased_query"),
            F.lit(K.OFFLINE_ERROR).alias("error"),
        )
    )


def lookup_rewriter(rewrites: DataFrame) -> Rewriter:
    """Answers from a table (level, input_string, decision, rephrased_query).

    Of several answers to one (level, input_string) the smallest counts; requests that
    are not in it get "no match found".
    """
    table = rewrites.groupBy("level", "input_string").agg(
        F.min(F.struct("decision", "rephrased_query")).alias("_answer")
    )

    def rewrite(requests: DataFrame) -> DataFrame:
        joined = requests.select("query_no", "level", "input_string").join(
            table, ["level", "input_string"], "left"
        )
        found = F.col("_answer").isNotNull()
        return _answers(
            joined.select(
                "query_no",
                "level",
                _model().alias("model"),
                F.when(found, F.col("_answer.decision"))
                .otherwise(K.NO_MATCH_FOUND)
                .alias("decision"),
                F.col("_answer.rephrased_query").alias("rephrased_query"),
                F.lit(None).alias("error"),
            )
        )

    return rewrite


def service_rewriter(ask: Callable) -> Rewriter:
    """A rewriter that calls a service.

    ``ask`` is a ``mapInPandas`` function from batches of (query_no, level, prompt) to
    (query_no, level, content); content is the answer's text, null if the call failed.
    """
    first = rewrite_prompt("input_string", "top_name")
    second = rewrite_prompt("input_string", "top_name", "decision", "rephrased_query")

    def rewrite(requests: DataFrame) -> DataFrame:
        prompt = F.when(F.col("level") == 1, first).otherwise(second).alias("prompt")
        contents = requests.select("query_no", "level", prompt).mapInPandas(
            ask, "query_no long, level int, content string"
        )
        parsed = F.when(F.col("level") == 1, parse_decision("content", 1)).otherwise(
            parse_decision("content", 2)
        )
        return _answers(contents.select("query_no", "level", parsed.alias("_p")).select("query_no", "level", "_p.*"))

    return rewrite


def _request_key():
    """What an answer may depend on: equal requests have equal keys."""
    context = ["level", "input_string", "top_name", "decision", "rephrased_query"]
    return F.sha2(F.to_json(F.struct(*context), {"ignoreNullFields": "false"}), 256)


def _asked(requests: DataFrame, rewriter: Rewriter, name: str, answer_root: str | None) -> DataFrame:
    """One answer for every request. Written, so that the rewriter is asked once."""
    spark = requests.sparkSession
    fields = [f.name for f in REWRITE.fields if f.name not in ("query_no", "level")]
    requests = materialize(requests.withColumn("request", _request_key()), f"{name}_requests")
    known = None if answer_root is None else read_table(spark, answer_root, ANSWERS)
    new = requests if known is None else requests.join(known, "request", "left_anti")
    # equal requests count once, before the rewriter sees them
    asked = new.groupBy("request").agg(F.min("query_no").alias("query_no"))
    once = materialize(new.join(asked, ["request", "query_no"]), f"{name}_asked")
    answers = rewriter(once.drop("request")).groupBy("query_no").agg(F.min(F.struct(*fields)).alias("_a"))
    answers = once.select("request", "query_no").join(answers, "query_no").select("request", "_a.*")
    answers = materialize(answers, f"{name}_answers")
    if answer_root is not None:
        # a failed call is asked again by the next batch
        kept = answers.filter("error is null").select(*ANSWERS.fieldNames())
        if not kept.isEmpty():
            upsert_table(kept, answer_root, ANSWERS, "request")
        answers = answers.unionByName(known.select(*answers.columns))
    answers = answers.select("request", F.struct(*fields).alias("_a"))
    joined = requests.select("query_no", "level", "request").join(answers, "request", "left")
    missing = F.when(F.col("_a").isNull(), K.OFFLINE_ERROR)
    return materialize(
        _answers(
            joined.select(
                "query_no",
                "level",
                F.coalesce("_a.model", _model()).alias("model"),
                F.coalesce("_a.decision", F.when(F.col("_a").isNull(), K.NO_MATCH_FOUND)).alias("decision"),
                F.col("_a.rephrased_query").alias("rephrased_query"),
                F.coalesce("_a.error", missing).alias("error"),
            )
        ),
        name,
    )


def route_queries(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """Hits, best score and next step of every query after its first pass."""
    found = ranked.groupBy("query_no").agg(
        F.count("*").alias("n"),
        F.max("rapidfuzz_score").alias("best_score"),
        F.min_by("given_name", "fuzzy_rank").alias("top_name"),
    )
    return queries.join(found, "query_no", "left").select(
        "query_no",
        "input_string",
        F.coalesce("n", F.lit(0)).alias("n_hits"),
        "best_score",
        "top_name",
        F.when(F.col("n").isNull(), ASK_WITHOUT_HITS)
        .when(F.col("best_score") < K.SCORE_THRESHOLD, ASK)
        .otherwise(DONE)
        .alias("route"),
    )


def rephrased(prefix: str):
    """The answer holds a usable new query."""
    return (F.coalesce(F.col(f"{prefix}_decision"), F.lit("")) == K.REPHRASED) & is_set(
        f"{prefix}_rephrased_query"
    )


def _prefixed(answers: DataFrame, prefix: str) -> DataFrame:
    fields = [f.name for f in REWRITE.fields if f.name not in ("query_no", "level")]
    return answers.select("query_no", *[F.col(f).alias(f"{prefix}_{f}") for f in fields])


def rewrite_queries(routed: DataFrame, rewriter: Rewriter, answer_root: str | None = None) -> DataFrame:
    """Ask level 1 for weak queries, level 2 where that did not settle them.

    Level 2 is asked only if the first pass had hits. ``next_query`` is the string
    for the second pass, null where there is none. ``answer_root`` is a table that keeps
    answers from batch to batch.
    """
    context = F.when(F.col("n_hits") > 0, F.col("top_name"))
    none = F.lit(None).cast("string")
    level1 = routed.filter(F.col("route") != DONE).select(
        "query_no",
        F.lit(1).alias("level"),
        "input_string",
        context.alias("top_name"),
        none.alias("decision"),
        none.alias("rephrased_query"),
    )
    asked = routed.join(_prefixed(_asked(level1, rewriter, "level1", answer_root), "level1"), "query_no", "left")

    settled = rephrased("level1") | F.coalesce(
        F.col("level1_decision").isin(K.NOT_A_PRODUCT, K.VALID_PRODUCT), F.lit(False)
    )
    level2 = asked.filter((F.col("route") == ASK) & ~settled).select(
        "query_no",
        F.lit(2).alias("level"),
        "input_string",
        "top_name",
        F.col("level1_decision").alias("decision"),
        F.col("level1_rephrased_query").alias("rephrased_query"),
    )
    answered = asked.join(_prefixed(_asked(level2, rewriter, "level2", answer_root), "level2"), "query_no", "left")
    return answered.withColumn(
        "next_query",
        F.when(rephrased("level1"), F.col("level1_rephrased_query")).when(
            rephrased("level2"), F.col("level2_rephrased_query")
        ),
    )
