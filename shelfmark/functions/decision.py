"""Prompts for a query rewriter and the reading of its answers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import constants as K
from shelfmark.functions.text import is_set


def rewrite_prompt(query, top_name, decision=None, rephrased=None) -> Column:
    """User prompt: the query, the best hit if any, the earlier analysis if any."""
    query, top_name = F.col(query), F.col(top_name)
    parts = [
        F.concat(F.lit('User Search Query: "'), query, F.lit('"')),
        F.when(is_set(top_name), F.concat(F.lit('\nPossible Result: "'), top_name, F.lit('"'))),
    ]
    if decision is not None:
        decision, rephrased = F.col(decision), F.col(rephrased)
        suggestion = F.when(
            is_set(rephrased), F.concat(F.lit(', suggested: "'), rephrased, F.lit('"'))
        )
        parts.append(
            F.when(
                decision.isNotNull(),
                F.concat_ws("", F.lit("\nPrevious Analysis: "), decision, suggestion),
            )
        )
    return F.concat_ws("", *parts)


def parse_decision(content, level: int) -> Column:
    """Answer text -> struct(model, decision, rephrased_query, error).

    The outermost braces hold the answer. Without braces the words of the text
    decide; with broken JSON inside them the answer counts as failed.
    """
    content = F.col(content) if isinstance(content, str) else content
    body = F.regexp_extract(content, r"(?s)\{.*\}", 0)
    # As the only element of a list, so that text after the object is an error.
    parsed = F.from_json(
        F.concat(F.lit("["), body, F.lit("]")),
        "array<struct<decision: string, rephrased_query: string>>",
        {"allowSingleQuotes": "false"},
    )
    has_braces, readable = body != "", parsed.isNotNull()

    def field(name):
        return parsed[0][name]

    def has(word):
        return F.lower(content).contains(word)

    named = F.array_contains(F.json_object_keys(body), "decision")
    from_json = F.when(named, field("decision")).otherwise(K.NO_MATCH_FOUND)
    from_words = (
        F.when(has("not_a_product"), K.NOT_A_PRODUCT)
        .when(has("rephrased") | has("improved"), K.REPHRASED)
        .when(has("valid"), K.VALID_PRODUCT)
        .otherwise(K.NO_MATCH_FOUND)
    )
    failed = F.lit(f"Failed to parse Level {level} model response")
    return F.struct(
        F.lit(K.LEVEL_MODELS[level]).alias("model"),
        F.when(content.isNull(), K.NO_MATCH_FOUND)
        .when(~has_braces, from_words)
        .when(readable, from_json)
        .otherwise(K.NO_MATCH_FOUND)
        .alias("decision"),
        F.when(has_braces & readable, field("rephrased_query")).alias("rephrased_query"),
        F.when(content.isNull() | (has_braces & ~readable), failed).alias("error"),
    )
