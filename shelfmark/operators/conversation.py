"""Export of rewriter conversations, kept as rows (model, conv_id, turn, role, content)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfmark.plans.skew import salted_join


def conversation_lengths(messages: DataFrame) -> DataFrame:
    return messages.groupBy("model", "conv_id").agg(F.count("*").alias("total_messages"))


def conversation_export(messages: DataFrame) -> DataFrame:
    """(model, conv_id, turn, role, content, total_messages), one row per message.

    The shape is the same at every length of a conversation; the totals come from a
    combined count joined with the hot keys spread.
    """
    key = F.to_json(F.struct("model", "conv_id"))
    totals = conversation_lengths(messages).select(key.alias("_conv"), "total_messages")
    counts = totals.select("_conv", F.col("total_messages").alias("n_rows"))
    rows = messages.select("model", "conv_id", "turn", "role", "content", key.alias("_conv"))
    return salted_join(rows, totals, "_conv", [F.col("turn")], counts=counts).drop("_conv")


def unanswered_turns(messages: DataFrame) -> DataFrame:
    """User messages whose next message, if any, is not the assistant's: the call failed."""
    following = F.lead("role").over(W.partitionBy("model", "conv_id").orderBy("turn"))
    rows = messages.withColumn("_next", following)
    lost = (F.col("role") == "user") & ~F.col("_next").eqNullSafe("assistant")
    return rows.filter(lost).drop("_next")
