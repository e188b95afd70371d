"""Incremental catalog ingest with Structured Streaming.

Streams take what is there and stop (``availableNow``); a restart from the checkpoint goes on
after the last finished batch. Tables remember the last batch that they took from a
stream (its checkpoint's path names it), so a batch that is replayed is skipped.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.functions import text as X
from shelfmark.operators import ingest as I
from shelfmark.schemas import CATALOG, COUNTS, LANGUAGES, PATHS, VALUES
from shelfmark.session import materialize
from shelfmark.sources.tables import read_table, upsert_table


def _start(stream: DataFrame, take, checkpoint: str, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).foreachBatch(take).start()


def stream_catalog(
    records: DataFrame, root: str, checkpoint: str, lang: str | None = "pl"
) -> StreamingQuery:
    """Upsert a stream of source records into the catalog table at ``root``.

    Filtering and projection are part of the streaming plan; each micro-batch is one upsert.
    """
    records = records if lang is None else I.filter_lang(records, lang)
    documents = I.catalog_project(I.valid_products(records))

    def take(batch: DataFrame, batch_id: int) -> None:
        upsert_table(batch, root, CATALOG, "_id", "seq", (checkpoint, batch_id))

    return _start(documents, take, checkpoint)


def stream_build(
    records: DataFrame, root: str, checkpoint: str, lang: str | None = "pl"
) -> StreamingQuery:
    """The whole build on a stream: catalog and side outputs, as tables below ``root``.

    ``catalog``, ``category_paths``, ``food_groups`` and ``categories`` are keyed tables that
    each micro-batch merges into; ``counts`` gets one row a batch. Every table skips
    batches that it has, so a batch that failed half way is finished by its replay.
    """
    records = records if lang is None else I.filter_lang(records, lang)

    def take(batch: DataFrame, batch_id: int) -> None:
        token = (checkpoint, batch_id)
        batch = materialize(batch.withColumn("_valid", X.is_valid_product()), "micro_batch")
        valid = batch.filter("_valid").drop("_valid")
        upsert_table(I.catalog_project(valid), f"{root}/catalog", CATALOG, "_id", "seq", token)
        upsert_table(I.category_paths(valid), f"{root}/category_paths", PATHS, "name", batch=token)
        upsert_table(I.distinct_tags(valid), f"{root}/food_groups", VALUES, "value", batch=token)
        upsert_table(I.distinct_categories(valid), f"{root}/categories", VALUES, "value", batch=token)
        counts = batch.agg(F.count_if("_valid").alias("processed"), F.count_if(~F.col("_valid")).alias("skipped"))
        counts = counts.withColumn("batch", F.lit(f"{checkpoint}#{batch_id}"))
        upsert_table(counts, f"{root}/counts", COUNTS, "batch", batch=token)

    return _start(records, take, checkpoint)


def stream_counts(spark, root: str) -> DataFrame:
    """(processed, skipped) of all batches that ``stream_build`` has taken."""
    counts = read_table(spark, f"{root}/counts", COUNTS)
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("processed", "skipped")])


def stream_languages(records: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Running record counts per language, as a keyed table at ``root``.

    The counts are the stream's state; each batch upserts the languages that it changed.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        upsert_table(batch, root, LANGUAGES, "lang", batch=(checkpoint, batch_id))

    return _start(I.lang_distribution(records), take, checkpoint, "update")


def stream_lang_distribution(records: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Running record counts per language, as the in-memory table ``name``."""
    return (
        I.lang_distribution(records)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .format("memory")
        .queryName(name)
        .start()
    )
