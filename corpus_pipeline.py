"""The training-data pipeline over ``documents``: each stage's decisions take effect.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All stages but the last return
the columns of documents; extra columns of the input are dropped. The last one also returns each
document's slot and place in the mixture, which do not depend on the order of the files.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark.llm import bpe, mixing, toxicity
from shelfmark.llm.batches import small_batches
from shelfmark.llm.near_dedup import near_duplicates
from shelfmark.llm.queries import vocabulary_path
from shelfmark.llm.substring_dedup import dedup_substrings
from shelfmark.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Word shingles of the near-duplicate stage, and their least similarity in hundredths.
SHINGLE, PERCENT = 5, 80


def remove_toxic(spark, docs, sf_dir):
    """Documents with a toxicity score of at least the threshold go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select(*COLUMNS), model, name="_toxicity")
    return scored.filter(F.col("_toxicity") < toxicity.THRESHOLD).drop("_toxicity")


def remove_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies stays, the one with the smallest id (null ids last).

    Rows of one id with different texts are documents of their own, and so are rows without an
    id; rows with equal ids and texts count once. Documents without words stay.
    """
    named = docs.select(*COLUMNS).withColumn("_key", F.xxhash64("doc_id", "text"))
    groups = near_duplicates(named, id_col="_key", shingle=SHINGLE, percent=PERCENT).select("_key", "component_id").distinct()
    first = F.min_by("_key", F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("_key")
    kept = named.select("doc_id", "_key").join(groups, "_key").groupBy("component_id").agg(first)
    one = Window.partitionBy("_key").orderBy("lang", "source", "n_chars")
    rows = named.join(kept.select("_key"), "_key").withColumn("_row", F.row_number().over(one))
    return rows.filter("_row = 1").select(*COLUMNS)


def remove_repeated_passages(spark, docs, sf_dir):
    """Words of passages that occur more than once go; every document stays."""
    cut = dedup_substrings(docs.select(*COLUMNS)).drop("n_words", "n_removed", "kept_sha256")
    cut = cut.withColumnRenamed("kept_text", "text")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark, docs, sf_dir):
    """All documents in the order of the mixture."""
    return mixing.mix(docs.select(*COLUMNS))


def encode(spark, docs, sf_dir):
    """Token ids of each document, the text that they decode to, and its ``slot`` and ``place`` in the mixture."""
    # the same rows as in the mixing stage, so the same slots: the order of its files is lost
    placed = mixing.schedule(docs.select(*COLUMNS))
    coded = bpe.encode(placed, vocabulary_path()).drop("text")
    coded = bpe.decode(coded, vocabulary_path(), decoded="text")
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", remove_toxic),
    ("near dedup", remove_near_duplicates),
    ("substring dedup", remove_repeated_passages),
    ("source mixing", mix_sources),
    ("bpe", encode),
]

#: The stages use trained models, hashing and scheduling, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with small_batches(spark, "4m"):
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
