"""Replace-or-insert by key."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest_by_key(df: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """One row per key, the one that arrived last; null is a key like any other.

    The rank limit is applied before the shuffle as well, so a hot key sends at
    most one row per input partition.
    """
    newest = W.partitionBy(key).orderBy(F.desc(order))
    ranked = df.withColumn("_n", F.row_number().over(newest))
    return ranked.filter(F.col("_n") == 1).drop("_n")


def merge_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` and the rows of ``old`` whose key is not in ``new``.

    Both sides hold each key once. Rows of ``old`` are never deleted otherwise.
    """
    replaced = new.select(F.col(key).alias("_key"))
    kept = old.join(replaced, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    return new.unionByName(kept.select(*new.columns))


def merge_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(processed, inserted, updated) of merging ``new`` into ``old``."""
    known = old.select(F.col(key).alias("_key"), F.lit(True).alias("_known"))
    joined = new.join(known, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("_known").isNull()).alias("inserted"),
        F.count_if(F.col("_known").isNotNull()).alias("updated"),
    )
