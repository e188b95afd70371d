"""Equi-join that keeps one hot key from landing in one task."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot above 1/MAX_SHARE of all rows, so there are fewer than MAX_SHARE
# hot keys whatever the data: that bounds the only table broadcast here.
MAX_SHARE = 1000
# ... and never below this many rows, which one task handles well.
MIN_HOT_ROWS = 1_000_000


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_rows"))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    spread: list[Column],
    counts: DataFrame | None = None,
    how: str = "inner",
    min_hot_rows: int | None = None,
) -> DataFrame:
    """``big`` join ``small`` on ``key`` with the hot keys of ``big`` split up.

    Rows of a hot key are spread over several salts by a hash of the ``spread``
    columns (repeatable, so a re-run task sends the same rows to the same place);
    the matching ``small`` rows are repeated once per salt. All other keys keep a
    single salt. ``counts`` (key, n_rows) can be passed when already known.
    ``how`` is ``inner`` or ``left``. The counts are looked at first: without a hot
    key this is a plain join.
    """
    counts = key_counts(big, key) if counts is None else counts
    floor = MIN_HOT_ROWS if min_hot_rows is None else min_hot_rows
    total, peak = counts.agg(F.sum("n_rows"), F.max("n_rows")).first()
    limit = max((total or 0) // MAX_SHARE, floor)
    if (peak or 0) <= limit:
        return big.join(small, key, how)

    hot = F.broadcast(
        counts.filter(F.col(key).isNotNull() & (F.col("n_rows") > limit)).select(
            key, F.ceil(F.col("n_rows") / F.lit(limit)).cast("int").alias("_salts")
        )
    )
    salts = F.coalesce("_salts", F.lit(1))
    big = (
        big.join(hot, key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int"))
        .drop("_salts")
    )
    small = (
        small.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return big.join(small, [key, "_salt"], how).drop("_salt")
