"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each shingle of ``SHINGLE`` words is hashed once. The high bits of the hash name one
of ``BINS`` bins, the lowest hash in a bin is its value. An empty bin borrows the
value of the first filled bin in its own probing order, which starts at the bin
itself and is a fixed pseudo-random walk through all bins (optimal densification: which
filled bin lends is equally likely and the same for all texts). The fingerprint is the
low ``BITS`` bits of every bin, as hexadecimal text.

The share of equal bins of two fingerprints estimates their similarity J plus chance
hits: share = J + (1 - J) / 2 ** BITS; ``likeness`` solves for J.

Definitions: words are runs of characters other than space and U+0009-U+000D, case kept; a
text with fewer words than a shingle is one shingle; a null text or one without words has
the empty fingerprint, which is like itself (1) and unlike all others (0). Rows are
independent.
"""

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
BINS = 128  # a power of two
BITS = 8
_BIN_BITS = BINS.bit_length() - 1
_DIGITS = BITS // 4


@lru_cache
def _walks() -> list[int]:
    """An odd step for each bin; its inverse modulo BINS says when the walk meets another bin."""
    rng = np.random.default_rng(11)
    return (rng.integers(0, BINS // 2, BINS) * 2 + 1).tolist()


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def _shingle_hashes(w: Column) -> Column:
    """Hash of every shingle; the unsigned order of hashes is their signed order here."""
    count = F.greatest(F.size(w) - (SHINGLE - 1), F.least(F.size(w), F.lit(1)))
    at = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - _BIN_BITS).cast("int")


def _low(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def add_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with string column ``name``, the fingerprint of column ``text``."""
    # one projection for each step, so that every step is computed once
    found, hashes, filled, codes, bins = (f"{name}_{x}" for x in ("words", "hashes", "filled", "codes", "bins"))
    df = df.withColumn(found, words(F.col(text)))
    df = df.withColumn(hashes, F.sort_array(_shingle_hashes(F.col(found)))).drop(found)
    h = F.col(hashes)
    # sorted by signed value, equal bins are still neighbours: the first of each is its least
    lead = F.filter(h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(h, i - 1))))
    df = df.withColumn(filled, lead).drop(hashes)
    f = F.col(filled)
    steps = F.array(*[F.lit(s) for s in _walks()])
    every = F.sequence(F.lit(0), F.lit(BINS - 1))
    unit = 1 << BITS

    def lender(i):
        # (when the walk of bin i meets the filled bin, its low bits), least first
        met = F.transform(
            f, lambda x: ((_bin(x) - i) * F.get(steps, i)).bitwiseAND(F.lit(BINS - 1)) * unit + _low(x)
        )
        return F.array_min(met).bitwiseAND(F.lit(unit - 1))

    # filled bins as (bin, 0, low bits) and all bins as (bin, 1, 0), sorted; a bin is empty
    # if no filled one of its number comes just before
    filled_codes = F.transform(f, lambda x: _bin(x) * (2 * unit) + _low(x))
    every_code = F.transform(every, lambda i: i * (2 * unit) + unit)
    df = df.withColumn(codes, F.when(F.size(f) > 0, F.sort_array(F.concat(filled_codes, every_code))))
    c = F.col(codes)

    def stays(x, i):
        return (x.bitwiseAND(F.lit(unit)) == 0) | (i == 0) | (F.get(c, i - 1) < x - unit)

    def value(x):
        empty = x.bitwiseAND(F.lit(unit)) != 0
        return F.when(empty, lender(F.shiftright(x, BITS + 1))).otherwise(x.bitwiseAND(F.lit(unit - 1)))

    values = F.transform(F.filter(c, stays), value)
    df = df.withColumn(bins, values).drop(filled, codes)
    packed = F.array_join(F.transform(F.col(bins), lambda v: F.lpad(F.lower(F.hex(v)), _DIGITS, "0")), "")
    return df.withColumn(name, F.coalesce(packed, F.lit(""))).drop(bins)


def likeness(a: Column, b: Column) -> Column:
    """Similarity of two fingerprints, corrected for bins that agree by chance (0 to 1)."""
    every = F.sequence(F.lit(0), F.lit(BINS - 1))
    same = F.size(F.filter(every, lambda i: F.substr(a, i * _DIGITS + 1, F.lit(_DIGITS)) == F.substr(b, i * _DIGITS + 1, F.lit(_DIGITS))))
    chance = 2.0**-BITS
    corrected = (same / BINS - chance) / (1 - chance)
    return (
        F.when(a == b, F.lit(1.0))
        .when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .otherwise(F.greatest(corrected, F.lit(0.0)))
    )


def with_next(docs: DataFrame, id_col: str, carried: list[str], parts: int) -> DataFrame:
    """``docs`` with ``next``, a struct of the ``carried`` columns of the next row.

    Rows are in descending order of id (ids that are equal by descending ``carried``
    columns, null ids last); after the last row comes the first. The order is cut at
    exact ids, about ``parts`` quantiles found without sorting the table, and each
    piece is a window of its own; the row a piece begins with is repeated at the end of
    the piece before it, so no piece looks into another.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    found = ids.agg(
        F.percentile_approx("id", F.array(*[F.lit(i / parts) for i in range(1, parts + 1)]), 10_000).alias("cuts"),
        F.max("id").alias("top"),
        F.count(F.when(F.col("id").isNull(), 1)).alias("nulls"),
    ).first()  # ``parts`` numbers, whatever the table
    # a piece begins with the rows of its cut and goes down to the next one
    cuts = sorted({*(found["cuts"] or ()), *([] if found["top"] is None else [found["top"]])}, reverse=True)
    if found["nulls"] or not cuts:
        cuts.append(None)
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts if c is not None])
    n = len(cuts)
    numbered = len([c for c in cuts if c is not None])
    i = F.col(id_col).cast("long")
    piece = F.when(i.isNull(), F.lit(n - 1)).otherwise(
        (F.lit(numbered) - F.size(F.filter(bounds, lambda c: c < i)) - 1)
        if numbered
        else F.lit(0)
    )
    # the piece whose cut is the smallest one not below the id
    is_cut = i.isNull() | F.array_contains(bounds, i)
    copies = F.when(is_cut, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = docs.withColumn("_piece", piece.cast("int")).withColumn("_copy", F.explode(copies))
    rows = rows.withColumn("_piece", F.pmod(F.col("_piece") - F.col("_copy"), F.lit(n)))
    order = [F.col("_copy"), F.col(id_col).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in carried]]
    window = Window.partitionBy("_piece").orderBy(*order)
    out = rows.withColumn("next", F.lead(F.struct(*carried)).over(window))
    return out.filter("_copy = 0").drop("_piece", "_copy")


def edited_text(text: Column, following: Column) -> Column:
    """``text`` whose last third is replaced by as many first characters of ``following``."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - third), F.substr(following, F.lit(1), third))
