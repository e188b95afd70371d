"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are dealt into blocks of ``block`` rows in a fixed pseudo-random
order. A source of weight w (a share of the active weights) releases its i-th block at slot
floor(i / w) and must place it before slot ceil((i + 1) / w); earliest deadline first
over the released blocks fills one slot after the other. Such a schedule always exists for
shares that sum to one, and after any number of slots each source is within one
block of its exact share.

When a source runs out, the shares of the others are scaled up and a new phase
begins; so every row is placed, once. Targets are whole numbers of 50 binary digits, so that
the bound holds for the given shares and does not drift. One task deals all blocks (not rows)
from the weights and block counts of at most about ``MAX_SOURCES`` sources. More sources are
dealt to hash groups first: the groups are scheduled like sources, with the sums of their
members' targets, and the blocks of a group go to its members by the same rule. There a source is
within two blocks of its share for each level of groups, until one of its group runs out, whose
share then goes to the others of the group.

Row numbers within a source come from counts of hash pieces of a bounded mean size and
a window inside each piece, so a source with most of the rows is not gathered either.

Definitions: a null source is a source of its own; sources without a weight, or with one of
0, take part with the smallest weight; repeated rows are rows. Added columns are ``slot``
and ``place`` (order within the block), which replace columns of those names.
"""

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shelfmark.session import materialize

BLOCK = 16
RESOLUTION = 1 << 50
#: Sources that one task schedules together.
MAX_SOURCES = 1000
#: Rows of a hash piece of a source, on average.
PIECE_ROWS = 4_000


def whole_weights(targets: dict, resolution: int = RESOLUTION) -> dict:
    """Target weights as whole numbers of at least 1 that sum to about ``resolution``."""
    total = sum(targets.values()) or 1
    return {s: max(1, round(w * resolution / total)) for s, w in targets.items()}


def earliest(weights: list[int]):
    """Which source fills slot 0, 1, 2 ... by EDF, without end."""
    total = sum(weights)
    done = [0] * len(weights)
    # the next block of every source: waiting for its release, then ready by deadline
    waiting = [(0, s) for s in range(len(weights))]
    ready = []
    for t in itertools.count():
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * total // weights[s]), s))
        s = heapq.heappop(ready)[1]
        yield s
        done[s] += 1
        heapq.heappush(waiting, (done[s] * total // weights[s], s))


def one_round(weights: list[int]) -> list[int]:
    """Which source fills each slot of a round of sum(weights) slots."""
    return list(itertools.islice(earliest(weights), sum(weights)))


def deal(targets: dict, blocks: dict):
    """The source of each slot, until all ``blocks`` are placed.

    A phase ends with the slot at which one of its sources places its last block.
    """
    weights = whole_weights(targets)
    left = {s: n for s, n in blocks.items() if n > 0}
    active = sorted(left, key=lambda s: (s is None, str(s)))
    while active:
        for k in earliest([weights[s] for s in active]):
            s = active[k]
            yield s
            left[s] -= 1
            if not left[s]:
                active.remove(s)
                break


def _dealt(kind: pa.DataType):
    """(key, group, block, slot) of all blocks of the groups of a partition, from (key, group, target, blocks)."""

    def run(batches):
        groups: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                groups.setdefault(r["group"], []).append((r["key"], r["target"], r["blocks"]))
        for group, own in groups.items():
            slots = deal({k: w for k, w, _ in own}, {k: n for k, _, n in own})
            placed, start = {k: 0 for k, _, _ in own}, 0
            while keys := list(itertools.islice(slots, 1 << 15)):
                block = []
                for k in keys:
                    block.append(placed[k])
                    placed[k] += 1
                slot = np.arange(start, start + len(keys))
                columns = [pa.array(keys, kind), pa.array(np.full(len(keys), group)), pa.array(block, pa.int64()), pa.array(slot)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "group", "block", "slot"])
                start += len(keys)

    return run


def _deal_groups(tasks: DataFrame) -> DataFrame:
    """(key, group, block, slot) from (key, group, target, blocks), each group dealt by itself."""
    kind = tasks.schema["key"].dataType
    own = tasks.repartition("group")
    return own.mapInArrow(_dealt(to_arrow_type(kind)), f"key {kind.simpleString()}, group long, block long, slot long")


def slots_of(tasks: DataFrame, n: int, most: int = MAX_SOURCES) -> DataFrame:
    """(key, block, slot) of all blocks of ``n`` tasks (key, target, blocks)."""
    if n <= most:
        return _deal_groups(tasks.withColumn("group", F.lit(0).cast("long"))).select("key", "block", "slot")
    n_groups = -(-2 * n // most)
    grouped = tasks.withColumn("group", F.pmod(F.xxhash64("key", F.lit(n)), F.lit(n_groups)))
    groups = grouped.groupBy(F.col("group").alias("key")).agg(F.sum("target").alias("target"), F.sum("blocks").alias("blocks"))
    outer = slots_of(groups, n_groups, most).select(F.col("key").alias("group"), F.col("block").alias("_at"), F.col("slot").alias("_slot"))
    inner = _deal_groups(grouped).withColumnRenamed("slot", "_at")
    return inner.join(outer, ["group", "_at"]).select("key", "block", F.col("_slot").alias("slot"))


def number_rows(rows: DataFrame, group: str, key: Column, pieces: int, more=None) -> DataFrame:
    """``rows`` with ``_n``: 0, 1, 2 ... within each ``group``, in the order of ``key`` (a hash).

    ``more`` may add columns to the pieces (``group``, ``_piece``, ``_before``, ``_count``), which the rows get.
    """
    piece = F.shiftrightunsigned(key, 40) % pieces
    # a struct is never null, so the join below has the keys of the window and rows move once
    own = F.struct(group)
    rows = rows.withColumn("_key", key).withColumn("_piece", piece).withColumn("_group", own)
    counts = rows.groupBy(group, "_piece").agg(F.count("*").alias("_count"))
    before = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as there are pieces: a small part of the table
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0)))
    offsets = more(offsets) if more else offsets
    added = [f"o.{c}" for c in offsets.columns if c not in (group, "_piece", "_before", "_count")]
    offsets = offsets.withColumn("_group", own)
    within = Window.partitionBy("_group", "_piece").orderBy("_key")
    rows = rows.withColumn("_row", F.row_number().over(within) - 1)
    same = (F.col("r._group") == F.col("o._group")) & (F.col("r._piece") == F.col("o._piece"))
    joined = rows.alias("r").join(offsets.alias("o"), same)
    return joined.select("r.*", *added, (F.col("o._before") + F.col("r._row")).alias("_n")).drop("_row", "_piece", "_key", "_group")


def schedule(docs: DataFrame, weights: dict | None = None, source: str = "source", block: int = BLOCK) -> DataFrame:
    """``docs`` with ``slot`` and ``place``; ordering by both gives the mixture.

    ``weights`` are targets by source; without them, the square roots of the row counts.
    """
    others = [c for c in docs.columns if c not in ("slot", "place")]
    rows = docs.select(F.struct(*others).alias("_r"), F.col(source).alias("_s"))
    counts = materialize(rows.groupBy("_s").agg(F.count("*").alias("n")), "sources")
    size = counts.agg(F.count("*").alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    tasks = counts.select(F.col("_s").alias("key"), F.sqrt("n").alias("target"), F.ceil(F.col("n") / block).alias("blocks"))
    if weights:
        kind = docs.schema[source].dataType.simpleString()
        given = [(s, float(w)) for s, w in weights.items()]
        given = docs.sparkSession.createDataFrame(given, f"_given {kind}, _weight double")
        tasks = tasks.join(given, F.col("key").eqNullSafe(F.col("_given")), "left")
        tasks = tasks.select("key", F.coalesce("_weight", F.lit(0.0)).alias("target"), "blocks")
    slots = materialize(slots_of(tasks, size["sources"]), "slots")

    def with_slots(pieces):
        """The slots of the blocks that each piece has rows of."""
        first, last = (F.floor(x / block) for x in (F.col("_before"), F.col("_before") + F.col("_count") - 1))
        wanted = pieces.withColumn("_b", F.explode(F.sequence(first, last)))
        own = wanted.join(slots, F.col("_s").eqNullSafe(F.col("key")) & (F.col("_b") == F.col("block")))
        own = own.groupBy("_s", "_piece", "_before").agg(F.sort_array(F.collect_list("slot")).alias("_slots"))
        return own.withColumn("_first", F.floor(F.col("_before") / block))

    hashed = F.xxhash64(*[F.col("_r").getField(c) for c in others])
    rows = number_rows(rows, "_s", hashed, max(1, size["rows"] // PIECE_ROWS), with_slots)
    # later blocks of a source have later slots
    at = F.floor(F.col("_n") / block) - F.col("_first")
    slot, place = F.get("_slots", at.cast("int")), (F.col("_n") % block).cast("int")
    return rows.select(*[F.col("_r").getField(c).alias(c) for c in others], slot.cast("long").alias("slot"), place.alias("place"))


def mix(docs: DataFrame, weights: dict | None = None, source: str = "source", block: int = BLOCK) -> DataFrame:
    """All rows of ``docs`` in the order of the mixture, range-partitioned by it."""
    return schedule(docs, weights, source, block).orderBy("slot", "place").select(*docs.columns)
