"""Conversation structure repair: cheapest edits by shortest paths over big-integer weights.

A repaired conversation has the role initials ``(s?(ua)+)?``. Rows are edited in order: Keep (cost 0),
Rerole to user or assistant (2), Delete (3; the only edit of a blank row or a duplicate), and Insert an empty
row of user or assistant anywhere (2). A truncated row that is not deleted adds 1. The audit is the
string of the edits' letters D, I, K, R; of the cheapest ones, the least by ASCII is taken.

Both wishes are one whole number. An edit of cost c whose letter is the p-th of the audit weighs
c * 8 ** W + digit * 8 ** (W - 1 - p), with digits 1-4 in the order of the letters and places after the end left
zero, W being at least the longest audit. Nodes of the graph are (row, state), the state being what was
put out last; the least sum decides everything. Two audits of the same rows cannot have equal cost if one
begins the other (the rest would be inserts, which cost), so what follows cannot turn a decision.

At scale. The path search needs initials and faults only, so it runs on slim rows (two 64-bit hashes
stand for a text), with copies of a row of one turn as a count. Rows are range-partitioned by (conversation, turn, ...):
a long conversation is dealt over many partitions. Each run of at most ``SEGMENT`` rows becomes a segment
with the least weight from each state to each state; conversations are then put together from their
segments, read one after another, with one int per segment and state kept in memory and strings only
as far as the candidates still differ. Texts are shuffled once, for the digest, which is by its nature computed
over a conversation from first to last; they stream through in sorted order and none are gathered.

Definitions: a null role or text is one space, as is a null id or turn in the number that picks the
damage; a null id is a conversation of its own, null turns come first. Rows of one turn are ordered by role,
then by the hashes of the text, so repeated rows are adjacent. An empty role has a space as its initial. An
empty table gives no rows. Columns other than the four are not read.
"""

import hashlib
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import materialize

SEGMENT = 64
_SPACES = " \t\n\x0b\x0c\r"

# States: nothing put out yet, or the initial put out last.
_NONE, _SYSTEM, _USER, _ASSISTANT = range(4)
_INSERTS = [(_NONE, _USER), (_SYSTEM, _USER), (_ASSISTANT, _USER), (_USER, _ASSISTANT)]
_KEEPS = {(_NONE, "s"): _SYSTEM, **{(a, "u" if b == _USER else "a"): b for a, b in _INSERTS}}
_REROLES = dict(_INSERTS)
#: Edits that end a conversation: (cost, letters).
_ENDINGS = {_NONE: (0, ""), _ASSISTANT: (0, ""), _USER: (2, "I"), _SYSTEM: (4, "II")}
_DIGITS = str.maketrans("DIKR", "1234")
_LETTERS = str.maketrans("1234", "DIKR")
_KEY = ["conv_id", "turn", "role", "hash_a", "hash_b"]


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows that remain, with their number."""
    space = F.lit(" ")
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.crc32(name) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.filter(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"hash_a": F.xxhash64("text"), "hash_b": F.xxhash64(F.lit(1), "text")})


def slim_rows(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one: ``_KEY``, blank, open (truncated), copies and whether the first is no duplicate."""
    bare = F.rtrim("text", F.lit(_SPACES))
    slim = _hashed(rows).select(
        *_KEY, (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"), "copies"
    )
    slim = slim.groupBy(*_KEY, "blank", "open").agg(F.sum("copies").alias("copies"))
    same = ["conv_id", "role", "hash_a", "hash_b"]
    # nulls first: the first turn is null if any is
    turns = slim.groupBy(*same).agg(F.max(F.col("turn").isNull()).alias("no_turn"), F.min("turn").alias("least"))
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in same]
    first = F.when(F.col("no_turn"), F.col("x.turn").isNull()).otherwise(F.col("x.turn") == F.col("least"))
    return slim.alias("x").join(turns.alias("y"), on).select("x.*", first.alias("first"))


# ----------------------------------------------------------------- shortest paths


def _edge(to: dict, state: int, width: int, source: tuple, cost: int, digit: int) -> None:
    """Offers a path: weight of the source and of one more edit, whose letter takes the next place."""
    weight, place = source
    weight += (cost << 3 * width) + (digit << 3 * (width - 1 - place))
    if state not in to or weight < to[state][0]:
        to[state] = (weight, place + 1)


def _advance(states: dict, initial: str, must_go: bool, is_open: int, width: int) -> dict:
    """Least paths after one more row; states: {state: (weight, letters so far)}."""
    states = dict(states)
    for a, b in _INSERTS:  # in this order, two inserts in a row are found too
        if a in states:
            _edge(states, b, width, states[a], 2, 2)
    after: dict = {}
    for state, source in states.items():
        _edge(after, state, width, source, 3, 1)
        if not must_go:
            if (state, initial) in _KEEPS:
                _edge(after, _KEEPS[state, initial], width, source, is_open, 3)
            _edge(after, _REROLES[state], width, source, 2 + is_open, 4)
    return after


def paths(units: list[tuple[str, bool, int]], entry: int) -> dict[int, tuple[int, str]]:
    """(cost, letters) of the best edits of rows (initial, must go, truncated) from a state to each state."""
    width = 3 * len(units) + 1
    states = {entry: (0, 0)}
    for initial, must_go, is_open in units:
        states = _advance(states, initial, must_go, is_open, width)
    mask = (1 << 3 * width) - 1
    return {s: (w >> 3 * width, f"{w & mask:0{width}o}"[:n].translate(_LETTERS)) for s, (w, n) in states.items()}


def _weight(cost: int, letters: str, width: int) -> int:
    return (cost << 3 * width) + int(letters.translate(_DIGITS).ljust(width, "0"), 8)


# ---------------------------------------------------------------------- segments

_ROW = "turn: bigint, role: string, hash_a: bigint, hash_b: bigint, blank: boolean, duplicate: boolean, open: boolean"
_FIELDS = f"part int, seg long, units array<struct<{_ROW}>>, costs array<long>, letters array<string>"


def _initial(role: str) -> str:
    return role[:1] or " "


def _segment_rows(batches):
    """Units of consecutive rows as segments of one conversation each: (begins, conv, units)."""
    conv, units, begins, any_row = None, [], False, False
    for batch in batches:
        for row in batch.to_pylist():
            if not any_row or row["conv_id"] != conv:
                if units:
                    yield begins, conv, units
                # the first rows of a partition may go on with a conversation of the one before
                conv, units, begins, any_row = row["conv_id"], [], any_row, True
            for i in range(row["copies"]):
                unit = {c: row[c] for c in ("turn", "role", "hash_a", "hash_b", "blank", "open")}
                units.append(unit | {"duplicate": not row["first"] or i > 0})
                if len(units) == SEGMENT:
                    yield begins, conv, units
                    units, begins = [], False
    if units:
        yield begins, conv, units


def _segments(schema):
    def run(batches):
        part = TaskContext.get().partitionId()
        rows = []
        for seg, (begins, conv, units) in enumerate(_segment_rows(batches)):
            plain = [(_initial(u["role"]), u["blank"] or u["duplicate"], int(u["open"])) for u in units]
            costs, letters = [None] * 16, [None] * 16
            for entry in (_NONE,) if begins else range(4):
                for state, (cost, audit) in paths(plain, entry).items():
                    costs[4 * entry + state], letters[4 * entry + state] = cost, audit
            rows.append({"conv_id": conv, "part": part, "seg": seg, "units": units, "costs": costs, "letters": letters})
            if len(rows) == 256:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


class _Conversation:
    """Segments put together: least paths so far, and where each came from."""

    def __init__(self):
        self.paths = {_NONE: (0, "")}  # state: cost, letters since the paths last agreed
        self.keys, self.came = [], []
        self.counts = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0)
        self.role = self.least = self.last = None
        self.turns = 0

    def add(self, row: dict) -> None:
        found, came = {}, [0] * 4
        width = 2 * SEGMENT + max(len(p) for _, p in self.paths.values()) + max(len(x) for x in row["letters"] if x) + 1
        for entry, (cost, audit) in self.paths.items():
            for state in range(4):
                if (more := row["costs"][4 * entry + state]) is not None:
                    option = (cost + more, audit + row["letters"][4 * entry + state])
                    weight = _weight(*option, width)
                    if state not in found or weight < found[state][0]:
                        found[state], came[state] = (weight, *option), entry
        agreed = len(commonprefix([audit for _, _, audit in found.values()]))
        self.paths = {s: (cost, audit[agreed:]) for s, (_, cost, audit) in found.items()}
        self.keys.append((row["part"], row["seg"]))
        self.came.append(bytes(came))
        for unit in row["units"]:
            self._count(unit)

    def _count(self, unit: dict) -> None:
        fault = next((f for f in ("blank", "duplicate") if unit[f]), "truncated" if unit["open"] else None)
        if fault:
            self.counts[fault] += 1
        initial, turn = _initial(unit["role"]), unit["turn"]
        if self.role is not None and self.role + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.role = initial
        if turn is not None and turn != self.last:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.last = turn

    def rows(self, conv):
        """A row for each segment: its states, and at the last one the ending and the totals."""
        ends = {s: (cost + _ENDINGS[s][0], audit + _ENDINGS[s][1]) for s, (cost, audit) in self.paths.items()}
        width = max(len(audit) for _, audit in ends.values()) + 1
        state = min(ends, key=lambda s: _weight(*ends[s], width))
        if self.turns:
            self.counts["gaps"] = self.last - self.least + 1 - self.turns
        more = {"tail": _ENDINGS[state][1], "cost": ends[state][0], **self.counts}
        for (part, seg), came in zip(reversed(self.keys), reversed(self.came), strict=True):
            entry = came[state]
            yield {"conv_id": conv, "part": part, "seg": seg, "way": 4 * entry + state, **more}
            state, more = entry, {}


_CHOSEN = (
    "part int, seg long, way int, tail string, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"
)


def _choose(schema):
    def run(batches):
        conv, current, rows = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if current is None or row["conv_id"] != conv:
                    if current:
                        rows.extend(current.rows(conv))
                    conv, current = row["conv_id"], _Conversation()
                current.add(row)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if current:
            yield pa.RecordBatch.from_pylist(list(current.rows(conv)), schema)

    return run


def _arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _struct(spark, conv_type: str, fields: str):
    return spark.createDataFrame([], f"conv_id {conv_type}, {fields}").schema


def plan_repairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits and totals of damaged rows.

    Edits, one row each: conv_id, (part, seg, at) for their order, ``edit`` (its letter) and the key of the row
    that it edits, or beside which it inserts. Totals: conv_id, cost and the counts of the conversation.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["conv_id"]
    ordered = slim_rows(rows).repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)
    schema = _struct(spark, kind, _FIELDS)
    segments = materialize(ordered.mapInArrow(_segments(_arrow(schema)), schema), "segments")
    schema = _struct(spark, kind, _CHOSEN)
    streamed = segments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    chosen = materialize(streamed.mapInArrow(_choose(_arrow(schema)), schema), "chosen")
    # the letters of a row: inserts before it and its own edit
    way = F.concat(F.get("letters", F.col("way")), F.coalesce("tail", F.lit("")))
    letters = F.regexp_extract_all(way, F.lit("I*[DKR](?:I+$)?"), F.lit(0))
    edits = segments.join(chosen.drop("conv_id"), ["part", "seg"]).select(
        "conv_id", "part", "seg", F.posexplode(F.arrays_zip(F.col("units"), letters.alias("edits"))).alias("at", "u")
    )
    edits = edits.select("conv_id", "part", "seg", "at", "u.units.turn", "u.units.role", "u.units.hash_a", "u.units.hash_b", "u.edits")
    return edits, chosen.filter("cost is not null").drop("part", "seg", "way", "tail")


# -------------------------------------------------------------------- texts

_DIGEST = "audit string, repaired_sha256 string, repaired_rows long"


def _lines(edits: str, role: str, text, state: str):
    """(role, text) that the edits of a row put out; ``state`` is the initial put out before."""
    for edit in edits:
        if edit == "K":
            state = _initial(role)
            yield state, role, text
        elif edit != "D":
            new = "assistant" if state == "u" else "user"
            state = new[0]
            yield state, new, text if edit == "R" else ""


def _digests(schema):
    def run(batches):
        conv, any_row, audit, digest, text, state, n = None, False, [], None, None, "", 0

        def row():
            return {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest(), "repaired_rows": n}

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if not any_row or r["conv_id"] != conv:
                    if any_row:
                        done.append(row())
                    conv, any_row, audit, digest, state, n = r["conv_id"], True, [], hashlib.sha256(), "", 0
                if r["edits"] is None:
                    text = r["text"]  # sorted just before the edits of its key
                    continue
                audit.append(r["edits"])
                for state, role, line in _lines(r["edits"], r["role"], text, state):
                    digest.update(f"{chr(10) if n else ''}{role}:{line}".encode())
                    n += 1
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if any_row:
            yield pa.RecordBatch.from_pylist([row()], schema)

    return run


def _with_texts(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Texts (once a key at least) and edits, in the order of each conversation."""
    none = {c: F.lit(None) for c in ("part", "seg", "at", "edits")}
    texts = _hashed(rows.drop("copies")).withColumns(none)
    both = texts.unionByName(edits.withColumn("text", F.lit(None).cast("string")))
    order = [*_KEY, F.col("part").asc_nulls_first(), "seg", "at"]
    return both.repartition("conv_id").sortWithinPartitions(*order)


def digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256, repaired_rows) of each conversation with rows."""
    schema = _struct(rows.sparkSession, dict(rows.dtypes)["conv_id"], _DIGEST)
    return _with_texts(rows, edits).mapInArrow(_digests(_arrow(schema)), schema)


_REPAIRED = "place long, role string, text string"


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place from 0, role, text)."""
    schema = _struct(rows.sparkSession, dict(rows.dtypes)["conv_id"], _REPAIRED)
    arrow = _arrow(schema)

    def run(batches):
        conv, any_row, text, state, n = None, False, None, "", 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not any_row or r["conv_id"] != conv:
                    conv, any_row, state, n = r["conv_id"], True, "", 0
                if r["edits"] is None:
                    text = r["text"]
                    continue
                for state, role, line in _lines(r["edits"], r["role"], text, state):
                    out.append({"conv_id": conv, "place": n, "role": role, "text": line})
                    n += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

    return _with_texts(rows, edits).mapInArrow(run, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """A row for each conversation of the damaged table: faults, cheapest edits, digest of the repaired rows."""
    rows = damage(conversations)
    edits, totals = plan_repairs(rows)
    digest = digests(rows, edits).withColumnRenamed("conv_id", "digest_id")
    every = conversations.select(F.col("conv_id").alias("id")).distinct()
    out = every.join(totals, F.col("id").eqNullSafe(totals["conv_id"]), "left")
    out = out.join(digest, F.col("id").eqNullSafe(F.col("digest_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        F.col("id").alias("conv_id"),
        *zero,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
