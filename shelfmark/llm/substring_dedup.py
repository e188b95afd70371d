"""Removal of long word runs that occur more than once in the corpus (seed and extend).

``window`` (35) consecutive words of one text are a window. Every word covered by
a window whose word sequence also starts at another place, in the same text or
another, is removed; windows are judged on the input.

Seeds. Each window elects an anchor, its run of ``ANCHOR`` words with the smallest
hash (the first of equals). Equal windows elect equal anchors at the same offset, so
an anchor that occurs once rules out all windows that elected it. The elected
positions are the winnowed anchors of the text, about one per 15 words.

Extension. An anchor occurrence is extended both ways over the span of all windows
that elected it. Occurrences meet by a join on (anchor, span): equal spans
confirm all their windows at once, however many occurrences there are, because they
are counted and never paired. Where an anchor has different spans (at the ends of a
repeat), the windows of one occurrence per span are compared one by one. Confirmed
windows unite to the maximal repeats of at least ``window`` words.

Definitions: null text has no words; a text of fewer than ``window`` words keeps all;
repeated rows count as further occurrences; rows with equal (also null) ids are
separate texts. Extra columns are kept; the added names are listed at each function.
"""

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.batches import releasing
from shelfmark.llm.words import owner, run_hashes, text_slices, word_hashes, word_spans
from shelfmark.session import materialize

WINDOW = 35
ANCHOR = 8


def _sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the first smallest value of h[i : i + width], for every i."""
    n = len(h) - width + 1
    best = np.arange(len(h))
    span = 1
    while span * 2 <= width:
        left, right = best[:-span], best[span:]
        best = np.where(h[right] < h[left], right, left)
        span *= 2
    left, right = best[:n], best[width - span : width - span + n]
    return np.where(h[right] < h[left], right, left)


class _Texts:
    """Words and windows of a slice of texts."""

    def __init__(self, data, offsets, window):
        self.starts, self.stops, self.firsts = word_spans(data, offsets)
        self.hashes = word_hashes(data, self.starts, self.stops)
        n = len(self.hashes)
        if n < window:
            self.windows = self.elected = np.zeros(0, np.int64)
            return
        first = np.arange(n - ANCHOR + 1)
        grams = run_hashes(self.hashes, first, first + ANCHOR)
        text = owner(self.firsts)
        self.windows = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
        self.elected = _sliding_argmin(grams, window - ANCHOR + 1)[self.windows]
        self.grams, self.text = grams, text


def _anchors(window):
    """(anchor, span, text key, anchor position) of each winnowed anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key")
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                t = _Texts(data, offsets, window)
                if not len(t.windows):
                    continue
                new = np.ones(len(t.windows), dtype=bool)
                new[1:] = (t.elected[1:] != t.elected[:-1]) | (np.diff(t.windows) != 1)
                at = np.flatnonzero(new)
                last = np.append(at[1:], len(new)) - 1
                pos, lo_word, hi_word = t.elected[at], t.windows[at], t.windows[last] + window
                spans = run_hashes(t.hashes, lo_word, hi_word)
                # the place of the anchor in its span belongs to what must be equal
                spans ^= (pos - lo_word).astype(np.uint64)
                base = t.firsts[t.text[pos]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(t.grams[pos].view(np.int64)),
                        pa.array(spans.view(np.int64)),
                        keys.slice(lo, hi - lo).take(pa.array(t.text[pos])),
                        pa.array((lo_word - base).astype(np.int32)),
                        pa.array((hi_word - base).astype(np.int32)),
                    ],
                    names=["anchor", "span", "key", "lo", "hi"],
                )

    return run


def _window_rows(window):
    """The single windows of the spans listed in ``spans`` of each text."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            anchor, key, lo, hash_ = [], [], [], []
            for k, packed, spans in zip(
                batch.column("key").to_pylist(),
                batch.column("packed"),
                batch.column("spans").to_pylist(),
                strict=True,
            ):
                data = np.frombuffer(unpack.decompress(packed.as_py()), np.uint8)
                starts, stops, _ = word_spans(data, np.array([0, len(data)]))
                hashes = word_hashes(data, starts, stops)
                for s in spans:
                    at = np.arange(s["lo"], s["hi"] - window + 1)
                    lo.append(at)
                    hash_.append(run_hashes(hashes[s["lo"] : s["hi"]], at - s["lo"], at - s["lo"] + window))
                    anchor.append(np.full(len(at), s["anchor"], np.int64))
                    key.append(np.full(len(at), k, np.int64))
            if lo:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(anchor)),
                        pa.array(np.concatenate(hash_).view(np.int64)),
                        pa.array(np.concatenate(key)),
                        pa.array(np.concatenate(lo).astype(np.int32)),
                    ],
                    names=["anchor", "hash", "key", "lo"],
                )

    return run


def _pack(batches):
    """Texts compressed, so that a shuffle carries a fraction of their bytes."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        i = batch.schema.get_field_index("text")
        packed = [packer.compress((t or "").encode()) for t in batch.column(i).to_pylist()]
        yield batch.set_column(i, "packed", pa.array(packed, pa.binary()))


def kept_words(raw: bytes, covered: list | None) -> tuple[list[bytes], int]:
    """Words that stay, and the number of all words; ``covered`` are [lo, hi) word ranges."""
    words = raw.split()  # of bytes: exactly space and U+0009-U+000D
    if not covered:
        return words, len(words)
    keep = bytearray(b"\1") * len(words)
    for s in covered:
        keep[s["lo"] : s["hi"]] = bytes(s["hi"] - s["lo"])
    return list(compress(words, keep)), len(words)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, lo, hi): word ranges of repeated windows; ``docs`` has ``key`` and ``text``.

    Texts with equal keys are equal, so a range holds for all rows of its key.
    """
    found = materialize(
        docs.select("key", "text").mapInArrow(
            releasing(_anchors(window)), "anchor long, span long, key long, lo int, hi int"
        ),
        "anchors",
    )
    # counted with partial aggregation: a passage in a third of all texts is one row per task
    spans = found.groupBy("anchor", "span").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "lo", "hi")).alias("one")
    )
    # all of an anchor's spans
    anchors = spans.groupBy("anchor").agg(F.count("*").alias("n_spans"), F.sum("n").alias("total"))
    judged = materialize(
        spans.join(anchors.filter("total > 1"), "anchor").select("anchor", "span", "n", "n_spans", "one"),
        "spans",
    )
    whole = found.join(judged.filter("n > 1").select("anchor", "span"), ["anchor", "span"]).select("key", "lo", "hi")

    single = judged.filter("n_spans > 1").select("one.key", F.struct("anchor", "one.lo", "one.hi").alias("s"), "n")
    by_text = single.groupBy("key").agg(F.collect_list("s").alias("spans"))
    packed = docs.select("key", "text").mapInArrow(releasing(_pack), "key long, packed binary")
    texts = packed.groupBy("key").agg(F.first("packed").alias("packed")).join(by_text, "key")
    windows = materialize(
        texts.mapInArrow(releasing(_window_rows(window)), "anchor long, hash long, key long, lo int"), "windows"
    )
    again = windows.groupBy("anchor", "hash").agg(F.count("*").alias("n")).filter("n > 1")
    parts = windows.join(again.select("anchor", "hash"), ["anchor", "hash"]).select(
        "key", "lo", (F.col("lo") + window).cast("int").alias("hi")
    )
    return whole.unionByName(parts)


def _cut(batches):
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        n_words, n_removed, sha, kept_text = [], [], [], []
        for packed, covered in zip(
            batch.column("packed").to_pylist(), batch.column("covered").to_pylist(), strict=True
        ):
            kept, n = kept_words(unpack.decompress(packed), covered)
            joined = b" ".join(kept)
            n_words.append(n)
            n_removed.append(n - len(kept))
            sha.append(hashlib.sha256(joined).hexdigest())
            # the text itself where nothing is removed, white space included
            kept_text.append((joined if covered else unpack.decompress(packed)).decode())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(sha, pa.string()),
                pa.array(kept_text, pa.string()),
            ],
            names=["row", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def dedup_substrings(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without ``text``, with n_words, n_removed, kept_sha256 and kept_text.

    ``kept_text`` is the text itself where nothing is removed, else the kept words
    joined by single spaces; ``kept_sha256`` is always of the joined words. Columns of
    ``docs`` with one of the four added names are replaced.
    """
    added = ("n_words", "n_removed", "kept_sha256", "kept_text")
    others = [c for c in docs.columns if c not in (text, *added)]
    keyed = docs.select(
        F.struct(F.lit(0).alias("_"), *others).alias("row"),
        F.col(text).alias("text"),
        F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.length(text)).alias("key"),
    )
    # written first, so that the shuffles of the search are gone when the texts move
    covered = materialize(
        repeated_spans(keyed, window).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("covered")), "covered"
    )
    packed = keyed.mapInArrow(
        releasing(_pack), T.StructType([keyed.schema["row"], T.StructField("packed", T.BinaryType()), keyed.schema["key"]])
    )
    joined = packed.join(covered, "key", "left").select("row", "packed", "covered")
    schema = T.StructType([joined.schema["row"]]).add("n_words", "long").add("n_removed", "long")
    schema = schema.add("kept_sha256", "string").add("kept_text", "string")
    return joined.mapInArrow(releasing(_cut), schema).select(*[F.col("row").getField(c).alias(c) for c in others], *added)
