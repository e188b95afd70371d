"""Byte-level BPE: texts to token ids and back, with a published vocabulary file.

Encoding. A text is cut at the strings of added tokens, the rest into pieces (words
with their leading blank, numbers, other marks, white space). The bytes of a piece
are a doubly linked list of symbols; a priority queue holds the merge rank of each
neighbouring pair. The lowest rank, leftmost first, is merged, its two new pairs
are queued, and entries whose pair no longer exists are skipped when they surface. Pieces
repeat a lot, so each worker remembers a bounded number of short ones; pieces met once do not push
out those met again.

Decoding concatenates the vocabulary strings of the ids. Bytes that are not UTF-8
(ids cut in the middle of a character) become U+FFFD.

Definitions: null text is the empty text, which has no ids and decodes to itself; ids
that the vocabulary lacks are an error. Rows are independent; extra columns stay.
"""

import gc
import json
import re
import sys
import unicodedata
from array import array
from collections import defaultdict
from contextlib import contextmanager
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfmark.llm.batches import releasing

#: Pieces a worker remembers at most (some 25 MB): this many met again, and as many met once or
#: long ago. Longer pieces than ``KEPT_CHARS`` characters are rare and not kept.
MAX_PIECES = 50_000
KEPT_CHARS = 64
#: Texts handed to Arrow at a time, in characters.
BATCH_CHARS = 4_000_000

# Characters with the White_Space property, and the contractions.
_SPACE = "\t-\r \x85\xa0  -     　"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


@lru_cache
def _ranges(kind: str, top: int) -> str:
    """The code points to ``top`` of a general category (L or N), inside a character class."""
    found, first = [], None
    for c in range(top + 2):
        inside = c <= top and unicodedata.category(chr(c))[0] == kind
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            found.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(found)


@lru_cache
def piece_pattern(top: int = sys.maxunicode) -> re.Pattern:
    """Pieces of a text whose characters are at most ``top``; a low one is several times faster."""
    letter, number = _ranges("L", top), _ranges("N", top)
    return re.compile(
        f"{_CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+"
        f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


@lru_cache
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file.

    Printable Latin-1 stands for itself; the others follow from U+0100 in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256))
    return [chr(b) if b in own else chr(256 + next(others)) for b in range(256)]


class Vocabulary(dict):
    """A vocabulary file; as a dict, pieces already encoded (text -> int32 ids as bytes)."""

    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.max_pieces, self.older = max_pieces, {}
        self.strings = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in token)
        for token, i in added.items():
            self.strings[i] = token.encode()
        self.byte_ids = [vocab[c] for c in byte_letters()]
        merges = [(vocab[left], vocab[right], vocab[left + right]) for left, right in spec["model"]["merges"]]
        self.merged = [i for _, _, i in merges]
        pairs = defaultdict(dict)
        for rank, (left, right, _) in enumerate(merges):
            pairs[left][right] = rank << 32
        nothing = {}
        #: By symbol: the rank, shifted, of its pair with a next symbol. The same of two bytes.
        self.ranks = [pairs.get(i, nothing).get for i in range(len(self.strings))]
        found = ((a, b, self.ranks[i](j)) for a, i in enumerate(self.byte_ids) for b, j in enumerate(self.byte_ids))
        self.byte_ranks = {(a, b): rank for a, b, rank in found if rank is not None}
        self.added = {t: np.int32(i).tobytes() for t, i in added.items()}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")
        self.high = re.compile("[\U00010000-\U0010ffff]")

    def __missing__(self, piece: str) -> bytes:
        older, room = self.older, self.max_pieces
        ids = older.pop(piece, None)
        if ids is None:
            ids = array("i", self.merge(piece.encode())).tobytes()
            if len(piece) <= KEPT_CHARS:
                older[piece] = ids
        else:
            if len(self) >= room:
                for p in list(islice(self, max(room // 8, 1))):
                    older[p] = self.pop(p)
            self[piece] = ids
        if len(older) > room:
            for p in list(islice(older, max(room // 8, len(older) - room))):
                del older[p]
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of a piece."""
        n, ranks, merged = len(piece), self.ranks, self.merged
        symbols = [self.byte_ids[b] for b in piece]
        # the queue's entry of each symbol's pair with the next one
        found = enumerate(map(self.byte_ranks.get, zip(piece, piece[1:], strict=False)))
        entries = [rank if rank is None else rank | i for i, rank in found]
        queue = [e for e in entries if e is not None]
        heapify(queue)
        entries.append(None)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while queue:
            top = heappop(queue)
            i = top & 0xFFFFFFFF
            if entries[i] != top:  # stale: one of the two has changed
                continue
            j = after[i]
            new = symbols[i] = merged[top >> 32]
            symbols[j], entries[j] = -1, None
            k = after[i] = after[j]
            before[k] = i
            entry = ranks[new](symbols[k]) if k < n else None
            if entry is not None:
                entry |= i
                heappush(queue, entry)
            entries[i] = entry
            h = before[i]
            if h >= 0:
                entry = ranks[symbols[h]](new)
                if entry is not None:
                    entry |= h
                    heappush(queue, entry)
                entries[h] = entry
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> np.ndarray:
        top = sys.maxunicode if self.high.search(text) else 0xFFFF
        known, pieces = self.__getitem__, piece_pattern(top).findall
        if not self.added:
            return np.frombuffer(b"".join(map(known, pieces(text))), np.int32)
        parts = []
        for part in self.cut.split(text):
            parts.append(self.added.get(part) or b"".join(map(known, pieces(part))))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.strings.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _added(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema if f.name != name] + [T.StructField(name, kind)])


def _parts(lengths: list[int]):
    """Ranges of rows with about BATCH_CHARS characters or ids each."""
    first, total = 0, 0
    for i, n in enumerate(lengths):
        total += n
        if total >= BATCH_CHARS:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(lengths):
        yield first, len(lengths)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), column], names=[*names, name])


@contextmanager
def _without_gc():
    """Merging makes many lists but no cycles: the collector would look at all of them for nothing."""
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


def encode(docs: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with array column ``ids`` (replaced if there is one of that name)."""

    def run(batches):
        vocab = vocabulary(vocab_path)
        for batch in batches:
            texts = batch.column(text).fill_null("").to_pylist()
            for lo, hi in _parts([len(t) for t in texts]):
                with _without_gc():
                    rows = [vocab.encode(t) for t in texts[lo:hi]]
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) for r in rows], out=offsets[1:])
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))
                yield _with(batch.slice(lo, hi - lo), ids, column)

    kind = T.ArrayType(T.IntegerType(), True)
    return docs.mapInArrow(releasing(run), _added(docs.schema, ids, kind))


def decode(docs: DataFrame, vocab_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with string column ``decoded``; null ids decode to the empty text."""

    def run(batches):
        vocab = vocabulary(vocab_path)
        for batch in batches:
            column = batch.column(ids).fill_null([])
            sizes = np.diff(column.offsets.to_numpy()).tolist()
            for lo, hi in _parts(sizes):
                part = column.slice(lo, hi - lo)
                values, at = part.values.to_numpy(), part.offsets.to_numpy()
                rows = [vocab.decode(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield _with(batch.slice(lo, hi - lo), decoded, pa.array(rows, pa.string()))

    return docs.mapInArrow(releasing(run), _added(docs.schema, decoded, T.StringType()))
