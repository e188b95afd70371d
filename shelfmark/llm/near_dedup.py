"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of distinct word shingles. Documents whose sets have a Jaccard
similarity of at least ``threshold`` are linked; the result is the connected
components of the links.

1.  Documents with equal sets are one node, so copies are never compared. A node is named by the
    hash of one of its texts (the hash is seeded anew should two sets ever get one name). Sets
    of rows with one id are linked from the start.
2.  Each node gets ``MINS`` minwise values. A tree of the join sends a node down
    ``BRANCH`` paths at every level; a path is chosen by the node's minwise
    value at a coordinate that the path so far determines. Two linked nodes share
    a path of one tree with probability p = 1 - (1 - t p) ** BRANCH at least, at any
    depth (0.9375 for t = 0.8 and two branches), and trees repeat until the target
    recall is reached.
3.  First, every node is compared with the leader of each of its first paths: the node
    nearest to ``PROBES`` random ones, so the original in a group of edited copies. This
    is linear in the rows and joins most large groups into components.
4.  Then paths are followed down. Only nodes of different components need to be compared,
    so a path of one component is done. On the others, nodes outside the path's main
    component are compared with all its nodes if these are few pairs (``PAIRS``); else
    all nodes are compared with one leader of the path, and the path branches again.
    Components are brought up to date after every level. A path's candidates go on as pairs
    if these are no more than their nodes. Else, as in a large group of texts that all resemble
    one another, the nodes go on with their texts, are compared on full sets in place, and only
    links that join components come back, so rows grow with nodes and not with pairs.
5.  Comparisons use sketches with four standard deviations of slack: 128 bits against
    leaders, two bits of each minwise value inside a path (for t = 0.8, pairs of less than about
    0.68 hardly pass). They are confirmed on the full sets of 64-bit shingle hashes. All confirmed
    links form the components.

No path, node or candidate is dropped for its size: a path that used all coordinates
is compared exhaustively, block by block.

Definitions: words are runs of characters other than space and U+0009-U+000D, A-Z
lower-cased; a text with fewer words than a shingle is one shingle of all its words; a
null text or one without words has an empty set and is linked with nothing. Rows with equal
ids are one document with several texts; null ids are allowed (see ``near_duplicates``).
"""

import uuid
from functools import lru_cache
from math import ceil, log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import give_back, releasing, small_batches
from shelfmark.llm.graph import ONE_TASK_EDGES, connected_components
from shelfmark.llm.words import lower_ascii, mix, owner, run_hashes, text_slices, word_hashes, word_spans
from shelfmark.session import materialize, new_path, removing_shuffles

MINS = 256
COORDINATES = 64
#: Minwise values with one bit in the narrow sketch.
NARROW = 128
#: Columns of the wide sketch, 64 bits each: two bits of every minwise value.
WIDE = [f"wide_{i}" for i in range(MINS // 32)]
BRANCH = 2
#: A path with at most so many pairs across components is compared exhaustively: at most 1,000
#: sketches for a row, some ten milliseconds for a path.
PAIRS = 1_000_000
#: Nodes of a path that are compared in one place with ``MINORS`` outside its main component, on average.
MEMBERS, MINORS = 4096, 1024
#: Pairs of sketches compared at a time.
AT_ONCE = 1 << 18
#: So many entries of paths or fewer are worked on in one task per round, as in ``graph``.
ONE_TASK_ENTRIES = 100_000
#: A level of at most so many pairs to compare is compared in one task.
ONE_TASK_PAIRS = 200_000
#: Pairs and bytes of packed texts that a group of pairs to confirm has on average, at most.
TASK_PAIRS = 20_000
TASK_BYTES = 4 << 20
#: Bytes of packed texts of a path's nodes that are compared with one another in one place, on average.
MEMBER_BYTES = 1 << 20
#: Bytes of shingle sets that a confirming task keeps for its next pairs.
KEPT_BYTES = 32 << 20
PROBES = 8
RECALL = 0.999


def trees_for(threshold: float, recall: float = RECALL) -> int:
    """Independent trees so that a pair at the threshold shares a leaf with probability ``recall``."""
    p = 1.0
    for _ in range(1000):  # the limit over growing depth
        p = 1 - (1 - threshold * p) ** BRANCH
    return ceil(log(1 - recall) / log(1 - p))


def shingle_sets(data, offsets, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts of a slice, text by text, and where each begins."""
    data = lower_ascii(data)
    starts, stops, firsts = word_spans(data, offsets)
    words = word_hashes(data, starts, stops)
    counts = np.diff(firsts)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), sizes)
    begin = np.cumsum(sizes) - sizes
    at = firsts[text] + np.arange(len(text)) - begin[text]
    hashes = run_hashes(words, at, np.minimum(at + n, firsts[text + 1]))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(len(counts) + 1))


@lru_cache
def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 32, MINS, dtype=np.uint32) | np.uint32(1)


def minwise(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(texts, MINS) minwise values; rows of empty sets are meaningless."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(begin))
    out = np.zeros((len(begin) - 1, MINS), np.uint32)
    if len(full):
        for k, a in enumerate(_multipliers()):
            out[full, k] = np.minimum.reduceat(x * a, begin[full])
    return out


_SKETCH = "id long, own long, n_shingles long, set_a long, set_b long, mins binary, sketch_a long, sketch_b long, "
_SKETCH += ", ".join(f"{c} long" for c in WIDE)


def _sketch(n):
    """Set size and digest, minwise values and both sketches of each text."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                hashes, begin = shingle_sets(data, offsets, n)
                total = np.zeros((2, len(hashes) + 1), np.uint64)
                np.cumsum(mix(hashes), out=total[0, 1:])
                np.cumsum(mix(hashes ^ np.uint64(0xD6E8FEB86659FD93)), out=total[1, 1:])
                digest = total[:, begin[1:]] - total[:, begin[:-1]]
                mins = minwise(hashes, begin)
                mixed = mix(mins.astype(np.uint64)).astype(np.uint8)
                bits = np.packbits(mixed[:, :NARROW] & 1, axis=1).view(np.int64)
                # the two bits of a value side by side
                two = np.packbits(np.stack([mixed >> 1 & 1, mixed >> 2 & 1], axis=2).reshape(len(mixed), -1), axis=1)
                wide = two.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(lo, hi - lo),
                        batch.column("own").slice(lo, hi - lo),
                        pa.array(np.diff(begin).astype(np.int64)),
                        pa.array(digest[0].view(np.int64)),
                        pa.array(digest[1].view(np.int64)),
                        pa.array([r.tobytes() for r in mins[:, :COORDINATES]], pa.binary()),
                        pa.array(bits[:, 0]),
                        pa.array(bits[:, 1]),
                        *[pa.array(wide[:, i]) for i in range(len(WIDE))],
                    ],
                    schema=_arrow_schema(),
                )

    return run


@lru_cache
def _arrow_schema():
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _SKETCH.split(", ")])


def _pack(batches):
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [packer.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(packed, pa.binary())], names=["own", "packed"])


def _branch(trees):
    """The next level of paths of each node: (path, used, node, sketch_a, sketch_b).

    ``used`` has a bit for each coordinate of the path, which is not taken again.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            mins = np.frombuffer(b"".join(batch.column("mins").to_pylist()), np.uint32)
            mins = mins.reshape(len(node), COORDINATES)
            path = batch.column("path").to_numpy().view(np.uint64)
            used = batch.column("used").to_numpy().view(np.uint64)
            rows = np.arange(len(node))
            for branch in range(BRANCH * trees):
                chosen = mix(path + np.uint64(branch + 1)) % np.uint64(COORDINATES)
                for _ in range(COORDINATES):
                    taken = (used >> chosen) & np.uint64(1) == 1
                    if not taken.any():
                        break
                    chosen = np.where(taken, (chosen + np.uint64(1)) % np.uint64(COORDINATES), chosen)
                value = mins[rows, chosen.astype(np.int64)].astype(np.uint64)
                new = mix(mix(path + np.uint64(branch + 1)) ^ (value << np.uint64(7)) ^ chosen)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(new.view(np.int64)),
                        pa.array((used | np.uint64(1) << chosen).view(np.int64)),
                        batch.column("node"),
                        batch.column("sketch_a"),
                        batch.column("sketch_b"),
                    ],
                    names=["path", "used", "node", "sketch_a", "sketch_b"],
                )

    return run


_ENTRY = "path long, used long, node long, sketch_a long, sketch_b long"


def _slack(n: int, p: float) -> int:
    """Differences that ``n`` values of probability ``p`` each hardly exceed."""
    return int(n * p + 4 * (n * p * (1 - p)) ** 0.5) + 1


def _alike(threshold: float):
    """Whether the narrow sketches of two nodes (prefixes x, y) allow a similarity at the threshold."""
    return _distance("x.", "y.") <= _slack(NARROW, (1 - threshold) / 2)


def _whole_groups(batches):
    """Tables of whole groups, and where each begins and the last ends, from rows sorted by ``group``."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if batch.column("group")[0] == batch.column("group")[-1] == held.column("group")[0]:
            continue
        group = held.column("group").to_numpy()
        begin = np.append(0, np.flatnonzero(group[1:] != group[:-1]) + 1)
        yield held.slice(0, begin[-1]), begin
        held = held.slice(begin[-1])
    if held is not None:
        group = held.column("group").to_numpy()
        yield held, np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])


_CLOSE = "group long, minor boolean, node long, component long, other long"


def _close(threshold: float):
    """What of each group to compare on full sets: pairs (node, other), or if these are more than their nodes, the nodes.

    Compares the nodes that are ``minor`` with those that are not, between components only.
    """
    narrow, wide = _slack(NARROW, (1 - threshold) / 2), _slack(MINS, (1 - threshold) * 0.75)
    low, one = np.uint64(0x5555555555555555), np.uint64(1)

    def near(x, y, component, sketches, wides):
        """Places of minor and other nodes whose sketches allow a similarity at the threshold."""
        found = []
        step = max(1, AT_ONCE // len(y))
        for lo in range(0, len(x), step):
            part = x[lo : lo + step]
            differ = sum(np.bitwise_count(s[part][:, None] ^ s[y]).astype(np.int16) for s in sketches)
            i, j = np.nonzero((differ <= narrow) & (component[part][:, None] != component[y]))
            i, j = part[i], y[j]
            # two bits of different values agree in one case of four
            differ = np.zeros(len(i), np.int16)
            for s in wides:
                z = s[i] ^ s[j]
                differ += np.bitwise_count((z | z >> one) & low)
            found.append((i[differ <= wide], j[differ <= wide]))
        return (np.concatenate(f) for f in zip(*found, strict=True))

    def run(batches):
        for table, begin in _whole_groups(batches):
            minor = table.column("minor").to_numpy()
            node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
            sketches = [table.column(c).to_numpy().view(np.uint64) for c in ("sketch_a", "sketch_b")]
            wides = [table.column(c).to_numpy().view(np.uint64) for c in WIDE]
            at, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in zip(begin[:-1], begin[1:], strict=True):
                x, y = (lo + np.flatnonzero(m) for m in (minor[lo:hi], ~minor[lo:hi]))
                if not len(x) or not len(y):
                    continue
                i, j = near(x, y, component, sketches, wides)
                ends = np.union1d(i, j)
                if len(i) > len(ends):
                    i, j = ends, np.full(len(ends), -1)
                at.append(i)
                other.append(j)
            at, other = np.concatenate(at), np.concatenate(other)
            rows = table.select(["group", "minor", "node", "component"]).take(pa.array(at))
            others = pa.array(node[other], mask=other < 0) if len(node) else pa.array([], pa.int64())
            yield from rows.append_column("other", others).to_batches()

    return run


def _joining(n, percent):
    """Links (u, v) that join components, of the minor nodes of each group with all its nodes, on full sets."""

    def links(minor, node, component, packed, unpack):
        node, first = np.unique(node, return_index=True)
        texts = [unpack.decompress(packed[i].as_py()) for i in first]
        offsets = np.append(0, np.cumsum([len(t) for t in texts]))
        hashes, begin = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), offsets, n)
        _, code = np.unique(hashes, return_inverse=True)
        label, size, has = component[first].copy(), np.diff(begin), np.zeros(len(hashes), np.int32)
        for i in np.flatnonzero(np.isin(node, minor)):
            own = code[begin[i] : begin[i + 1]]
            has[own] = 1
            common = np.add.reduceat(has[code], begin[:-1])
            has[own] = 0
            alike = 100 * common >= percent * (size + size[i] - common)
            for j in np.flatnonzero(alike & (label != label[i])):
                if label[j] != label[i]:
                    yield node[i], node[j]
                    label[label == label[j]] = label[i]

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for table, begin in _whole_groups(batches):
            minor, node, component = (table.column(c).to_numpy() for c in ("minor", "node", "component"))
            found = []
            for lo, hi in zip(begin[:-1], begin[1:], strict=True):
                own = slice(lo, hi)
                packed = table.column("packed").slice(lo, hi - lo)
                found.extend(links(node[own][minor[own]], node[own], component[own], packed, unpack))
            u, v = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def _dealt(rows: DataFrame, by, members, minors) -> DataFrame:
    """Rows of each ``by`` in blocks, each of some nodes and some minor ones: with ``group`` and ``minor``.

    ``members`` and ``minors`` are the numbers of blocks; every pair of them meets in one group.
    """
    spread = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n.cast("long"))
    place = lambda i, j, minor: F.struct(i.alias("i"), j.alias("j"), F.lit(minor).alias("minor"))
    whole = F.transform(spread(minors), lambda i: place(i, own(members, 12), False))
    few = F.transform(spread(members), lambda j: place(own(minors, 13), j, True))
    # a row that is minor is a member too
    places = F.when(F.col("is_minor") & F.col("is_member"), F.concat(whole, few)).when(F.col("is_minor"), few).otherwise(whole)
    rows = rows.withColumn("_at", F.explode(places))
    return rows.withColumns({"group": F.xxhash64(by, "_at.i", "_at.j"), "minor": F.col("_at.minor")}).drop("_at")


def _confirm(n, percent):
    """The links among the pairs (u, v) of a group, from the packed texts of its nodes."""

    def run(pairs, texts):
        packed = dict(zip(texts.column("node").to_pylist(), texts.column("packed").to_pylist(), strict=True))
        unpack, cache, kept = zstandard.ZstdDecompressor(), {}, 0

        def shingles(node):
            nonlocal kept
            found = cache.get(node)
            if found is None:
                data = np.frombuffer(unpack.decompress(packed[node]), np.uint8)
                found, _ = shingle_sets(data, np.array([0, len(data)]), n)
                if kept + found.nbytes > KEPT_BYTES:
                    cache.clear()
                    kept = 0
                kept += found.nbytes
                cache[node] = found
            return found

        pairs = pairs.sort_by([("u", "ascending"), ("v", "ascending")])
        keep = []
        for u, v in zip(pairs.column("u").to_pylist(), pairs.column("v").to_pylist(), strict=True):
            a, b = shingles(u), shingles(v)
            both = np.concatenate([a, b])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(a) + len(b) - common))
        packed.clear()
        cache.clear()
        give_back()
        return pairs.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _distance(a: str, b: str):
    """Sketch bits in which two prefixes differ."""
    return F.bit_count(F.col(f"{a}sketch_a").bitwiseXOR(F.col(f"{b}sketch_a"))) + F.bit_count(
        F.col(f"{a}sketch_b").bitwiseXOR(F.col(f"{b}sketch_b"))
    )


def _led(paths: DataFrame) -> DataFrame:
    """The rows of paths with several nodes, with ``y``: the row of the path's leader."""
    names = [f"_p{i}" for i in range(PROBES)]
    probes = paths.groupBy("path").agg(
        F.count("*").alias("_n"),
        # of plain numbers, so that the aggregation is by hash and not by sorting
        *[F.min_by("sketch_a", F.xxhash64("node", F.lit(i))).alias(n) for i, n in enumerate(names)],
    )
    near = paths.join(probes.filter("_n > 1"), "path")
    far = sum(F.bit_count(F.col("sketch_a").bitwiseXOR(F.col(n))).cast("long") for n in names)
    # by distance, ties by a hash
    order = F.shiftleft(far, 48) + F.shiftrightunsigned(F.xxhash64("node", "path"), 16)
    near = materialize(near.withColumn("_d", order).drop("_n", *names), "near")
    others = [c for c in paths.columns if c not in ("path", "used")]
    leaders = near.groupBy("path").agg(*[F.min_by(c, "_d").alias(c) for c in others])
    return near.drop("_d").join(leaders.select("path", F.struct(*others).alias("y")), "path")


class _Checker:
    """Confirms candidate pairs; large lists leave out those looked at before."""

    def __init__(self, texts: DataFrame, n: int, percent: int):
        self.texts, self.n, self.percent, self.seen = texts, n, percent, None

    def links(self, pairs: DataFrame, few: bool = False) -> DataFrame:
        """The pairs (u, v) of nodes that are similar enough by their full sets.

        A ``few`` pairs are sooner confirmed again than looked up.
        """
        pairs = pairs.distinct()
        if self.seen is not None and not few:
            pairs = pairs.join(self.seen, ["u", "v"], "left_anti")
        pairs = materialize(pairs, "pairs")
        n = pairs.count()
        self.seen = pairs if self.seen is None else self.seen.unionByName(pairs)
        if not n:
            return pairs
        ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        # the large side is bucketed by node: only the ends move
        texts = materialize(self.texts.join(ends, "node"), "texts")
        size = texts.agg(F.sum(F.length("packed"))).first()[0]
        # pairs of two blocks of nodes are one group, which gets each text once
        blocks = max(ceil((n / TASK_PAIRS) ** 0.5), ceil(size / TASK_BYTES))
        at = [F.pmod(F.xxhash64(c, F.lit(11)), F.lit(blocks)) for c in ("u", "v")]
        grouped = pairs.withColumn("group", at[0] * blocks + at[1])
        needed = grouped.select(F.col("group").alias("to"), F.explode(F.array("u", "v")).alias("node")).distinct()
        own = needed.join(texts, "node").groupBy("to")
        found = grouped.groupBy("group").cogroup(own).applyInArrow(_confirm(self.n, self.percent), "u long, v long")
        return materialize(found, "links")

    def joining(self, rows: DataFrame) -> DataFrame:
        """Links (u, v) that join the components of the nodes of each group, minor ones with all, on full sets."""
        if rows.isEmpty():
            return rows.sparkSession.createDataFrame([], "u long, v long")
        nodes = rows.groupBy("group", "node", "component").agg(F.max("minor").alias("is_minor"), F.min("minor").alias("only"))
        nodes = nodes.withColumn("is_member", ~F.col("only"))
        held = materialize(self.texts.join(nodes, "node"), "members")
        sizes = held.groupBy("group").agg(F.ceil(F.sum(F.length("packed")) / MEMBER_BYTES).alias("blocks"))
        held = held.withColumnRenamed("group", "whole").join(sizes.withColumnRenamed("group", "whole"), "whole")
        dealt = _dealt(held, "whole", F.col("blocks"), F.col("blocks")).select("group", "minor", "node", "component", "packed")
        dealt = dealt.repartition("group").sortWithinPartitions("group")
        return materialize(dealt.mapInArrow(releasing(_joining(self.n, self.percent)), "u long, v long"), "links")


def _across(live: DataFrame, threshold: float, one_task: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) to confirm on each path of ``live``, between components only, and groups of nodes with many pairs."""
    one = (F.col("x.node") != F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
    few = live.filter("few").withColumns({"is_minor": F.col("component") != F.col("main"), "is_member": F.lit(True)})
    few = _dealt(few, "path", F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("minor") / MINORS))
    few = few.select("group", "minor", "node", "component", "sketch_a", "sketch_b", *WIDE)
    few = few.coalesce(1) if one_task else few.repartition("group")
    close = materialize(few.sortWithinPartitions("group").mapInArrow(releasing(_close(threshold)), _CLOSE), "close")
    pairs = close.filter("other is not null").select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"))
    many = _led(live.filter("not few").select("path", "node", "component", "sketch_a", "sketch_b")).alias("x")
    led = many.filter(one & _alike(threshold))
    led = led.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v"))
    return pairs.unionByName(led), close.filter("other is null").drop("other")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    shingle: int = 2,
    percent: int = 80,
    recall: float = RECALL,
) -> DataFrame:
    """(id, n_shingles, component_id) of each row of ``docs``, under its ``id_col`` name.

    ``percent`` is the least similarity in hundredths. ``component_id`` is the smallest
    id in reach. Rows without an id link like others, but a component only gets an
    id from its rows that have one.
    """
    spark = docs.sparkSession
    threshold = percent / 100
    key = ["set_a", "set_b", "n_shingles"]
    with small_batches(spark, "4m"):
        plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
        for seed in range(64):
            named = plain.withColumn("own", F.xxhash64(F.lit(seed), F.coalesce("text", F.lit(""))))
            rows = materialize(named.mapInArrow(releasing(_sketch(shingle)), _SKETCH), "sketches")
            filled = rows.filter("n_shingles > 0")
            if _differing(filled, "own").isEmpty():
                break
        reps = filled.groupBy(*key).agg(F.min("own").alias("node"), F.min("id").alias("least"))
        # rows of one name have one set, and so the same values
        nodes = filled.join(reps.select(*key, "node"), key).filter("own = node").groupBy("node")
        nodes = materialize(nodes.agg(*[F.first(c).alias(c) for c in ("mins", "sketch_a", "sketch_b", *WIDE)]), "nodes")
        table = f"near_dedup_{uuid.uuid4().hex}"
        packed = named.select("own", "text").mapInArrow(releasing(_pack), "own long, packed binary")
        packed = packed.join(reps.select(F.col("node").alias("own")), "own").groupBy("own").agg(F.first("packed").alias("packed"))
        n_buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        with removing_shuffles(spark):
            (
                packed.withColumnRenamed("own", "node")
                .write.bucketBy(n_buckets, "node")
                .option("path", new_path(spark, "packed"))
                .saveAsTable(table)
            )
        try:
            checker = _Checker(spark.table(table), shingle, percent)
            components = _components(nodes, checker, threshold, recall, _links_of_ids(filled, reps, key))
        finally:
            spark.sql(f"DROP TABLE {table}")
    ids = reps.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = ids.groupBy("component").agg(F.min("least").alias("smallest"))
    ids = materialize(ids.join(smallest, "component").select(*key, "smallest"), "ids")
    out = rows.select("id", *key).join(ids, key, "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(F.col("id")).alias("component_id"),
    )


def _differing(rows: DataFrame, name: str) -> DataFrame:
    """The values of ``name`` that rows of different sets share."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("set_a", "set_b") for n, f in (("min", F.min), ("max", F.max))]
    found = rows.groupBy(name).agg(*ends)
    return found.filter("min_set_a <> max_set_a or min_set_b <> max_set_b").select(name)


def _links_of_ids(filled: DataFrame, reps: DataFrame, key: list[str]) -> DataFrame:
    """Links (u, v) between the nodes of rows with one id."""
    several = materialize(_differing(filled.filter("id is not null"), "id"), "several")
    texts = filled.select("id", *key).join(several, "id").join(reps.select(*key, "node"), key).select("id", "node")
    hubs = texts.groupBy("id").agg(F.min("node").alias("v"))
    return texts.join(hubs, "id").filter("node <> v").select(F.col("node").alias("u"), "v").distinct()


def _linked(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of ``known`` ones and of ``links``, both written tables."""
    if known is not None:
        links = known.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links)
    if links.count() > ONE_TASK_EDGES:
        return materialize(connected_components(links), "known")
    return materialize(connected_components(links.coalesce(1)), "known").coalesce(1)


def _components(nodes: DataFrame, checker: _Checker, threshold: float, recall: float, given: DataFrame) -> DataFrame:
    """(node, component) of linked nodes; ``given`` are links (u, v) that need no check."""
    none = F.lit(0).cast("long")
    seeds = nodes.select("node", "mins", "sketch_a", "sketch_b", none.alias("path"), none.alias("used"))
    level = materialize(seeds.mapInArrow(releasing(_branch(trees_for(threshold, recall))), _ENTRY), "paths")

    # every node against the leader of its first paths
    led = materialize(_led(level), "paths")
    pairs = (
        led.alias("x")
        .filter((F.col("x.node") != F.col("y.node")) & _alike(threshold))
        .select(F.least("y.node", "x.node").alias("u"), F.greatest("y.node", "x.node").alias("v"))
    )
    known = _linked(None, checker.links(pairs).unionByName(materialize(given, "given")))
    level = led.drop("y")

    while True:
        one_task = level.count() <= ONE_TASK_ENTRIES
        if one_task:
            level = level.coalesce(1)
            nodes = nodes.coalesce(1)
        labelled = level.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
        labelled = materialize(labelled, "labelled")
        if one_task:  # a read table does not say that it is one partition
            labelled = labelled.coalesce(1)
        # by component first, so that a path's count is a sum over few rows
        sizes = labelled.groupBy("path", "component").agg(F.count("*").alias("n"))
        sizes = sizes.groupBy("path").agg(
            F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")
        ).filter("parts > 1")
        sizes = sizes.withColumn("few", (F.col("n") - F.col("most")) * F.col("n") <= PAIRS)
        sizes = sizes.withColumn("minor", F.col("n") - F.col("most"))
        live = labelled.join(sizes.select("path", "main", "few", "n", "minor"), "path")
        # later levels hold nodes of live paths only: no other takes part again
        nodes = materialize(nodes.join(live.select("node").distinct(), "node", "left_semi"), "nodes")
        if one_task:
            nodes = nodes.coalesce(1)
        live = materialize(live.join(nodes.select("node", *WIDE), "node"), "live")
        # a path without unused coordinates cannot branch: compared as a whole
        live = live.withColumn("few", F.col("few") | (F.bit_count("used") >= COORDINATES))
        to_compare = live.filter("few").agg(F.sum("minor")).first()[0] or 0
        few = one_task and to_compare <= ONE_TASK_PAIRS
        pairs, dense = _across(live.coalesce(1) if few else live, threshold, few)
        links = checker.links(pairs, few).unionByName(checker.joining(dense))
        if not links.isEmpty():
            known = _linked(known, links)
        rest = live.filter(~F.col("few")).select("path", "used", "node", "sketch_a", "sketch_b")
        if rest.isEmpty():
            return known
        if one_task:
            rest = rest.coalesce(1)
        rest = rest.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = rest.groupBy("path").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b")
        rest = rest.join(mixed.select("path"), "path").select("path", "used", "node", "sketch_a", "sketch_b")
        level = materialize(rest.join(nodes.select("node", "mins"), "node").mapInArrow(releasing(_branch(1)), _ENTRY), "paths")
