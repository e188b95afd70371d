"""Approximate nearest neighbours by inner product: NN-descent graph and greedy search.

Vectors that are equal are one node, so copies cost nothing and never crowd a list; their
ids are put back at the end. For the graph, vectors get one more component that makes them
equally long, so that the largest inner product is the smallest distance, and are kept in
single precision, so that short vectors beside long ones keep their digits; results are
scored on the original vectors in double precision.

Graph. Nodes start with their nearest neighbours in ``DEALS`` blocks of at most about ``BLOCK`` nodes: those with
the same nearest of a few sampled nodes, so that lists start about as good whatever the number of nodes.
An iteration joins each node's neighbours and reverse neighbours with one another: any
two of them, one new to the node at least, that improve each other's list are exchanged (neighbours of neighbours), until
an iteration changes less than ``CHANGED`` of all list entries. Lists
keep ``DEGREE`` nodes, and at most ``REVERSE`` reverse neighbours take part, new ones first, then random ones.

Search. A query starts from itself and the nearest of ``PIVOTS`` sampled and ``PIVOTS`` longest
nodes, then repeatedly expands its best unexpanded nodes: their neighbours are looked up where the
graph is and scored where the neighbours' vectors are. ``BEAM`` best nodes are kept. When
no query has an unexpanded node in its beam, the best ``RERANK`` are scored exactly.

Layout. Nodes and queries live in hash groups of bounded mean size. A step works on whole groups in numpy and
sends a packed row to each group that gets something: rows between steps grow with pairs of groups, not with
neighbours. Nothing is collected but the pivots (twice ``PIVOTS`` rows), counts and a maximum.

Definitions: vectors that are null, zero, of another length than most, or with a null or
non-finite component take no part, as query or as candidate. Repeated ids are distinct rows
with one id; rows without an id take no part. Fewer candidates than ``k`` give all. Ties
go to the smaller id.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import materialize

DEGREE = 32
REVERSE = 24
BLOCK = 4096
DEALS = 2
#: Share of list entries below which a change ends the iterations.
CHANGED = 0.005
OFFERS = 16
#: Neighbourhoods that are joined at once.
MEET = 64
PIVOTS = 2048
BEAM = 256
EXPAND = 128
RERANK = 80
#: Nodes of a hash block of lists or queries.
GROUP = 512
#: Nodes travel in groups, as one row each: ``GROUP`` nodes or more while there are ``SPREAD`` groups at most, then ``PACK``.
SPREAD, PACK = 32, 4096
#: Queries that are searched for at once, which bounds what a node gets that all of them ask for.
QUERIES = 32768


def _matrix(column, kind) -> np.ndarray:
    """Rows of equally long byte strings as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1) if n else np.zeros((0, 1), kind)


def _flat(column):
    """Values of a list column and the row of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)


def _lists(node, ids, sims, keep: int) -> pa.Table:
    """Per node, its ``keep`` best different ids, from flat columns."""
    order = np.lexsort((ids, -sims, node))
    node, ids, sims = node[order], ids[order], sims[order]
    # an id may be offered several times with one similarity: the first stays
    pair = np.lexsort((np.arange(len(node)), ids, node))
    new = np.ones(len(node), dtype=bool)
    new[1:] = (node[pair][1:] != node[pair][:-1]) | (ids[pair][1:] != ids[pair][:-1])
    first = np.sort(pair[new])
    node, ids, sims = node[first], ids[first], sims[first]
    begin = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, int)
    rank = np.arange(len(node)) - np.repeat(begin, np.diff(np.append(begin, len(node))))
    kept = rank < keep
    node, ids, sims = node[kept], ids[kept], sims[kept]
    begin = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, int)
    offsets = pa.array(np.append(begin, len(node)).astype(np.int32))
    return pa.table(
        {
            "node": pa.array(node[begin]),
            "ids": pa.ListArray.from_arrays(offsets, pa.array(ids)),
            "sims": pa.ListArray.from_arrays(offsets, pa.array(sims.astype(np.float32))),
        }
    )


def _block(column, n: int, seed: int):
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(max(n, 1)))


#: What groups of nodes send to one another: flat columns as byte strings, one row for each group that gets some.
_PACKED = "to int, kind int, a binary, b binary, c binary, d binary, e binary, changed long, entries long"
_ARROW = pa.schema(
    [("to", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in "abcde"], ("changed", pa.int64()), ("entries", pa.int64())]
)
#: Kinds of rows: nodes (node, code), offers (to, id, sim), a group's state (node, code, ids, sims, new), its members
#: (member, new), edges (to, from, new) and codes (node, code, worst). For the search: a group's graph (node, members), beams
#: (query, code, ids, sims, stage), what is asked (query, node) and codes of queries (query, code, least).
_NODES, _OFFERS, _STATE, _MEMBERS, _EDGES, _CODES, _GRAPH, _BEAMS, _ASKED, _QUERIES = range(10)
#: Stages of a node of a beam.
_WAITING, _NOW, _DONE = range(3)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _groups(n: int) -> int:
    return max(1, min(-(-n // GROUP), max(SPREAD, -(-n // PACK))))


def _home(node: np.ndarray, groups: int) -> np.ndarray:
    """The group of each node."""
    return (_mix(node) % np.uint64(groups)).astype(np.int64)


def _sent(kind: int, to: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Flat columns as a row for each group that they go to."""
    if not len(to):
        return []
    if (to[1:] < to[:-1]).any():
        order = np.argsort(to.astype(np.uint16) if to.max() < 1 << 16 else to, kind="stable")
        to, columns = to[order], [c[order] for c in columns]
    begin = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    return [_row(to[lo], kind, *[c[lo:hi] for c in columns]) for lo, hi in zip(begin, [*begin[1:], len(to)], strict=True)]


def _row(to: int, kind: int, *columns: np.ndarray, changed: int = 0, entries: int = 0) -> tuple:
    blobs = [np.ascontiguousarray(c).tobytes() for c in columns]
    return (int(to), kind, *blobs, *[None] * (5 - len(blobs)), changed, entries)


def _packed(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _ARROW]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _unpacked(table: pa.Table, kind: int, *kinds) -> list[np.ndarray]:
    """The flat columns of the rows of one kind."""
    at = np.flatnonzero(table.column("kind").to_numpy() == kind)
    out = []
    for name, of in zip("abcde", kinds, strict=False):
        column = table.column(name)
        out.append(np.frombuffer(b"".join([column[int(i)].as_buffer() for i in at]), of))
    return out


def _state(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Nodes of a group in order, their codes, neighbours (best first, -1 where there are no more), similarities and which are new."""
    node, code, ids, sims, new = _unpacked(table, _STATE, np.int64, np.float32, np.int64, np.float32, bool)
    return node, code.reshape(len(node), -1), ids.reshape(-1, DEGREE), sims.reshape(-1, DEGREE), new.reshape(-1, DEGREE)


def _kept(row, ids, sims, keep: int):
    """Places of the ``keep`` best different ids of each row, best first, and their ranks; an id's first entry counts."""
    if not len(row):
        return np.zeros(0, int), np.zeros(0, int)
    order = np.lexsort((ids, row)) if int(row.max() + 1) * int(ids.max() + 1) >= 1 << 63 else np.argsort(row * (ids.max() + 1) + ids, kind="stable")
    first = np.append(True, (row[order][1:] != row[order][:-1]) | (ids[order][1:] != ids[order][:-1]))
    order = order[first]
    bits = sims[order].view(np.int32).astype(np.int64)  # in the order of the numbers, when those below 0 are turned round
    falling = (1 << 31) - 1 - np.where(bits < 0, bits ^ 0x7FFFFFFF, bits)
    order = order[np.argsort((row[order] << 32) + falling, kind="stable")]
    rank = _rank(row[order])
    return order[rank < keep], rank[rank < keep]


def _rank(row: np.ndarray) -> np.ndarray:
    """Places of sorted rows within their row."""
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
    return np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vec double array) of the rows that take part."""
    vec = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s").first()
    return rows.filter(F.size("vec") == (size["s"] if size else 0))


def _code(longest: float):
    """Vectors for the graph as single-precision byte strings, from (node, vec).

    The component sqrt(longest^2 - |v|^2) makes all equally long. It is kept as its difference
    from ``longest``, which leaves distances as they are and is exact for short vectors too.
    """

    def run(batches):
        for batch in batches:
            values, _ = _flat(batch.column("vec"))
            x = values.reshape(batch.num_rows, -1) / longest
            own = np.minimum((x * x).sum(1), 1)
            code = np.hstack([x, (own / (1 + np.sqrt(1 - own)))[:, None]]).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([r.tobytes() for r in code], pa.binary())], names=["node", "code"]
            )

    return run


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half the squared distances of vectors, negative."""
    return a @ b.T - (a * a).sum(1)[:, None] / 2 - (b * b).sum(1) / 2


def _start(groups: int):
    """Nearest neighbours inside one block."""

    def run(table: pa.Table) -> pa.Table:
        node, x = table.column("node").to_numpy(), _matrix(table.column("code"), np.float32)
        n, keep = len(node), min(DEGREE, len(node) - 1)
        out = []
        for i in range(0, n if keep > 0 else 0, 512):
            s = _near(x[i : i + 512], x)
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
            best = np.argpartition(s, n - keep, axis=1)[:, n - keep :]
            own = np.repeat(node[i : i + 512], keep)
            out += _sent(_OFFERS, _home(own, groups), own, node[best].ravel(), np.take_along_axis(s, best, 1).ravel())
        return _packed(out)

    return run


def _pack_nodes(groups: int):
    def run(batches):
        for batch in batches:
            node, code = batch.column("node").to_numpy(), _matrix(batch.column("code"), np.float32)
            yield from _packed(_sent(_NODES, _home(node, groups), node, code)).to_batches()

    return run


def _merge(groups: int):
    """Lists of a group with what was offered to them, and the edges to their neighbours."""

    def run(table: pa.Table) -> pa.Table:
        if (table.column("kind").to_numpy() == _STATE).any():
            node, code, ids, sims, _ = _state(table)
        else:
            node, code = _unpacked(table, _NODES, np.int64, np.float32)
            order = np.argsort(node)
            node, code = node[order], code.reshape(len(node), -1)[order]
            ids, sims = np.full((len(node), DEGREE), -1), np.full((len(node), DEGREE), -np.inf, np.float32)
        to, offer, sim = _unpacked(table, _OFFERS, np.int64, np.int64, np.float32)
        had = ids >= 0
        row = np.append(np.nonzero(had)[0], np.searchsorted(node, to))
        # a neighbour that is offered again stays an old one
        near, sim = np.append(ids[had], offer), np.append(sims[had], sim)
        at, rank = _kept(row, near, sim, DEGREE)
        ids, sims, new = np.full(ids.shape, -1), np.full(ids.shape, -np.inf, np.float32), np.zeros(ids.shape, bool)
        ids[row[at], rank], sims[row[at], rank], new[row[at], rank] = near[at], sim[at], at >= had.sum()
        state = _row(table.column("to")[0].as_py(), _STATE, node, code, ids, sims, new, changed=int(new.sum()), entries=len(at))
        return _packed([state, *_sent(_EDGES, _home(near[at], groups), near[at], node[row[at]], at >= had.sum())])

    return run


def _members(table: pa.Table, iteration: int):
    """Neighbours and reverse neighbours of each node of a group (-1 where there are no more), which are new, and all edges to the group."""
    node, _, ids, _, new = _state(table)
    u, v, fresh = _unpacked(table, _EDGES, np.int64, np.int64, bool)
    row = np.searchsorted(node, u)
    # other reverse neighbours in each iteration
    by = _mix(v ^ _mix(u + np.int64(iteration)).view(np.int64))
    order = np.argsort((row << 33) | (~fresh).astype(np.int64) << 32 | (by >> np.uint64(32)).astype(np.int64), kind="stable")
    rank = _rank(row[order])
    order, rank = order[rank < REVERSE], rank[rank < REVERSE]
    member = np.full((len(node), DEGREE + REVERSE), -1)
    first = np.zeros(member.shape, bool)
    member[:, :DEGREE], first[:, :DEGREE] = ids, new
    member[row[order], DEGREE + rank], first[row[order], DEGREE + rank] = v[order], fresh[order]
    key = np.sort(member * 2 + ~first, axis=1)  # a member on both sides is new if it is on one
    member, first = key >> 1, key % 2 == 0
    again = member[:, 1:] == member[:, :-1]
    member[:, 1:][again], first[:, 1:][again] = -1, False
    return member, first, row, v


def _visit(groups: int, iteration: int):
    """The members of a group's neighbourhoods, and the codes of its nodes for all groups where they are members."""

    def run(table: pa.Table) -> pa.Table:
        node, code, ids, sims, _ = _state(table)
        member, new, row, v = _members(table, iteration)
        had = ids >= 0
        worst = np.where(had[:, -1], sims[:, -1], -np.inf).astype(np.float32)
        # a group gets a code once
        seen = np.zeros((groups, len(node)), bool)
        seen[_home(ids[had], groups), np.nonzero(had)[0]] = True
        seen[_home(v, groups), row] = True
        to, own = np.nonzero(seen)
        state = table.filter(pa.array(table.column("kind").to_numpy() == _STATE)).select(_ARROW.names).cast(_ARROW)
        home = state.column("to")[0].as_py()
        return pa.concat_tables([state, _packed([_row(home, _MEMBERS, member, new), *_sent(_CODES, to, node[own], code[own], worst[own])])])

    return run


def _most(s: np.ndarray, good: np.ndarray, axis: int) -> np.ndarray:
    """``good`` but for what is not among the ``OFFERS`` best along the axis."""
    if s.shape[axis] > OFFERS:
        over = np.nonzero(good.sum(axis) > OFFERS)
        if len(over[0]):
            own, kept = np.moveaxis(good, axis, 2), np.where(np.moveaxis(good, axis, 2)[over], np.moveaxis(s, axis, 2)[over], -np.inf)
            own[over] = kept >= np.maximum(np.partition(kept, -OFFERS, axis=1)[:, -OFFERS, None], np.finfo(np.float32).min)
    return good


def _offered(place: np.ndarray, new: np.ndarray, code: np.ndarray, worst: np.ndarray):
    """The local join: members of each neighbourhood, one new to it at least, offered to one another where they improve a list.

    ``place`` has members as rows of ``code``, as many as there are where a neighbourhood has no more.
    Returns (to, offer, sim), different pairs, of each ``to`` what its list can take.
    """
    n = len(code)
    half = np.append((code * code).sum(1) / 2, np.float32(np.inf))
    code, worst = np.vstack([code, np.zeros((1, code.shape[1]), np.float32)]), np.append(worst, np.float32(np.inf))
    order = np.argsort(np.where(place == n, 2, ~new).astype(np.uint8), axis=1, kind="stable")  # new members first
    fresh, size = (new & (place < n)).sum(1), (place < n).sum(1)
    place = np.take_along_axis(place, order, 1)
    todo = np.flatnonzero((fresh > 0) & (size > 1))
    todo = todo[np.argsort(fresh[todo], kind="stable")]
    found = []
    for at in range(0, len(todo), MEET):
        rows = todo[at : at + MEET]
        k = fresh[rows][:, None]
        w, m = k.max(), place[rows, : size[rows].max()]
        x, h, least = code[m], half[m], worst[m]
        s = x[:, :w] @ x.transpose(0, 2, 1)
        s -= h[:, :w, None]
        s -= h[:, None]
        s[np.arange(w) >= k] = -np.inf  # old ones have met
        s[:, np.arange(w), np.arange(w)] = -np.inf
        b, i, j = np.nonzero(_most(s, s > least[:, :w, None], 2))
        found.append((m[b, i], m[b, j], s[b, i, j]))
        b, i, j = np.nonzero(_most(s, (s > least[:, None]) & (np.arange(m.shape[1]) >= k)[:, None], 1))
        found.append((m[b, j], m[b, i], s[b, i, j]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
    to, offer, sim = map(np.concatenate, zip(*found, strict=True))
    at, _ = _kept(to, offer, sim, DEGREE)
    return to[at], offer[at], sim[at]


def _meet(table: pa.Table) -> pa.Table:
    """The local join of rows (v, u, new, worst, code): members (u) of each node's (v) neighbourhood."""
    v, u = table.column("v").to_numpy(), table.column("u").to_numpy()
    new = table.column("new").to_numpy(zero_copy_only=False)
    order = np.lexsort((u, v))
    rank, row = _rank(v[order]), np.unique(v[order], return_inverse=True)[1]
    node, first, own = np.unique(u, return_index=True, return_inverse=True)
    place, fresh = np.full((row.max() + 1, rank.max() + 1), len(node)), np.zeros((row.max() + 1, rank.max() + 1), bool)
    place[row, rank], fresh[row, rank] = own[order], new[order]
    code, worst = _matrix(table.column("code"), np.float32)[first], table.column("worst").to_numpy()[first]
    to, offer, sim = _offered(place, fresh, code, worst)
    return _lists(node[to], node[offer], sim, 1 << 30)


def _join(groups: int):
    """What the neighbourhoods of a group offer to nodes of all groups."""

    def run(table: pa.Table) -> pa.Table:
        own, new = _unpacked(table, _MEMBERS, np.int64, bool)
        node, code, worst = _unpacked(table, _CODES, np.int64, np.float32, np.float32)
        state = table.filter(pa.array(table.column("kind").to_numpy() == _STATE)).select(_ARROW.names).cast(_ARROW)
        if not len(node):
            return state
        order = np.argsort(node)
        node, code, worst = node[order], code.reshape(len(node), -1)[order], worst[order]
        place = np.where(own < 0, len(node), np.searchsorted(node, own)).reshape(-1, DEGREE + REVERSE)
        to, offer, sim = _offered(place, new.reshape(place.shape), code, worst)
        return pa.concat_tables([state, _packed(_sent(_OFFERS, _home(node[to], groups), node[to], node[offer], sim))])

    return run


def _cells(pivots: list[bytes]):
    """The number of the pivot that is nearest to each node."""
    p = np.frombuffer(b"".join(pivots), np.float32).reshape(len(pivots), -1)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                cell = _near(_matrix(part.column("code"), np.float32), p).argmax(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32))], names=["node", "code", "cell"])

    return run


def _dealt(nodes: DataFrame, n: int, block: int, deal: int) -> DataFrame:
    """``nodes`` with a ``cell`` of near ones and a ``part`` of it; a part has ``block`` nodes on average at most."""
    if n <= block:
        return nodes.withColumns({"cell": F.lit(0), "part": F.lit(0).cast("long")})
    wanted = min(PIVOTS, -(-4 * n // block))  # so that most cells are one part
    pivots = nodes.orderBy(F.xxhash64("node", F.lit(deal)), "node").limit(wanted).collect()
    dealt = nodes.select("node", "code").mapInArrow(_cells([p["code"] for p in pivots]), "node long, code binary, cell int")
    # a row per pivot
    parts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    dealt = dealt.join(F.broadcast(parts), "cell")
    return dealt.withColumn("part", F.pmod(F.xxhash64("node", F.lit(deal)), "parts")).drop("parts")


def _gathered(rows: DataFrame, run) -> DataFrame:
    """``run`` for each group, on all rows that go there."""
    return rows.groupBy("to").applyInArrow(run, _PACKED)


def build_graph(nodes: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """Packed lists of each node's nearest neighbours, and their edges; ``nodes`` has node and code."""
    groups = _groups(n)
    sent = nodes.select("node", "code").mapInArrow(_pack_nodes(groups), _PACKED)
    for deal in range(DEALS):
        sent = sent.unionByName(_dealt(nodes, n, block, deal + 1).groupBy("cell", "part").applyInArrow(_start(groups), _PACKED))
    lists = materialize(_gathered(sent, _merge(groups)), "lists")
    # one block has compared all pairs; else lists only get better, so that this ends
    iteration, changed = 0, float(n > block)
    while changed >= CHANGED:
        iteration += 1
        offers = _gathered(_gathered(lists, _visit(groups, iteration)), _join(groups))
        lists = materialize(_gathered(offers, _merge(groups)), "lists")
        changed = lists.filter(F.col("kind") == _STATE).agg(F.sum("changed") / F.sum("entries")).first()[0] or 0.0
    return lists


def _graph(table: pa.Table) -> pa.Table:
    """A group's nodes with their neighbours and reverse neighbours."""
    node, code, ids, sims, new = _state(table)
    member, _, _, _ = _members(table, 0)
    home = table.column("to")[0].as_py()
    return _packed([_row(home, _GRAPH, node, member), _row(home, _NODES, node, code)])


def save_graph(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The searchable graph, with reverse edges, and the codes of its nodes, both by group."""
    both = materialize(_gathered(lists, _graph), "graph")
    return both.filter(F.col("kind") == _GRAPH), both.filter(F.col("kind") == _NODES)


def _enter(pivots: list[tuple[int, bytes]], groups: int):
    """Beams of the nearest pivots."""
    node = np.array([p[0] for p in pivots])
    x = np.frombuffer(b"".join(p[1] for p in pivots), np.float32).reshape(len(node), -1)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                query, q = part.column("query").to_numpy(), _matrix(part.column("code"), np.float32)
                s, keep = q @ x.T, min(BEAM, len(node))
                best = np.argpartition(s, len(node) - keep, axis=1)[:, len(node) - keep :]
                # a query is a node too, with its own neighbours in the graph
                near = np.append(node[best], query[:, None], axis=1)
                sims = np.append(np.take_along_axis(s, best, 1), np.einsum("ij,ij->i", q, q)[:, None], axis=1)
                beams = _beams(np.repeat(np.arange(len(query)), keep + 1), near.ravel(), sims.ravel(), np.zeros(near.size, np.uint8), len(query))
                yield from _packed(_sent(_BEAMS, _home(query, groups), query, q, *beams)).to_batches()

    return run


def _beams(row, ids, sims, stage, n: int) -> tuple[np.ndarray, ...]:
    """Beams of ``n`` queries (best first, -1 where there are no more), from flat columns; the next nodes to expand are marked."""
    at, rank = _kept(row, ids, sims, BEAM)
    beam = np.full((n, BEAM), -1), np.full((n, BEAM), -np.inf, np.float32), np.full((n, BEAM), _DONE, np.uint8)
    for column, values in zip(beam, (ids, sims, stage), strict=True):
        column[row[at], rank] = values[at]
    waiting = beam[2] == _WAITING
    beam[2][waiting & (np.cumsum(waiting, axis=1) <= EXPAND)] = _NOW
    return beam


def _unpacked_beams(table: pa.Table) -> tuple[np.ndarray, ...]:
    query, code, ids, sims, stage = _unpacked(table, _BEAMS, np.int64, np.float32, np.int64, np.float32, np.uint8)
    return query, code.reshape(len(query), -1), ids.reshape(-1, BEAM), sims.reshape(-1, BEAM), stage.reshape(-1, BEAM)


def _asked(groups: int):
    """The nodes that queries expand next, to the groups of the nodes."""

    def run(batches):
        for batch in batches:
            query, _, ids, _, stage = _unpacked_beams(pa.Table.from_batches([batch]))
            row, at = np.nonzero(stage == _NOW)
            yield from _packed(_sent(_ASKED, _home(ids[row, at], groups), query[row], ids[row, at])).to_batches()

    return run


def _measures(groups: int):
    """The codes of queries that go on, to all groups, each with what a node must exceed to enter its beam."""

    def run(batches):
        for batch in batches:
            query, code, ids, sims, stage = _unpacked_beams(pa.Table.from_batches([batch]))
            on = (stage == _NOW).any(1)
            least = np.where(ids[:, -1] >= 0, sims[:, -1], -np.inf).astype(np.float32)
            if on.any():
                blobs = [np.ascontiguousarray(c[on]).tobytes() for c in (query, code, least)]
                yield from _packed([(g, _QUERIES, *blobs, None, None, 0, 0) for g in range(groups)]).to_batches()

    return run


def _reach(groups: int):
    """Neighbours of the nodes asked for, to the groups that have their codes."""

    def run(table: pa.Table) -> pa.Table:
        node, member = _unpacked(table, _GRAPH, np.int64, np.int64)
        query, asked = _unpacked(table, _ASKED, np.int64, np.int64)
        near = member.reshape(len(node), -1)[np.searchsorted(node, asked)]
        there = near >= 0
        return _packed(_sent(_ASKED, _home(near[there], groups), np.repeat(query, there.sum(1)), near[there]))

    return run


def _scored(groups: int):
    """Scores of the nodes reached that can still enter the query's beam, to the groups of the queries."""

    def run(table: pa.Table) -> pa.Table:
        node, code = _unpacked(table, _NODES, np.int64, np.float32)
        if not len(node):  # few nodes may leave a group empty
            return _packed([])
        query, measure, least = _unpacked(table, _QUERIES, np.int64, np.float32, np.float32)
        of, near = _unpacked(table, _ASKED, np.int64, np.int64)
        order = np.argsort(query)
        query, measure, least = query[order], measure.reshape(len(query), -1)[order], least[order]
        code = code.reshape(len(node), -1)
        pair = np.sort(np.searchsorted(query, of) * len(node) + np.searchsorted(node, near))
        row, at = np.divmod(pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair, len(node))
        sim = np.zeros(len(row), np.float32)
        for i in range(0, len(row), PACK):
            sim[i : i + PACK] = np.einsum("ij,ij->i", measure[row[i : i + PACK]], code[at[i : i + PACK]])
        good = sim > least[row]
        row, at, sim = row[good], at[good], sim[good]
        return _packed(_sent(_OFFERS, _home(query[row], groups), query[row], node[at], sim))

    return run


def _advance(table: pa.Table) -> pa.Table:
    """Beams of a group's queries after their frontier was scored."""
    query, code, ids, sims, stage = _unpacked_beams(table)
    order = np.argsort(query)
    query, code, ids, sims, stage = query[order], code[order], ids[order], sims[order], stage[order]
    to, offer, sim = _unpacked(table, _OFFERS, np.int64, np.int64, np.float32)
    had = ids >= 0
    row = np.append(np.nonzero(had)[0], np.searchsorted(query, to))
    stage = np.append(np.where(stage[had] == _NOW, _DONE, stage[had]), np.full(len(to), _WAITING)).astype(np.uint8)
    beams = _beams(row, np.append(ids[had], offer), np.append(sims[had], sim), stage, len(query))
    return _packed([_row(table.column("to")[0].as_py(), _BEAMS, query, code, *beams, changed=int((beams[2] == _NOW).sum()))])


def _opened(table: pa.Table) -> pa.Table:
    """The first beams of a group's queries in one row."""
    query, code, ids, sims, stage = _unpacked_beams(table)
    order = np.argsort(query)
    home, now = table.column("to")[0].as_py(), int((stage == _NOW).sum())
    return _packed([_row(home, _BEAMS, query[order], code[order], ids[order], sims[order], stage[order], changed=now)])


def _best(batches):
    """(query, ids) of beams, best first."""
    for batch in batches:
        query, _, ids, _, _ = _unpacked_beams(pa.Table.from_batches([batch]))
        had = ids >= 0
        offsets = pa.array(np.append(0, np.cumsum(had.sum(1))).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.ListArray.from_arrays(offsets, pa.array(ids[had]))], names=["query", "ids"])


def nearest(
    vectors: DataFrame,
    is_query,
    k: int,
    id_col: str = "vec_id",
    vector: str = "embedding",
    block: int = BLOCK,
    pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query``, its ``k`` nearest others."""
    rows = usable(vectors, id_col, vector).withColumn("query", is_query)
    # a row's number stays as it is written; ids may repeat
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    # one node for equal vectors, named by the smallest number of their rows
    named = rows.groupBy("vec").agg(F.min("uid").alias("node"), F.max(F.struct("query")).getField("query").alias("query"))
    distinct = materialize(named, "distinct")
    stats = distinct.agg(
        F.count("*").alias("n"),
        F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("longest"),
    ).first()
    n, longest = stats["n"], float(stats["longest"] or 0) ** 0.5
    code = "node long, code binary"
    nodes = materialize(distinct.select("node", "vec").mapInArrow(_code(longest), code), "nodes")
    # the longest vectors have the largest products with many queries
    length = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    longest_first = distinct.select("node", length.alias("l")).orderBy(F.desc("l"), "node").limit(pivots).select("node")
    sampled = nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(pivots)
    entries = nodes.join(F.broadcast(sampled.union(longest_first).distinct()), "node").collect()
    if not entries:
        empty = "query_id long, rank int, vec_id long, score double"
        return vectors.sparkSession.createDataFrame([], empty)
    graph = save_graph(build_graph(nodes, n, block))
    asked = distinct.filter("query").select("node", "vec")
    # a query has no added component: it only measures products
    asked = materialize(asked.mapInArrow(_query_code(longest), "query long, code binary"), "asked")
    turns = -(-asked.count() // QUERIES)
    beams = None
    for turn in range(turns):
        part = _search(*graph, asked.filter(_block("query", turns, 7) == turn), entries, _groups(n))
        beams = part if beams is None else beams.unionByName(part)
    if beams is None:
        beams = asked.select("query", F.array().cast("array<long>").alias("ids"))
    return _exact(beams, distinct, rows, k)


def _search(graph: DataFrame, codes: DataFrame, asked: DataFrame, pivots: list, groups: int) -> DataFrame:
    """(query, ids): beams of queries when all their nodes are expanded."""
    entered = asked.mapInArrow(_enter([(p["node"], p["code"]) for p in pivots], groups), _PACKED)
    beams = materialize(_gathered(entered, _opened), "beams")
    # a node is expanded once by a query, so that this ends
    while beams.agg(F.sum("changed")).first()[0]:
        reached = _gathered(beams.mapInArrow(_asked(groups), _PACKED).unionByName(graph), _reach(groups))
        measures = beams.mapInArrow(_measures(groups), _PACKED)
        scored = _gathered(reached.unionByName(measures).unionByName(codes), _scored(groups))
        beams = materialize(_gathered(scored.unionByName(beams), _advance), "beams")
    return beams.mapInArrow(_best, "query long, ids array<long>")


def _query_code(longest: float):
    def run(batches):
        for batch in batches:
            values, _ = _flat(batch.column("vec"))
            x = values.reshape(batch.num_rows, -1) / longest
            code = np.hstack([x, np.zeros((len(x), 1))]).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([r.tobytes() for r in code], pa.binary())], names=["query", "code"]
            )

    return run


def _dots(batches):
    """Exact inner products of pairs of vectors."""
    for batch in batches:
        if batch.num_rows:
            a, b = (_flat(batch.column(c))[0].reshape(batch.num_rows, -1) for c in ("a", "b"))
            score = pa.array(np.einsum("ij,ij->i", a, b))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), score], names=["query", "node", "score"])


def _exact(beams: DataFrame, distinct: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    # copies of the query's own vector may be among its nearest
    best = F.array_distinct(F.concat(F.array("query"), F.slice("ids", 1, RERANK)))
    pairs = beams.select("query", F.explode(best).alias("node"))
    pairs = pairs.join(distinct.select("node", F.col("vec").alias("b")), "node")
    pairs = pairs.join(distinct.select(F.col("node").alias("query"), F.col("vec").alias("a")), "query")
    scored = pairs.mapInArrow(_dots, "query long, node long, score double")
    # the k + 1 smallest ids of each node can be wanted, no more: one may be the query itself
    by_node = Window.partitionBy("node").orderBy("id", "uid")
    ids = rows.join(distinct.select("vec", "node"), "vec").select("id", "uid", "node", "query")
    members = ids.withColumn("r", F.row_number().over(by_node)).filter(F.col("r") <= k + 1).select("node", "id", "uid")
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "id", "uid")
    top = scored.join(members, "node").withColumn("r", F.row_number().over(by_query)).filter(F.col("r") <= k + 1)
    top = top.select(F.col("query").alias("node"), F.col("id").alias("vec_id"), "uid", "score")
    # every query row of a node gets the node's results but itself
    queries = ids.filter("query").select(F.col("id").alias("query_id"), F.col("uid").alias("own"), "node")
    rank = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id", "uid")
    found = queries.join(top, "node").filter("own != uid")
    found = found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
