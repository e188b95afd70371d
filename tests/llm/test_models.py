"""Trained operators by held-out accuracy, mixing by its bound, neighbours by recall."""

import collections
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import ann, langid, mixing, queries, toxicity

# ------------------------------------------------------------------ toxicity


@pytest.fixture(scope="session")
def moods(spark):
    rnd = random.Random(1)
    syllables = "an ther in lo ka rem tis".split()
    bad = ["vileword", "nastyone", "horridly"]
    docs, labels = [], []
    for i in range(500):
        words = ["".join(rnd.choices(syllables, k=rnd.randint(1, 3))) for _ in range(rnd.randint(5, 150))]
        toxic = int(i % 4 == 0)
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(bad)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    docs += [(500, "an ther nastyonne lo"), (501, None), (502, ""), (503, "?! ..."), (504, "an ther in " * 20_000)]
    labels += [(9000, 1, 1), (None, 1, 1), (501, 0, None), (3, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int"
    )


def test_toxicity(moods):
    docs, labels = moods
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs.withColumn("held", toxicity.held_out()).withColumn("score", F.lit("old")), model).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held"] and r["doc_id"] < 500]
    right = [(r["score"] >= toxicity.THRESHOLD) == (r["doc_id"] % 4 == 0) for r in held]
    assert len(held) > 80 and np.mean(right) > 0.95
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[500] >= toxicity.THRESHOLD  # a misspelling never seen
    assert by_id[501] == by_id[502] == by_id[503] == 0 and by_id[504] < toxicity.THRESHOLD


def test_toxicity_scores_in_small_pieces(spark, moods):
    """Workers of one machine share its memory: a worker's arrays stay small, whatever the batch."""
    model = toxicity.Model(np.random.default_rng(1).standard_normal(toxicity.BUCKETS).astype(np.float32), 0.0)
    words = moods[0].filter("doc_id < 20").agg(F.concat_ws(" ", F.collect_list("text"))).first()[0]
    docs = spark.createDataFrame([(i, f"{i} {words}") for i in range(300)], "doc_id long, text string").coalesce(1)

    assert docs.agg(F.sum(F.octet_length("text"))).first()[0] > 2 * toxicity.SLICE_BYTES
    pieces = list(toxicity.text_slices(docs.toArrow().column("text"), toxicity.SLICE_BYTES))
    assert len(pieces) > 2 and max(len(p[2]) for p in pieces) <= toxicity.SLICE_BYTES
    tracemalloc.start()
    for _, _, data, offsets in pieces:
        model.score(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20
    got = [r["score"] for r in toxicity.score(docs, model).orderBy("doc_id").collect()]
    texts = [r["text"].encode() for r in docs.orderBy("doc_id").collect()]
    assert got == [float(model.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]) for t in texts]


def test_toxicity_without_labels(moods):
    docs, labels = moods
    for known in (labels.limit(0), labels.filter("toxic = 1")):
        assert toxicity.score(docs, toxicity.fit(docs, known)).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels.limit(0))).count() == 0


# ------------------------------------------------------------------ language


def test_languages(spark, sf_dir, nothing):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame(
        [(-1, None, "en", "s", 0), (-2, "", "fr", "s", 0), (-3, "12 %", "de", "s", 0)], docs.schema
    )
    net = langid.fit(docs)
    got = langid.predict(docs.unionByName(extra).withColumn("score", F.lit(7)), net)
    got = got.withColumn("held", toxicity.held_out()).collect()
    held = [r for r in got if r["doc_id"] >= 0 and r["held"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.9
    assert all((r["lang_pred"], r["score"]) == ("und", 0) for r in got if r["doc_id"] < 0)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.fit(nothing) is None
    assert {r["lang_pred"] for r in langid.predict(docs.limit(3), None).collect()} == {"und"}


def test_a_text_is_read_to_its_end(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = langid.fit(docs)
    part = {r["lang"]: r["text"] for r in docs.filter("n_chars > 1500").collect()}
    both = spark.createDataFrame([(part["en"][:600] + " " + part["de"] * 8,)], "text string")
    assert langid.predict(both, net).first()["lang_pred"] == "de"


# -------------------------------------------------------------------- mixing


@pytest.mark.parametrize("seed", range(8))
def test_a_round_stays_within_one_block(seed):
    rnd = random.Random(seed)
    weights = list(mixing.whole_weights({i: rnd.random() + 0.001 for i in range(rnd.randint(1, 8))}, 97).values())
    count = [0] * len(weights)
    for t, s in enumerate(mixing.one_round(weights), 1):
        count[s] += 1
        assert all(abs(c - t * w / sum(weights)) < 1 for c, w in zip(count, weights, strict=True))
    assert count == weights


@pytest.mark.parametrize("weights", [None, {"s0": 1.0, "s1": 8.0}])
def test_schedule(small, weights):
    block = 3
    docs = small.withColumns({"slot": F.lit(-1), "_n": F.lit(1), "piece": F.lit(2)})
    rows = mixing.schedule(docs, weights, block=block).collect()
    assert len(rows) == docs.count() and {"_n", "piece"} <= set(rows[0].asDict())
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["slot"]].append(r)
    assert sorted(slots) == list(range(len(slots)))
    assert all(sorted(r["place"] for r in v) == list(range(len(v))) and len({r["source"] for r in v}) == 1 for v in slots.values())
    n = collections.Counter(r["source"] for r in rows)
    targets = {s: (weights or {}).get(s, 0.0) if weights else c**0.5 for s, c in n.items()}
    whole, left = mixing.whole_weights(targets), {s: -(-c // block) for s, c in n.items()}
    count, t = collections.Counter(), 0
    for slot in range(len(slots)):  # within a block of the shares of the sources that are left
        t += 1
        source = slots[slot][0]["source"]
        count[source] += 1
        left[source] -= 1
        total = sum(whole[s] for s in left)
        assert all(abs(count[s] - t * whole[s] / total) < 1 for s in left)
        if not left[source]:
            del left[source]
            count, t = collections.Counter(), 0


def within(rows, targets, bound, until):
    """Slots of ``rows`` are within ``bound`` blocks of the given targets, up to slot ``until``."""
    order = [s for _, s in sorted({(r["slot"], r["source"]) for r in rows})][:until]
    total, count, wrong = sum(targets.values()), collections.Counter(), 0
    for t, s in enumerate(order, 1):
        count[s] += 1
        if t % 50 == 0:
            wrong += sum(abs(count[k] - t * w / total) >= bound for k, w in targets.items())
        else:
            wrong += abs(count[s] - t * targets[s] / total) >= bound
    return len(order) == until and not wrong


def test_bound_for_the_given_targets(spark):
    # one large source and 500 tiny ones
    targets = {"big": 0.9, **{f"s{i}": 0.0002 for i in range(500)}}
    rows = spark.range(14_000).withColumn("source", F.expr("if(id < 9000, 'big', concat('s', id % 500))"))
    got = mixing.schedule(rows, targets, block=1).collect()
    assert sorted(r["slot"] for r in got) == list(range(14_000))
    assert within(got, targets, 1, 9000)
    # square roots of uneven counts, far above a thousand slots
    rows = spark.range(30_000).withColumn("source", F.expr("concat('s', cast(log2(id % 4093 + 1) as int))"))
    n = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect() if r["count"] > 1000}
    got = mixing.schedule(rows.filter(F.col("source").isin(list(n))), block=1).collect()
    least = min(c**0.5 for c in n.values())
    assert within(got, {s: c**0.5 for s, c in n.items()}, 1, int(least * sum(c**0.5 for c in n.values())) - len(n))


def test_more_sources_than_a_task_schedules(spark):
    rows = spark.range(9000).withColumn("source", F.concat(F.lit("www"), F.col("id") % 1500))
    got = mixing.schedule(rows, block=2).collect()
    assert len(got) == 9000 and sorted({r["slot"] for r in got}) == list(range(4500))
    n = {f"www{i}": 6 for i in range(1500)}
    assert within(got, n, 2, 3000)
    tasks = spark.range(60).select(F.col("id").alias("key"), F.lit(1.0).alias("target"), F.lit(2).cast("long").alias("blocks"))
    deep = mixing.slots_of(tasks, 60, most=3).collect()  # groups of groups
    assert sorted(r["slot"] for r in deep) == list(range(120))
    assert {(r["key"], r["block"]) for r in deep} == {(i, b) for i in range(60) for b in range(2)}


def test_mix_keeps_all(small, nothing):
    assert mixing.mix(nothing).count() == 0
    got = mixing.mix(small)
    assert got.columns == small.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, small.collect()))


def test_row_numbers_over_many_pieces(small):
    rows = mixing.number_rows(small.select("doc_id", "source"), "source", F.xxhash64("doc_id"), 7).collect()
    for source in {r["source"] for r in rows}:
        own = sorted(r["_n"] for r in rows if r["source"] == source)
        assert own == list(range(len(own)))


def test_texts_move_once_to_be_numbered(small):
    """The join with the pieces' offsets finds the rows where the window left them."""
    rows = small.select("text", "source")
    numbered = mixing.number_rows(rows, "source", F.xxhash64("text"), 7)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin") :]
    left = join[: join.index("Window")]
    assert "Exchange" not in left


# ---------------------------------------------------------------- neighbours


def brute(rows, k):
    good = [(i, v) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], dtype=np.float64)
    out = {}
    for n, i in enumerate(ids):
        if i % 20 == 0:
            s = x @ x[n]
            order = [m for m in np.lexsort((ids, -s)) if m != n][:k]
            out.setdefault(i, [(s[m], ids[m]) for m in order])
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 8)) * rng.uniform(0.5, 2, (900, 1))
    x[100:160] = x[99]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [1.0] * 7 + [None]), (1060, [float("nan")] * 8), (1080, [1.0])]
    rows += [(None, [1.0] * 8), (1100, [float("inf")] + [0.0] * 7)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(0))
    got = collections.defaultdict(list)
    for r in ann.nearest(table, F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = brute(rows, 20)
    assert set(got) == set(want)
    hits = [len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want]
    assert np.mean(hits) / 20 >= 0.9 and all(len(v) == 20 for v in got.values())
    assert [i for _, i in got[100]] == [i for _, i in want[100]]  # ties among copies


def test_nearest_of_rows_with_one_id(spark):
    """Rows of one id are rows of their own, as queries and as candidates."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (3, [0.5, 0.5]), (5, [2.0, 0.1]), (0, [1.0, 0.0]), (20, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.nearest(table, F.col("id") % 20 == 0, 20).collect())
    want = []
    for i, (q, v) in enumerate(rows):
        if q % 20 == 0:
            others = [(float(np.dot(v, w)), c) for j, (c, w) in enumerate(rows) if j != i]
            others.sort(key=lambda x: (-x[0], x[1]))
            want += [(q, r, c, s) for r, (s, c) in enumerate(others, 1)]
    assert got == sorted(want)


def recall(spark, x, asked=40, k=20):
    """Recall where neither one block nor the pivots see all of the vectors."""
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    every = len(x) // asked
    got = collections.defaultdict(set)
    for r in ann.nearest(table, F.col("id") % every == 0, k, block=128, pivots=32).collect():
        got[r["query_id"]].add(r["vec_id"])
    s = x[::every] @ x.T
    s[np.arange(len(s)), np.arange(0, len(x), every)] = -np.inf
    want = np.argsort(-s, axis=1)[:, :k]
    return np.mean([len(got[n * every] & set(w.tolist())) / k for n, w in enumerate(want)])


def test_recall_beyond_blocks_and_pivots(spark):
    rng = np.random.default_rng(5)
    # groups of vectors, most of them without a pivot
    x = rng.standard_normal((100, 1, 16)) + 0.2 * rng.standard_normal((100, 60, 16))
    x = x.reshape(-1, 16)[rng.permutation(6000)]
    assert recall(spark, x / np.linalg.norm(x, axis=1, keepdims=True)) >= 0.9


def test_recall_with_unequal_norms(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    few = np.ones((2000, 1))
    few[[3, 500, 1777]] = 100
    assert recall(spark, x * few) >= 0.9
    assert recall(spark, x * 100 ** rng.random((2000, 1))) >= 0.9


def test_few_vectors(spark):
    for rows in ([], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (7, [2.0, 1.0]), (9, [1.0, 2.0])]):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = ann.nearest(table, F.col("id") % 20 == 0, 20).orderBy("rank").collect()
        want = [(0, 1, 9, 5.0), (0, 2, 7, 4.0)] if len(rows) > 1 else []
        assert [tuple(r) for r in got] == want


def test_local_join_leaves_out_pairs_that_have_met():
    x = np.eye(4, dtype=np.float32)
    table = pa.table({"v": [9] * 4, "u": [1, 2, 3, 4], "new": [False, False, False, True], "worst": np.full(4, -np.inf, np.float32), "code": [r.tobytes() for r in x]})
    got = {r["node"]: r["ids"] for r in ann._meet(table).to_pylist()}
    assert {u: sorted(ids) for u, ids in got.items()} == {1: [4], 2: [4], 3: [4], 4: [1, 2, 3]}
    old = table.set_column(2, "new", pa.array([False] * 4))
    assert ann._meet(old).num_rows == 0


def test_lists_start_from_near_nodes(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((40, 8))
    x = (np.repeat(centers, 30, axis=0) + 0.01 * rng.standard_normal((1200, 8))).astype(np.float32)
    nodes = spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate(x)], "node long, code binary")
    dealt = ann._dealt(nodes, len(x), 120, 1).select("node", "cell", "part").collect()
    assert sorted(r["node"] for r in dealt) == list(range(1200))
    sizes = collections.Counter((r["cell"], r["part"]) for r in dealt)
    assert max(sizes.values()) <= 2 * 120
    cells = collections.defaultdict(set)
    for r in dealt:
        cells[r["node"] // 30].add(r["cell"])
    # a group has one or several nearest pivots, few of them with pivots of its own
    assert sum(len(c) for c in cells.values()) <= 3 * len(cells)


def coded(spark, x):
    return spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in enumerate(x.astype(np.float32))], "node long, code binary")


def test_nodes_travel_in_groups(spark):
    """Rows between steps are as many as pairs of groups at most, and the searchable graph holds no neighbour's vector."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 8))
    lists = ann.build_graph(coded(spark, x), len(x), block=256)
    groups = ann._groups(len(x))
    assert groups == 8 and lists.count() <= groups + groups**2
    graph, codes = (part.toArrow() for part in ann.save_graph(lists))
    node, member = ann._unpacked(graph, ann._GRAPH, np.int64, np.int64)
    assert sorted(node) == list(range(4000)) and sorted(ann._unpacked(codes, ann._NODES, np.int64)[0]) == list(range(4000))
    assert graph.num_rows == codes.num_rows == groups and graph.nbytes < 4000 * 8 * (ann.DEGREE + ann.REVERSE + 2)
    near = dict(zip(node.tolist(), member.reshape(4000, -1).tolist(), strict=True))
    for i in range(0, 4000, 50):
        want = np.argsort(((x - x[i]) ** 2).sum(1))[1:21]
        assert len({*want.tolist()} & {*near[i]}) >= 18
        real = [u for u in near[i] if u >= 0]
        assert i not in real and len({*real}) == len(real) >= ann.DEGREE


def test_local_join_of_neighbourhoods_by_brute_force():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((60, 5)).astype(np.float32)
    worst = np.where(rng.random(60) < 0.3, -np.inf, -4 * rng.random(60)).astype(np.float32)
    place, new = np.full((70, 40), 60), np.zeros((70, 40), bool)
    for v in range(70):
        m = rng.choice(60, rng.integers(0, 41), replace=False)
        place[v, : len(m)], new[v, : len(m)] = m, rng.random(len(m)) < v / 70
    want = collections.defaultdict(dict)
    for v in range(70):
        own = [(int(a), bool(n)) for a, n in zip(place[v], new[v], strict=True) if a < 60]
        for a, fresh in own:
            offers = [(-float(((x[a] - x[b]) ** 2).sum()) / 2, b) for b, other in own if b != a and (fresh or other)]
            good = sorted((o for o in offers if o[0] > worst[a]), reverse=True)
            want[a].update({b: s for s, b in good[: ann.OFFERS]})
    got = collections.defaultdict(dict)
    for a, b, s in zip(*(c.tolist() for c in ann._offered(place, new, x, worst)), strict=True):
        assert b not in got[a]
        got[a][b] = s
    for a in range(60):
        best = sorted(want[a], key=want[a].get, reverse=True)[: ann.DEGREE]
        assert sorted(got[a]) == sorted(best)
        assert np.allclose([got[a][b] for b in best], [want[a][b] for b in best], atol=1e-4)


def test_queries_in_turns(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((700, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")

    def found():
        return sorted(map(tuple, ann.nearest(table, F.col("id") % 20 == 0, 5, block=128, pivots=32).collect()))

    want = found()
    monkeypatch.setattr(ann, "QUERIES", 8)
    assert len(want) == 35 * 5 and found() == want
