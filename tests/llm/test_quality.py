"""Quality classifier: features by plain Python, risk and gradient, held-out labels."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import quality as Q
from shelfmark.llm import queries

TEXTS = ["", " \n", "One two two, ONE!! two", "a", "Ünïcode wörds ## | x9 THE", "the " * 50, "WORD\tWORD\nWORD."]


def _features(texts):
    return np.vstack([Q.features(d, o) for _, _, d, o in Q.text_slices(pa.array(texts, pa.string()))])


def _plain(text):
    data = text.encode()
    words = [w for w in data.replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
    n, pairs = len(words), list(zip(words, words[1:], strict=False))
    lengths = [len(w) for w in words]
    share = lambda a, b: a / max(b, 1)
    ascii_upper = lambda w: sum(65 <= b <= 90 for b in w)
    ascii_lower = lambda w: sum(97 <= b <= 122 for b in w)
    return [
        np.log1p(len(data)),
        np.log1p(n),
        share(sum(lengths), n),
        np.std(lengths) if n else 0,
        share(len(set(words)), n),
        share(max(Counter(words).values(), default=0), n),
        share(len(set(pairs)), max(n - 1, 0)),
        share(sum(a == b for a, b in pairs), max(n - 1, 0)),
        share(sum(not ascii_lower(w) and ascii_upper(w) > 1 for w in words), n),
        share(sum(w[-1:] in b"#$%&*+-/<=>@[\\]^_`{|}~(" for w in words), n),
    ]


def test_features():
    got = _features(TEXTS)
    assert got.shape == (len(TEXTS), Q.FEATURES)
    for text, x in zip(TEXTS, got, strict=True):
        assert np.allclose(x[Q._N_KINDS :], _plain(text)), text
        assert np.isclose((x[: Q._N_KINDS] ** 2).sum(), 1 if text else 0)
    # a text's features do not depend on its neighbours
    assert all(np.allclose(_features([t])[0], x) for t, x in zip(TEXTS, got, strict=True))


def test_the_step_is_the_gradient_of_the_risk():
    rng = np.random.default_rng(0)
    for _ in range(20):
        p, u, prior = rng.standard_normal(7), rng.standard_normal(9), 0.6
        good, bad = Q.risks(p, u, prior)

        def risk(p, u, bad=bad):
            a, b = Q.risks(p, u, prior)
            return a + b if bad >= 0 else -b

        for which, z in ((0, p), (1, u)):
            for i in range(len(z)):
                up, down = z.copy(), z.copy()
                up[i] += 1e-6
                down[i] -= 1e-6
                args = [(up, u), (down, u)] if which == 0 else [(p, up), (p, down)]
                slope = (risk(*args[0]) - risk(*args[1])) / 2e-6
                assert abs(slope - Q._non_negative(prior)(p, u)[which][i]) < 1e-6


@pytest.mark.parametrize("prior", (0.2, 0.5, 0.9))
def test_prior_and_separation(prior):
    rng = np.random.default_rng(1)
    make = lambda n, at: rng.standard_normal((n, Q.FEATURES)) * 0.5 + np.where(np.arange(Q.FEATURES) < 4, at, 0)
    good = int(prior * 6000)
    model = Q.train(make(2000, 1), np.vstack([make(good, 1), make(6000 - good, -1)]))
    assert abs(model.prior - prior) < 0.08
    assert (model.score(make(500, 1)) >= Q.THRESHOLD).mean() > 0.97 and (model.score(make(500, -1)) < Q.THRESHOLD).mean() > 0.97


def test_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(Q, "POSITIVE", 20)
    monkeypatch.setattr(Q, "UNLABELLED", 30)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    one = spark.createDataFrame([(1, "hot text"), (None, "no id"), (2, None)], "doc_id long, text string")
    docs = docs.unionByName(one).unionByName(one.crossJoin(spark.range(50)).drop("id"))
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(400)] + [(3, 0, 1), (None, 1, 1), (9, None, 1)], "doc_id long, quality int, toxic int")
    rows = Q.training_sample(docs, labels).collect()
    good = [r for r in rows if r["positive"]]
    assert len(good) == 20 and len(rows) == 50 and len({(r["doc_id"], r["digest"]) for r in good}) == 20
    assert all(r["doc_id"] % 2 and r["doc_id"] != 3 and zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in good)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)


def test_edges(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.fit(nothing, labels)
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 3), (2, "word " * 100_000, 4)], "doc_id long, text string, score int")
    assert [r["score"] for r in Q.score(docs, model).collect()] == [0.0] * 4
    assert Q.score(nothing, model).count() == 0
    # one text of each kind, a column that is replaced, equal texts
    model = Q.fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    got = Q.score(docs, model)
    assert got.columns == ["doc_id", "text", "score"]
    scores = [r["score"] for r in got.collect()]
    assert scores[0] == scores[1] == scores[2] and all(0 <= s <= 1 for s in scores)


def test_query(spark):
    """Held-out labels at the size that tests can afford."""
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op13_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    unseen = [r for r in rows if r["held_out"] and r["quality"] is not None]
    good, bad = ([r["score"] for r in unseen if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97
