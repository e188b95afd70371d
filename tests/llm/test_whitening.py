"""Whitening against exact sums and a plain eigendecomposition."""

from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import queries
from shelfmark.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, label int, n int, x string"


def _plain(rows, most=16):
    """(deviation, whitened, explained) by id, from exact whole numbers."""
    xs = [[floor(Fraction(64) * Fraction(c)) + 1_000_000 for c in v] for _, v in rows]
    fit = sorted(set(map(tuple, xs)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = lambda x: np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)])
    c = np.array([centred(x) for x in fit])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(most, int((values > 1e-12 * values.sum()).sum()))
    out = []
    for (vec_id, _), x in zip(rows, xs, strict=True):
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        out.append((vec_id, n, deviation, centred(x) @ vectors[:, :kept] / np.sqrt(values[:kept])))
    return out, values[:kept] / values.sum()


def _compare(got, rows):
    want, explained = _plain(rows)
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
    k = len(explained)
    assert len(got) == k * len(rows)
    sign = None
    for vec_id, n, deviation, white in want:
        mine = [min(by_row[vec_id][i + 1], key=lambda r: abs(r["deviation"] - deviation)) for i in range(k)]
        assert all(r["n"] == n and r["deviation"] == deviation for r in mine)
        value = np.array([r["whitened"] for r in mine])
        if sign is None and (np.abs(white) > 1e-3).all():
            sign = np.sign(value * white)
        if sign is not None:
            assert np.allclose(value, sign * white, rtol=1e-8, atol=1e-8)
    assert sign is not None
    return k


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 20)) * np.linspace(0.3, 2, 20) @ rng.standard_normal((20, 20))
    x[:, 7] = x[:, 3] * 2  # a direction without spread
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def test_against_plain(spark, vectors):
    rows = vectors + [(i % 7, v) for i, v in vectors[:150]] + [(9000 + i, vectors[0][1]) for i in range(50)]  # copies, repeated ids
    rows.append((None, [0.0] * 20))
    bad = [(1, None), (2, []), (3, [1.0] * 19), (4, [nan] + [0.0] * 19), (5, [inf] + [0.0] * 19), (6, [None] + [0.0] * 19)]
    df = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows + bad], SCHEMA).repartition(6)
    assert _compare(W.whiten(df).collect(), rows) == 16


def test_parts_and_rounds(spark, vectors, monkeypatch):
    monkeypatch.setattr(W, "FAN", 2)
    fit = spark.createDataFrame([([floor(64 * c) + W.OFFSET for c in v],) for _, v in vectors], "x array<long>").repartition(11)
    found = W.spectrum(fit)
    x = np.array([r["x"] for r in fit.collect()]) - W.OFFSET
    c = (x - x.mean(0)).T @ (x - x.mean(0))
    assert found.n == len(x) and np.allclose(found.mean, x.mean(0))
    assert np.allclose(found.basis * found.values @ found.basis.T, c, atol=1e-11 * np.abs(c).max())


@pytest.mark.parametrize("seed", range(6))
def test_rank_one_updates(seed):
    """Products with zero entries, repeated eigenvalues, and entries of very different size."""
    rng = np.random.default_rng(seed)
    d = 12
    s, c = W.Spectrum.of_none(d), np.zeros((d, d))
    for i in range(40):
        z = rng.standard_normal(d) * 10.0 ** rng.integers(-9, 3, d if seed % 2 else 1)
        z[rng.random(d) < 0.4] = 0
        z = np.eye(d)[i % d] if seed == 2 else z
        s.add_product(z)
        c += np.outer(z, z)
        size = max(np.abs(c).max(), 1e-300)
        assert np.abs(s.basis * s.values @ s.basis.T - c).max() < 1e-12 * size
        assert np.abs(s.basis.T @ s.basis - np.eye(d)).max() < 1e-12 and (np.diff(s.values) >= 0).all()


def test_secular_roots():
    poles, u = np.array([0.0, 1e-12, 1.0, 1.0 + 1e-9, 5.0]), np.array([1e-7, 1e-3, 1e-9, 2.0, 1e-5])
    origin, offset = W.secular_roots(poles, u)
    roots = poles[origin] + offset
    assert (roots >= poles).all() and (roots[:-1] <= poles[1:]).all() and (offset != 0).all()
    assert np.allclose(roots.sum(), poles.sum() + (u * u).sum(), rtol=1e-14)


def test_few_rows(spark):
    make = lambda rows: W.whiten(spark.createDataFrame([(i, v, 0, 0, "") for i, v in rows], SCHEMA)).collect()
    assert make([]) == [] and make([(1, None)]) == [] and make([(1, [1.0, 2.0])] * 3) == []
    got = make([(1, [0.0, 1.0]), (2, [0.0, 3.0]), (2, [0.0, 3.0])])
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"])) for r in got] == [
        (1, 1, 2, 128**2, 1.0), (2, 1, 2, 128**2, 1.0), (2, 1, 2, 128**2, 1.0)
    ]
    # entries beyond the cut, and a deviation beyond 64 bits
    got = make([(1, [1e300]), (2, [-1e300]), (3, [0.5])])
    assert len(got) == 3 and [r["deviation"] for r in got if r["vec_id"] == 1] == [None]


def test_query(spark, sf_dir):
    got = queries.op12_whitening(spark, sf_dir).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>")).collect()]
    assert _compare(got, rows) == 16
