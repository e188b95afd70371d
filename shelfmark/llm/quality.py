"""Quality classifier by positive-unlabelled learning, trained in numpy.

Only good texts are trusted to be labelled; everything else is unlabelled web text, a
mixture of good and bad. The class prior (the share of good texts in the mixture) is
estimated first: a classifier of labelled against unlabelled texts is fitted on one half of
the sample, and on the other half the prior is the least ratio of unlabelled to labelled
mass above a score (above a high score the unlabelled texts are good ones only), where the
ratio with its deviation bound is least. Then a network with one hidden layer minimises the
non-negative unbiased risk

    prior * R+(labelled) + max(0, R-(unlabelled) - prior * R-(labelled))

with the sigmoid loss, which is bounded, so that few texts cannot outweigh the mixture; the
sigmoid of the network is the score. When the second term of a batch is below zero, the step
goes up along it instead, which undoes overfitting.

A text is described as a whole by ``FEATURES`` numbers: shares of kinds of bytes, lengths and
shapes of words, and how much of it repeats. Training reads a bounded sample of
(id, text) pairs: ``POSITIVE`` labelled and ``UNLABELLED`` of all, the first by a hash of the
id; only their features move, and one task trains. Scoring covers every text.

Definitions: a null text counts as empty, and an empty text is scored like any other. Labels other
than 0 and 1, null labels and labels without an id are ignored; of several labels of a document
the smallest counts. Rows that repeat an id and a text are one pair of the sample and are all
scored; equal texts have equal scores. Without a trusted positive every score is 0. Columns of
``docs`` other than those named are neither read nor returned, but for those ``score`` is given.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.words import owner, run_hashes, text_slices, word_hashes, word_spans

#: Most pairs of a training sample.
POSITIVE, UNLABELLED = 4000, 8000
THRESHOLD = 0.3
HIDDEN = 24
EPOCHS = 120
BATCHES = 4
RATE = 0.003
#: Features beyond so many standard deviations count as that many.
CLIP = 6.0

_LOWER, _UPPER, _DIGIT, _HIGH, _CONTROL = range(5)


def _byte_kinds() -> tuple[np.ndarray, int]:
    """Byte -> kind: letters, digits, bytes above ASCII and controls by class, others one by one."""
    kinds = np.full(256, _CONTROL)
    kinds[128:] = _HIGH
    kinds[ord("a") : ord("z") + 1] = _LOWER
    kinds[ord("A") : ord("Z") + 1] = _UPPER
    kinds[ord("0") : ord("9") + 1] = _DIGIT
    singles = [b for b in (9, 10, 13, *range(32, 127)) if not chr(b).isalnum()]
    kinds[singles] = np.arange(5, 5 + len(singles))
    return kinds, 5 + len(singles)


_KINDS, _N_KINDS = _byte_kinds()
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\")"]] = True
FEATURES = _N_KINDS + 10


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _distinct(text: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text, its number of different hashes and the count of the most frequent one."""
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])) if len(text) else [])
    most = np.zeros(n)
    np.maximum.at(most, text[first], np.diff(np.append(first, len(text))))
    return np.bincount(text[first], minlength=n), most


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, FEATURES) of the texts of a slice, each as a whole."""
    n, size = len(offsets) - 1, np.diff(offsets)
    text = np.repeat(np.arange(n), size)
    kinds = np.bincount(text * _N_KINDS + _KINDS[data], minlength=n * _N_KINDS).reshape(n, _N_KINDS)
    starts, stops, firsts = word_spans(data, offsets)
    words, of, count = word_hashes(data, starts, stops), owner(firsts), np.diff(firsts)
    length = stops - starts
    different, most = _distinct(of, words, n)
    pair = np.flatnonzero(of[1:] == of[:-1])
    pairs, _ = _distinct(of[pair], run_hashes(words, pair, pair + 2), n)
    per_text = lambda mask: np.bincount(of, mask, n)
    lower, upper = (np.concatenate([[0], np.cumsum(_KINDS[data] == k)]) for k in (_LOWER, _UPPER))
    shouted = (lower[stops] == lower[starts]) & (upper[stops] - upper[starts] > 1)
    mean = _share(per_text(length), count)
    columns = [
        np.log1p(size),
        np.log1p(count),
        mean,
        np.sqrt(np.maximum(_share(per_text(length.astype(float) ** 2), count) - mean**2, 0)),
        _share(different, count),
        _share(most, count),
        _share(pairs, np.maximum(count - 1, 0)),
        _share(np.bincount(of[pair], words[pair] == words[pair + 1], n), np.maximum(count - 1, 0)),
        _share(per_text(shouted), count),
        _share(per_text(_SYMBOL[data[stops - 1]] if len(stops) else np.zeros(0)), count),
    ]
    return np.column_stack([np.sqrt(kinds / np.maximum(size, 1)[:, None]), *columns])


@dataclass
class Model:
    """Network on standardised features; without a trusted positive ``out`` is None and scores are 0."""

    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray  # (FEATURES + 1, HIDDEN), the last row for a constant
    out: np.ndarray | None  # (HIDDEN + 1,)
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return _forward(self, x)[2]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.out is None:
            return np.zeros(len(x))
        return _sigmoid(self.logits(x))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _one(x):
    return np.column_stack([x, np.ones(len(x))])


def _forward(model: Model, x: np.ndarray):
    x = _one(np.clip((x - model.mean) / model.scale, -CLIP, CLIP))
    h = _one(np.tanh(x @ model.hidden))
    return x, h, h @ model.out


def risks(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the unbiased risk, from logits: of good texts, and of bad ones (may be below 0)."""
    loss = lambda z: _sigmoid(-z).mean()
    return prior * loss(positive), loss(-unlabelled) - prior * loss(-positive)


def _new(p: np.ndarray, u: np.ndarray, prior: float, rng) -> Model:
    both = np.vstack([p, u])
    scale = both.std(0)
    scale[scale < 1e-9] = 1
    hidden = rng.standard_normal((p.shape[1] + 1, HIDDEN)) / np.sqrt(p.shape[1])
    return Model(both.mean(0), scale, hidden, rng.standard_normal(HIDDEN + 1) * 0.1, prior)


def _train(p: np.ndarray, u: np.ndarray, prior: float, step, seed: int, epochs: int) -> Model:
    """Adam steps; ``step`` gives the gradient of a batch's risk by the logits of both parts."""
    rng = np.random.default_rng(seed)
    model = _new(p, u, prior, rng)
    weights = [model.hidden, model.out]
    first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        deal = [np.array_split(rng.permutation(len(x)), BATCHES) for x in (p, u)]
        for i, j in zip(*deal, strict=True):
            if not len(i) or not len(j):
                continue
            x, h, z = _forward(model, np.vstack([p[i], u[j]]))
            g = np.concatenate(step(z[: len(i)], z[len(i) :]))
            back = np.outer(g, model.out[:-1]) * (1 - h[:, :-1] ** 2)
            t += 1
            for w, grad, a, b in zip(weights, (x.T @ back + 1e-4 * model.hidden, h.T @ g), first, second, strict=True):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                w -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return model


def _against_unlabelled(p, u):
    """Logistic loss of labelled against unlabelled, both weighing the same."""
    return -_sigmoid(-p) / len(p), _sigmoid(u) / len(u)


def _non_negative(prior: float):
    def step(p, u):
        slope_p, slope_u = (_sigmoid(z) * _sigmoid(-z) / len(z) for z in (p, u))
        if risks(p, u, prior)[1] < 0:  # up along the term that fell below zero
            return prior * slope_p, -slope_u
        return -2 * prior * slope_p, slope_u

    return step


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of good texts among the unlabelled, from scores of texts that the scorer has not seen."""
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    above = lambda s: 1 - np.searchsorted(np.sort(s), cuts) / len(s)
    p, u = above(positive), above(unlabelled)
    slack = sum(np.sqrt(np.log(4 / delta) / (2 * len(s))) for s in (positive, unlabelled))
    seen = p > 0
    ratio = u[seen] / p[seen]
    return float(np.clip(ratio[np.argmin(ratio + slack / p[seen])], 0.01, 0.99))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, seed: int = 5) -> Model:
    """A model from the features of trusted positives and of unlabelled texts."""
    if not len(positive) or not len(unlabelled):
        zero = np.zeros(FEATURES)
        return Model(zero, zero + 1, np.zeros((FEATURES + 1, HIDDEN)), None, 0.0)
    if prior is None:
        rng = np.random.default_rng(seed)
        fit, rest = zip(*(np.array_split(rng.permutation(len(x)), 2) for x in (positive, unlabelled)), strict=True)
        if min(len(part) for part in (*fit, *rest)):
            known = _train(positive[fit[0]], unlabelled[fit[1]], 0.5, _against_unlabelled, seed, EPOCHS // 4)
            prior = estimate_prior(known.logits(positive[rest[0]]), known.logits(unlabelled[rest[1]]))
        else:  # one text of a kind tells nothing about the mixture
            prior = 0.5
    return _train(positive, unlabelled, prior, _non_negative(prior), seed, EPOCHS)


def held_out(id_col: str = "doc_id"):
    """The rows whose labels no model may learn from."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, digest, positive) of a bounded number of different (id, text) pairs.

    A pair can be in both parts: trusted positives are a part of the unlabelled mixture too.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = known.filter((F.col("quality") == 1) & ~held_out()).select("doc_id")
    pairs = docs.select("doc_id", _digest("text").alias("digest")).filter(~held_out()).distinct()
    first = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("digest")]
    positive = pairs.join(good, "doc_id", "left_semi").orderBy(*first).limit(POSITIVE).withColumn("positive", F.lit(True))
    return positive.unionByName(pairs.orderBy(*first).limit(UNLABELLED).withColumn("positive", F.lit(False)))


def _digest(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _described(batches):
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column("text")):
            x = features(data, offsets).astype(np.float32)
            part = batch.slice(lo, hi - lo).drop_columns(["text"])
            rows = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, rows], names=[*part.schema.names, "x"])


def _fit(batches):
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["digest"]))
    part = lambda good: [np.frombuffer(r["x"], np.float32) for r in rows if r["positive"] == good]
    p, u = (np.array(part(good), float).reshape(-1, FEATURES) for good in (True, False))
    model = train(p, u)
    parts = [model.mean, model.scale, model.hidden, model.out if model.out is not None else np.zeros(0)]
    arrays = [pa.array([a.astype(float).tobytes()], pa.binary()) for a in parts]
    yield pa.RecordBatch.from_arrays([*arrays, pa.array([model.prior])], names=["mean", "scale", "hidden", "out", "prior"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the bounded sample, trained in one task; only the model comes back."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # at most POSITIVE + UNLABELLED rows of two numbers: safe to broadcast
    sample = F.broadcast(training_sample(docs, labels))
    rows = docs.withColumn("digest", _digest("text")).join(sample, ["doc_id", "digest"])
    rows = rows.mapInArrow(_described, "doc_id long, digest long, positive boolean, x binary")
    rows = rows.groupBy("doc_id", "digest", "positive").agg(F.first("x").alias("x"))
    found = rows.repartition(1).mapInArrow(_fit, "mean binary, scale binary, hidden binary, out binary, prior double").first()
    if found is None:  # no row, no task
        return train(np.zeros((0, FEATURES)), np.zeros((0, FEATURES)))
    mean, scale, hidden, out = (np.frombuffer(found[c], float) for c in ("mean", "scale", "hidden", "out"))
    return Model(mean, scale, hidden.reshape(-1, HIDDEN), out if len(out) else None, found["prior"])


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability that each text is good (replacing a column of that name)."""

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text)
            for lo, hi, data, offsets in text_slices(batch.column(i)):
                part = batch.slice(lo, hi - lo)
                names = [n for n in part.schema.names if n != name]
                scores = pa.array(model.score(features(data, offsets)))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), scores], names=[*names, name])

    fields = [f for f in docs.schema if f.name != name]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.DoubleType())]))
