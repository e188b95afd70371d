"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained in numpy.

A word is a run of letters, digits and bytes above ASCII (capitals folded); its subwords
are its character n-grams with word borders and the word itself, hashed into
``BUCKETS`` rows of an embedding table. A word is the mean of its subwords, a window of
``WINDOW`` words the mean of its words; a softmax over the window's vector gives the
probability of the toxic class, and a text is as toxic as its worst window. A misspelt
word shares most of its n-grams with the right one. Embeddings and softmax are
trained together; a label says only that some window of a text is toxic, so the
gradient of a text goes through its worst windows.

The softmax is linear in the embeddings, so a trained table shrinks to one number per
bucket, and scoring a text is a lookup and three averages over its whole length.

Training reads a bounded sample: at most ``TOXIC_TEXTS`` and ``CLEAN_TEXTS`` labelled texts, the
first by a hash of the id, without those of over ``TRAIN_CHARS`` characters, and of a clean
text ``CLEAN_WINDOWS`` evenly spaced windows. Scoring covers every text as a whole.

Definitions: a null text, or one without words, has score 0. Without labels of both
classes every score is 0. Labels that are null are ignored; if a document has several
labels, the largest counts.
"""

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.batches import releasing
from shelfmark.llm.words import mix, run_hashes, text_slices

BUCKETS = 1 << 18
WINDOW = 10
GRAMS = (3, 4, 5, 6)
DIMENSIONS = 8
#: Most toxic and most clean texts of a training sample; of a clean one, most windows.
TOXIC_TEXTS, CLEAN_TEXTS = 1000, 4000
CLEAN_WINDOWS = 24
#: Longer texts are not trained on: their label says too little about any one window.
TRAIN_CHARS = 12_000
THRESHOLD = 0.3
TOXIC_WEIGHT = 3.0
EPOCHS = 14
#: Texts are cut to subwords in slices of about this many bytes; a byte has some hundred bytes of them.
SLICE_BYTES = 1 << 18


@lru_cache
def _letters() -> np.ndarray:
    """Byte -> folded byte; 0 for what parts words."""
    table = np.zeros(256, np.uint8)
    table[0x80:] = np.arange(0x80, 256)
    for c in range(ord("0"), ord("9") + 1):
        table[c] = c
    for c in range(ord("a"), ord("z") + 1):
        table[c] = table[c - 32] = c
    return table


@dataclass
class Subwords:
    """Buckets of the subwords of a slice, by word; words by text."""

    bucket: np.ndarray
    word: np.ndarray  # of each bucket
    text: np.ndarray  # of each word


def subwords(data: np.ndarray, offsets: np.ndarray) -> Subwords:
    # a border after each text, so that no word crosses it
    n_texts = len(offsets) - 1
    stream = np.zeros(len(data) + n_texts + 1, np.uint8)
    at = np.arange(len(data)) + 1 + np.repeat(np.arange(n_texts), np.diff(offsets))
    stream[at] = _letters()[data]
    capital = (stream[1:] >= 0x80) & (stream[1:] <= 0x9E) & (stream[:-1] == 0xC3)
    stream[1:][capital] += 0x20
    solid = stream > 0
    starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    stops = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Subwords(none, none, none)
    text = np.searchsorted(offsets[1:] + np.arange(1, n_texts + 1), starts - 1, "right")
    word = np.cumsum(np.bincount(starts, minlength=len(stream))) - 1
    values = stream.astype(np.uint64) + np.uint64(1)
    gaps = np.concatenate([[0], np.cumsum(~solid)])
    buckets = [run_hashes(values, starts - 1, np.minimum(stops + 1, len(stream))) % np.uint64(BUCKETS)]
    words = [np.arange(len(starts))]
    for n in GRAMS:
        first = np.flatnonzero(gaps[n - 1 : -1] == gaps[1 : len(gaps) - n + 1])  # letters inside
        buckets.append(run_hashes(values, first, first + n) % np.uint64(BUCKETS))
        words.append(word[first + 1])
    return Subwords(np.concatenate(buckets).astype(np.int64), np.concatenate(words), text)


def _windows(text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each word, and the text of each window; windows do not cross texts."""
    counts = np.bincount(text, minlength=n_texts)
    begin = np.cumsum(counts) - counts
    per_text = -(-counts // WINDOW)
    first = np.cumsum(per_text) - per_text
    return first[text] + (np.arange(len(text)) - begin[text]) // WINDOW, np.repeat(np.arange(n_texts), per_text)


def _window_logits(s: Subwords, table: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logit (without bias) of each window, the window of each word, the text of each window."""
    n_words = len(s.text)
    word = np.bincount(s.word, table[s.bucket], n_words) / np.bincount(s.word, minlength=n_words)
    window, text = _windows(s.text, n_texts)
    return np.bincount(window, word, len(text)) / np.bincount(window, minlength=len(text)), window, text


@dataclass
class Model:
    """table: per bucket, the difference of its two class logits; bias: the same of the softmax."""

    table: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n_texts = len(offsets) - 1
        s = subwords(data, offsets)
        out = np.zeros(n_texts)
        if not len(s.text) or self.bias == -np.inf:
            return out
        logits, _, text = _window_logits(s, self.table, n_texts)
        worst = np.full(n_texts, -np.inf)
        np.maximum.at(worst, text, logits)
        return 1 / (1 + np.exp(-(worst + self.bias)))


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The concatenated ``parts``, which are let go of."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Embeddings and softmax from texts and their 0/1 labels."""
    labels = np.asarray(labels)
    if not (labels == 1).any() or not (labels == 0).any():
        return Model(np.zeros(BUCKETS, np.float32), -np.inf)
    parts, text = ([], [], []), []
    for lo, hi, data, offsets in text_slices(pa.array(texts, pa.large_string()), SLICE_BYTES):
        s = subwords(data, offsets)
        if not len(s.text):
            continue
        window, of_text = _windows(s.text, hi - lo)
        # weight of each subword in its window's mean: mean over words of means over subwords
        of = window[s.word]
        weight = 1 / np.bincount(s.word)[s.word] / np.bincount(window)[of]
        every = np.bincount(of_text, minlength=hi - lo)
        rank = np.arange(len(of_text)) - np.repeat(np.cumsum(every) - every, every)
        step = np.maximum(1, -(-every // CLEAN_WINDOWS))[of_text]
        kept = (labels[lo:hi][of_text] == 1) | (rank % step == 0)
        order = np.argsort(of, kind="stable")
        order = order[kept[of[order]]]
        sizes = np.bincount(of, minlength=len(of_text))[kept]
        for part, values in zip(parts, (s.bucket[order].astype(np.int32), weight[order].astype(np.float32), sizes), strict=True):
            part.append(values)
        text.append(of_text[kept] + lo)
    if not text:
        return Model(np.zeros(BUCKETS, np.float32), -np.inf)
    bucket, weight, sizes = map(_joined, parts)
    text, bound = np.concatenate(text), np.concatenate([[0], np.cumsum(sizes)])
    n_windows = len(text)
    first = np.searchsorted(text, np.arange(len(texts)))  # text -> its first window
    last = np.searchsorted(text, np.arange(len(texts)), "right")

    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((BUCKETS, DIMENSIONS)) * 0.1).astype(np.float32)
    soft = (rng.standard_normal((DIMENSIONS, 2)) * 0.3).astype(np.float32)
    bias = np.zeros(2, np.float32)
    emb_g, soft_g, bias_g = np.full(BUCKETS, 1e-8, np.float32), np.full_like(soft, 1e-8), np.full_like(bias, 1e-8)
    has = last > first
    for epoch in range(EPOCHS):
        table = emb @ (soft[:, 1] - soft[:, 0])
        logits = np.zeros(n_windows, np.float32)
        for i in range(0, n_windows, 4096):  # in pieces, for memory
            j = min(i + 4096, n_windows)
            piece = slice(bound[i], bound[j])
            logits[i:j] = np.add.reduceat(table[bucket[piece]] * weight[piece], bound[i:j] - bound[i])
        by_score = np.lexsort((-logits, text))
        # a toxic text teaches by its worst window, a clean one by its worst few and by
        # random ones; at first, when nothing is known, all by random ones
        picked, target = [], []
        for i in np.flatnonzero(has):
            own = by_score[first[i] : last[i]]
            if epoch < 3:
                own = rng.choice(own, min(len(own), 6), replace=False)
            elif labels[i]:
                own = own[:1]
            else:
                own = np.concatenate([own[:3], rng.choice(own, 1)])
            picked.append(own)
            target.append(np.full(len(own), labels[i]))
        picked, target = np.concatenate(picked), np.concatenate(target)
        shuffled = rng.permutation(len(picked))
        for part in np.array_split(shuffled, max(1, len(shuffled) // 256)):
            rows, y = picked[part], target[part]
            sizes = bound[rows + 1] - bound[rows]
            inside = np.repeat(np.arange(len(rows)), sizes)
            at = np.repeat(bound[rows], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            b, w = bucket[at], weight[at]
            x = np.add.reduceat(emb[b] * w[:, None], np.cumsum(sizes) - sizes)
            z = x @ soft + bias
            z = np.exp(z - z.max(1, keepdims=True))
            p = z / z.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            g = p * (np.where(y == 1, TOXIC_WEIGHT, 1.0) / len(y))[:, None].astype(np.float32)
            g_soft, g_bias, g_x = x.T @ g, g.sum(0), g @ soft.T
            touched, where = np.unique(b, return_inverse=True)
            grad = np.zeros((len(touched), DIMENSIONS), np.float32)
            for d in range(DIMENSIONS):
                grad[:, d] = np.bincount(where, g_x[inside, d] * w, len(touched))
            emb_g[touched] += (grad * grad).mean(1)
            emb[touched] -= 0.3 * grad / np.sqrt(emb_g[touched])[:, None]
            soft_g += g_soft**2
            bias_g += g_bias**2
            soft -= 0.05 * g_soft / np.sqrt(soft_g)
            bias -= 0.05 * g_bias / np.sqrt(bias_g)
    return Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(id_col: str = "doc_id"):
    """The rows that no model may learn from."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of a bounded number of labelled documents of each class."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out()).withColumn("at", F.xxhash64("doc_id"))
    picked = None
    for toxic, most in ((0, CLEAN_TEXTS), (1, TOXIC_TEXTS)):
        part = known.filter(F.col("toxic") == toxic).orderBy("at", "doc_id").limit(most).drop("at")
        picked = part if picked is None else picked.unionByName(part)
    # a bounded number of rows of two numbers: safe to broadcast
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")


def _fit(batches):
    rows = [r for b in batches for r in b.to_pylist()]
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    model = train([r["text"] for r in rows], [r["toxic"] for r in rows])
    table = pa.array([model.table.tobytes()], pa.binary())
    yield pa.RecordBatch.from_arrays([table, pa.array([model.bias], pa.float64())], names=["table", "bias"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the bounded sample, trained in one task; only the model comes back."""
    rows = training_sample(docs, labels).filter(F.length("text") <= TRAIN_CHARS).repartition(1)
    found = rows.mapInArrow(releasing(_fit), "table binary, bias double").first()
    if found is None:  # no row, no task
        return train([], [])
    return Model(np.frombuffer(found["table"], np.float32), found["bias"])


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability that each text is toxic (replacing a column of that name)."""

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text)
            for lo, hi, data, offsets in text_slices(batch.column(i), SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                names = [n for n in part.schema.names if n != name]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(model.score(data, offsets))], names=[*names, name]
                )

    fields = [f for f in docs.schema if f.name != name]
    return docs.mapInArrow(releasing(run), T.StructType([*fields, T.StructField(name, T.DoubleType())]))
