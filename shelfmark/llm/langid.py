"""Language identification by a byte convolutional network, in numpy.

Texts are cut into windows of ``WINDOW`` bytes. Bytes are embedded, filters of several
widths slide over the window, each keeps its largest response (ReLU and max
pooling), and a softmax over these gives the window's language. A text's language has
the largest mean log probability over all its windows, each weighted by the share
of it that the text fills.

Training fits the network by Adam on windows of a bounded sample: at most ``PER_LANG``
labelled documents of each language, the first by a hash of the id, and at most
``TRAIN_WINDOWS`` windows of each document. Prediction covers whole texts. A filter
response is a sum of per-byte terms, so prediction looks pairs of bytes up in tables made
from the trained weights.

Definitions: a null text or one without any letter is ``und`` with score 0; so is every
text if no labels were learned. Null languages are not learned.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.toxicity import held_out
from shelfmark.llm.words import text_slices

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
PER_LANG = 1000
TRAIN_WINDOWS = 4
EPOCHS = 6
UNKNOWN = "und"
#: Windows predicted at a time.
BATCH = 2048


def cut_windows(data: np.ndarray, offsets: np.ndarray):
    """(windows, text of each window, bytes of the text in it); the rest of a window is 0."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    first = np.cumsum(counts) - counts
    start = offsets[text] + (np.arange(len(text)) - first[text]) * WINDOW
    filled = np.minimum(offsets[text + 1] - start, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    out = padded[np.minimum(at, len(padded) - 1)]
    out[np.arange(WINDOW) >= filled[:, None]] = 0
    return out, text, filled


@dataclass
class Network:
    langs: list[str]
    emb: np.ndarray  # (256, EMBEDDING)
    filters: list[np.ndarray]  # of each width, (width * EMBEDDING, FILTERS)
    shift: list[np.ndarray]  # of each width, (FILTERS,)
    soft: np.ndarray  # (len(WIDTHS) * FILTERS, languages)
    bias: np.ndarray

    def tables(self):
        """Responses of all filters to a byte pair, and to the pair two bytes on."""
        steps = [
            [self.emb @ w[j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(n)]
            for n, w in zip(WIDTHS, self.filters, strict=True)
        ]
        zero = np.zeros((256, FILTERS), np.float32)
        near, far = [], []
        for s, b in zip(steps, self.shift, strict=True):
            s = s + [zero] * (4 - len(s))
            near.append((s[0][:, None] + s[1][None] + b).reshape(-1, FILTERS))
            far.append((s[2][:, None] + s[3][None]).reshape(-1, FILTERS))
        # the narrowest filters do not look further than a pair
        return np.hstack(near).astype(np.float32), np.hstack(far[1:]).astype(np.float32)

    def log_probs(self, windows: np.ndarray, tables) -> np.ndarray:
        near, far = tables
        pair = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        response = near[pair[:, :-2]]
        response[:, :, FILTERS:] += far[pair[:, 2:]]
        z = np.maximum(response.max(1), 0) @ self.soft + self.bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def predict(self, data: np.ndarray, offsets: np.ndarray, tables):
        """Index of the language of each text and its probability by the mean over windows."""
        n = len(offsets) - 1
        windows, text, filled = cut_windows(data, offsets)
        total = np.zeros((n, len(self.langs)))
        for i in range(0, len(windows), BATCH):
            logs = self.log_probs(windows[i : i + BATCH], tables) * filled[i : i + BATCH, None]
            np.add.at(total, text[i : i + BATCH], logs)
        mean = total / np.maximum(np.diff(offsets), 1)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def train(texts: list[str], langs: list[str], seed: int = 5) -> Network | None:
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    codes = np.array([names.index(x) for x in langs])
    for lo, _, data, offsets in text_slices(pa.array(texts, pa.large_string())):
        windows, text, filled = cut_windows(data, offsets)
        order = rng.permutation(len(windows))
        rank = np.zeros(len(offsets), int)
        keep = []
        for i in order:
            if filled[i] >= 16 and rank[text[i]] < TRAIN_WINDOWS:
                rank[text[i]] += 1
                keep.append(i)
        xs.append(windows[keep])
        ys.append(codes[lo + text[keep]])
    x, y = np.concatenate(xs), np.concatenate(ys)
    scale = lambda *s: (rng.standard_normal(s) * (2 / s[0]) ** 0.5).astype(np.float32)
    net = Network(
        names,
        (rng.standard_normal((256, EMBEDDING)) * 0.5).astype(np.float32),
        [scale(n * EMBEDDING, FILTERS) for n in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        scale(len(WIDTHS) * FILTERS, len(names)),
        np.zeros(len(names), np.float32),
    )
    if not len(x):
        return net
    params = [net.emb, *net.filters, *net.shift, net.soft, net.bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = (len(y) / np.maximum(np.bincount(y, minlength=len(names)), 1) / len(names))[y].astype(np.float32)
    step = 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            step += 1
            b, t = x[part], y[part]
            e = net.emb[b]
            pooled, best, patches = [], [], []
            for n, w, s in zip(WIDTHS, net.filters, net.shift, strict=True):
                view = np.concatenate([e[:, j : WINDOW - n + 1 + j] for j in range(n)], axis=2)
                r = view @ w + s
                at = r.argmax(1)
                best.append(at)
                pooled.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
                patches.append(view)
            h = np.concatenate(pooled, axis=1)
            a = np.maximum(h, 0)
            z = a @ net.soft + net.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(t)), t] -= 1
            p *= weight[part][:, None] / len(t)
            g_h = (p @ net.soft.T) * (h > 0)
            g_emb = np.zeros_like(net.emb)
            g_filters, g_shift = [], []
            rows = np.arange(len(t))[:, None]
            for k, (n, w) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                g = g_h[:, k * FILTERS : (k + 1) * FILTERS]
                patch = patches[k][rows, best[k]]  # (texts, FILTERS, n * EMBEDDING)
                g_filters.append(np.einsum("if,ifk->kf", g, patch))
                g_shift.append(g.sum(0))
                back = g[:, :, None] * w.T[None]
                for j in range(n):
                    np.add.at(g_emb, b[rows, best[k] + j], back[:, :, j * EMBEDDING : (j + 1) * EMBEDDING])
            for i, grad in enumerate([g_emb, *g_filters, *g_shift, a.T @ p, p.sum(0)]):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                params[i] -= 0.004 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-7)
    return net


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Network | None:
    """A network from the bounded sample, trained on the driver."""
    known = docs.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_lang)
    # at most per_lang short rows of each language: safe to broadcast
    picked = picked.select("doc_id", F.col("lang").alias("known_lang"))
    rows = (
        docs.select("doc_id", "text", "lang")
        .join(F.broadcast(picked), "doc_id")
        .filter("lang = known_lang")
        .select("doc_id", "lang", F.substring("text", 1, 1 << 16).alias("text"))  # of a training text
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (columns of those names are replaced)."""
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if net is None:
        return docs.select(*others, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        tables = net.tables()
        names = np.array(net.langs, dtype=object)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(text)):
                part = batch.slice(lo, hi - lo)
                code, p = net.predict(data, offsets, tables)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in others), pa.array(names[code], pa.string()), pa.array(p)],
                    names=[*others, "lang_pred", "score"],
                )

    fields = [docs.schema[c] for c in others]
    schema = T.StructType(fields).add("lang_pred", "string").add("score", "double")
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.select(*others).mapInArrow(run, schema).withColumns(
        {
            "lang_pred": F.when(letters, F.col("lang_pred")).otherwise(UNKNOWN),
            "score": F.when(letters, F.col("score")).otherwise(0.0),
        }
    )
