"""String similarity (0-100) of a query against the fields of its candidates.

The score of a pair is the better of two longest-common-subsequence ratios:

* token sort: both strings with their words sorted, ``200 * lcs / (m + n)``;
* partial: the shorter string against every window of its own length in the
  longer one, windows cut off at either end included. Equal lengths are tried
  both ways round.

Only the pair scorer runs in Python, over whole Arrow batches: the bit-parallel
LCS recurrence (Hyyro, 2004) advances all windows of all pairs of a batch at
once in numpy. Everything around it (lower-casing, field lists, maxima, weights)
is Spark expressions. Strings may have any length. Where the shorter one needs more than one
64-bit word, all windows come from one sweep instead (semi-local LCS by combing, Tiskin), whose
work grows with the product of both lengths.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from shelfmark import constants as K
from shelfmark.functions import text as X

# Windows advanced together; bounds the working set of one step.
_CHUNK_WORDS = 1 << 20


def _sorted_words(s: str) -> str:
    return " ".join(sorted(s.split()))


def _match_words(short: str, long: str, words: int) -> bytes:
    """For each character of ``long``, the positions of it in ``short`` as bits."""
    masks = {}
    for i, ch in enumerate(short):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    packed = {ch: m.to_bytes(8 * words, "little") for ch, m in masks.items()}
    none = bytes(8 * words)
    return b"".join([packed.get(ch, none) for ch in long])


def _lcs_lengths(masks: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """LCS of each window ``masks[start : start + length]`` with its short string."""
    words = masks.shape[1]
    out = np.empty(len(start), dtype=np.int64)
    step = max(1, _CHUNK_WORDS // words)
    order = np.argsort(-length, kind="stable")
    for lo in range(0, len(order), step):
        rows = order[lo : lo + step]
        begin, size = start[rows], length[rows]
        v = np.full((len(rows), words), ~np.uint64(0))
        for t in range(int(size[0])):
            active = int(np.searchsorted(-size, -t, side="left"))
            head = v[:active]
            u = head & masks[begin[:active] + t]
            rest = head - u
            if words == 1:
                total = head + u
            else:
                total = np.empty_like(head)
                carry = np.zeros(active, dtype=np.uint64)
                for w in range(words):
                    part = head[:, w] + u[:, w]
                    over = part < u[:, w]
                    total[:, w] = part + carry
                    carry = (over | (total[:, w] < carry)).astype(np.uint64)
            v[:active] = total | rest
        out[rows] = 64 * words - np.bitwise_count(v).sum(axis=1, dtype=np.int64)
    return out


def _code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")


def window_lcs(short: str, long: str) -> tuple[np.ndarray, np.ndarray]:
    """LCS of ``short`` with each window of its length in ``long``, and the lengths of the windows.

    Windows begin at 1 - m to n - 1 and are cut off at either end of ``long``. Strands enter the
    grid of both strings from the left and the top; two that meet at a cell swap at a match, or
    if they have met before. A strand from top s to bottom e is a character that the windows
    holding both s and e do without. The cells of an anti-diagonal do not depend on one another.
    """
    m, n = len(short), len(long)
    rows, columns = _code_points(short)[::-1], _code_points(long)
    left, top = np.arange(m, dtype=np.int32), np.arange(m, m + n, dtype=np.int32)
    for d in range(m + n - 1):
        low, high = max(0, d - n + 1), min(m - 1, d)  # rows of the diagonal
        a, b = slice(m - 1 - high, m - low), slice(d - high, d - low + 1)
        h, v = left[a], top[b]
        swap = (rows[a] == columns[b]) | (h > v)
        left[a], top[b] = np.where(swap, v, h), np.where(swap, h, v)
    first = np.arange(1 - m, n)
    length = np.minimum(first + m, n) - np.maximum(first, 0)
    end = np.flatnonzero(top >= m)
    begin = top[end] - m
    # a strand counts for windows that begin after end - m and not after its begin, if there are any
    end, begin = end[end < begin + m], begin[end < begin + m]
    step = np.bincount(end, minlength=m + n) - np.bincount(begin + m, minlength=m + n)
    return length - np.cumsum(step)[: m + n - 1], length


class _Windows:
    """Collects LCS tasks for pairs whose masks have the same number of words."""

    def __init__(self, words: int):
        self.words = words
        self.masks, self.base = [], 0
        self.start, self.length, self.norm, self.pair = [], [], [], []

    def add(self, pair: int, short: str, long: str, sliding: bool):
        m, n = len(short), len(long)
        self.masks.append(_match_words(short, long, self.words))
        if sliding:
            first = np.arange(1 - m, n)
            lo, hi = np.maximum(first, 0), np.minimum(first + m, n)
        else:
            lo, hi = np.array([0]), np.array([n])
        self.start.append(self.base + lo)
        self.length.append(hi - lo)
        self.norm.append(m + hi - lo)
        self.pair.append(np.full(len(lo), pair))
        self.base += n

    def score_into(self, best: np.ndarray):
        masks = np.frombuffer(b"".join(self.masks), dtype="<u8").reshape(-1, self.words)
        lcs = _lcs_lengths(masks, np.concatenate(self.start), np.concatenate(self.length))
        ratio = 200.0 * lcs / np.concatenate(self.norm)
        np.maximum.at(best, np.concatenate(self.pair), ratio)


def pair_scores(pairs, token_sort: bool = True, partial: bool = True) -> np.ndarray:
    """Best ratio of every ``(a, b)`` pair; 0 where either string is empty."""
    best = np.zeros(len(pairs))
    groups: dict[int, _Windows] = {}

    def add(i, a, b, sliding):
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        words = (len(short) + 63) // 64
        if words > 1 and sliding:
            lcs, length = window_lcs(short, long)
            best[i] = max(best[i], (200.0 * lcs / (len(short) + length)).max())
        elif words:
            groups.setdefault(words, _Windows(words)).add(i, short, long, sliding)

    for i, (a, b) in enumerate(pairs):
        if not a or not b:
            continue
        if a == b or (partial and (a in b or b in a)):
            best[i] = 100.0  # an exact window cannot be beaten
            continue
        if token_sort:
            add(i, _sorted_words(a), _sorted_words(b), False)
        if partial:
            add(i, a, b, True)
            if len(a) == len(b):
                add(i, b, a, True)
    for windows in groups.values():
        windows.score_into(best)
    return best


def _score_lists(query: pd.Series, texts: pd.Series, **ratios) -> pd.Series:
    """Score each row's texts; every distinct pair of the batch is scored once."""
    position: dict[tuple, int] = {}
    rows = [
        [position.setdefault((q or "", t or ""), len(position)) for t in ts]
        for q, ts in zip(query, texts)
    ]
    best = pair_scores(list(position), **ratios)
    return pd.Series([best[r] if r else np.empty(0) for r in rows])


@F.pandas_udf(ArrayType(DoubleType()))
def field_similarities(query: pd.Series, texts: pd.Series) -> pd.Series:
    return _score_lists(query, texts)


@F.pandas_udf(ArrayType(DoubleType()))
def token_sort_ratios(query: pd.Series, texts: pd.Series) -> pd.Series:
    return _score_lists(query, texts, partial=False)


@F.pandas_udf(ArrayType(DoubleType()))
def partial_ratios(query: pd.Series, texts: pd.Series) -> pd.Series:
    return _score_lists(query, texts, token_sort=False)


def _pair(udf, a, b) -> Column:
    return udf(F.lower(a), F.array(F.lower(b)))[0]


def token_sort_ratio(a, b) -> Column:
    return _pair(token_sort_ratios, F.col(a), F.col(b))


def partial_ratio(a, b) -> Column:
    return _pair(partial_ratios, F.col(a), F.col(b))


def similarity(a, b) -> Column:
    return _pair(field_similarities, F.col(a), F.col(b))


def with_field_scores(
    df,
    query="input_string",
    product_name="product_name",
    brands="brands",
    categories="categories",
    categories_tags="categories_tags",
    labels="labels",
    quantity="quantity",
):
    """Add the five field scores and their weighted total to every candidate row.

    One call to the pair scorer per row covers all fields; the lists are cut
    apart again with ``slice``. ``categories`` and ``labels`` are arrays.
    """
    lists = {
        "_names": F.transform(X.product_names(product_name), F.lower),
        "_categories": F.transform(X.non_blank(categories), F.lower),
        "_tags": F.coalesce(
            F.transform(
                F.filter(F.col(categories_tags), X.is_set), lambda t: F.lower(X.clean_tag(t))
            ),
            F.array().cast("array<string>"),
        ),
        "_labels": F.transform(X.non_blank(labels), F.lower),
    }
    df = df.withColumns(lists)
    singles = F.array(
        *[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in (brands, quantity)]
    )
    df = df.withColumn(
        "_sims", field_similarities(F.lower(F.col(query)), F.concat(singles, *map(F.col, lists)))
    )

    offset, parts = F.lit(3), {}
    for name in lists:
        parts[name] = F.slice("_sims", offset, F.size(name))
        offset = offset + F.size(name)

    def best(values):
        return F.coalesce(F.array_max(values), F.lit(0.0))

    weighted = F.transform(
        parts["_categories"], lambda s, i: s * (F.lit(1.0) + i * F.lit(K.SPECIFICITY_STEP))
    )
    scores = {
        "names_score": best(parts["_names"]),
        "brands_score": F.col("_sims")[0],
        "categories_score": F.least(
            best(F.concat(weighted, parts["_tags"])), F.lit(K.MAX_FIELD_SCORE)
        ),
        "labels_score": best(parts["_labels"]),
        "quantity_score": F.col("_sims")[1],
    }
    total = None
    for field, weight in K.FIELD_WEIGHTS.items():
        part = F.col(f"{field}_score") * F.lit(weight)
        total = part if total is None else total + part
    return (
        df.withColumns(scores).withColumn("rapidfuzz_score", total).drop("_sims", *lists)
    )
