"""The vectorised pair scorer against a plain dynamic-programming definition."""

import random
import time

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import similarity as S
from shelfmark.schemas import NAMES


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(row[j], row[j - 1], last + 1 if x == y else 0)
    return row[-1]


def ratio(a, b):
    return 200.0 * lcs(a, b) / (len(a) + len(b))


def token_sort(a, b):
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial(a, b):
    short, long = sorted((a, b), key=len)
    m = len(short)

    def windows(s, t):
        return max(ratio(s, t[max(i, 0) : i + m]) for i in range(1 - m, len(t)))

    best = windows(short, long)
    return max(best, windows(long, short)) if len(a) == len(b) else best


def random_pairs(n, longest, alphabet="abc d", seed=7):
    rng = random.Random(seed)

    def word():
        return "x" + "".join(rng.choice(alphabet) for _ in range(rng.randrange(longest)))

    return [(word(), word()) for _ in range(n)]


@pytest.mark.parametrize("n,longest", [(300, 12), (60, 80), (10, 200)])
def test_pair_scores_equal_definition(n, longest):
    pairs = random_pairs(n, longest)
    assert list(S.pair_scores(pairs, partial=False)) == [token_sort(a, b) for a, b in pairs]
    assert list(S.pair_scores(pairs, token_sort=False)) == [partial(a, b) for a, b in pairs]
    both = [max(token_sort(a, b), partial(a, b)) for a, b in pairs]
    assert list(S.pair_scores(pairs)) == both


def test_lengths_around_word_size():
    for m in (63, 64, 65, 127, 128, 129):
        a = ("ab" * m)[:m]
        pairs = [(a, "z" + a[::-1] + "b"), (a, a[1:] + "q")]
        assert list(S.pair_scores(pairs, token_sort=False)) == [partial(*p) for p in pairs]


def test_window_lcs_is_the_lcs_of_every_window():
    rnd = random.Random(8)
    for _ in range(300):
        m = rnd.randrange(1, 9)
        a = "".join(rnd.choice("abcż") for _ in range(m))
        b = "".join(rnd.choice("abcdż") for _ in range(rnd.randrange(m, 15)))
        got, length = S.window_lcs(a, b)
        windows = [b[max(f, 0) : f + m] for f in range(1 - m, len(b))]
        assert got.tolist() == [lcs(a, w) for w in windows] and length.tolist() == list(map(len, windows))


def test_long_strings_take_one_sweep():
    rnd = random.Random(9)
    a, b = ("".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in (150, 180))
    for x, y in ((a, b), (b, a), (a, b[:150]), (a, "z" * 90)):
        assert abs(S.pair_scores([(x, y)], token_sort=False)[0] - partial(x, y)) < 1e-9
    start = time.perf_counter()
    S.pair_scores([(a * 13, b * 11)], token_sort=False)
    assert time.perf_counter() - start < 5  # 1,950 characters; seconds only on a machine that is very busy


def test_chunks_do_not_change_results(monkeypatch):
    pairs = random_pairs(40, 90, seed=3)
    whole = list(S.pair_scores(pairs))
    monkeypatch.setattr(S, "_CHUNK_WORDS", 7)
    assert list(S.pair_scores(pairs)) == whole


def test_empty_strings_score_zero():
    assert list(S.pair_scores([("", "a"), ("a", ""), ("", ""), ("a", "  ")])) == [0.0] * 4


DOCUMENT = {
    "product_name": [
        {"lang": "it", "text": "Farina di ceci"},
        {"lang": "main", "text": "Mąka z ciecierzycy"},
        {"lang": "en", "text": None},
    ],
    "brands": "Młyn Nad Wartą",
    "categories": ["Produkty suche", "", "Mąki", "Mąki bezglutenowe"],
    "categories_tags": [None, "en:legume-flours"],
    "labels": [None, "Wegańskie"],
    "quantity": "2 x 0.5 kg",
}
FIELDS = (
    f"product_name {NAMES.simpleString()}, brands string, categories array<string>,"
    " categories_tags array<string>, labels array<string>, quantity string"
)


def field_scores(spark, queries, document=DOCUMENT):
    rows = [(q, *[document.get(k) for k in DOCUMENT]) for q in queries]
    df = spark.createDataFrame(rows, f"input_string string, {FIELDS}")
    return {r["input_string"]: r.asDict() for r in S.with_field_scores(df).collect()}


def similar(a, b):
    a, b = a.lower(), b.lower()
    return max(token_sort(a, b), partial(a, b))


def expected_scores(query):
    """The five scores by the definition, from the plain ratios."""
    categories = [c for c in DOCUMENT["categories"] if c.strip()]
    weighted = [similar(query, c) * (1 + 0.1 * i) for i, c in enumerate(categories)]
    tags = [similar(query, t[3:].replace("-", " ")) for t in DOCUMENT["categories_tags"] if t]
    return {
        "names_score": max(similar(query, n["text"]) for n in DOCUMENT["product_name"] if n["text"]),
        "brands_score": similar(query, DOCUMENT["brands"]),
        "categories_score": min(100, max(weighted + tags)),
        "labels_score": max(similar(query, x) for x in DOCUMENT["labels"] if x),
        "quantity_score": similar(query, DOCUMENT["quantity"]),
    }


def test_field_scores(spark):
    queries = ["ceci farina", "nad wartą młyn", "mąki", "legume flours", "wegan", "0.5kg", "qx"]
    got = field_scores(spark, queries)
    for query in queries:
        want = expected_scores(query)
        for field, value in want.items():
            assert abs(got[query][field] - value) < 1e-9, (query, field)
        weights = dict(zip(want, (3.0, 2.0, 1.5, 1.0, 0.5), strict=True))
        total = sum(want[f] * w for f, w in weights.items())
        assert abs(got[query]["rapidfuzz_score"] - total) < 1e-9


def test_specificity_counts_non_blank_categories(spark):
    got = field_scores(spark, ["kre"], {"categories": ["qqq", " ", "kxxx", "", "krxx"]})["kre"]
    sim = {c: max(token_sort("kre", c), partial("kre", c)) for c in ("qqq", "kxxx", "krxx")}
    assert got["categories_score"] == max(
        sim["qqq"] * 1.0, sim["kxxx"] * (1.0 + 0.1), sim["krxx"] * (1.0 + 2 * 0.1)
    )


def test_missing_fields_score_zero(spark):
    got = field_scores(spark, ["ceci"], {})["ceci"]
    assert got["rapidfuzz_score"] == 0.0
    only_label = {"labels": ["ceci secchi"]}
    assert field_scores(spark, ["ceci"], only_label)["ceci"]["rapidfuzz_score"] == 100.0


def test_scorer_is_called_once_per_row(spark):
    df = spark.createDataFrame([("q", *DOCUMENT.values())], f"input_string string, {FIELDS}")
    plan = S.with_field_scores(df).filter(F.col("rapidfuzz_score") > 0)
    assert plan._jdf.queryExecution().executedPlan().toString().count("pythonUDF0") >= 1
    assert "pythonUDF1" not in plan._jdf.queryExecution().executedPlan().toString()
