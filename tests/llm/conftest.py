import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def small(spark):
    """A corpus with copies, near copies, shared passages, nulls, empty and long texts, ties."""
    rnd = random.Random(4)
    vocab = [f"{a}{b}" for a in ("ba", "de", "ki", "lo", "mu", "ÑO", "pé") for b in ("ra", "st", "nu", "x,", "!!")]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage = text(60)
    rows = []
    for i in range(40):
        rows.append([i, text(rnd.choice([1, 3, 30, 80, 200]))])
    base = text(120).split()
    for i in range(40, 60):  # near copies of one text
        words = list(base)
        for _ in range(rnd.choice([0, 1, 2, 4, 9])):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        rows.append([i, " ".join(words)])
    for i in range(60, 70):  # a passage that many share
        rows.append([i, f"{text(20)}\n{passage}\t{text(25)}"])
    rows += [[70, None], [71, ""], [72, " \n\t"], [73, rows[3][1]], [74, rows[3][1].upper()]]
    rows += [[75, passage + " " + passage], [76, "one two " * 30_000], [None, passage], [5, rows[5][1]], [77, "one"]]
    langs = ["en", "fr", None]
    full = [(i, t, langs[n % 3], f"s{n % 4}" if n % 7 else None, len(t or "")) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
