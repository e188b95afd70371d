"""Text operators against brute force on a small corpus and on the smallest table."""

import collections
import hashlib
import re
import subprocess
import sys
import time
from itertools import islice, product
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import bpe, fingerprint, queries
from shelfmark.llm import near_dedup as N
from shelfmark.llm.near_dedup import near_duplicates, trees_for
from shelfmark.llm.substring_dedup import dedup_substrings
from shelfmark.session import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# ------------------------------------------------------------- substring dedup


def cut(rows, n):
    count = collections.Counter()
    for _, t in rows:
        w = words(t)
        count.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for i, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for x in range(len(w) - n + 1):
            if count[tuple(w[x : x + n])] > 1:
                keep[x : x + n] = [False] * n
        kept = " ".join(a for a, k in zip(w, keep, strict=True) if k)
        out.append((i, len(w), len(w) - sum(keep), sha(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [35, 12])
def test_repeated_windows_go(small, window):
    docs = small.filter("doc_id is null or doc_id <> 76")
    got = dedup_substrings(docs, window=window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == cut(rows_of(docs), window)


def test_repeats_inside_one_text(spark):
    docs = spark.createDataFrame([(1, "a b c " * 60), (2, " ".join(map(str, range(34))))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in dedup_substrings(docs).collect()}
    assert (got[1]["n_removed"], got[1]["kept_text"]) == (180, "")
    assert (got[2]["n_removed"], got[2]["kept_text"]) == (0, " ".join(map(str, range(34))))


def test_substring_columns(small, nothing):
    assert dedup_substrings(nothing).count() == 0
    clash = small.limit(5).withColumns({"key": F.lit(1), "row": F.lit(2), "n_words": F.lit(-1), "packed": F.lit(3)})
    out = dedup_substrings(clash)
    assert {"key", "row", "packed", "n_words", "kept_text"} <= set(out.columns)
    assert out.filter("n_words < 0 or key <> 1 or row <> 2 or packed <> 3").count() == 0


# ----------------------------------------------------------------- near dedup


def components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            b = sets[j]
            if (a and b and 100 * len(a & b) >= percent * len(a | b)) or (same_id and a and b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(
        ((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))),
        key=str,
    )


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(small, n):
    got = near_duplicates(small, shingle=n).collect()
    assert sorted(map(tuple, got), key=str) == components(rows_of(small), n, 80)


def test_near_duplicates_of_rows_with_one_id(spark):
    """One id with two texts links the copies of both; other rows of an id stay what they are."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("b")), (2, text("a") + " more"), (3, text("b") + " more"), (9, text("c"))]
    rows += [(None, text("d")), (None, text("d") + " x"), (8, text("d")), (7, ""), (7, text("e")), (5, text("e") + " y")]
    rows += [(4, text("f")), (4, text("f")), (6, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = components([(i, t or "") for i, t in rows], 2, 80)
    assert sorted(map(tuple, got), key=str) == want
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}


def test_names_of_sets_are_made_unique(spark, monkeypatch):
    """If two sets share a name, all are named anew."""
    seeds, real = [], N._differing

    def differing(rows, name):
        seeds.append(name)
        return real(rows, name) if name != "own" or seeds.count("own") > 2 else rows.select(name).limit(1)

    monkeypatch.setattr(N, "_differing", differing)
    rows = [(1, "a b c d"), (2, "A b c d"), (3, "x y z")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3} and seeds.count("own") == 3


def test_near_duplicates_of_a_large_family(spark):
    """Copies that resemble the original but hardly one another, past the exhaustive size."""
    rnd = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 700):
        own = list(base)
        for k in rnd.choice(200, 8, replace=False):
            own[k] = f"x{i}_{k}"
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(f"z{i}_{k}" for k in range(40))) for i in range(700, 720)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found if r["doc_id"] < 700} == {0}
    assert all(r["component_id"] == r["doc_id"] for r in found if r["doc_id"] >= 700)


def test_pairs_of_a_family_of_half_copies_are_not_listed(spark, monkeypatch):
    """Texts that resemble one another, but hardly enough: rows grow with the texts, and no link is lost."""
    rnd = np.random.default_rng(5)
    base = [f"w{i}" for i in range(201)]
    rows = []
    for i in range(80):
        own = list(base)
        for k in rnd.choice(201, 7, replace=False):
            own[k] = f"x{i}_{k}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, rows[i][1].replace("w20 ", "y ").replace("w90 ", "z ")) for i in (3, 40, 77)]
    listed, links = [], N._Checker.links

    def counted(self, pairs, *more):
        listed.append(pairs.distinct().count())
        return links(self, pairs, *more)

    monkeypatch.setattr(N._Checker, "links", counted)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=str) == components(rows, 2, 80)
    assert sum(listed) < 10 * len(rows)


def test_blocks_of_a_path_meet(spark):
    """Every minor node meets every member once, whatever the number of blocks."""
    rows = spark.range(50).selectExpr("1L AS path", "id AS node", "id % 5 = 0 AS is_minor", "true AS is_member")
    dealt = N._dealt(rows, "path", F.lit(4), F.lit(3)).select("group", "minor", "node").collect()
    met = collections.Counter()
    for x, y in product((r for r in dealt if r["minor"]), (r for r in dealt if not r["minor"])):
        if x["group"] == y["group"]:
            met[x["node"], y["node"]] += 1
    assert met == {(x, y): 1 for x in range(0, 50, 5) for y in range(50)}


def test_whole_groups_over_batches():
    group = [1] * 5 + [2] + [3] * 7 + [4, 5] + [6] * 3
    batches = [pa.RecordBatch.from_arrays([pa.array(group[i : i + 2], pa.int64())], ["group"]) for i in range(0, len(group), 2)]
    got = []
    for table, begin in N._whole_groups(iter(batches)):
        own = table.column("group").to_pylist()
        assert list(begin) == [*(i for i in range(len(own)) if not i or own[i] != own[i - 1]), len(own)]
        assert not got or got[-1] != own[0]
        got += own
    assert got == group


def test_near_duplicates_of_nothing(nothing):
    assert near_duplicates(nothing).count() == 0


def test_recall_of_the_trees():
    assert trees_for(0.8, 0.9) == 1 and trees_for(0.8, 0.999) == 3


# ------------------------------------------------------------------------ bpe

TRICKY = [
    "", " ", "a<|endoftext|>b", "<|endoftext|>", "  <|endoftext|>  x", "   x", "x\x1cy\x1f z", "日本語 テスト ½ ² Ⅷ ٣",
    "é́ 😀👨‍", "don't DON'T 'S we'll", "\ta\r\n\n  b   ", "a" * 3000, "\x00\x01", "﻿hi",
    "1٣a²", "_a_b", "\x85x", "　 x y",
]


def test_bpe_equals_the_library(spark, small, sf_dir):
    path = queries.vocabulary_path()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = TRICKY + [t for _, t in rows_of(small) if len(t) < 5000] + [t for _, t in rows_of(table)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = bpe.decode(bpe.encode(docs, path), path).collect()
    assert len(out) == len(texts)
    for r in out:
        want = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == want, texts[r["doc_id"]][:60]
        assert r["decoded"] == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_edges(spark, nothing):
    path = queries.vocabulary_path()
    assert bpe.encode(nothing, path).count() == 0
    docs = spark.createDataFrame([(1, None, "x", 7)], "doc_id long, text string, ids string, decoded int")
    row = bpe.decode(bpe.encode(docs, path), path).first()
    assert (row["doc_id"], row["text"], row["ids"], row["decoded"]) == (1, None, [], "")
    cut_char = bpe.vocabulary(path).encode("é😀")
    assert bpe.vocabulary(path).decode(cut_char[-1:]) == "�"
    tiny = bpe.Vocabulary(path, max_pieces=2)
    assert [tiny.encode("a b c d a").tolist() for _ in range(2)] == [bpe.vocabulary(path).encode("a b c d a").tolist()] * 2


def test_bpe_memory_is_bounded():
    vocab = bpe.Vocabulary(queries.vocabulary_path(), max_pieces=100)
    want = bpe.vocabulary(queries.vocabulary_path())
    for i in range(1000):
        text = f"often w{i}x{i * i} {'z' * i}"
        assert vocab.encode(text).tolist() == want.encode(text).tolist()
    kept = {**vocab, **vocab.older}
    assert len(vocab) <= 100 and len(kept) <= 200 and max(map(len, kept)) <= bpe.KEPT_CHARS
    assert "often" in kept  # pieces in use stay
    assert 2 * bpe.MAX_PIECES <= 100_000


def test_bpe_keeps_pieces_met_again():
    """Pieces met once do not push out those met again, so these are merged once."""
    vocab = bpe.Vocabulary(queries.vocabulary_path(), max_pieces=100)
    merged = []
    merge = vocab.merge
    vocab.merge = lambda piece: merged.append(piece) or merge(piece)
    names = (" " + "".join(n) for n in product("abcdefghijklmnopqrstu", repeat=3))
    often = "".join(islice(names, 40))
    for _ in range(30):
        vocab.encode(often + often)
        vocab.encode("".join(islice(names, 250)))
        assert max(len(vocab), len(vocab.older)) <= 100
    assert len(merged) == 40 + 30 * 250


# --------------------------------------------------------------- fingerprints


def shingles(text, n=fingerprint.SHINGLE):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def test_fingerprints(spark, sf_dir):
    rows = sorted(rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet")), reverse=True)
    got = {r["doc_id"]: r for r in queries.op9_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    off = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        third = len(t) // 3
        edited = t[: len(t) - third] + u[:third]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited))
        for other, near in ((edited, r["near_edited"]), (u, r["near_next"])):
            a, b = shingles(t), shingles(other)
            off.append(near - len(a & b) / max(len(a | b), 1))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.06


def test_fingerprint_edges(spark, small, nothing):
    assert fingerprint.add_fingerprint(nothing, "text", "f").count() == 0
    got = fingerprint.add_fingerprint(small, "text", "f").collect()
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r["text"]].add(r["f"])
    assert all(len(v) == 1 for v in by_text.values())
    assert by_text[None] == by_text[""] == by_text[" \n\t"] == {""}
    pair = spark.createDataFrame([("", ""), ("", "ab"), ("ab", "ab")], "a string, b string")
    assert [r[0] for r in pair.select(fingerprint.likeness(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1.0]


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_next_row(spark, small, parts):
    docs = small.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = fingerprint.with_next(docs, "doc_id", ["text"], parts).collect()
    order = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = [(*a, b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True)]
    assert sorted(((r["doc_id"], r["text"], r["next"]["text"]) for r in got), key=str) == sorted(want, key=str)
    one = docs.filter("doc_id = 1")
    assert fingerprint.with_next(one, "doc_id", ["text"], parts).first()["next"]["text"] == one.first()["text"]
    assert fingerprint.with_next(docs.limit(0), "doc_id", ["text"], parts).count() == 0


def test_bpe_texts_survive_slices():
    """A word never crosses a text, wherever batches are cut."""
    from shelfmark.llm import words as w

    column = pa.array(["ab", "", None, "c d"])
    (lo, hi, data, offsets), *rest = w.text_slices(column)
    starts, stops, firsts = w.word_spans(data, offsets)
    assert (lo, hi, rest, (stops - starts).tolist(), firsts.tolist()) == (0, 4, [], [2, 1, 1], [0, 1, 1, 1, 3])


# --------------------------------------------------------------------- memory

RESIDENT = """
import pyarrow as pa
from shelfmark.llm import batches, near_dedup

def texts():
    for i in range(2):
        rows = [" ".join(str(i * 7919 + j * k) for j in range(500)) for k in range(4000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array(rows)], names=["own", "text"])

def resident(run):
    for out in run(texts()):
        pass
    del out
    return int(open("/proc/self/statm").read().split()[1]) * 4096

print(resident(near_dedup._pack), resident(batches.releasing(near_dedup._pack)))
"""


def test_shuffles_of_written_tables_are_removed(spark):
    """A written table needs its shuffle files no more; they do not wait for the driver's garbage collection."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    before, was = shuffles(), spark.conf.get(setting)
    found = materialize(spark.range(1000).repartition(3, "id").groupBy("id").count().orderBy("id"), "numbers")
    assert found.count() == 1000
    assert spark.conf.get(setting) == was
    for _ in range(100):
        spark.range(1).collect()
        if not {f for f in shuffles() - before if f.endswith(".data")}:
            break
        time.sleep(0.1)
    # the count above has a shuffle of its own, of one row per task
    assert sum(Path(f).stat().st_size for f in shuffles() - before if Path(f).exists()) < 2000


def test_workers_give_memory_back():
    """After a task, a worker keeps much less than its allocators would."""
    out = subprocess.run([sys.executable, "-c", RESIDENT], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    kept, released = map(int, out.stdout.split())
    assert released < kept - 10_000_000
