"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from shelfmark.llm import conversation_repair as C
from shelfmark.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * (kind != 0) + [(turn, role, text)] * (kind == 3)
    return out


def _plain(rows):
    """What the contract says for the damaged rows of one conversation, by trying all edits."""
    seen, faults, initials = set(), [], [r[:1] or " " for _, r, _ in rows]
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append((fault, bare[-1:] not in (".", "!", "?")))

    @cache
    def best(i, last):
        """(cost, audit, output) of the rest; output as (row or None, initial)."""
        options = []
        if last in ("", "a") and i == len(rows):
            options.append((0, "", ()))
        follow = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        # two inserts in a row at most are of use
        for n in (1, 2):
            end = follow if n == 1 else {"u": "a", "a": "u"}[follow]
            put = ((None, follow),) if n == 1 else ((None, follow), (None, end))
            if i == len(rows):
                options += [(2 * n, "I" * n, put)] if end == "a" else []
            else:
                options += [(c + 2 * n, "I" * n + a, put + o) for c, a, o in edits(i, end)]
        if i < len(rows):
            options += edits(i, last)
        return min(options, key=lambda x: x[:2])

    def edits(i, last):
        fault, is_open = faults[i]
        c, a, o = best(i + 1, last)
        out = [(c + 3, "D" + a, o)]
        if fault not in ("blank", "duplicate"):
            allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
            if initials[i] in allowed:
                c, a, o = best(i + 1, initials[i])
                out.append((c + is_open, "K" + a, ((i, initials[i]), *o)))
            new = allowed[-1]
            c, a, o = best(i + 1, new)
            out.append((c + 2 + is_open, "R" + a, ((i, "R" + new), *o)))
        return out

    cost, audit, output = best(0, "")
    name = {"u": "user", "a": "assistant"}
    lines = []
    for i, initial in output:
        if i is None:
            lines.append(name[initial] + ":")
        else:
            lines.append(f"{name[initial[1]] if initial[0] == 'R' else rows[i][1]}:{rows[i][2]}")
    turns = {t for t, _, _ in rows if t is not None}
    count = lambda f: sum(x == f for x, _ in faults)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        count("blank"),
        count("duplicate"),
        count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def _expected(rows, spark):
    """Rows of one turn go by role, then by the hashes of the text."""
    from pyspark.sql import functions as F

    texts = sorted({t for _, _, _, t in rows if t is not None} | {" ", ""})
    texts += [t.translate({ord(c): None for c in ".!?"}) for t in texts]
    hashes = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    hashes = {t: (a, b) for t, a, b in hashes.collect()}
    out = {}
    for conv in {r[0] for r in rows}:
        mine = _damaged([r for r in rows if r[0] == conv])
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashes[r[2]]))
        out[conv] = _plain(mine)
    return out


def _check(spark, rows, more=()):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:] for r in C.repair(df).collect()}
    want = _expected(rows, spark)
    assert {k: v for k, v in got.items() if v != want.get(k)} == {} and set(got) == set(want)


@pytest.fixture(scope="module")
def messy():
    rnd = random.Random(11)
    texts = ["Yes.", "No!", "What?", "and so", "", " \n", "a.b ", "Fine. ", None, "x" * 5000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "sudo"]
    rows = []
    for conv in [*range(60), None]:
        for i in range(rnd.choice([1, 2, 3, 5, 8, 13])):
            turn = rnd.choice([i, i, i, i, 2 * i, None, 0])
            rows.append((conv, turn, rnd.choices(roles, [9, 9, 3, 1, 1, 1, 1, 1])[0], rnd.choice(texts)))
    rows += [(70, t, "user" if t % 2 else "assistant", f"Line {t}.") for t in range(400)]  # many segments
    rows += [(71, t, rnd.choice(roles[:3]), rnd.choice(["Yes.", f"n {t}", f"m {t}!"])) for t in range(300)]
    rows += [(72, 5, "user", "Same.")] * 150  # copies of one turn
    return rows


def test_against_all_edits(spark, messy):
    import sys

    sys.setrecursionlimit(20_000)
    _check(spark, messy)


def test_ties_and_segments(spark, monkeypatch):
    # paths of a whole run equal those put together from pieces, entry by entry
    rnd = random.Random(3)
    for _ in range(200):
        units = [(rnd.choice("suat"), rnd.random() < 0.3, rnd.randrange(2)) for _ in range(rnd.randrange(1, 9))]
        for entry in range(4):
            whole, cut = C.paths(units, entry), rnd.randrange(len(units) + 1)
            joined = {}
            for middle, (c, a) in (C.paths(units[:cut], entry) if cut else {entry: (0, "")}).items():
                for state, (d, b) in (C.paths(units[cut:], middle) if cut < len(units) else {middle: (0, "")}).items():
                    joined[state] = min(joined.get(state, (1 << 40, "")), (c + d, a + b))
            # inserts after the last row of a piece belong to the next one
            assert {s: w for s, w in joined.items() if s in whole} == whole


def test_partitions_do_not_matter(spark, messy):
    df = spark.createDataFrame(messy, SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            found.append(sorted(map(str, C.repair(df.repartition(5)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == found[1]


def test_repaired_rows(spark, messy):
    rows = C.damage(spark.createDataFrame(messy, SCHEMA))
    edits, _ = C.plan_repairs(rows)
    digests = {r["conv_id"]: r for r in C.digests(rows, edits).collect()}
    lines = {}
    for r in sorted(C.repaired(rows, edits).collect(), key=lambda r: (str(r["conv_id"]), r["place"])):
        lines.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for conv, d in digests.items():
        text = "\n".join(f"{a}:{b}" for a, b in lines.get(conv, []))
        assert hashlib.sha256(text.encode()).hexdigest() == d["repaired_sha256"] and d["repaired_rows"] == len(lines.get(conv, []))
        initials = "".join(a[0] for a, _ in lines.get(conv, []))
        body = initials[initials[:1] == "s" :]
        assert body == "ua" * (len(body) // 2) and (body or not initials)


def test_nothing_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair(empty).collect() == []
    # a conversation whose only row is dropped
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    more = "conv_id long, turn long, role string, text string, hash_a int, part int, audit string, copies string"
    df = spark.createDataFrame([(7, turn, "user", "Hi.", 1, 1, "x", "y")], more)
    got = C.repair(df).collect()
    assert [tuple(r) for r in got] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query(spark, sf_dir):
    df = queries.op11_conversation_repair(spark, sf_dir)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: tuple(r)[1:] for r in df.collect()} == _expected(rows, spark)
