"""Re-ranking, routing, rewriting, the two passes, reports and result documents."""

import csv
import json
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from shelfmark import constants as K
from shelfmark.functions import decision as D
from shelfmark.operators import conversation as C
from shelfmark.operators import report as P
from shelfmark.operators import rerank as R
from shelfmark.operators import rewrite as W
from shelfmark.plans.build import build_catalog
from shelfmark.plans.search import search_documents, two_pass_search
from shelfmark.schemas import QUERIES, REWRITE, SRC
from shelfmark.sources import readers, writers


def product(seq, name, brands, categories, quantity="1 kg", labels=None):
    row = dict.fromkeys(SRC.fieldNames())
    row |= {"seq": seq, "code": f"{seq:04d}", "lang": "pl", "brands": brands}
    row |= {"categories": categories, "quantity": quantity, "labels": labels}
    row["product_name"] = [{"lang": "main", "text": name}, {"lang": "pl", "text": f" {name} "}]
    return tuple(row.values())


PRODUCTS = [
    product(1, "Kasza jaglana", "Młynarz", "Groceries,Groats,Kasza jaglana", "350 g", "Bio"),
    product(2, "Kasza gryczana", "Natura", "Groceries,Groats,Kasza gryczana", "500 g"),
    product(3, "Mąka jaglana", "Natura", "Groceries,Flours,Mąka", "500 g"),
    product(4, "Woda, gazowana", 'Z "gór"', "Food,Woda", "1,5 l"),
]
LINES = [
    "Kasza jaglana Młynarz 350 g",  # 1 good at once
    "jagl",  # 2 no hits: level 1 rewrites
    "KaszaGrycz500g",  # 3 weak: level 1 has no idea, level 2 rewrites
    "woda",  # 4 weak: confirmed
    "reklamówka",  # 5 no hits, not a product
    "mąka",  # 6 weak, neither level helps
    "natura",  # 7 weak: rewritten to something that is not there
    "brak trafień",  # 8 no hits, no idea: level 2 is not asked
]
REWRITES = [
    (1, "jagl", K.REPHRASED, "kasza jaglana"),
    (1, "KaszaGrycz500g", K.REPHRASED, ""),
    (2, "KaszaGrycz500g", K.REPHRASED, "kasza gryczana natura 500 g"),
    (1, "woda", K.VALID_PRODUCT, None),
    (1, "reklamówka", K.NOT_A_PRODUCT, None),
    (2, "mąka", K.VALID_PRODUCT, None),
    (1, "natura", K.REPHRASED, "qwerty"),
    (2, "brak trafień", K.REPHRASED, "mąka"),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return build_catalog(spark.createDataFrame(PRODUCTS, SRC)).catalog()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(enumerate(LINES, 1)), QUERIES)


@pytest.fixture(scope="module")
def result(spark, queries, catalog):
    table = spark.createDataFrame(
        REWRITES, "level int, input_string string, decision string, rephrased_query string"
    )
    return two_pass_search(queries, catalog, W.lookup_rewriter(table))


@pytest.fixture(scope="module")
def offline(queries, catalog):
    return two_pass_search(queries, catalog)


def by_query(df):
    return {r.query_no: r for r in df.collect()}


def test_rewrites_and_second_pass(result):
    q = by_query(result.queries)
    assert [q[i].route for i in range(1, 9)] == [
        W.DONE, W.ASK_WITHOUT_HITS, W.ASK, W.ASK, W.ASK_WITHOUT_HITS, W.ASK, W.ASK,
        W.ASK_WITHOUT_HITS,
    ]
    assert [q[i].next_query for i in range(1, 9)] == [
        None, "kasza jaglana", "kasza gryczana natura 500 g", None, None, None, "qwerty", None,
    ]
    assert [q[i].level2_decision for i in (3, 6)] == [K.REPHRASED, K.VALID_PRODUCT]
    assert all(q[i].level2_model is None for i in (1, 2, 4, 5, 7, 8))
    assert q[8].level1_decision == K.NO_MATCH_FOUND
    best = by_query(R.best_match(result.hits))
    assert best[2]._id == "0001" and best[3]._id == "0002"
    assert set(best) == {1, 2, 3, 4, 6}  # 7 lost its hits: the last pass counts


def test_rankings_are_permutations(result):
    rows = result.hits.select("query_no", "text_rank", "fuzzy_rank", "rapidfuzz_score").collect()
    for no in {r.query_no for r in rows}:
        mine = [r for r in rows if r.query_no == no]
        dense = list(range(1, len(mine) + 1))
        assert sorted(r.text_rank for r in mine) == sorted(r.fuzzy_rank for r in mine) == dense
        ordered = sorted(mine, key=lambda r: (-r.rapidfuzz_score, r.text_rank))
        assert [r.fuzzy_rank for r in ordered] == dense


@pytest.mark.parametrize("query,best", [("gryczana", "0002"), ("młynarz", "0001"), ("woda gazowana", "0004")])
def test_rerank_prefers_the_matching_product(spark, catalog, query, best):
    q = spark.createDataFrame([(1, query)], QUERIES)
    hits = catalog.select(
        F.lit(1).cast("long").alias("query_no"), "_id", F.lit(1.0).alias("score"),
        F.col("_id").cast("int").alias("text_rank"),
    )
    assert by_query(R.best_match(R.fuzzy_rerank(hits, q, catalog)))[1]._id == best


def test_status_and_counts(result, queries):
    status = by_query(R.match_status(queries, result.hits))
    assert status[1].match_status == "successful" and status[1].match_confidence == "high"
    assert status[4].match_status == "low_confidence" and status[4].threshold == 550.0
    assert status[5].match_status == "no_match" and status[5].best_score is None
    counts = by_query(R.hit_counts(queries, result.hits))
    assert counts[5].direct_count == 0 and counts[1].rapidfuzz_count > 0


def test_offline_row_numbers(offline):
    rows = P.report_rows(offline).groupBy("query_no").count().collect()
    found = {r.query_no: r["count"] for r in rows}
    assert found == {1: 2, 2: 3, 3: 4, 4: 4, 5: 3, 6: 4, 7: 4, 8: 3}
    error = offline.queries.filter("query_no = 2").first().level1_error
    assert "not available" in error


def test_report_rows(result):
    rows = [tuple(r) for r in P.batch_report(result).collect()]
    assert [r[0] for r in rows[:5]] == ["1.Mongo", "1.Fuzzy", "2.Mongo", "2.Fuzzy", "2.level-1"]
    mine = {r[0]: r for r in rows}
    assert mine["2.level-1"][2:] == (
        f"{K.REPHRASED}: kasza jaglana", "0", "AI", K.REPHRASED, "kasza jaglana",
    )
    assert mine["5.Mongo"] == ("5.Mongo", "reklamówka", "", "0", "", "", "")
    assert mine["5.level-1"][2:] == (K.NOT_A_PRODUCT, "0", "AI", K.NOT_A_PRODUCT, "")
    # Report names are stripped but not made distinct.
    assert mine["1.Fuzzy"][2] == "Kasza jaglana"
    assert mine["1.Fuzzy"][5:] == ("Groceries,Groats,Kasza jaglana", "Kasza jaglana; Kasza jaglana")
    counts = P.report_counts(P.report_rows(result)).first()
    assert (counts.total_rows, counts.products_processed) == (len(rows), len(LINES))


def test_report_round_trip(spark, result, tmp_path):
    path = str(tmp_path / "report")
    writers.write_report(result, path)
    want = [tuple(r) for r in P.batch_report(result).collect()]
    read = [tuple(r) for r in readers.read_report(spark, path).collect()]
    assert sorted(read) == sorted(want)
    rows = []
    for f in sorted(Path(path).glob("part-*.csv")):
        with open(f, newline="", encoding="utf-8") as text:
            header, *body = csv.reader(text)
            assert header == K.REPORT_COLUMNS
            rows += [tuple(r) for r in body]
    assert rows == want


def test_short_report_rows_are_padded(spark, tmp_path):
    path = tmp_path / "old.csv"
    path.write_text('Number,Input string,Given Name,Score,ID\n1.Mongo,"a ""b"", c",,0,\n', "utf-8")
    assert [tuple(r) for r in readers.read_report(spark, str(path)).collect()] == [
        ("1.Mongo", 'a "b", c', "", "0", "", "", "")
    ]


def test_two_decimals_round_like_the_exact_value(spark):
    values = [0.125, 0.375, 1.005, 1.015, 2.675, 550.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(P.two_decimals("x")).collect()]
    assert got == [None if v is None else f"{v:.2f}" for v in values]


def test_result_documents(spark, result, tmp_path):
    path = str(tmp_path / "results")
    writers.write_results(result, path)
    files = sorted(Path(path).glob("part-*.json"))
    docs = [json.loads(x) for f in files for x in f.read_text("utf-8").splitlines()]
    assert [d["query_no"] for d in docs] == list(range(1, len(LINES) + 1))
    one, two, five = docs[0], docs[1], docs[4]
    assert one["formatted_string"] == "kasza jaglana młynarz 350 g"
    assert one["direct_search"]["count"] == len(one["direct_search"]["results"])
    assert one["best_match"]["product"] == one["rapidfuzz_search"]["results"][0]
    assert one["best_match"]["score"] >= 550 and "openai_level1" not in one
    # The formatted text is that of the original query.
    assert two["formatted_string"] == "jagl"
    assert two["openai_level1"]["rephrased_query"] == "kasza jaglana"
    assert five["rapidfuzz_search"] == {"count": 0, "results": []}
    assert five["match_status"] == "no_match" and "best_match" not in five
    scores = [h["rapidfuzz_score"] for h in one["rapidfuzz_search"]["results"]]
    assert scores == sorted(scores, reverse=True)
    assert search_documents(result).count() == len(LINES)


def test_top_views(result):
    top = by_query(R.top_results(result.hits))
    assert top[1].text_id == top[1].fuzzy_id == "0001"
    rows = R.top_summary(result.hits).filter("query_no = 1").collect()
    assert {(r.ranking, r["rank"]) for r in rows} >= {("text", 1), ("fuzzy", 1)}
    assert all(r["rank"] <= 3 for r in rows)
    by_id = {r._id: r for r in rows}
    assert by_id["0001"].labels == "Bio" and by_id["0002"].labels == "N/A"


ANSWERS = {
    '{"decision": "valid_product", "rephrased_query": "x"}': (K.VALID_PRODUCT, "x", False),
    'text {"decision":"rephrased_successfully",\n"rephrased_query":"a b"} more': (
        K.REPHRASED, "a b", False,
    ),
    '{"rephrased_query": "y"}': (K.NO_MATCH_FOUND, "y", False),
    '{"decision": null}': (None, None, False),
    '{"decision": "made_up"}': ("made_up", None, False),
    "{}": (K.NO_MATCH_FOUND, None, False),
    "{not json}": (K.NO_MATCH_FOUND, None, True),
    '{"decision": "valid_product"} {}': (K.NO_MATCH_FOUND, None, True),
    "{'decision': 'valid_product'}": (K.NO_MATCH_FOUND, None, True),
    "It is NOT_A_PRODUCT, not valid": (K.NOT_A_PRODUCT, None, False),
    "an improved query": (K.REPHRASED, None, False),
    "invalid": (K.VALID_PRODUCT, None, False),
    "no idea }{": (K.NO_MATCH_FOUND, None, False),
    "": (K.NO_MATCH_FOUND, None, False),
    None: (K.NO_MATCH_FOUND, None, True),
}


def test_parse_decision(spark):
    df = spark.createDataFrame([(a,) for a in ANSWERS], "content string")
    for r in df.select("content", D.parse_decision("content", 2).alias("r")).collect():
        want = ANSWERS[r.content]
        assert (r.r.decision, r.r.rephrased_query, r.r.error is not None) == want, r.content
        assert r.r.model == K.LEVEL_MODELS[2]


def test_rewrite_prompt(spark):
    df = spark.createDataFrame(
        [("q", "T", "valid", None), ("q", "", None, None), ("q", None, "x", "y")],
        "q string, t string, d string, r string",
    )
    assert [r[0] for r in df.select(D.rewrite_prompt("q", "t", "d", "r")).collect()] == [
        'User Search Query: "q"\nPossible Result: "T"\nPrevious Analysis: valid',
        'User Search Query: "q"',
        'User Search Query: "q"\nPrevious Analysis: x, suggested: "y"',
    ]
    first = df.select(D.rewrite_prompt("q", "t")).first()[0]
    assert first == 'User Search Query: "q"\nPossible Result: "T"'


def test_service_rewriter_plugs_in(spark, queries, catalog):
    """A rewriter that answers in Python batches, as one calling a service would."""

    def ask(batches):
        for b in batches:
            b["content"] = '{"decision": "rephrased_successfully", "rephrased_query": "kasza jaglana"}'
            yield b[["query_no", "level", "content"]]

    def rewriter(requests):
        prompts = requests.withColumn("prompt", D.rewrite_prompt("input_string", "top_name"))
        told = prompts.mapInPandas(ask, "query_no long, level int, content string")
        return told.withColumn("r", D.parse_decision("content", 1)).select(
            "query_no", "level", "r.*"
        ).select(*REWRITE.fieldNames())

    got = two_pass_search(queries, catalog, rewriter)
    best = by_query(R.best_match(got.hits))
    assert set(best) == set(range(1, 9))
    assert all(best[i]._id == "0001" for i in (2, 5, 8))


def test_equal_requests_are_asked_once_and_answers_are_kept(spark, tmp_path):
    log, store = tmp_path / "asked", str(tmp_path / "answers")
    log.mkdir()

    def ask(batches):
        for b in batches:
            for no, prompt in zip(b["query_no"], b["prompt"], strict=True):
                with open(log / f"{no}-{abs(hash(prompt))}", "a") as f:
                    f.write("call\n")
            failed = b["prompt"].str.contains("broken")
            b["content"] = '{"decision": "no_match_found", "rephrased_query": null}'
            b.loc[failed, "content"] = "{oops}"
            yield b[["query_no", "level", "content"]]

    routed = spark.createDataFrame(
        [(i, "same text", 1, 10.0, "Name", W.ASK) for i in range(6)]
        + [(6, "same text", 1, 10.0, "Other", W.ASK), (7, "other", 0, None, None, W.ASK_WITHOUT_HITS)]
        + [(8, "broken", 0, None, None, W.ASK_WITHOUT_HITS), (9, "fine", 3, 700.0, "Fine", W.DONE)],
        "query_no long, input_string string, n_hits long, best_score double, top_name string, route string",
    )
    first = W.rewrite_queries(routed, W.service_rewriter(ask), store).orderBy("query_no").collect()
    # level 1: two contexts of one text, "other", "broken"; level 2: the two contexts
    assert len(list(log.iterdir())) == 6
    assert [r.level1_decision for r in first] == ["no_match_found"] * 9 + [None]
    assert [r.level2_decision for r in first] == ["no_match_found"] * 7 + [None] * 3
    second = W.rewrite_queries(routed.filter("query_no > 2"), W.service_rewriter(ask), store).orderBy("query_no").collect()
    assert [tuple(r) for r in second] == [tuple(r) for r in first[3:]]
    lines = sorted(f.read_text().count("\n") for f in log.iterdir())
    assert lines == [1] * 5 + [2]  # only the failed call was made again


MESSAGES = [
    ("m1", 1, 0, "system", "s"), ("m1", 1, 1, "user", "u"), ("m1", 1, 2, "assistant", "a"),
    ("m1", 1, 3, "user", "lost"), ("m1", 1, 4, "user", "again"), ("m1", 1, 5, "assistant", "b"),
    ("m2", 1, 0, "user", "only"),
]
MESSAGE = "model string, conv_id long, turn long, role string, content string"


def test_conversations(spark, tmp_path):
    messages = spark.createDataFrame(MESSAGES, MESSAGE)
    lost = C.unanswered_turns(messages).collect()
    assert {(r.model, r.turn) for r in lost} == {("m1", 3), ("m2", 0)}
    path = str(tmp_path / "conversations")
    writers.write_conversations(messages, path)
    files = sorted(Path(path).glob("part-*.json"))
    docs = [json.loads(x) for f in files for x in f.read_text().splitlines()]
    shown = [tuple(d[k] for k in ("model", "conv_id", "turn", "role", "content")) for d in docs]
    assert shown == MESSAGES and [d["total_messages"] for d in docs] == [6] * 6 + [1]
    assert "exported_at" in docs[0]
    gaps = spark.createDataFrame([("m", 1, 1, "user", "q"), ("m", 1, 3, "assistant", "a")], MESSAGE)
    assert C.unanswered_turns(gaps).count() == 0
    empty = tmp_path / "none"
    writers.write_conversations(messages.limit(0), str(empty))
    assert not empty.exists()


def test_conversation_documents(spark, tmp_path):
    rows = [*MESSAGES, (None, 1, 0, "user", 'say "x"\n'), ("none", 1, 0, "user", None)]
    path = str(tmp_path / "documents")
    writers.write_conversation_documents(spark.createDataFrame(rows, MESSAGE).repartition(5), path)
    files = list(Path(path).glob("document=*/part-*"))
    docs = [json.loads(f.read_text()) for f in files]
    assert len(docs) == 4 and all(set(d) == {"model", "conv_id", "conversation", "total_messages", "exported_at"} for d in docs)
    assert {(d["model"], d["conv_id"]): [(m["role"], m["content"]) for m in d["conversation"]] for d in docs} == {
        ("m1", 1): [r[3:] for r in MESSAGES[:6]], ("m2", 1): [("user", "only")],
        (None, 1): [("user", 'say "x"\n')], ("none", 1): [("user", None)],
    }
    assert sorted(d["total_messages"] for d in docs) == [1, 1, 1, 6]
    assert writers.read_conversation_documents(spark, path).count() == 4
    empty = tmp_path / "none"
    writers.write_conversation_documents(spark.createDataFrame([], MESSAGE), str(empty))
    assert not empty.exists()


def test_many_conversation_documents(spark, tmp_path):
    """Files are written by the tasks themselves and listed by few tasks, in Spark's layout."""
    n, path, tracker = 600, str(tmp_path / "documents"), spark.sparkContext.statusTracker()
    messages = spark.range(2 * n, numPartitions=6).selectExpr(
        "if(id % 4 < 2, 'a/b=\"c\" é', null) AS model", "id div 2 AS conv_id", "id % 2 AS turn", "'user' AS role", "string(id) AS content"
    )
    writers.write_conversation_documents(messages, path)
    folders = list(Path(path).glob("document=*"))
    assert len(folders) == n and sum(f.name.startswith("document=a%2Fb%3D%22c%22 é-") for f in folders) == n // 2
    assert all([f.name for f in d.iterdir()] == ["part-00000.txt"] for d in folders)  # no checksums, no leftovers
    assert (Path(path) / "_SUCCESS").exists()
    spark.sparkContext.setJobGroup("listing", "")
    try:
        rows = {(r.model, r.conv_id): [m.content for m in r.conversation] for r in writers.read_conversation_documents(spark, path).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert rows == {("a/b=\"c\" é" if i % 2 == 0 else None, i): [str(2 * i), str(2 * i + 1)] for i in range(n)}
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= writers.LISTING_TASKS
    with pytest.raises(AnalysisException):
        writers.write_conversation_documents(messages, path)


def test_a_long_conversation_is_streamed(spark, tmp_path):
    n = 300_000
    messages = spark.range(n, numPartitions=8).selectExpr(
        "'m' AS model", "1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "string(id) AS content"
    )
    path = str(tmp_path / "documents")
    writers.write_conversation_documents(messages, path)
    (file,) = Path(path).glob("document=*/part-*")
    doc = json.loads(file.read_text())
    assert doc["total_messages"] == n and [m["content"] for m in doc["conversation"]] == list(map(str, range(n)))


def test_read_queries(spark, tmp_path):
    path = tmp_path / "batch.txt"
    path.write_bytes("  a\r\n\n b \r   \nc\n\nc".encode())
    got = readers.read_queries(spark, str(path)).orderBy("query_no").collect()
    assert [tuple(r) for r in got] == [(1, "a"), (2, "b"), (3, "c"), (4, "c")]
    assert readers.read_queries(spark, str(tmp_path / "missing.txt")).count() == 0


def test_read_queries_numbers_across_splits(spark, tmp_path):
    path = tmp_path / "batch.txt"
    lines = [f"line {i}" if i % 7 else "" for i in range(5000)]
    path.write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = readers.read_queries(spark, str(path))
        got = [tuple(r) for r in df.orderBy("query_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == list(enumerate([x for x in lines if x], 1))


def test_empty_batch_and_empty_catalog(spark, queries, catalog):
    nothing = spark.createDataFrame([], QUERIES)
    got = two_pass_search(nothing, catalog)
    assert got.hits.count() == P.report_rows(got).count() == 0
    bare = two_pass_search(queries, catalog.limit(0))
    assert bare.hits.count() == 0
    assert P.report_rows(bare).count() == 3 * len(LINES)


def requests_of(spark, rows):
    schema = "query_no long, input_string string, n_hits long, top_name string, route string"
    return spark.createDataFrame(rows, schema)


ROUTED = [(1, "a", 2, "A", W.ASK), (2, "b", 0, None, W.ASK_WITHOUT_HITS), (3, "c", 1, "C", W.DONE), (4, "d", 1, "D", W.ASK)]


def test_the_service_is_asked_once(spark, tmp_path):
    log = str(tmp_path)

    def ask(batches):
        import uuid

        for b in batches:
            for n, level in zip(b["query_no"], b["level"]):
                Path(log, f"{level}-{n}-{uuid.uuid4().hex}").touch()
            b["content"] = ["not_a_product" if n == 4 else None if n == 2 else "{}" for n in b["query_no"]]
            yield b[["query_no", "level", "content"]]

    q = by_query(W.rewrite_queries(requests_of(spark, ROUTED), W.service_rewriter(ask)))
    assert sorted(p.name[:3] for p in tmp_path.iterdir()) == ["1-1", "1-2", "1-4", "2-1"]
    assert q[4].level1_decision == K.NOT_A_PRODUCT and q[4].level2_model is None
    assert (q[2].level1_decision, q[2].level1_error is None) == (K.NO_MATCH_FOUND, False)
    assert q[3].level1_model is None


def test_missing_and_repeated_answers(spark):
    table = [(1, "a", K.VALID_PRODUCT, None), (1, "a", K.REPHRASED, "x")]
    table = spark.createDataFrame(table, "level int, input_string string, decision string, rephrased_query string")

    def lazy(requests):
        answers = W.lookup_rewriter(table)(requests).filter("query_no = 1")
        return answers.unionByName(answers)

    q = W.rewrite_queries(requests_of(spark, ROUTED), lazy).collect()
    assert sorted(r.query_no for r in q) == [1, 2, 3, 4]
    q = {r.query_no: r for r in q}
    assert q[1].level1_decision == min(K.VALID_PRODUCT, K.REPHRASED)
    assert q[2].level1_decision == q[4].level1_decision == K.NO_MATCH_FOUND
    assert q[2].level1_error and q[4].level1_error
