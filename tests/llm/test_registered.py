"""Registered queries: SQL where there is one, shapes and the pipeline otherwise."""

from collections import Counter

import compare
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import mixing, queries, toxicity
from shelfmark.llm.near_dedup import near_duplicates
from shelfmark.session import materialize

SQL = queries.oracle_sql()


def test_one_query_for_each_operator():
    numbers = [int(name[2:].split("_")[0]) for name in queries.queries()]
    assert sorted(numbers) == list(range(1, 14)) and set(SQL) <= set(queries.queries())


@pytest.mark.parametrize("name", list(SQL))
def test_against_sql(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    assert compare.differences(df, compare.connect(sf_dir), SQL[name]) == []


def test_near_dedup_against_plain_sets(spark, sf_dir):
    from test_texts import components, rows_of

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.op5_near_dedup(spark, sf_dir).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == components(rows_of(docs), 2, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_model_queries(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    n = docs.count()
    toxic = queries.op1_toxicity(spark, sf_dir).join(labels, "doc_id", "left").collect()
    assert len(toxic) == n and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in toxic)
    lang = queries.op6_language_id(spark, sf_dir)
    assert lang.count() == n and lang.columns == ["doc_id", "held_out", "lang_pred", "score"]
    mixed = queries.op4_source_mixing(spark, sf_dir)
    assert mixed.count() == n and mixed.select("slot", "place").distinct().count() == n


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near dedup", "substring dedup", "source mixing", "bpe"]
    # rows that a stage must cope with
    more = [(None, "alpha beta", None, None, None), (None, "alpha beta", "en", "s", 1), (0, None, "en", "s", 0), (-5, "", "", "", 0)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("row", F.lit(1))
    counts, tables = [docs.count()], [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        counts.append(docs.count())
        tables.append(docs)
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4] == counts[5]
    assert tables[2].filter("doc_id is null").count() == 1
    again = near_duplicates(tables[2].filter("doc_id is not null"), shingle=5)
    assert again.filter("doc_id <> component_id").count() == 0
    assert tables[5].filter("n_tokens <> size(ids)").count() == 0
    a, b = tables[4].select("doc_id", "text"), tables[5].select("doc_id", "text")
    assert a.exceptAll(b.withColumn("text", F.col("text"))).filter("text is not null").count() == 0


def test_near_dedup_stage_keeps_what_is_no_near_copy(spark, sf_dir):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("b")), (2, text("a") + " x"), (None, text("b") + " x"), (None, text("c")), (None, text("c") + " x")]
    rows += [(3, text("d")), (3, text("d")), (4, ""), (5, None), (6, text("e"))]
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.remove_near_duplicates(spark, docs, sf_dir)
    assert kept.columns == corpus_pipeline.COLUMNS
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    sure = [(1, text("a")), (1, text("b")), (3, text("d")), (4, ""), (5, None), (6, text("e"))]
    nameless = [x for x in got if x not in sure]
    assert len(got) == 7 and all(x in got for x in sure)
    assert nameless in ([(None, text("c"))], [(None, text("c") + " x")])


def test_the_mixture_reaches_the_last_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    docs = docs.withColumn("text", F.substring("text", 1, 40)).crossJoin(spark.range(20))
    docs = docs.withColumn("doc_id", F.col("doc_id") * 20 + F.col("id")).drop("id")
    mixed = materialize(corpus_pipeline.mix_sources(spark, docs, sf_dir), "stage")
    rows = corpus_pipeline.encode(spark, mixed, sf_dir).select("source", "slot", "place").collect()
    n = Counter(r["source"] for r in rows)
    assert sum(n.values()) == docs.count() == len({(r["slot"], r["place"]) for r in rows})
    order = [s for _, s in sorted({(r["slot"], r["source"]) for r in rows})]
    left, count = {s: -(-k // mixing.BLOCK) for s, k in n.items()}, Counter()
    for t, s in enumerate(order, 1):
        count[s] += 1
        assert all(abs(count[k] - t * c**0.5 / sum(x**0.5 for x in n.values())) < 1 for k, c in n.items())
        if count[s] == left[s]:
            break


def test_pipeline_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        assert docs.count() == 0


def test_held_out_rows(spark):
    import zlib

    ids = spark.range(200).select(F.col("id").alias("doc_id"), toxicity.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in ids)


def test_the_toxicity_model_is_trained_in_a_task(spark, sf_dir, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(toxicity, "train", None)  # on the driver only: workers import the module themselves
    assert toxicity.fit(docs, labels).table.any()
