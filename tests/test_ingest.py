"""Catalog build: statistics per record, last write wins, upserts, streaming."""

import json
from pathlib import Path

import pytest

from shelfmark.operators import ingest as I
from shelfmark.operators.upsert import latest_by_key, merge_by_key, merge_counts
from shelfmark.plans.build import build_catalog
from shelfmark.schemas import CATALOG, CATEGORIES, PATHS, SRC, VALUES
from shelfmark.sources import readers, writers
from shelfmark.sources import tables
from shelfmark.streaming import ingest as S
from shelfmark.streaming.ingest import stream_catalog, stream_lang_distribution


def record(seq, code, categories="Food,Jams", lang="pl", name="Dżem", **more):
    row = dict.fromkeys(SRC.fieldNames())
    row |= {"seq": seq, "code": code, "lang": lang, "categories": categories}
    row["product_name"] = None if name is None else [{"lang": "main", "text": name}]
    return tuple((row | more).values())


RECORDS = [
    record(1, "01", food_groups_tags=["en:b", "en:a"]),
    record(2, "02", categories="en:x"),
    record(3, "01", categories="Food, Sweet ,Jams,pl:dżemy", brands="New", food_groups_tags=["en:a"]),
    record(4, None, name="Null key"),
    record(5, None, name="Null key again", labels="Bio, ,Eko"),
    record(6, "03", lang="fr"),
    record(7, "04", name=" "),
    record(8, "05", categories="A > B,C"),
    record(9, "06", categories="C,A > B"),
]


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame(RECORDS, SRC)


@pytest.fixture(scope="module")
def build(source):
    return build_catalog(source)


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_counts_and_rejects(build, source):
    assert build.counts.first().asDict() == {"processed": 6, "skipped": 2}
    assert sorted(r.code for r in build.rejected.collect()) == ["02", "04"]
    sample = I.reject_sample(I.filter_lang(source), 1).collect()
    assert [r.code for r in sample] == ["02"]
    assert as_dict(build.languages, "lang", "n_records") == {"pl": 6}


def test_languages_keep_null(spark):
    df = spark.createDataFrame([record(1, "a", lang=None), record(2, "b")], SRC)
    assert as_dict(I.lang_distribution(df), "lang", "n_records") == {None: 1, "pl": 1}


def test_distinct_lists_are_sorted(build):
    assert [r.value for r in build.food_groups.collect()] == ["en:a", "en:b"]
    assert [r.value for r in build.categories.collect()] == [
        "A > B", "C", "Food", "Jams", "Sweet", "pl:dżemy",
    ]


def test_paths_latest_record_wins(build):
    assert as_dict(build.category_paths, "name", "path") == {
        "Jams": "Food > Jams",
        "C": "A > B > C",
        "A > B": "C > A > B",
    }
    # "A > B" does not end its own path once that is split again.
    assert as_dict(build.category_tree, "name", "ancestors") == {"Jams": ["Food"], "C": ["A", "B"]}


def test_catalog_documents(build):
    docs = {r["_id"]: r for r in build.catalog().collect()}
    assert set(docs) == {"01", None, "05", "06"}
    assert docs["01"].brands == "New"
    assert docs["01"].categories == ["Food", "Sweet", "Jams", "pl:dżemy"]
    assert docs[None].labels == ["Bio", "", "Eko"]
    assert docs[None].search_string == "null key again food jams bio   eko"
    assert build.catalog().schema.fieldNames() == CATALOG.fieldNames()


def test_upsert_replaces_inserts_keeps(spark, build, tmp_path):
    root = str(tmp_path / "catalog")
    first = spark.createDataFrame(
        [record(1, "01", brands="Old"), record(2, "99", brands="Kept"), record(3, None)], SRC
    )
    writers.upsert_table(I.catalog_project(first), root, CATALOG, "_id", "seq")
    for _ in range(2):  # the second time changes nothing
        writers.upsert_table(build.documents, root, CATALOG, "_id", "seq")
        brands = as_dict(writers.read_table(spark, root, CATALOG), "_id", "brands")
        assert brands == {"01": "New", "99": "Kept", None: None, "05": None, "06": None}


def test_uncommitted_version_is_ignored(spark, build, tmp_path):
    root = tmp_path / "catalog"
    assert writers.read_table(spark, str(root), CATALOG).count() == 0
    writers.upsert_table(build.documents, str(root), CATALOG, "_id", "seq")
    (root / "v=1").mkdir()
    (root / "v=1" / "part-0.parquet").write_text("half written")
    assert writers.read_table(spark, str(root), CATALOG).count() == 4
    writers.upsert_table(build.documents, str(root), CATALOG, "_id", "seq")
    assert writers.read_table(spark, str(root), CATALOG).count() == 4


def test_an_upsert_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    root = str(tmp_path / "table")
    old = spark.range(2000).selectExpr("cast(id as string) AS name", "'old' AS path")
    writers.upsert_table(old, root, PATHS, "name", buckets=64)
    delta = spark.createDataFrame([(str(i * 31), "new") for i in range(9)] + [(None, "new")], PATHS)
    writers.upsert_table(delta, root, PATHS, "name")
    rewritten = list((tmp_path / "table" / "v=1" / "data").glob("_bucket=*"))
    assert 1 <= len(rewritten) <= 10 and len(list((tmp_path / "table" / "v=0" / "data").glob("_bucket=*"))) == 64
    got = as_dict(writers.read_table(spark, root, PATHS), "name", "path")
    assert got == {str(i): "old" for i in range(2000)} | {str(i * 31): "new" for i in range(9)} | {None: "new"}


def test_superseded_buckets_go_unless_pinned(spark, tmp_path):
    root = str(tmp_path / "table")
    rows = lambda v: spark.createDataFrame([("a", v), ("b", v)], PATHS)
    stored = lambda: {p.parent.parent.name for p in (tmp_path / "table").glob("v=*/data/_bucket=*")}
    writers.upsert_table(rows("0"), root, PATHS, "name")
    with writers.pinned(spark, root) as version:
        for v in "123":
            writers.upsert_table(rows(v), root, PATHS, "name")
        assert stored() == {"v=0", "v=2", "v=3"}
        pinned = writers.read_table(spark, root, PATHS, version)
        assert as_dict(pinned, "name", "path") == {"a": "0", "b": "0"}
    writers.upsert_table(spark.createDataFrame([("a", "4")], PATHS), root, PATHS, "name")
    writers.upsert_table(spark.createDataFrame([("a", "5")], PATHS), root, PATHS, "name")
    assert as_dict(writers.read_table(spark, root, PATHS), "name", "path") == {"a": "5", "b": "3"}
    assert stored() == {"v=3", "v=4", "v=5"}  # "b" is still read where it was written


def test_a_grown_table_is_dealt_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "BUCKET_ROWS", 10)
    root = str(tmp_path / "table")
    writers.upsert_table(spark.range(20).selectExpr("cast(id as string) AS name", "'a' AS path"), root, PATHS, "name")
    writers.upsert_table(spark.range(10, 900).selectExpr("cast(id as string) AS name", "'b' AS path"), root, PATHS, "name")
    assert len(tables._manifest(spark, root, 1)[0]) == 182
    got = as_dict(writers.read_table(spark, root, PATHS), "name", "path")
    assert got == {str(i): "ab"[i >= 10] for i in range(900)}


def test_a_batch_is_applied_once(spark, tmp_path):
    root = str(tmp_path / "table")
    rows = lambda v: spark.createDataFrame([("a", v)], PATHS)
    for stream, batch_id, value, want in (("s", 0, "0", "0"), ("s", 1, "1", "1"), ("s", 0, "again", "1"), ("t", 0, "2", "2"), ("s", 1, "again", "2")):
        writers.upsert_table(rows(value), root, PATHS, "name", batch=(stream, batch_id))
        assert as_dict(writers.read_table(spark, root, PATHS), "name", "path") == {"a": want}
    assert tables.applied(spark, root, ("s", 1)) and not tables.applied(spark, root, ("s", 2))
    # a batch without rows is remembered too
    writers.upsert_table(rows("x").limit(0), root, PATHS, "name", batch=("s", 5))
    assert tables.applied(spark, root, ("s", 5))


def test_stream_build_in_arrival_order(spark, source, build, tmp_path):
    """Side outputs and counts of a dump without numbers, over restarts and a replayed batch."""
    dump, root, state = (str(tmp_path / n) for n in ("dump", "tables", "state"))
    for lo, hi in ((0, 3), (3, 6), (6, 9)):
        part = source.filter(f"seq > {lo} AND seq <= {hi}").orderBy("seq").drop("seq")
        part.coalesce(1).write.mode("append").parquet(dump)
        query = S.stream_build(readers.stream_products(spark, dump, max_files=1, arrival=True), root, state)
        query.awaitTermination()
        assert query.exception() is None
    # the commit of the last batch is lost: the batch is replayed, and every table has it already
    (tmp_path / "state" / "commits" / "2").unlink()
    (tmp_path / "state" / "commits" / ".2.crc").unlink(missing_ok=True)
    S.stream_build(readers.stream_products(spark, dump, max_files=1, arrival=True), root, state).awaitTermination()
    read = lambda name, schema: writers.read_table(spark, f"{root}/{name}", schema)
    assert sorted(map(str, read("catalog", CATALOG).collect())) == sorted(map(str, build.catalog().collect()))
    assert as_dict(read("category_paths", PATHS), "name", "path") == as_dict(build.category_paths, "name", "path")
    for name, want in (("food_groups", build.food_groups), ("categories", build.categories)):
        assert sorted(r.value for r in read(name, VALUES).collect()) == [r.value for r in want.collect()]
    assert S.stream_counts(spark, root).first() == build.counts.first()
    assert len(tables.versions(spark, f"{root}/counts")) <= 3


def test_merge_counts(spark):
    old = spark.createDataFrame([("a", ["x"]), (None, [])], CATEGORIES)
    new = spark.createDataFrame([("a", ["y"]), ("b", []), (None, ["z"])], CATEGORIES)
    assert merge_counts(old, new, "name").first().asDict() == {
        "processed": 3,
        "inserted": 1,
        "updated": 2,
    }
    merged = as_dict(merge_by_key(old, new, "name"), "name", "ancestors")
    assert merged == {"a": ["y"], "b": [], None: ["z"]}


def test_latest_by_key_limits_before_the_shuffle(source):
    plan = latest_by_key(source, "code")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_store_and_side_outputs(spark, build, tmp_path):
    build.store(str(tmp_path / "catalog"), str(tmp_path / "categories"))
    assert writers.read_table(spark, str(tmp_path / "catalog"), CATALOG).count() == 4
    tree = writers.read_table(spark, str(tmp_path / "categories"), CATEGORIES)
    assert as_dict(tree, "name", "ancestors") == {"Jams": ["Food"], "C": ["A", "B"]}
    build.write_side_outputs(str(tmp_path / "side"))

    def lines(name):
        files = sorted(Path(tmp_path / "side" / name).glob("part-*.json"))
        return [json.loads(x) for f in files for x in f.read_text("utf-8").splitlines()]

    assert [x["value"] for x in lines("unique_food_groups")] == ["en:a", "en:b"]
    assert lines("unique_categories")[-1] == {"value": "pl:dżemy"}
    assert [x["name"] for x in lines("unique_last_categories")] == ["A > B", "C", "Jams"]


def test_empty_source_gives_empty_outputs(spark):
    build = build_catalog(spark.createDataFrame([], SRC))
    assert build.catalog().count() == build.category_tree.count() == 0
    assert build.counts.first().asDict() == {"processed": 0, "skipped": 0}


def test_json_dump_with_odd_shapes(spark, tmp_path):
    path = tmp_path / "dump.json"
    rows = [
        {"code": "007", "lang": "pl", "product_name": "bare string", "categories": "Food"},
        {"code": "008", "lang": "pl", "product_name": [{"text": "Jam"}], "categories": "Food", "x": {"y": 1}},
    ]
    path.write_text("\n".join(json.dumps(r) for r in rows))
    df = readers.read_products(spark, str(path), "json")
    assert [r.code for r in I.valid_products(df).collect()] == ["008"]
    assert df.filter("code = '007'").first().product_name is None


def test_stream_equals_batch(spark, source, build, tmp_path):
    dump, root, state = (str(tmp_path / n) for n in ("dump", "catalog", "state"))
    ordered = source.orderBy("seq").coalesce(1)
    ordered.filter("seq <= 3").write.parquet(dump)
    for lo, hi in ((3, 6), (6, 9)):
        part = ordered.filter(f"seq > {lo} AND seq <= {hi}")
        part.write.mode("append").parquet(dump)
        stream = readers.stream_products(spark, dump, max_files=1)
        query = stream_catalog(stream, root, state)  # a restart goes on where it ended
        query.awaitTermination()
        assert query.exception() is None
    got = writers.read_table(spark, root, CATALOG)
    assert sorted(map(str, got.collect())) == sorted(map(str, build.catalog().collect()))


def test_stream_lang_distribution(spark, source, tmp_path):
    dump = str(tmp_path / "dump")
    source.write.parquet(dump)
    stream = readers.stream_products(spark, dump)
    stream_lang_distribution(stream, "langs", str(tmp_path / "state")).awaitTermination()
    assert as_dict(spark.table("langs"), "lang", "n_records") == {"pl": 8, "fr": 1}


def test_filter_is_pushed_and_columns_pruned(spark, source, tmp_path):
    dump = str(tmp_path / "dump")
    source.write.parquet(dump)
    df = I.filter_lang(readers.read_products(spark, dump)).select("code")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,pl)" in plan
    assert "ReadSchema: struct<code:string,lang:string>" in plan


def test_arrival_order_of_a_dump_without_numbers(spark, source, build, tmp_path):
    rows = source.orderBy("seq").drop("seq")
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        rows.repartitionByRange(3, "code").write.format(fmt).save(path)
        again = readers.read_products(spark, path, fmt)
        assert again.filter("seq is null").count() == 0
        assert again.select("seq").distinct().count() == source.count()
    one = str(tmp_path / "one")
    rows.coalesce(1).write.json(one)
    got = build_catalog(readers.read_products(spark, one, "json"))
    assert as_dict(got.category_paths, "name", "path") == as_dict(build.category_paths, "name", "path")
    assert sorted(map(str, got.catalog().collect())) == sorted(map(str, build.catalog().collect()))
