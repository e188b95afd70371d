"""Archives, url rules and graphs."""

import gzip
import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import graph, queries, url_filter, warc
from shelfmark.session import new_path

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="session")
def pages(spark):
    rows = [(i, f"http://h{i % 3}.example.com/en/{i}", f"<p>{i % 5}é</p>" * (i % 7)) for i in range(40)]
    rows += [(40, None, None), (41, "x", ""), (None, "u", "<p>1é</p>"), (None, "u", "only"), (3, rows[3][1], rows[3][2])]
    rows += [(42, "http://a/b\r\nX-Page-Id: 9", "WARC/1.1\r\n\r\n" * 3), (43, "", "long " * 60_000)]
    return spark.createDataFrame(rows, PAGES)


def expected(rows, dedup_from=0):
    first = {}
    for r in rows:
        body = r["html"] or ""
        if r["page_id"] is not None:
            first[body] = min(r["page_id"], first.get(body, r["page_id"]))
    out = []
    for r in rows:
        body = r["html"] or ""
        to = first.get(body)
        again = to is not None and to != r["page_id"] and len(body.encode()) >= dedup_from
        out.append((r["page_id"], len(body.encode()), warc.digest(body.encode()), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("dedup_from", "split"), [(0, 1 << 22), (10, 200), (0, 37)])
def test_archives_round_trip(spark, pages, dedup_from, split):
    manifest = warc.write_archives(pages, new_path(spark, "warc"), dedup_from=dedup_from)
    records = warc.read_archives(manifest, split)
    got = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(pages.collect(), dedup_from)
    texts = {r["page_id"]: r["html"] or "" for r in pages.collect() if r["page_id"] is not None}
    for r in records.filter("record_type = 'response' and page_id is not null").collect():
        assert bytes(r["payload"]).decode() == texts[r["page_id"]]
    listed = warc.list_archives(spark, manifest.first()["path"].rsplit("/", 1)[0] + "/*.warc.gz")
    assert listed.count() == manifest.count()


def test_archives_of_nothing(spark, pages):
    manifest = warc.write_archives(pages.limit(0), new_path(spark, "warc"))
    assert warc.read_archives(manifest).count() == 0


def test_every_split_finds_its_own_records():
    bodies = [b"x" * n + warc._MAGIC * (n % 3) for n in range(25)]
    archive = b"".join(warc.record([("WARC-Type", "resource")], b) for b in bodies)
    # a candidate that decodes, but not to a record
    archive += gzip.compress(b"no record", mtime=0) + warc.record([("WARC-Type", "resource")], b"last")
    file = pa.PythonFile(io.BytesIO(archive), mode="r")
    whole = list(warc.members(file, 0, len(archive)))
    assert [warc.parse(d)[1] for _, d in whole] == [*bodies, b"last"]
    for step in (1, 7, 64, 1000):
        parts = [m for i in range(0, len(archive), step) for m in warc.members(file, i, min(i + step, len(archive)))]
        assert parts == whole
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(pa.PythonFile(io.BytesIO(archive[:-6]), mode="r"), 0, len(archive)))


# --------------------------------------------------------------------- graph


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 5), (7, 7), (None, 1), (9, None)]
    edges += [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)]
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **{i: 100 for i in range(100, 161)}, **{i: 200 for i in range(200, 260)}}
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert graph.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


# ----------------------------------------------------------------- url rules


def test_url_parts(spark):
    urls = ["http://A.b/C?d#e", "x://h", "h/p", None, "", "http://u@h:1?q/", "://#/", "http://a://b/c"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    got = rows.select(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).collect()
    assert [(h or "", p or "") for h, p in got] == [
        ("a.b", "/C"), ("h", ""), ("", ""), ("", ""), ("", ""), ("u@h:1", ""), ("", ""), ("a:", "//b/c"),
    ]


def test_targets_are_resolved(spark):
    at = "http://A.org/x/y/z.html?q=1#f"
    cases = {
        "page.html": "http://a.org/x/y/page.html", "../x": "http://a.org/x/x", "./": "http://a.org/x/y",
        "../../../up?a=1&amp;b=../2": "http://a.org/up?a=1&b=../2", "?p=2&amp;r=3": "http://a.org/x/y/z.html?p=2&r=3",
        "//B.org/x": "http://b.org/x", "/r/./s/../t": "http://a.org/r/t", "#top": at, "mailto:a@b://c": None,
        "https://c.org/d": "http://c.org/d", "page?u=http://d.org/": "http://a.org/x/y/page?u=http://d.org/",
    }
    rows = spark.createDataFrame([(t, at, w) for t, w in cases.items()], "t string, base string, want string")
    node = url_filter.node_of(url_filter.resolve(F.col("t"), F.col("base")))
    got = rows.select("t", node.eqNullSafe(url_filter.node_of(F.col("want"))).alias("same")).collect()
    assert [r["t"] for r in got if not r["same"]] == []


def test_relative_links_inherit(spark):
    link = lambda to, more="": f'{more}<link href="{to}" rel="canonical">'
    rows = [
        (1, "http://bad.net/es/1", None), (2, "http://bad.net/about", link("es/1")), (3, "http://bad.net/x/y", link("../es/1")),
        (4, "http://e.org/a", link("//bad.net/es/1")), (5, "http://bad.net/es/2?a=1&b=2", None),
        (6, "http://f.org/", link("http://bad.net/es/2?a=1&amp;b=2")), (7, "http://g.org/v", link("1", "<base href='//bad.net/es/'>")),
        (8, "http://h.org/p", link("?p=2")), (9, "http://h.org/p?p=2", link("http://bad.net/es/1")), (10, "http://i.org/p", link("?p=2")),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    out = url_filter.judge(pages.drop("html"), rules, url_filter.links(pages)).collect()
    assert {r["page_id"]: r["verdict"] for r in out} == {i: "allow" if i == 10 else "block" for i in range(1, 11)}


def test_aliases(spark):
    link = '<html><head><LINK href="http://bad.net/es/9" rel="canonical"></head>'
    refresh = "<meta http-equiv='Refresh' content='0; url=/es/x'>"
    rows = [
        (1, "http://bad.net/es/1", None), (2, "http://a.org/1", link), (3, "https://A.org/1/?utm_source=f#top", ""),
        (4, "http://bad.net/es/9", ""), (5, "http://c.net/other", refresh), (6, "http://c.org/", "x"),
        (7, "http://www.example.com/en/1", ""), (8, "http://d.org/", '<link rel=canonical href=http://example.com/en/2>'),
        (9, "http://d.org", '<link rel="canonical" href="http://www.example.com/en/1">'), (10, None, None), (11, "junk", link),
    ]
    rows += [(12, "http://example.com/en/2", ""), (13, "http://c.net/es/x", "")]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"rule": F.lit(0), "node": F.lit(1), "row": F.lit(2)})
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    out = url_filter.judge(pages.drop("html"), rules, url_filter.links(pages)).collect()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in out}
    block, none = ("net/es/", "block"), (None, "allow")
    assert len(out) == len(rows) and all((r["node"], r["row"]) == (1, 2) for r in out)
    assert got == {
        1: block, 2: (None, "block"), 3: (None, "block"), 4: block, 5: (None, "block"), 6: none,
        7: ("www.example.com/en/", "allow"), 8: none, 9: none, 10: none, 11: none,
        12: ("example.com/en/", "block"), 13: block,
    }
    empty = url_filter.judge(pages.drop("html").limit(0), rules, url_filter.links(pages.limit(0)))
    assert empty.count() == 0
