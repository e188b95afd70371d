"""Registered queries of the numbered operators, and their DuckDB texts."""

from pyspark.sql import functions as F

from shelfmark.llm import ann, bpe, conversation_repair, fingerprint, langid, mixing, quality, toxicity
from shelfmark.llm import url_filter, warc, whitening
from shelfmark.llm.near_dedup import near_duplicates
from shelfmark.llm.substring_dedup import dedup_substrings
from shelfmark.session import new_path

#: (host, path, verdict)
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path():
    """The published byte-level BPE file; its package is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_bpe(spark, sf_dir):
    path = vocabulary_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, path).select("doc_id", "ids")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return bpe.decode(coded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_source_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.schedule(docs).select("doc_id", "source", "slot", "place")


def op5_near_dedup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    held_out = F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


def op7_nearest_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op8_warc(spark, sf_dir):
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return warc.read_archives(manifest).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = fingerprint.add_fingerprint(docs, "text", "fingerprint")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = fingerprint.with_next(docs, "doc_id", ["text", "fingerprint"], parts)
    rows = rows.withColumn("edited", fingerprint.edited_text(F.col("text"), F.col("next.text")))
    rows = fingerprint.add_fingerprint(rows, "edited", "edited_fingerprint")
    own = F.col("fingerprint")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        fingerprint.likeness(own, F.col("edited_fingerprint")).alias("near_edited"),
        fingerprint.likeness(own, F.col("next.fingerprint")).alias("near_next"),
    )


def op10_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(pages.select("page_id", "url"), rules, url_filter.links(pages))


def op11_conversation_repair(spark, sf_dir):
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def queries():
    return {
        "op1_toxicity": op1_toxicity,
        "op2_bpe": op2_bpe,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_source_mixing": op4_source_mixing,
        "op5_near_dedup": op5_near_dedup,
        "op6_language_id": op6_language_id,
        "op7_nearest_neighbours": op7_nearest_neighbours,
        "op8_warc": op8_warc,
        "op9_fingerprints": op9_fingerprints,
        "op10_url_filter": op10_url_filter,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_whitening": op12_whitening,
        "op13_quality": op13_quality,
    }


# Base32 of a hexadecimal digest: five digits are four letters.
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(key, CAST(i // 4 * 5 + 1 AS BIGINT), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '')"""

_OP8 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS key FROM p),
f AS (SELECT key, min(page_id) AS first_id FROM d GROUP BY key),
r AS (SELECT d.*, first_id, first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again
      FROM d JOIN f USING (key))
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM r
"""

_CANONICAL = """(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*\\bhref\\s*=\\s*["'']?([^"''\\s>]+)"""
_REFRESH = """(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*\\burl\\s*=\\s*["'']?([^"''\\s>]+)"""


def _sql_rest(url):
    return f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"


def _sql_host(url):
    return f"translate(regexp_extract({_sql_rest(url)}, '^[^/?#]*'), '{url_filter._UPPER}', '{url_filter._LOWER}')"


def _sql_path(url):
    return f"regexp_extract({_sql_rest(url)}, '^[^/?#]*([^?#]*)', 1)"


def _sql_node(url):
    query = f"regexp_extract({_sql_rest(url)}, '^[^?#]*\\?([^#]*)', 1)"
    kept = f"list_filter(string_split({query}, '&'), lambda x: NOT starts_with(x, 'utm_') AND x <> '')"
    return (
        f"CASE WHEN instr({url}, '://') > 0 THEN {_sql_host(url)} || rtrim({_sql_path(url)}, '/') || '?'"
        f" || array_to_string({kept}, '&') END"
    )


_OP10 = f"""
WITH RECURSIVE rules(host, path, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
p AS (SELECT page_id, url, html, coalesce({_sql_host("url")}, '') AS host,
             coalesce({_sql_path("url")}, '') AS path, {_sql_node("url")} AS node
      FROM pages),
t AS (SELECT node, host, unnest([regexp_extract(html, '{_CANONICAL}', 1), regexp_extract(html, '{_REFRESH}', 1)]) AS dest
      FROM p WHERE html IS NOT NULL),
a AS (SELECT node, CASE WHEN starts_with(dest, '/') THEN 'http://' || host || dest ELSE dest END AS dest
      FROM t WHERE dest <> ''),
e AS (SELECT node AS u, {_sql_node("dest")} AS v FROM a),
both_ways AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v),
reach AS (SELECT node AS a, node AS b FROM p WHERE node IS NOT NULL
          UNION SELECT r.a, w.v FROM reach r JOIN both_ways w ON r.b = w.u),
c AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
fit AS (SELECT DISTINCT p.host, p.path, r.host || r.path AS rule, r.verdict
        FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
best AS (SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
         FROM fit GROUP BY host, path),
q AS (SELECT p.page_id, p.host, p.path, c.component, best.rule, best.verdict
      FROM p LEFT JOIN best USING (host, path) LEFT JOIN c USING (node)),
d AS (SELECT component, min(verdict) AS verdict FROM q WHERE component IS NOT NULL AND rule IS NOT NULL GROUP BY component)
SELECT page_id, host, path, q.rule, coalesce(q.verdict, d.verdict, 'allow') AS verdict
FROM q LEFT JOIN d USING (component)
"""

# Words, windows and hashes as the contract states them, with no seeds and no extension.
_OP3 = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
k AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM win),
again AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
cut AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM k SEMI JOIN again USING (h)),
g AS (SELECT r, list(i) AS gone FROM cut GROUP BY r),
f AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (r)),
j AS (SELECT doc_id, len(w) AS n, len(gone) AS m,
             CASE WHEN len(gone) = 0 THEN w
                  ELSE list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(gone, x)), lambda x: w[x])
             END AS kept FROM f)
SELECT doc_id, n AS n_words, CAST(m AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM j
"""

# Every pair of documents with a common shingle, and the closure of the links.
_OP5 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter._UPPER}', '{url_filter._LOWER}'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w
         ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
      FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id,
       coalesce(b, doc_id) >= doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def oracle_sql():
    return {"op3_substring_dedup": _OP3, "op5_near_dedup": _OP5, "op8_warc": _OP8, "op10_url_filter": _OP10}
