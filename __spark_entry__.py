"""Registered queries: one per operator, over the shared test tables.

``queries()`` maps a name to ``f(spark, sf_dir) -> DataFrame``; ``oracle_sql()``
holds SQL with the same result for a check in DuckDB. Lists are shown as joined
strings and scores rounded to six digits, so both engines print the same values.
"""

from __future__ import annotations

from collections.abc import Callable

import oracles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import fixtures as T
from shelfmark.functions import decision as D
from shelfmark.functions import similarity as S
from shelfmark.functions import text as X
from shelfmark.operators import conversation as C
from shelfmark.operators import ingest as I
from shelfmark.operators import report as P
from shelfmark.operators import rerank as R
from shelfmark.operators import rewrite as W
from shelfmark.operators.postings import text_index
from shelfmark.operators.retrieve import store_index, text_search
from shelfmark.operators.upsert import latest_by_key, merge_by_key, merge_counts
from shelfmark.plans.build import build_catalog
from shelfmark.plans.search import search_documents, search_pass, two_pass_search
from shelfmark.schemas import CATALOG, LANGUAGES, PATHS, VALUES
from shelfmark.session import materialize, new_path
from shelfmark.sources import readers, writers
from shelfmark.streaming import ingest as ST

try:  # the corpus operators are a subpackage that can be left out
    import corpus_pipeline
    from shelfmark.llm import queries as corpus_queries
except ImportError as e:
    if e.name != "corpus_pipeline" and not (e.name or "").startswith("shelfmark.llm"):
        raise
    CORPUS_QUERIES, CORPUS_SQL = {}, {}
else:
    CORPUS_QUERIES = {**corpus_queries.queries(), "pipeline": corpus_pipeline.run}
    CORPUS_SQL = corpus_queries.oracle_sql()
    if corpus_pipeline.ORACLE_SQL:
        CORPUS_SQL = {**CORPUS_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}

# ------------------------------------------------------------------ inputs


def _build(spark, sf_dir):
    return build_catalog(T.products(spark, sf_dir))


def _records(spark, sf_dir):
    return I.filter_lang(T.products(spark, sf_dir))


def _valid(spark, sf_dir):
    return I.valid_products(_records(spark, sf_dir))


def _stored(spark, sf_dir):
    """Query batch and catalog as stored tables, as a search finds them."""
    queries = materialize(T.queries(spark, sf_dir), "queries")
    return queries, materialize(_build(spark, sf_dir).catalog(), "catalog")


def _ranked(spark, sf_dir):
    queries, catalog = _stored(spark, sf_dir)
    return queries, search_pass(queries, catalog, store_index(text_index(catalog)))


def _searched(spark, sf_dir):
    queries, catalog = _stored(spark, sf_dir)
    return two_pass_search(queries, catalog, W.lookup_rewriter(T.rewrites(spark, sf_dir)))


# ------------------------------------------------------------------ display


def _join(c, sep="|"):
    return F.array_join(c, sep)


def _show_lists(df):
    lists = [f.name for f in CATALOG.fields if f.dataType.typeName() == "array"]
    shown = {c: _join(c) for c in lists if c != "product_name"}
    names = F.transform("product_name", lambda n: F.concat(n["lang"], F.lit("="), n["text"]))
    return df.withColumns({**shown, "product_name": _join(names)})


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _show_ranked(df):
    return _round(
        df.select(
            "query_no",
            "_id",
            F.col("text_rank").cast("long").alias("text_rank"),
            "score",
            F.col("fuzzy_rank").cast("long").alias("fuzzy_rank"),
            "rapidfuzz_score",
            "given_name",
        ),
        "score",
        "rapidfuzz_score",
    )


def _show_hits(df):
    return df.select("query_no", "_id", F.col("text_rank").cast("long").alias("text_rank"), "score")


# ------------------------------------------------------- sources and sinks


def scan_products(spark, sf_dir):
    path = new_path(spark, "dump")
    T.products(spark, sf_dir).write.parquet(path)
    names = F.transform("product_name", lambda n: n["text"])
    return readers.read_products(spark, path).select(
        "seq", "code", "lang", "brands", "quantity", "categories", "labels", "popularity_key",
        "nutriscore_grade", "nutriscore_score", _join(names).alias("names"),
    )


def stream_ingest(spark, sf_dir):
    root = new_path(spark, "catalog")
    schema = T.table(spark, sf_dir, "part").schema
    parts = readers.stream_products(spark, sf_dir, "part.parquet", schema)
    ST.stream_catalog(
        T.products_from_part(parts), root, new_path(spark, "stream_state")
    ).awaitTermination()
    return _show_lists(writers.read_table(spark, root, CATALOG))


def _streamed(spark, sf_dir):
    """The folder of a streamed build: the dump arrives in three files without ``seq``, two runs take it."""
    dump, root, state = (new_path(spark, n) for n in ("dump", "build", "stream_state"))
    products = T.products(spark, sf_dir)
    lo, hi = products.agg(F.min("seq"), F.max("seq")).first()
    third = (hi - lo) // 3 + 1
    for i in range(3):
        part = products.filter(F.floor((F.col("seq") - lo) / third) == i).orderBy("seq").drop("seq")
        part.coalesce(1).write.mode("append").parquet(dump)
        if i:
            stream = readers.stream_products(spark, dump, max_files=1, arrival=True)
            ST.stream_build(stream, root, state).awaitTermination()
    return root


def _streamed_table(name, schema, *shown):
    return lambda s, d: writers.read_table(s, f"{_streamed(s, d)}/{name}", schema).select(*shown or "*")


def running_languages(spark, sf_dir):
    """Counts after two runs, with new files between them."""
    dump, root, state = (new_path(spark, n) for n in ("dump", "languages", "stream_state"))
    documents = T.table(spark, sf_dir, "documents").select("doc_id", "lang")
    for odd in (0, 1):
        documents.filter(F.pmod("doc_id", F.lit(2)) == odd).write.mode("append").parquet(dump)
        stream = readers.stream_products(spark, dump, schema=documents.schema, max_files=1)
        ST.stream_languages(stream, root, state).awaitTermination()
    return writers.read_table(spark, root, LANGUAGES)


def text_search_updated(spark, sf_dir):
    """A stored index of the older catalog, brought up to date by the build's documents."""
    queries = materialize(T.queries(spark, sf_dir), "queries")
    older = latest_by_key(I.catalog_project(T.older_products(spark, sf_dir)), "_id")
    index = store_index(text_index(older))
    index.update(text_index(_build(spark, sf_dir).catalog()))
    return _show_hits(text_search(queries, index))


def write_lists(spark, sf_dir):
    """The value lists as the sink wrote them."""
    path = new_path(spark, "lists")
    _build(spark, sf_dir).write_side_outputs(path)
    lists = None
    for name in ("unique_food_groups", "unique_categories"):
        part = spark.read.schema("value string").json(f"{path}/{name}").select(F.lit(name).alias("list"), "value")
        lists = part if lists is None else lists.unionByName(part)
    return lists


def write_paths(spark, sf_dir):
    path = new_path(spark, "lists")
    _build(spark, sf_dir).write_side_outputs(path)
    return spark.read.schema("name string, path string").json(f"{path}/unique_last_categories")


def build_without_store(spark, sf_dir):
    """No-store mode: everything is computed and nothing is written."""
    build = _build(spark, sf_dir)
    sizes = {
        "n_documents": build.catalog(), "n_food_groups": build.food_groups, "n_categories": build.categories,
        "n_paths": build.category_paths, "n_tree": build.category_tree, "n_rejected": build.rejected,
    }
    out = build.counts
    for name, df in sizes.items():  # one row each
        out = out.join(df.agg(F.count("*").alias(name)), F.lit(True))
    return out


def read_queries(spark, sf_dir):
    path = new_path(spark, "batch")
    T.receipt_lines(spark, sf_dir).orderBy("s_suppkey").select("line").write.text(path)
    return readers.read_queries(spark, path)


def read_report(spark, sf_dir):
    queries, catalog = _stored(spark, sf_dir)
    path = new_path(spark, "report")
    writers.write_report(two_pass_search(queries, catalog), path)
    return readers.read_report(spark, path)


def upsert_catalog(spark, sf_dir):
    root = new_path(spark, "catalog")
    older = I.catalog_project(T.older_products(spark, sf_dir))
    writers.upsert_table(older, root, CATALOG, "_id", "seq")
    writers.upsert_table(_build(spark, sf_dir).documents, root, CATALOG, "_id", "seq")
    return _show_lists(writers.read_table(spark, root, CATALOG))


def _trees(spark, sf_dir):
    older = build_catalog(T.older_products(spark, sf_dir), lang=None).category_tree
    return older, _build(spark, sf_dir).category_tree


def upsert_categories(spark, sf_dir):
    merged = merge_by_key(*_trees(spark, sf_dir), "name")
    return merged.select("name", _join("ancestors", " > ").alias("ancestors"))


def upsert_counts(spark, sf_dir):
    return merge_counts(*_trees(spark, sf_dir), "name")


def result_json(spark, sf_dir):
    result = _searched(spark, sf_dir)
    path = new_path(spark, "results")
    writers.write_results(result, path)
    schema = search_documents(result).schema
    best = F.col("best_match")

    def ids(ranking):
        return _join(F.col(f"{ranking}_search.results._id"))

    empty = F.lit("")
    return spark.read.schema(schema).json(path).select(
        "query_no",
        "input_string",
        "formatted_string",
        F.col("direct_search.count").cast("long").alias("direct_count"),
        F.col("rapidfuzz_search.count").cast("long").alias("fuzzy_count"),
        F.nullif(ids("direct"), empty).alias("direct_ids"),
        F.nullif(ids("rapidfuzz"), empty).alias("fuzzy_ids"),
        *[
            F.col(f"openai_level{n}.{f}").alias(f"level{n}_{f}")
            for n in (1, 2)
            for f in ("decision", "rephrased_query")
        ],
        "match_status",
        "match_confidence",
        F.round(best["score"], 6).alias("best_score"),
        best["product"]["given_name"].alias("best_name"),
    )


def _unnumbered(spark, sf_dir):
    """The dump in files without ``seq``, as real dumps come; read back in arrival order."""
    path = new_path(spark, "dump")
    T.products(spark, sf_dir).orderBy("seq").drop("seq").write.parquet(path)
    return build_catalog(readers.read_products(spark, path))


def write_conversations(spark, sf_dir):
    path = new_path(spark, "conversations")
    writers.write_conversations(T.messages(spark, sf_dir), path)
    schema = "model string, conv_id long, turn long, role string, content string, total_messages long"
    return spark.read.schema(schema).json(path)


def conversation_documents(spark, sf_dir):
    """Documents as written: their sizes and a digest of their messages in order."""
    path = new_path(spark, "documents")
    writers.write_conversation_documents(T.messages(spark, sf_dir), path)
    lines = F.transform("conversation", lambda m: F.concat_ws(":", m["role"], m["content"]))
    return writers.read_conversation_documents(spark, path).select(
        "model", "conv_id", "total_messages", F.md5(F.array_join(lines, "\n")).alias("digest")
    )


# ------------------------------------------------------------ catalog build


def split_lists(spark, sf_dir):
    return T.products(spark, sf_dir).select(
        "seq",
        _join(X.split_list("categories")).alias("categories"),
        F.size(X.split_list("categories")).cast("long").alias("n_categories"),
        _join(X.list_items("categories")).alias("non_blank"),
        _join(X.split_list("labels")).alias("labels"),
    )


def category_tree(spark, sf_dir):
    return _build(spark, sf_dir).category_tree.select(
        "name",
        _join("ancestors", " > ").alias("ancestors"),
        F.size("ancestors").cast("long").alias("n_ancestors"),
    )


def clean_tags(spark, sf_dir):
    tags = T.products(spark, sf_dir).select(F.explode("categories_tags").alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).select(
        "tag", X.clean_tag("tag").alias("cleaned"), "n"
    )


# ------------------------------------------------------------------- search


def search_batch(spark, sf_dir):
    queries, catalog = _stored(spark, sf_dir)
    return queries, text_search(queries, store_index(text_index(catalog)))


def text_search_documents(spark, sf_dir):
    index = store_index(text_index(T.documents_as_catalog(spark, sf_dir)))
    return _show_hits(text_search(T.benchmark_queries(spark, sf_dir), index))


def field_scores(spark, sf_dir):
    scores = [f"{f}_score" for f in ("names", "brands", "categories", "labels", "quantity")]
    return _round(_ranked(spark, sf_dir)[1].select("query_no", "_id", *scores), *scores)


def _answered(spark, sf_dir, rewriter=None):
    rewriter = rewriter or W.lookup_rewriter(T.rewrites(spark, sf_dir))
    return W.rewrite_queries(W.route_queries(*_ranked(spark, sf_dir)), rewriter)


def rewrite_queries(spark, sf_dir):
    return _answered(spark, sf_dir).select(
        "query_no", "route",
        *[f"level{n}_{f}" for n in (1, 2) for f in ("model", "decision", "rephrased_query", "error")],
        "next_query",
    )


def rewrite_queries_offline(spark, sf_dir):
    return _answered(spark, sf_dir, W.offline_rewriter).select(
        "query_no", "route", "level1_decision", "level1_error", "level2_decision",
        "level2_error", "next_query",
    )


def rewrite_prompt(spark, sf_dir):
    asked = _answered(spark, sf_dir).filter(F.col("route") != W.DONE)
    level2 = D.rewrite_prompt("input_string", "top", "level1_decision", "level1_rephrased_query")
    return asked.withColumn("top", F.when(F.col("n_hits") > 0, F.col("top_name"))).select(
        "query_no",
        D.rewrite_prompt("input_string", "top").alias("level1_prompt"),
        F.when(F.col("level2_model").isNotNull(), level2).alias("level2_prompt"),
    )


def parse_decision(spark, sf_dir):
    answers = T.answers(spark, sf_dir)
    return answers.select("conv_id", "turn", D.parse_decision("content", 1).alias("r")).select(
        "conv_id", "turn", "r.*"
    )


def _ratio(function):
    def run(spark, sf_dir):
        pairs = T.sold_names(spark, sf_dir)
        return _round(pairs.withColumn("ratio", function("a", "b")), "ratio")

    return run


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the classified best match of every line of a receipt batch."""
    queries, ranked = _ranked(spark, "/root/testdata/sf0.001")
    return R.match_status(queries, ranked)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "scan_products": scan_products,
        "stream_ingest": stream_ingest,
        "stream_by_arrival": lambda s, d: _show_lists(_streamed_table("catalog", CATALOG)(s, d)),
        "stream_category_paths": _streamed_table("category_paths", PATHS),
        "stream_tags": _streamed_table("food_groups", VALUES),
        "stream_categories": _streamed_table("categories", VALUES),
        "stream_counts": lambda s, d: ST.stream_counts(s, _streamed(s, d)),
        "running_languages": running_languages,
        "text_search_updated": text_search_updated,
        "write_lists": write_lists,
        "write_paths": write_paths,
        "build_without_store": build_without_store,
        "read_queries": read_queries,
        "read_report": read_report,
        "upsert_catalog": upsert_catalog,
        "upsert_categories": upsert_categories,
        "upsert_counts": upsert_counts,
        "result_json": result_json,
        "batch_report": lambda s, d: P.batch_report(_searched(s, d)),
        "conversation_export": lambda s, d: C.conversation_export(T.messages(s, d)),
        "write_conversations": write_conversations,
        "conversation_documents": conversation_documents,
        "category_paths_by_arrival": lambda s, d: _unnumbered(s, d).category_paths,
        "catalog_by_arrival": lambda s, d: _show_lists(_unnumbered(s, d).catalog()),
        "unanswered_turns": lambda s, d: C.unanswered_turns(T.messages(s, d)).drop("role"),
        "filter_lang": lambda s, d: I.filter_lang(T.table(s, d, "documents"), "fr").drop("text"),
        "valid_products": lambda s, d: _valid(s, d).select("seq", "code", "categories"),
        "rejected_products": lambda s, d: I.rejected_products(_records(s, d)).select(
            "seq", "code", "categories"
        ),
        "catalog_project": lambda s, d: _show_lists(_build(s, d).documents),
        "split_lists": split_lists,
        "search_text": lambda s, d: T.products(s, d).select(
            "seq", X.search_text().alias("search_string")
        ),
        "route_queries": lambda s, d: _round(
            W.route_queries(*_ranked(s, d)).drop("input_string"), "best_score"
        ),
        "text_search": lambda s, d: _show_hits(search_batch(s, d)[1]),
        "text_search_documents": text_search_documents,
        "fuzzy_rerank": lambda s, d: _show_ranked(_ranked(s, d)[1]),
        "rewrite_queries": rewrite_queries,
        "rewrite_queries_offline": rewrite_queries_offline,
        "lang_distribution": lambda s, d: I.lang_distribution(T.table(s, d, "documents")),
        "lang_distribution_products": lambda s, d: _build(s, d).languages,
        "distinct_tags": lambda s, d: _build(s, d).food_groups,
        "distinct_categories": lambda s, d: _build(s, d).categories,
        "category_paths": lambda s, d: _build(s, d).category_paths,
        "category_tree": category_tree,
        "ingest_counts": lambda s, d: _build(s, d).counts,
        "best_match": lambda s, d: _round(R.best_match(_ranked(s, d)[1]), "best_score"),
        "hit_counts": lambda s, d: R.hit_counts(*search_batch(s, d)),
        "field_scores": field_scores,
        "report_counts": lambda s, d: P.report_counts(P.report_rows(_searched(s, d))),
        "top_results": lambda s, d: _round(
            R.top_results(_ranked(s, d)[1]), "text_score", "fuzzy_score"
        ),
        "top3_summary": lambda s, d: _round(
            R.top_summary(_ranked(s, d)[1]), "score", "rapidfuzz_score"
        ).withColumn("rank", F.col("rank").cast("long")),
        "format_query": lambda s, d: T.receipt_lines(s, d).select(
            "s_suppkey", X.format_query("line").alias("formatted")
        ),
        "format_query_documents": lambda s, d: T.table(s, d, "documents").select(
            "doc_id", X.format_query("text").alias("formatted")
        ),
        "product_names": lambda s, d: T.products(s, d).select(
            "seq",
            _join(X.product_names("product_name")).alias("names"),
            F.size(X.product_names("product_name")).cast("long").alias("n_names"),
        ),
        "given_name": lambda s, d: T.products(s, d).select(
            "seq", X.given_name(X.split_list("categories"), "product_name").alias("given_name")
        ),
        "clean_tags": clean_tags,
        "rewrite_prompt": rewrite_prompt,
        "parse_decision": parse_decision,
        "token_sort_ratio": _ratio(S.token_sort_ratio),
        "partial_ratio": _ratio(S.partial_ratio),
        "two_pass_search": lambda s, d: _show_ranked(_searched(s, d).hits),
        "match_status": lambda s, d: _round(R.match_status(*_ranked(s, d)), "best_score"),
        **CORPUS_QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return {**oracles.oracle_sql(), **CORPUS_SQL}

