"""DuckDB SQL for checking the registered queries.

Each text states the definition directly (every query term joined with every
document term, every window of every pair), without the shortcuts of the Spark
plans, over whole tables.
"""

from shelfmark import constants as K

WS = K.WHITESPACE
TRUE_PREFIX = K.TAXONOMY_PREFIX


def strip(x):
    return f"trim({x}, '{WS}')"


def non_blank(x):
    return (
        f"list_filter(list_transform(coalesce({x}, []), lambda e: {strip('e')}),"
        " lambda e: coalesce(e, '') <> '')"
    )


def list_items(x):
    return non_blank(f"string_split({x}, ',')")


def split_list(x):
    return (
        f"CASE WHEN coalesce({x}, '') = '' THEN []::VARCHAR[]"
        f" ELSE list_transform(string_split({x}, ','), lambda e: {strip('e')}) END"
    )


def usable(c):
    return (
        f"(CASE WHEN starts_with(lower({c}), 'pl:') THEN length({c}) > 3"
        f" ELSE NOT contains({c}, ':') END)"
    )


def names(x):
    texts = f"list_filter(list_transform({x}, lambda n: n.text), lambda t: coalesce(t, '') <> '')"
    first_seen = "lambda t, i: list_position({0}, t) = i"
    return f"list_filter({texts}, {first_seen.format(texts)})"


def valid(p="product_name", c="categories"):
    named = f"len(list_filter({p}, lambda n: coalesce({strip('n.text')}, '') <> '')) > 0"
    placed = f"len(list_filter({list_items(c)}, lambda e: {usable('e')})) > 0"
    return f"(coalesce({named}, false) AND coalesce({placed}, false))"


def given_name(c="categories", p="product_name"):
    last = f"list_filter({non_blank(c)}, lambda e: {usable('e')})[-1]"
    named = f"list_filter({p}, lambda n: coalesce(n.text, '') <> '')"
    return f"""coalesce(
        CASE WHEN starts_with(lower({last}), 'pl:') THEN substring({last}, 4) ELSE {last} END,
        (list_filter({named}, lambda n: n.lang = 'main')[1]).text, ({named}[1]).text, '')"""


def format_query(x):
    lo, up = K.LOWER_LETTERS, K.UPPER_LETTERS
    out = f"translate(coalesce({x}, ''), ',;', '  ')"
    for pattern in (
        f"([{lo}])([{up}])",
        f"([{up}]+)([{up}][{lo}])",
        f"([{lo}{up}])(\\p{{Nd}})",
        f"(\\p{{Nd}})([{lo}{up}])",
    ):
        out = f"regexp_replace({out}, '{pattern}', '\\1 \\2', 'g')"
    return strip(f"regexp_replace(lower({out}), '[{WS}]+', ' ', 'g')")


def tokens(x):
    folded = f"translate(lower({x}), '{K.FOLD_FROM}', '{K.FOLD_TO}')"
    return (
        f"list_filter(regexp_split_to_array({folded}, '[^\\p{{L}}\\p{{N}}]+'),"
        " lambda t: t <> '')"
    )


def search_text():
    parts = ", ".join(f"nullif({c}, '')" for c in ("quantity", "brands", "categories", "labels"))
    return (
        f"translate(lower(concat_ws(' ', array_to_string({names('product_name')}, ' '),"
        f" {parts})), ',', ' ')"
    )


def joined(x, sep="|"):
    return f"array_to_string({x}, '{sep}')"


# ---------------------------------------------------------------- test tables

PRODUCTS = """products AS (
  SELECT p_partkey AS seq,
    lpad(CAST(p_partkey - CASE WHEN p_partkey % 10 = 2 THEN 2 ELSE 0 END AS VARCHAR), 13, '0') AS code,
    CASE p_partkey % 4 WHEN 3 THEN 'en' ELSE 'pl' END AS lang,
    [{'lang': 'main', 'text': p_name}, {'lang': 'pl', 'text': upper(p_name)},
     {'lang': 'en', 'text': p_name}] AS product_name,
    p_brand AS brands,
    concat(CAST(p_size AS VARCHAR), ' g') AS quantity,
    CAST(p_size AS VARCHAR) AS product_quantity,
    'g' AS product_quantity_unit,
    CASE p_partkey % 6
      WHEN 0 THEN concat('Goods,', p_type, ',', p_name)
      WHEN 1 THEN 'en:goods,fr:biens'
      WHEN 2 THEN concat('Goods,pl:', lower(p_type))
      WHEN 3 THEN ''
      WHEN 4 THEN concat('Goods, ,', p_type, ',') END AS categories,
    CASE WHEN p_size % 2 = 0 THEN [concat('en:', lower(p_type)), 'en:all-goods'] END AS categories_tags,
    CASE WHEN p_size > 25 THEN 'Large,Bulk' END AS labels,
    CASE WHEN p_size > 25 THEN ['en:large', 'en:bulk'] END AS labels_tags,
    CASE WHEN p_size % 3 = 0 THEN [concat('en:', lower(p_type))] END AS food_groups_tags,
    p_partkey * 7 AS popularity_key,
    CASE WHEN p_size % 5 = 0 THEN ['top-75-percent'] END AS popularity_tags,
    CASE WHEN p_size < 10 THEN 'a' WHEN p_size < 30 THEN 'c' END AS nutriscore_grade,
    CAST(p_size - 15 AS BIGINT) AS nutriscore_score
  FROM part)"""

OLDER = """older AS (SELECT * REPLACE (concat(product_quantity, ' oz') AS quantity,
    replace(replace(categories, 'Goods', 'Wares'), 'PROMO', 'OFFER') AS categories)
  FROM products WHERE lang = 'en' OR labels IS NULL)"""

RECORDS = "records AS (SELECT * FROM products WHERE lang = 'pl')"
VALID = f"valid AS (SELECT * FROM records WHERE {valid()})"

_PLAIN = ["lang", "product_name", "brands", "food_groups_tags", "product_quantity_unit"]
_PLAIN += ["product_quantity", "quantity", "categories_tags", "labels_tags", "popularity_key"]
_PLAIN += ["popularity_tags", "nutriscore_grade", "nutriscore_score"]


def project(source):
    return (
        f"SELECT seq, code AS _id, {', '.join(_PLAIN)}, {split_list('categories')} AS categories,"
        f" {split_list('labels')} AS labels, {search_text()} AS search_string FROM {source}"
    )


DOCS = f"docs AS ({project('valid')})"
CATALOG = """catalog AS MATERIALIZED (SELECT * EXCLUDE (seq) FROM docs
  QUALIFY row_number() OVER (PARTITION BY _id ORDER BY seq DESC) = 1)"""

BUILD = [PRODUCTS, RECORDS, VALID, DOCS, CATALOG]

_CAMEL = (
    "list_reduce(list_transform(string_split(p_name, ' '),"
    " lambda w: concat(upper(w[1]), lower(w[2:]))), lambda a, b: concat(a, b))"
)
LINES = f"""receipt_lines AS (
  SELECT s_suppkey, CASE s_suppkey % 8
    WHEN 0 THEN concat({_CAMEL}, p_size, 'g')
    WHEN 1 THEN concat('  ', p_name, ' ')
    WHEN 2 THEN concat({_CAMEL}, ';', p_size, ' g')
    WHEN 3 THEN concat(p_name, ' ', p_brand)
    WHEN 4 THEN concat(string_split(p_name, ' ')[1], ' ', lower(p_type))
    WHEN 5 THEN upper(replace(p_name, ' ', ','))
    WHEN 6 THEN CASE WHEN p_size % 2 = 0 THEN 'xyzzy' ELSE '   ' END
    ELSE concat(p_name, ' ', p_brand, ' ', p_type, ' ', p_size, ' g') END AS line
  FROM supplier
  JOIN (SELECT l_suppkey, l_partkey FROM lineitem QUALIFY row_number() OVER (
          PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) = 1) AS o
    ON l_suppkey = s_suppkey
  JOIN part ON p_partkey = l_partkey)"""
QUERIES = """queries AS MATERIALIZED (
  SELECT s_suppkey + 1 AS query_no, trim(line) AS input_string
  FROM receipt_lines WHERE trim(line) <> '')"""
REWRITES = f"""rewrites AS (
  WITH strings AS (SELECT trim(line) AS input_string, min(s_suppkey) AS no
                   FROM receipt_lines WHERE trim(line) <> '' GROUP BY 1)
  SELECT 1 AS level, input_string,
    CASE no % 5 WHEN 0 THEN '{K.REPHRASED}' WHEN 1 THEN '{K.NOT_A_PRODUCT}'
      WHEN 2 THEN '{K.VALID_PRODUCT}' WHEN 3 THEN '{K.NO_MATCH_FOUND}'
      ELSE '{K.REPHRASED}' END AS decision,
    CASE no % 5 WHEN 0 THEN concat(input_string, ' red plate Brand#1') WHEN 4 THEN '' END AS rephrased_query
  FROM strings
  UNION ALL
  SELECT 2, input_string,
    CASE no % 3 WHEN 0 THEN '{K.REPHRASED}' WHEN 1 THEN '{K.NO_MATCH_FOUND}' ELSE '{K.VALID_PRODUCT}' END,
    CASE no % 3 WHEN 0 THEN concat('promo ', input_string) END
  FROM strings)"""
SOLD = """sold AS (SELECT DISTINCT trim(line) AS a, p_name AS b
  FROM receipt_lines JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey
  WHERE trim(line) <> '')"""
_QUOTED = "to_json({{'decision': '{}', 'rephrased_query': text}})"
ANSWERS = f"""answers AS (SELECT conv_id, turn, CASE (conv_id + turn) % 8
    WHEN 0 THEN concat('Answer: ', {_QUOTED.format(K.REPHRASED)}, ' done.')
    WHEN 1 THEN CAST(to_json({{'rephrased_query': text}}) AS VARCHAR)
    WHEN 2 THEN '{{"decision": null, "rephrased_query": null}}'
    WHEN 3 THEN concat(text, ' NOT_A_PRODUCT, not valid')
    WHEN 4 THEN concat('{{broken ', text, '}}')
    WHEN 5 THEN concat(text, ' improved')
    WHEN 6 THEN concat(text, ' looks invalid')
    ELSE concat('{{"decision": "valid_product"}} or ', text, ' {{}}') END AS content
  FROM conversations)"""
MESSAGES = f"""messages AS (
  SELECT CASE conv_id % 2 WHEN 0 THEN '{K.LEVEL_MODELS[1]}' ELSE '{K.LEVEL_MODELS[2]}' END AS model,
    conv_id, turn, role, text AS content FROM conversations)"""


def with_(ctes, body):
    return f"WITH {', '.join(ctes)}\n{body}"


# --------------------------------------------------------------------- search


def text_search(queries, docs, tag=""):
    """CTEs ending in hits<tag>(query_no, _id, score, text_rank)."""
    k1, b = K.BM25_K1, K.BM25_B
    return [
        f"terms{tag} AS MATERIALIZED (SELECT _id, {tokens('search_string')} AS ts FROM {docs})",
        f"size{tag} AS (SELECT count(*) AS n, sum(len(ts)) / count(*) AS mean FROM terms{tag})",
        f"""tf{tag} AS (SELECT _id, dl, token, count(*) AS tf FROM (
              SELECT _id, len(ts) AS dl, unnest(ts) AS token FROM terms{tag}) GROUP BY ALL)""",
        f"df{tag} AS (SELECT token, count(*) AS df FROM tf{tag} GROUP BY token)",
        f"""qt{tag} AS (SELECT DISTINCT query_no, unnest({tokens(format_query('input_string'))}) AS token
              FROM {queries})""",
        f"""scored{tag} AS (SELECT query_no, _id, round(sum(
                ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
                * (tf * ({k1}::DOUBLE + 1.0::DOUBLE) / (tf + {k1}::DOUBLE
                   * (1.0::DOUBLE - {b}::DOUBLE + {b}::DOUBLE * dl / mean)))), {K.SCORE_DIGITS}) AS score
              FROM qt{tag} JOIN df{tag} USING (token) JOIN tf{tag} USING (token), size{tag}
              GROUP BY query_no, _id)""",
        f"""hits{tag} AS MATERIALIZED (SELECT *, row_number() OVER (
                PARTITION BY query_no ORDER BY score DESC, _id) AS text_rank
              FROM scored{tag} QUALIFY text_rank <= {K.TOP_K})""",
    ]


def _sorted(x):
    return f"array_to_string(list_sort({non_blank_words(x)}), ' ')"


def non_blank_words(x):
    return f"list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda w: w <> '')"


def _masks(short, long):
    bit = f"CASE WHEN {short}[i] = c THEN 1::BIGINT << (i - 1)::INT ELSE 0::BIGINT END"
    return (
        f"list_transform(string_split({long}, ''), lambda c: list_reduce("
        f"range(1, length({short}) + 1), lambda acc, i: acc | {bit}, 0::BIGINT))"
    )


def _lcs(masks, m):
    """LCS of a string of m <= 62 characters with the characters behind the masks."""
    full = f"((1::BIGINT << ({m})::INT) - 1)"
    return (
        f"(({m}) - bit_count(list_reduce({masks}, lambda v, x:"
        f" ((v + (v & x)) | (v - (v & x))) & {full}, {full})))"
    )


def _windows(masks, m, n):
    lo, hi = "greatest(w, 0)", f"least(w + {m}, {n})"
    lcs = _lcs(f"list_slice({masks}, {lo} + 1, {hi})", m)
    return (
        f"list_max(list_transform(range(1 - {m}, {n}),"
        f" lambda w: 200.0::DOUBLE * {lcs} / ({m} + {hi} - {lo})))"
    )


def pair_scores(pairs, tag=""):
    """CTEs ending in pair_scores<tag>(q, t, token_sort, partial) for non-empty pairs."""
    return [
        f"""oriented{tag} AS (SELECT q, t,
              CASE WHEN length(q) <= length(t) THEN q ELSE t END AS s,
              CASE WHEN length(q) <= length(t) THEN t ELSE q END AS l,
              {_sorted('q')} AS qs, {_sorted('t')} AS ts
            FROM {pairs} WHERE q <> '' AND t <> '')""",
        f"""masked{tag} AS (SELECT *, {_masks('s', 'l')} AS sl,
              CASE WHEN length(s) = length(l) THEN {_masks('l', 's')} END AS ls,
              CASE WHEN length(qs) <= length(ts) THEN {_masks('qs', 'ts')} ELSE {_masks('ts', 'qs')} END AS st
            FROM oriented{tag})""",
        f"""pair_scores{tag} AS MATERIALIZED (SELECT q, t,
              200.0::DOUBLE * {_lcs('st', 'least(length(qs), length(ts))')}
                / (length(qs) + length(ts)) AS token_sort,
              greatest({_windows('sl', 'length(s)', 'length(l)')},
                CASE WHEN ls IS NOT NULL THEN {_windows('ls', 'length(s)', 'length(l)')} ELSE 0 END) AS partial
            FROM masked{tag})""",
    ]


def fuzzy(hits, queries, tag=""):
    """CTEs ending in ranked<tag>: hits with catalog fields, field scores and fuzzy_rank."""
    tags = "list_filter(coalesce(categories_tags, []), lambda x: coalesce(x, '') <> '')"
    cleaned = (
        f"list_transform({tags}, lambda x: translate(regexp_replace(x, '^[a-z]{{2}}:', ''), '-', ' '))"
    )
    lists = {
        "names": names("product_name"),
        "brands": "[coalesce(brands, '')]",
        "categories": non_blank("categories"),
        "tags": cleaned,
        "labels": non_blank("labels"),
        "quantity": "[coalesce(quantity, '')]",
    }
    texts = " UNION ALL ".join(
        f"SELECT query_no, _id, q, '{field}' AS field, unnest(x) AS t, generate_subscripts(x, 1) - 1 AS i"
        f" FROM (SELECT query_no, _id, q, {x} AS x FROM found{tag})"
        for field, x in lists.items()
    )

    def best(*fields):
        chosen = ", ".join(f"'{f}'" for f in fields)
        return f"coalesce(max(s) FILTER (field IN ({chosen})), 0.0::DOUBLE)"

    w = {k: f"{v}::DOUBLE" for k, v in K.FIELD_WEIGHTS.items()}
    return [
        f"""found{tag} AS MATERIALIZED (SELECT h.*, input_string, lower(input_string) AS q,
              c.* EXCLUDE (_id) FROM {hits} AS h JOIN {queries} USING (query_no) JOIN catalog AS c USING (_id))""",
        f"texts{tag} AS MATERIALIZED (SELECT * REPLACE (lower(t) AS t) FROM ({texts}))",
        f"pairs{tag} AS (SELECT DISTINCT q, t FROM texts{tag})",
        *pair_scores(f"pairs{tag}", tag),
        f"""weighed{tag} AS (SELECT query_no, _id, field, CASE WHEN field = 'categories'
              THEN greatest(token_sort, partial) * (1.0::DOUBLE + i * {K.SPECIFICITY_STEP}::DOUBLE)
              ELSE greatest(token_sort, partial) END AS s
            FROM texts{tag} JOIN pair_scores{tag} USING (q, t))""",
        f"""fields{tag} AS (SELECT query_no, _id, {best('names')} AS names_score,
              {best('brands')} AS brands_score,
              least({best('categories', 'tags')}, {K.MAX_FIELD_SCORE}::DOUBLE) AS categories_score,
              {best('labels')} AS labels_score, {best('quantity')} AS quantity_score
            FROM weighed{tag} GROUP BY query_no, _id)""",
        f"""totals{tag} AS (SELECT *, names_score * {w['names']} + brands_score * {w['brands']}
              + categories_score * {w['categories']} + labels_score * {w['labels']}
              + quantity_score * {w['quantity']} AS rapidfuzz_score FROM fields{tag})""",
        f"""ranked{tag} AS MATERIALIZED (SELECT *, {given_name()} AS given_name, row_number() OVER (
                PARTITION BY query_no ORDER BY rapidfuzz_score DESC, text_rank) AS fuzzy_rank
              FROM found{tag} JOIN totals{tag} USING (query_no, _id))""",
    ]


SEARCH = [*BUILD, LINES, QUERIES, *text_search("queries", "catalog")]
RERANK = [*SEARCH, *fuzzy("hits", "queries")]

ROUTED = f"""routed AS MATERIALIZED (SELECT query_no, input_string, coalesce(n, 0) AS n_hits, best_score, top_name,
    CASE WHEN n IS NULL THEN 'level-1, no hits' WHEN best_score < {K.SCORE_THRESHOLD} THEN 'level-1'
         ELSE 'done' END AS route
  FROM queries LEFT JOIN (SELECT query_no, count(*) AS n, max(rapidfuzz_score) AS best_score,
      max(CASE WHEN fuzzy_rank = 1 THEN given_name END) AS top_name FROM ranked GROUP BY query_no)
    USING (query_no))"""


def _good(d, r):
    return f"(coalesce({d}, '') = '{K.REPHRASED}' AND coalesce({r}, '') <> '')"


def rewritten(rewrites=True):
    """CTEs ending in answered(…, level1_*, level2_*, next_query)."""

    def asked(level, condition):
        join = f"LEFT JOIN rewrites AS r ON r.level = {level} AND r.input_string = b.input_string"
        decision, query = "r.decision", "r.rephrased_query"
        missing = "r.input_string IS NULL"
        error = "NULL::VARCHAR"
        if not rewrites:
            join, decision, query, missing = "", "NULL", "NULL::VARCHAR", "true"
            error = f"'{K.OFFLINE_ERROR}'"
        p = f"level{level}"
        return f"""SELECT b.*,
            CASE WHEN {condition} THEN '{K.LEVEL_MODELS[level]}' END AS {p}_model,
            CASE WHEN {condition} THEN CASE WHEN {missing} THEN '{K.NO_MATCH_FOUND}' ELSE {decision} END END AS {p}_decision,
            CASE WHEN {condition} THEN {query} END AS {p}_rephrased_query,
            CASE WHEN {condition} THEN {error} END AS {p}_error
          FROM {'routed' if level == 1 else 'first_answers'} AS b {join}"""

    settled = (
        f"({_good('level1_decision', 'level1_rephrased_query')}"
        f" OR coalesce(level1_decision IN ('{K.NOT_A_PRODUCT}', '{K.VALID_PRODUCT}'), false))"
    )
    return [
        ROUTED,
        f"first_answers AS ({asked(1, 'route <> ' + repr('done'))})",
        f"second_answers AS ({asked(2, 'route = ' + repr('level-1') + ' AND NOT ' + settled)})",
        f"""answered AS MATERIALIZED (SELECT *,
              CASE WHEN {_good('level1_decision', 'level1_rephrased_query')} THEN level1_rephrased_query
                   WHEN {_good('level2_decision', 'level2_rephrased_query')} THEN level2_rephrased_query END AS next_query
            FROM second_answers)""",
    ]


ANSWERED = [*RERANK, REWRITES, *rewritten()]
TWO_PASS = [
    *ANSWERED,
    """again AS MATERIALIZED (SELECT query_no, next_query AS input_string FROM answered
        WHERE next_query IS NOT NULL)""",
    *text_search("again", "catalog", "2"),
    *fuzzy("hits2", "again", "2"),
    """final AS MATERIALIZED (SELECT * FROM ranked WHERE query_no NOT IN (SELECT query_no FROM again)
        UNION ALL BY NAME SELECT * FROM ranked2)""",
]


def status(queries, ranked):
    t = K.SCORE_THRESHOLD
    return f"""SELECT query_no, q.input_string,
        CASE WHEN rapidfuzz_score >= {t} THEN 'successful' WHEN rapidfuzz_score IS NOT NULL
             THEN 'low_confidence' ELSE 'no_match' END AS match_status,
        CASE WHEN rapidfuzz_score >= {t} THEN 'high' WHEN rapidfuzz_score IS NOT NULL
             THEN 'low' ELSE 'none' END AS match_confidence,
        rapidfuzz_score AS best_score,
        CASE WHEN rapidfuzz_score IS NOT NULL THEN {t}::DOUBLE END AS threshold, _id, given_name
      FROM {queries} AS q LEFT JOIN (SELECT * EXCLUDE (input_string) FROM {ranked} WHERE fuzzy_rank = 1)
        USING (query_no)"""


def report(queries, ranked):
    """CTE report(query_no, type_order, <seven columns>)."""
    cols = K.REPORT_COLUMNS

    def row(order, label, source, name, score, id_, cats, prods):
        values = [f"concat(a.query_no, '.{label}')", "a.input_string", name, score, id_, cats, prods]
        shown = ", ".join(
            f"coalesce({v}, '') AS \"{c}\"" for v, c in zip(values, cols)
        )
        return f"SELECT a.query_no, {order} AS type_order, {shown} FROM {queries} AS a {source}"

    texts = non_blank("list_transform(h.product_name, lambda n: n.text)")

    def hit(order, label, rank, score):
        return row(
            order, label, f"LEFT JOIN (SELECT * FROM {ranked} WHERE {rank} = 1) AS h USING (query_no)",
            "h.given_name", f"coalesce(printf('%.2f', h.{score}), '0')", "h._id",
            joined("h.categories", ","), joined(texts, "; "),
        )

    def rewrite(order, level):
        p = f"level{level}"
        return row(
            order, K.LEVEL_ROWS[level], f"WHERE {p}_model IS NOT NULL",
            f"concat_ws(': ', {p}_decision, nullif({p}_rephrased_query, ''))", "'0'",
            f"'{K.REWRITE_ROW_ID}'", f"{p}_decision", f"{p}_rephrased_query",
        )

    rows = [
        hit(1, K.TEXT_ROW, "text_rank", "score"),
        hit(2, K.FUZZY_ROW, "fuzzy_rank", "rapidfuzz_score"),
        rewrite(3, 1),
        rewrite(4, 2),
    ]
    return f"report AS ({' UNION ALL '.join(rows)})"


# ------------------------------------------------------------ catalog build

_SHOWN = [
    "_id", "lang", "brands", "quantity", "product_quantity", "product_quantity_unit",
    "popularity_key", "nutriscore_grade", "nutriscore_score", "search_string",
]
_LISTS = ["categories", "labels", "categories_tags", "labels_tags", "food_groups_tags", "popularity_tags"]


def shown_catalog(source):
    lists = ", ".join(f"{joined(c)} AS {c}" for c in _LISTS)
    texts = joined("list_transform(product_name, lambda n: concat(n.lang, '=', n.text))")
    return f"SELECT {', '.join(_SHOWN)}, {lists}, {texts} AS product_name FROM {source}"


MERGED = f"""old_docs AS ({project('older')}),
  old_catalog AS (SELECT * EXCLUDE (seq) FROM old_docs
    QUALIFY row_number() OVER (PARTITION BY _id ORDER BY seq DESC) = 1),
  merged AS (SELECT * FROM catalog UNION ALL BY NAME
    SELECT * FROM old_catalog WHERE _id NOT IN (SELECT _id FROM catalog))"""


def paths(source, out):
    plain = f"list_filter({list_items('categories')}, lambda e: NOT contains(e, ':'))"
    return f"""{out} AS (SELECT name, arg_max(array_to_string(p, '{K.PATH_SEPARATOR}'), seq) AS path
      FROM (SELECT seq, p, p[-1] AS name FROM (SELECT seq, {plain} AS p FROM {source}) WHERE len(p) > 0)
      GROUP BY name)"""


def tree(source, out):
    parts = non_blank(f"string_split(path, '{K.PATH_SEPARATOR}')")
    return f"""{out} AS (SELECT name, parts[:len(parts) - 1] AS ancestors
      FROM (SELECT name, {parts} AS parts FROM {source} WHERE name <> '' AND path <> '')
      WHERE len(parts) = 0 OR parts[-1] = name)"""


TREES = [
    PRODUCTS, OLDER, RECORDS, VALID, paths("valid", "paths"), tree("paths", "tree"),
    f"older_valid AS (SELECT * FROM older WHERE {valid()})",
    paths("older_valid", "older_paths"), tree("older_paths", "older_tree"),
]


def parsed(level):
    """CTE parsed(conv_id, turn, decision, rephrased_query, error)."""
    low = "lower(content)"
    return f"""bodies AS (SELECT *, regexp_extract(content, '\\{{.*\\}}', 0, 's') AS body FROM answers),
    parsed AS (SELECT conv_id, turn, '{K.LEVEL_MODELS[level]}' AS model,
      CASE WHEN body = '' THEN CASE WHEN contains({low}, 'not_a_product') THEN '{K.NOT_A_PRODUCT}'
             WHEN contains({low}, 'rephrased') OR contains({low}, 'improved') THEN '{K.REPHRASED}'
             WHEN contains({low}, 'valid') THEN '{K.VALID_PRODUCT}' ELSE '{K.NO_MATCH_FOUND}' END
           WHEN NOT json_valid(body) THEN '{K.NO_MATCH_FOUND}'
           WHEN list_contains(json_keys(body), 'decision') THEN body ->> '$.decision'
           ELSE '{K.NO_MATCH_FOUND}' END AS decision,
      CASE WHEN body <> '' AND json_valid(body) THEN body ->> '$.rephrased_query' END AS rephrased_query,
      CASE WHEN body <> '' AND NOT json_valid(body)
           THEN 'Failed to parse Level {level} model response' END AS error
    FROM bodies)"""


def _r(*cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


_HIT = "query_no, _id, CAST(text_rank AS BIGINT) AS text_rank, round(score, 6) AS score"
_SCORES = ["names_score", "brands_score", "categories_score", "labels_score", "quantity_score"]
_RANKED = (
    f"SELECT {_HIT}, CAST(fuzzy_rank AS BIGINT) AS fuzzy_rank, {_r('rapidfuzz_score')}, given_name FROM "
)


def _summary():
    def na(x):
        return f"CASE WHEN coalesce({x}, '') = '' THEN 'N/A' ELSE {x} END"

    shown = f"""_id, {_r('score', 'rapidfuzz_score')}, given_name,
      {na(joined(names('product_name'), ', '))} AS product_names, {na('quantity')} AS quantity,
      {na('brands')} AS brands, {na(joined('categories', ', '))} AS categories,
      {na(joined('labels', ', '))} AS labels, coalesce(search_string, '') AS text"""
    return " UNION ALL ".join(
        f"SELECT query_no, '{name}' AS ranking, CAST({name}_rank AS BIGINT) AS rank, {shown}"
        f" FROM ranked WHERE {name}_rank <= 3"
        for name in ("text", "fuzzy")
    )


def _results():
    ids = "string_agg(_id, '|' ORDER BY {}) AS {}"
    return f"""SELECT a.query_no, a.input_string, {format_query('a.input_string')} AS formatted_string,
        coalesce(n, 0) AS direct_count, coalesce(n, 0) AS fuzzy_count, direct_ids, fuzzy_ids,
        level1_decision, level1_rephrased_query, level2_decision, level2_rephrased_query,
        match_status, match_confidence, round(s.best_score, 6) AS best_score,
        s.given_name AS best_name
      FROM answered AS a LEFT JOIN (SELECT query_no, count(*) AS n, {ids.format('text_rank', 'direct_ids')},
          {ids.format('fuzzy_rank', 'fuzzy_ids')} FROM final GROUP BY query_no) USING (query_no)
        JOIN ({status('answered', 'final')}) AS s USING (query_no)"""


def _prompts():
    base = "concat('User Search Query: \"', input_string, '\"'"
    top = "CASE WHEN coalesce(top, '') <> '' THEN concat(chr(10), 'Possible Result: \"', top, '\"') ELSE '' END"
    before = """concat(chr(10), 'Previous Analysis: ', level1_decision,
        CASE WHEN coalesce(level1_rephrased_query, '') <> ''
             THEN concat(', suggested: \"', level1_rephrased_query, '\"') ELSE '' END)"""
    return f"""SELECT query_no, {base}, {top}) AS level1_prompt,
        CASE WHEN level2_model IS NOT NULL THEN {base}, {top}, {before}) END AS level2_prompt
      FROM (SELECT *, CASE WHEN n_hits > 0 THEN top_name END AS top FROM answered WHERE route <> 'done')"""


_REPORT_COLS = ", ".join(f'"{c}"' for c in K.REPORT_COLUMNS)
_REPORTED = [*TWO_PASS, report("answered", "final")]
_OFFLINE = [*RERANK, *rewritten(rewrites=False), report("answered", "ranked")]
_DOCUMENTS = [
    "doc_catalog AS (SELECT CAST(doc_id AS VARCHAR) AS _id, text AS search_string FROM documents)",
    "items AS (SELECT item_id AS query_no, text AS input_string FROM benchmark)",
    *text_search("items", "doc_catalog"),
]
_PAIRS = [LINES, SOLD, "pairs AS (SELECT DISTINCT lower(a) AS q, lower(b) AS t FROM sold)", *pair_scores("pairs")]


_COUNTS = f"SELECT count(*) FILTER ({valid()}) AS processed, count(*) FILTER (NOT {valid()}) AS skipped FROM records"


def oracle_sql():
    named = "list_transform(product_name, lambda n: n.text)"
    tags = "(SELECT unnest(categories_tags) AS tag FROM products)"
    return {
        "scan_products": with_([PRODUCTS], f"SELECT seq, code, lang, brands, quantity, categories, labels, popularity_key, nutriscore_grade, nutriscore_score, {joined(named)} AS names FROM products"),
        "stream_ingest": with_(BUILD, shown_catalog("catalog")),
        "read_queries": with_([LINES], f"SELECT row_number() OVER (ORDER BY s_suppkey) AS query_no, {strip('line')} AS input_string FROM receipt_lines WHERE {strip('line')} <> ''"),
        "read_report": with_(_OFFLINE, f"SELECT {_REPORT_COLS} FROM report"),
        "upsert_catalog": with_([PRODUCTS, OLDER, *BUILD[1:], MERGED], shown_catalog("merged")),
        "stream_by_arrival": with_(BUILD, shown_catalog("catalog")),
        "stream_category_paths": with_(TREES[:5], "SELECT name, path FROM paths"),
        "stream_tags": with_(BUILD[:3], "SELECT DISTINCT unnest(food_groups_tags) AS value FROM valid"),
        "stream_categories": with_(BUILD[:3], f"SELECT DISTINCT unnest({list_items('categories')}) AS value FROM valid"),
        "stream_counts": with_(BUILD[:2], _COUNTS),
        "running_languages": "SELECT lang, count(*) AS n_records FROM documents GROUP BY lang",
        "text_search_updated": with_([PRODUCTS, OLDER, *BUILD[1:], MERGED, LINES, QUERIES, *text_search("queries", "merged")], f"SELECT {_HIT} FROM hits"),
        "write_lists": with_(BUILD[:3], f"SELECT DISTINCT 'unique_food_groups' AS list, unnest(food_groups_tags) AS value FROM valid UNION ALL SELECT DISTINCT 'unique_categories', unnest({list_items('categories')}) FROM valid"),
        "write_paths": with_(TREES[:5], "SELECT name, path FROM paths"),
        "build_without_store": with_([*BUILD, *TREES[4:6]], f"""SELECT *, (SELECT count(*) FROM catalog) AS n_documents,
            (SELECT count(DISTINCT t) FROM (SELECT unnest(food_groups_tags) AS t FROM valid)) AS n_food_groups,
            (SELECT count(DISTINCT t) FROM (SELECT unnest({list_items('categories')}) AS t FROM valid)) AS n_categories,
            (SELECT count(*) FROM paths) AS n_paths, (SELECT count(*) FROM tree) AS n_tree,
            (SELECT count(*) FROM records WHERE NOT {valid()}) AS n_rejected FROM ({_COUNTS})"""),
        "upsert_categories": with_(TREES, f"SELECT name, {joined('ancestors', ' > ')} AS ancestors FROM tree UNION ALL SELECT name, {joined('ancestors', ' > ')} FROM older_tree WHERE name NOT IN (SELECT name FROM tree)"),
        "upsert_counts": with_(TREES, "SELECT count(*) AS processed, count(*) FILTER (o.name IS NULL) AS inserted, count(*) FILTER (o.name IS NOT NULL) AS updated FROM tree AS t LEFT JOIN older_tree AS o USING (name)"),
        "result_json": with_(TWO_PASS, _results()),
        "batch_report": with_(_REPORTED, f"SELECT {_REPORT_COLS} FROM report"),
        "conversation_export": with_([MESSAGES], "SELECT model, conv_id, turn, role, content, count(*) OVER (PARTITION BY model, conv_id) AS total_messages FROM messages"),
        "write_conversations": with_([MESSAGES], "SELECT model, conv_id, turn, role, content, count(*) OVER (PARTITION BY model, conv_id) AS total_messages FROM messages"),
        "conversation_documents": with_([MESSAGES], "SELECT model, conv_id, count(*) AS total_messages, md5(string_agg(concat_ws(':', role, content), chr(10) ORDER BY turn)) AS digest FROM messages GROUP BY model, conv_id"),
        "unanswered_turns": with_([MESSAGES], "SELECT model, conv_id, turn, content FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM messages) WHERE role = 'user' AND nxt IS DISTINCT FROM 'assistant'"),
        "filter_lang": "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'fr'",
        "valid_products": with_(BUILD[:3], "SELECT seq, code, categories FROM valid"),
        "rejected_products": with_(BUILD[:2], f"SELECT seq, code, categories FROM records WHERE NOT {valid()}"),
        "catalog_project": with_(BUILD[:4], shown_catalog("docs").replace("SELECT ", "SELECT seq, ", 1)),
        "split_lists": with_([PRODUCTS], f"SELECT seq, {joined(split_list('categories'))} AS categories, len({split_list('categories')}) AS n_categories, {joined(list_items('categories'))} AS non_blank, {joined(split_list('labels'))} AS labels FROM products"),
        "search_text": with_([PRODUCTS], f"SELECT seq, {search_text()} AS search_string FROM products"),
        "route_queries": with_([*RERANK, ROUTED], f"SELECT query_no, n_hits, {_r('best_score')}, top_name, route FROM routed"),
        "text_search": with_(SEARCH, f"SELECT {_HIT} FROM hits"),
        "text_search_documents": with_(_DOCUMENTS, f"SELECT {_HIT} FROM hits"),
        "fuzzy_rerank": with_(RERANK, _RANKED + "ranked"),
        "rewrite_queries": with_(ANSWERED, "SELECT query_no, route, level1_model, level1_decision, level1_rephrased_query, level1_error, level2_model, level2_decision, level2_rephrased_query, level2_error, next_query FROM answered"),
        "rewrite_queries_offline": with_([*RERANK, *rewritten(rewrites=False)], "SELECT query_no, route, level1_decision, level1_error, level2_decision, level2_error, next_query FROM answered"),
        "lang_distribution": "SELECT lang, count(*) AS n_records FROM documents GROUP BY lang",
        "lang_distribution_products": with_(BUILD[:3], "SELECT lang, count(*) AS n_records FROM valid GROUP BY lang"),
        "distinct_tags": with_(BUILD[:3], "SELECT DISTINCT unnest(food_groups_tags) AS value FROM valid"),
        "distinct_categories": with_(BUILD[:3], f"SELECT DISTINCT unnest({list_items('categories')}) AS value FROM valid"),
        "category_paths_by_arrival": with_(TREES[:5], "SELECT name, path FROM paths"),
        "catalog_by_arrival": with_(BUILD, shown_catalog("catalog")),
        "category_paths": with_(TREES[:5], "SELECT name, path FROM paths"),
        "category_tree": with_(TREES[:6], f"SELECT name, {joined('ancestors', ' > ')} AS ancestors, len(ancestors) AS n_ancestors FROM tree"),
        "ingest_counts": with_(BUILD[:2], _COUNTS),
        "best_match": with_(RERANK, "SELECT query_no, _id, given_name, round(rapidfuzz_score, 6) AS best_score FROM ranked WHERE fuzzy_rank = 1"),
        "hit_counts": with_(SEARCH, "SELECT query_no, count(_id) AS direct_count, count(_id) AS rapidfuzz_count FROM queries LEFT JOIN hits USING (query_no) GROUP BY query_no"),
        "field_scores": with_(RERANK, f"SELECT query_no, _id, {_r(*_SCORES)} FROM ranked"),
        "report_counts": with_(_REPORTED, "SELECT count(*) AS total_rows, count(DISTINCT query_no) AS products_processed FROM report"),
        "top_results": with_(RERANK, "SELECT t.query_no, t._id AS text_id, t.given_name AS text_given_name, round(t.score, 6) AS text_score, f._id AS fuzzy_id, f.given_name AS fuzzy_given_name, round(f.rapidfuzz_score, 6) AS fuzzy_score FROM ranked AS t JOIN ranked AS f USING (query_no) WHERE t.text_rank = 1 AND f.fuzzy_rank = 1"),
        "top3_summary": with_(RERANK, _summary()),
        "format_query": with_([LINES], f"SELECT s_suppkey, {format_query('line')} AS formatted FROM receipt_lines"),
        "format_query_documents": f"SELECT doc_id, {format_query('text')} AS formatted FROM documents",
        "product_names": with_([PRODUCTS], f"SELECT seq, {joined(names('product_name'))} AS names, len({names('product_name')}) AS n_names FROM products"),
        "given_name": with_([PRODUCTS], f"SELECT seq, {given_name(split_list('categories'))} AS given_name FROM products"),
        "clean_tags": f"WITH {PRODUCTS} SELECT tag, translate(regexp_replace(tag, '^[a-z]{{2}}:', ''), '-', ' ') AS cleaned, count(*) AS n FROM {tags} GROUP BY tag",
        "rewrite_prompt": with_(ANSWERED, _prompts()),
        "parse_decision": with_([ANSWERS, parsed(1)], "SELECT conv_id, turn, model, decision, rephrased_query, error FROM parsed"),
        "token_sort_ratio": with_(_PAIRS, "SELECT a, b, round(token_sort, 6) AS ratio FROM sold JOIN pair_scores ON q = lower(a) AND t = lower(b)"),
        "partial_ratio": with_(_PAIRS, "SELECT a, b, round(partial, 6) AS ratio FROM sold JOIN pair_scores ON q = lower(a) AND t = lower(b)"),
        "two_pass_search": with_(TWO_PASS, _RANKED + "final"),
        "match_status": with_(RERANK, f"SELECT query_no, input_string, match_status, match_confidence, {_r('best_score')}, threshold, _id, given_name FROM ({status('queries', 'ranked')})"),
    }
