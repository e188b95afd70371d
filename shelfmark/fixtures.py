"""Product, query and conversation tables derived from the shared test tables.

Everything is computed from whole tables, so its size follows theirs: one
product record per ``part``, one receipt line per ``supplier`` (naming the part
of the supplier's first order line), one message per ``conversations`` row.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import constants as K
from shelfmark.schemas import SRC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Record -> product. Covers duplicate and zero-padded keys, null, empty and blank
# categories, colon-only and "pl:" categories, a repeated name, other languages.
_PRODUCT = [
    "p_partkey AS seq",
    "lpad(CAST(p_partkey - CASE WHEN p_partkey % 10 = 2 THEN 2 ELSE 0 END AS STRING), 13, '0') AS code",
    "CASE p_partkey % 4 WHEN 3 THEN 'en' ELSE 'pl' END AS lang",
    """array(named_struct('lang', 'main', 'text', p_name),
             named_struct('lang', 'pl', 'text', upper(p_name)),
             named_struct('lang', 'en', 'text', p_name)) AS product_name""",
    "p_brand AS brands",
    "concat(CAST(p_size AS STRING), ' g') AS quantity",
    "CAST(p_size AS STRING) AS product_quantity",
    "'g' AS product_quantity_unit",
    """CASE p_partkey % 6
            WHEN 0 THEN concat('Goods,', p_type, ',', p_name)
            WHEN 1 THEN 'en:goods,fr:biens'
            WHEN 2 THEN concat('Goods,pl:', lower(p_type))
            WHEN 3 THEN ''
            WHEN 4 THEN concat('Goods, ,', p_type, ',')
       END AS categories""",
    """CASE WHEN p_size % 2 = 0
            THEN array(concat('en:', lower(p_type)), 'en:all-goods') END AS categories_tags""",
    "CASE WHEN p_size > 25 THEN 'Large,Bulk' END AS labels",
    "CASE WHEN p_size > 25 THEN array('en:large', 'en:bulk') END AS labels_tags",
    "CASE WHEN p_size % 3 = 0 THEN array(concat('en:', lower(p_type))) END AS food_groups_tags",
    "p_partkey * 7 AS popularity_key",
    "CASE WHEN p_size % 5 = 0 THEN array('top-75-percent') END AS popularity_tags",
    "CASE WHEN p_size < 10 THEN 'a' WHEN p_size < 30 THEN 'c' END AS nutriscore_grade",
    "CAST(p_size - 15 AS BIGINT) AS nutriscore_score",
]


def products_from_part(part: DataFrame) -> DataFrame:
    """Works on a batch or a streaming ``part``."""
    return part.selectExpr(*_PRODUCT).select(*SRC.fieldNames())


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products_from_part(table(spark, sf_dir, "part"))


def older_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of the dump: other records, quantities and category names."""
    return (
        products(spark, sf_dir)
        .filter("lang = 'en' OR labels IS NULL")
        .selectExpr(
            "* EXCEPT (quantity, categories)",
            "concat(product_quantity, ' oz') AS quantity",
            "replace(replace(categories, 'Goods', 'Wares'), 'PROMO', 'OFFER') AS categories",
        )
        .select(*SRC.fieldNames())
    )


# Receipt lines in the ways tills abbreviate: camel case, glued sizes, commas.
_RECEIPT_LINE = """CASE s_suppkey % 8
    WHEN 0 THEN concat(replace(initcap(p_name), ' ', ''), p_size, 'g')
    WHEN 1 THEN concat('  ', p_name, ' ')
    WHEN 2 THEN concat(replace(initcap(p_name), ' ', ''), ';', p_size, ' g')
    WHEN 3 THEN concat(p_name, ' ', p_brand)
    WHEN 4 THEN concat(substring_index(p_name, ' ', 1), ' ', lower(p_type))
    WHEN 5 THEN upper(replace(p_name, ' ', ','))
    WHEN 6 THEN CASE WHEN p_size % 2 = 0 THEN 'xyzzy' ELSE '   ' END
    ELSE concat(p_name, ' ', p_brand, ' ', p_type, ' ', p_size, ' g')
END"""


def receipt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, line): raw lines of a query batch, blank ones included."""
    first_line = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("line"))
        .selectExpr("l_suppkey AS s_suppkey", "line.l_partkey AS p_partkey")
    )
    return (
        table(spark, sf_dir, "supplier")
        .join(first_line, "s_suppkey")
        .join(table(spark, sf_dir, "part"), "p_partkey")
        .selectExpr("s_suppkey", f"{_RECEIPT_LINE} AS line")
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_no, input_string): the non-blank lines, numbered by supplier."""
    return receipt_lines(spark, sf_dir).selectExpr(
        "s_suppkey + 1 AS query_no", "trim(line) AS input_string"
    ).filter("input_string <> ''")


def rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level, input_string, decision, rephrased_query) for the lookup rewriter.

    Covers every decision; one answer per level and string.
    """
    lines = (
        receipt_lines(spark, sf_dir)
        .selectExpr("s_suppkey AS no", "trim(line) AS input_string")
        .filter("input_string <> ''")
        .groupBy("input_string")
        .agg(F.min("no").alias("no"))
    )
    level1 = lines.selectExpr(
        "1 AS level",
        "input_string",
        f"""CASE no % 5 WHEN 0 THEN '{K.REPHRASED}' WHEN 1 THEN '{K.NOT_A_PRODUCT}'
                WHEN 2 THEN '{K.VALID_PRODUCT}' WHEN 3 THEN '{K.NO_MATCH_FOUND}'
                ELSE '{K.REPHRASED}' END AS decision""",
        """CASE no % 5 WHEN 0 THEN concat(input_string, ' red plate Brand#1')
                WHEN 4 THEN '' END AS rephrased_query""",
    )
    level2 = lines.selectExpr(
        "2 AS level",
        "input_string",
        f"""CASE no % 3 WHEN 0 THEN '{K.REPHRASED}' WHEN 1 THEN '{K.NO_MATCH_FOUND}'
                ELSE '{K.VALID_PRODUCT}' END AS decision""",
        "CASE no % 3 WHEN 0 THEN concat('promo ', input_string) END AS rephrased_query",
    )
    return level1.unionByName(level2)


_MODEL = f"CASE conv_id % 2 WHEN 0 THEN '{K.LEVEL_MODELS[1]}' ELSE '{K.LEVEL_MODELS[2]}' END"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, conv_id, turn, role, content) from ``conversations``."""
    return table(spark, sf_dir, "conversations").selectExpr(
        f"{_MODEL} AS model", "conv_id", "turn", "role", "text AS content"
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, content): rewriter answers of all shapes around whole texts."""
    quoted = "to_json(named_struct('decision', '{}', 'rephrased_query', text))"
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id",
        "turn",
        f"""CASE (conv_id + turn) % 8
            WHEN 0 THEN concat('Answer: ', {quoted.format(K.REPHRASED)}, ' done.')
            WHEN 1 THEN to_json(named_struct('rephrased_query', text))
            WHEN 2 THEN '{{"decision": null, "rephrased_query": null}}'
            WHEN 3 THEN concat(text, ' NOT_A_PRODUCT, not valid')
            WHEN 4 THEN concat('{{broken ', text, '}}')
            WHEN 5 THEN concat(text, ' improved')
            WHEN 6 THEN concat(text, ' looks invalid')
            ELSE concat('{{"decision": "valid_product"}} or ', text, ' {{}}') END AS content""",
    )


def documents_as_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as (_id, search_string), whole texts."""
    return table(spark, sf_dir, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS _id", "text AS search_string"
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").selectExpr(
        "item_id AS query_no", "text AS input_string"
    )


def sold_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): each supplier's receipt line with every part name it sold."""
    sold = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS s_suppkey", "l_partkey AS p_partkey"
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    named = sold.distinct().join(parts, "p_partkey").select("s_suppkey", "p_name").distinct()
    return (
        receipt_lines(spark, sf_dir)
        .filter("trim(line) <> ''")
        .join(named, "s_suppkey")
        .selectExpr("trim(line) AS a", "p_name AS b")
        .distinct()
    )
