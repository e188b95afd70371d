"""Explicit schemas, so a scan decodes only the fields that are used."""

from pyspark.sql import types as T

NAMES = T.ArrayType(
    T.StructType([T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())])
)
_S, _L, _A = T.StringType(), T.LongType(), T.ArrayType(T.StringType())


def _struct(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


# Source records; "seq" is the arrival order that decides last-write-wins.
SRC = _struct(
    ("seq", _L),
    ("code", _S),
    ("lang", _S),
    ("product_name", NAMES),
    ("brands", _S),
    ("quantity", _S),
    ("product_quantity", _S),
    ("product_quantity_unit", _S),
    ("categories", _S),
    ("categories_tags", _A),
    ("labels", _S),
    ("labels_tags", _A),
    ("food_groups_tags", _A),
    ("popularity_key", _L),
    ("popularity_tags", _A),
    ("nutriscore_grade", _S),
    ("nutriscore_score", _L),
)

CATALOG = _struct(
    ("_id", _S),
    ("lang", _S),
    ("product_name", NAMES),
    ("brands", _S),
    ("food_groups_tags", _A),
    ("product_quantity_unit", _S),
    ("product_quantity", _S),
    ("quantity", _S),
    ("categories_tags", _A),
    ("categories", _A),
    ("labels_tags", _A),
    ("labels", _A),
    ("popularity_key", _L),
    ("popularity_tags", _A),
    ("nutriscore_grade", _S),
    ("nutriscore_score", _L),
    ("search_string", _S),
)

CATEGORIES = _struct(("name", _S), ("ancestors", _A))

# Side outputs of a build that is kept up to date by a stream.
PATHS = _struct(("name", _S), ("path", _S))
VALUES = _struct(("value", _S))
COUNTS = _struct(("batch", _S), ("processed", _L), ("skipped", _L))
LANGUAGES = _struct(("lang", _S), ("n_records", _L))

QUERIES = _struct(("query_no", _L), ("input_string", _S))

# One row per rewriter answer.
REWRITE = _struct(
    ("query_no", _L),
    ("level", T.IntegerType()),
    ("model", _S),
    ("decision", _S),
    ("rephrased_query", _S),
    ("error", _S),
)

# Kept answers, by the hash of their request.
ANSWERS = _struct(
    ("request", _S), ("model", _S), ("decision", _S), ("rephrased_query", _S), ("error", _S)
)
