"""Scans: products, query batches and written reports."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from shelfmark import constants as K
from shelfmark.functions import text as X
from shelfmark.schemas import QUERIES, SRC


def _arrival(fmt: str):
    """Sortable text of a record's place in the dump: file name, then position."""
    position = F.col("_metadata.row_index")
    if fmt != "parquet":
        # block start plus the number in the task: a block has more bytes than records
        within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        position = F.col("_metadata.file_block_start") + within
    return F.concat("_metadata.file_path", F.lit("#"), F.lpad(position.cast("string"), 20, "0"))


def read_products(
    spark: SparkSession, path, fmt: str = "parquet", schema=SRC, arrival: bool | None = None
) -> DataFrame:
    """Product dump with an explicit schema: unused source fields are never decoded.

    ``arrival`` derives ``seq`` from the order of files and records, for a dump without that
    field; by default where Parquet footers have none, and for other formats. In
    JSON, a product name that is not a list fails to parse into ``NAMES`` and becomes
    null, that is "no names".
    """
    df = spark.read.schema(schema).format(fmt).load(path)
    if arrival is None:
        arrival = fmt != "parquet" or "seq" not in spark.read.parquet(path).columns
    return df.withColumn("seq", _arrival(fmt)) if arrival else df


def stream_products(
    spark: SparkSession, path: str, pattern: str = "*.parquet", schema=SRC, max_files=None, arrival: bool = False
) -> DataFrame:
    """The same dump as a stream: files are picked up as they appear in ``path``, the oldest first.

    ``arrival`` derives ``seq``, for a dump without it, from a file's time, its name and the place of
    the record in it, which is the order in which the stream takes them.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.parquet(path)
    if not arrival:
        return df
    when = F.date_format("_metadata.file_modification_time", "yyyyMMddHHmmssSSS")
    return df.withColumn("seq", F.concat(when, F.lit("#"), _arrival("parquet")))


def read_queries(spark: SparkSession, path) -> DataFrame:
    """Query batch from text: stripped non-blank lines numbered from 1 in order.

    Large files are read in splits. A line's number is its number within the
    split plus the lines of all splits before it, so no task sees the whole file;
    only one row per split goes through the running total. A missing path gives
    an empty batch.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], QUERIES)
    lines = lines.select(
        X.strip("value").alias("input_string"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        # Rises with the position inside a split, which is all it is used for.
        F.monotonically_increasing_id().alias("pos"),
    ).filter(X.is_set("input_string"))
    sizes = lines.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    within = F.row_number().over(W.partitionBy("file", "start").orderBy("pos"))
    return (
        lines.withColumn("n", within)
        .join(offsets, ["file", "start"])
        .select((F.col("offset") + F.col("n")).alias("query_no"), "input_string")
    )


def read_report(spark: SparkSession, path, columns=K.REPORT_COLUMNS) -> DataFrame:
    """A written report; short rows are padded with empty strings."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    report = (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .option("enforceSchema", True)
        .csv(path)
    )
    return report.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])
