"""Sinks. Sorted outputs are range-partitioned: part files follow the sort order
and nothing is funnelled through one task."""

import re
import uuid
from itertools import groupby

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfmark.operators.conversation import conversation_export
from shelfmark.operators.report import batch_report
from shelfmark.plans.search import SearchResult, search_documents
from shelfmark.sources.tables import pinned, read_table, upsert_table, vacuum

__all__ = [
    "pinned", "read_conversation_documents", "read_table", "upsert_table", "vacuum",
    "write_conversation_documents", "write_conversations", "write_paths", "write_report",
    "write_results", "write_values",
]


#: Tasks that list the folders of conversation documents, at most.
LISTING_TASKS = 256


def write_values(values: DataFrame, path: str) -> None:
    """A distinct list, one JSON object per line, sorted by value."""
    values.orderBy("value").write.json(path)


def write_paths(paths: DataFrame, path: str) -> None:
    """Category name to path, one JSON object per line, sorted by name."""
    paths.orderBy("name").write.json(path)


def write_report(result: SearchResult, path: str) -> None:
    (
        batch_report(result)
        .write.option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_results(result: SearchResult, path: str, timestamp=None) -> None:
    """One nested JSON document per query and line, in query order."""
    search_documents(result, timestamp).orderBy("query_no").write.json(path)


def write_conversations(messages: DataFrame, path: str, timestamp=None) -> None:
    """Messages as JSON rows in order; without messages nothing is written."""
    stamp = F.current_timestamp() if timestamp is None else timestamp
    if messages.isEmpty():
        return
    (
        conversation_export(messages)
        .withColumn("exported_at", stamp)
        .orderBy("model", "conv_id", "turn")
        .write.json(path)
    )


def write_conversation_documents(messages: DataFrame, path: str, timestamp=None) -> None:
    """One JSON document per conversation, in a folder of its own below ``path``.

    A document is ``{model, conv_id, conversation: [{role, content}, ...], total_messages,
    exported_at}`` with a message a line. Its lines are rows that are written in order as
    they come, so a conversation of any length never is one value. Without messages
    nothing is written.

    Hadoop's local file system starts a process for every file and folder to set its
    mode, so below a ``file:`` path tasks write the files themselves.
    """
    if messages.isEmpty():
        return
    stamp = F.current_timestamp() if timestamp is None else timestamp
    conversation = ["model", "conv_id"]
    ends = messages.select(*conversation).distinct().withColumns(
        {"turn": F.lit(None).cast("long"), "role": F.lit(None).cast("string"), "content": F.lit(None).cast("string")}
    )
    rows = messages.select(*conversation, "turn", "role", "content", F.lit(False).alias("_end")).unionByName(
        ends.withColumn("_end", F.lit(True))
    )
    name = F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in conversation])
    # a null and the text "none" must not share a folder
    rows = rows.withColumn("document", F.concat(name, F.lit("-"), F.hex(F.xxhash64(*conversation))))
    number = F.row_number().over(W.partitionBy("document").orderBy("_end", "turn", "role", "content"))
    fields = {"ignoreNullFields": "false"}
    head = F.to_json(F.struct(*conversation), fields)
    head = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"conversation":['))
    message = F.to_json(F.struct("role", "content"), fields)
    tail = F.to_json(F.struct((F.col("_n") - 1).alias("total_messages"), stamp.alias("exported_at")))
    tail = F.concat(F.lit("],"), F.substr(tail, F.lit(2), F.length(tail) - 1))
    line = F.when(F.col("_end"), tail).when(F.col("_n") == 1, F.concat(head, message)).otherwise(F.concat(F.lit(","), message))
    lines = rows.withColumn("_n", number).select("document", line.alias("value"))
    spark = messages.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getUri().getScheme() != "file":
        lines.write.partitionBy("document").text(path)
        return
    if files.exists(folder):
        raise AnalysisException(f"[PATH_ALREADY_EXISTS] Path {path} already exists.")
    root = files.makeQualified(folder).toUri().getPath()
    # sorted by the window, so that a document's lines are side by side
    lines.mapInArrow(_document_files(root), "document string").write.format("noop").mode("overwrite").save()
    files.create(files.makeQualified(folder).suffix("/_SUCCESS")).close()


def _document_files(root: str):
    """Writes each document's lines to a file of a fixed name, so that a task that runs again replaces it."""

    def run(batches):
        files, folder, part, out = pafs.LocalFileSystem(), None, None, None

        def finish():
            out.close()
            files.move(part, f"{folder}/part-00000.txt")

        try:
            for batch in batches:
                rows = zip(batch.column("document").to_pylist(), batch.column("value").to_pylist(), strict=True)
                for document, lines in groupby(rows, key=lambda r: r[0]):
                    to = f"{root}/document={_escaped(document)}"
                    if to != folder:
                        if out is not None:
                            finish()
                        folder, part = to, f"{to}/_part-{uuid.uuid4().hex}"
                        files.create_dir(to, recursive=True)
                        out = files.open_output_stream(part, compression=None)
                    out.writelines(f"{line}\n".encode() for _, line in lines)
            if out is not None:
                finish()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
                files.delete_file(part)
            raise
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["document"])

    return run


def _escaped(name: str) -> str:
    """A folder's name as Spark escapes it."""
    return re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", name)


def read_conversation_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents under ``path`` as rows."""
    kind = "model string, conv_id long, conversation array<struct<role: string, content: string>>, total_messages long, exported_at timestamp"
    # else a task a folder, each of which reads Spark's settings
    parallelism = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(parallelism)
    spark.conf.set(parallelism, min(int(before), LISTING_TASKS))
    try:
        return spark.read.schema(kind).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    finally:
        spark.conf.set(parallelism, before)
