"""Work folder and intermediate tables."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a
    cluster must name one that every executor can reach.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="run-")
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/shelfmark/{uuid.uuid4().hex}/{name}"


@contextmanager
def removing_shuffles(spark: SparkSession):
    """Spark removes the shuffle files of a table written inside as soon as it is written.

    They are needed no more then, but would stay until the driver happens to collect its
    garbage. Only for writes: each is planned anew, so nothing reads those files again.
    """
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_REMOVE_SHUFFLES)
        else:
            spark.conf.set(_REMOVE_SHUFFLES, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once and go on from the written table.

    Used where several later steps read the same result: it is then computed
    once, and a lost executor costs a re-read instead of the whole lineage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with removing_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
