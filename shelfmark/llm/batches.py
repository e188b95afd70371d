"""Size of the batches that Spark hands to Python, and memory that Python workers hand back."""

import ctypes
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: str = "16m"):
    """Jobs started inside use batches of at most ``size``: less memory beside the heap."""
    before = spark.conf.get(_BYTES)
    spark.conf.set(_BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(_BYTES, before)


def give_back() -> None:
    """Hands free memory of this process to the system; the allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def releasing(run):
    """``run`` for mapInArrow, whose worker gives memory back when its task ends.

    Spark keeps more workers than a stage needs and lets tasks take turns on them, so
    what each one holds on to adds up.
    """

    @wraps(run)
    def released(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return released
