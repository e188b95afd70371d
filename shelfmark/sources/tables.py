"""Keyed tables that are upserted bucket by bucket.

A table is a folder of versions. Rows are dealt to buckets by a hash of their key, and a version
holds only the buckets that its delta touches, each with the old rows that stay. Its manifest
names the version in which every bucket is to be found, so the cost of an upsert follows the
delta. The manifest is written last and makes the version count; nothing that a reader has
open is written to.

Superseded buckets are removed once neither one of the last ``KEEP`` manifests nor a pinned one names
them; a reader that outlives that many upserts pins its version (``pinned``).
"""

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.upsert import latest_by_key, merge_by_key
from shelfmark.session import materialize

#: Rows of a bucket that a new table is laid out for; above four times as many it is dealt anew.
BUCKET_ROWS = 100_000
LEAST_BUCKETS, MOST_BUCKETS = 8, 1 << 16
KEEP = 2

_MANIFEST = "bucket int, version long, rows long, stream string, batch long"


def _fs(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, pattern: str) -> list[str]:
    fs, path = _fs(spark, pattern)
    return [s.getPath().getName() for s in fs.globStatus(path(pattern)) or []]


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions; an interrupted write leaves no manifest."""
    fs, path = _fs(spark, root)
    done = fs.globStatus(path(f"{root}/v=*/manifest/_SUCCESS")) or []
    return sorted(int(s.getPath().getParent().getParent().getName()[2:]) for s in done)


def _manifest(spark: SparkSession, root: str, version: int | None) -> tuple[dict, dict]:
    """bucket -> (version, rows) and stream -> last batch."""
    if version is None:
        return {}, {}
    rows = spark.read.schema(_MANIFEST).parquet(f"{root}/v={version}/manifest").collect()  # MOST_BUCKETS at most
    buckets = {r["bucket"]: (r["version"], r["rows"]) for r in rows if r["bucket"] is not None}
    return buckets, {r["stream"]: r["batch"] for r in rows if r["stream"] is not None}


def _write_manifest(spark: SparkSession, rows: list[tuple], path: str) -> None:
    names = [c.split()[0] for c in _MANIFEST.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = f"array<struct<{', '.join(c.replace(' ', ': ') for c in _MANIFEST.split(', '))}>>"
    table = spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(text), kind)).alias("r")).select("r.*")
    table.write.mode("overwrite").parquet(path)


def _read(spark: SparkSession, root: str, schema, buckets: dict) -> DataFrame:
    paths = [f"{root}/v={v}/data/_bucket={b}" for b, (v, rows) in sorted(buckets.items()) if rows]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, root: str, schema, version: int | None = None) -> DataFrame:
    """The latest committed version (or the given one) of a table; empty before the first."""
    if version is None:
        version = max(versions(spark, root), default=None)
    return _read(spark, root, schema, _manifest(spark, root, version)[0])


@contextmanager
def pinned(spark: SparkSession, root: str):
    """The latest version number, whose files stay as long as the context lasts."""
    fs, path = _fs(spark, root)
    version = versions(spark, root)[-1]
    pin = path(f"{root}/pins/{version}-{uuid.uuid4().hex}")
    fs.create(pin).close()
    try:
        yield version
    finally:
        fs.delete(pin, False)


def applied(spark: SparkSession, root: str, batch: tuple[str, int]) -> bool:
    """Whether the table holds this (stream, batch id) or a later one of the stream."""
    last = max(versions(spark, root), default=None)
    return _manifest(spark, root, last)[1].get(batch[0], -1) >= batch[1]


def upsert_table(
    new: DataFrame,
    root: str,
    schema,
    key: str,
    order: str | None = None,
    batch: tuple[str, int] | None = None,
    buckets: int | None = None,
) -> None:
    """Merge ``new`` into the table at ``root`` by key and commit a new version.

    With ``order``, the last row of a key counts. A null key is a key like any other. ``batch`` is a
    stream's name and batch id: a batch that was committed before is skipped. ``buckets`` lays
    out a new table; by default it follows the rows.
    """
    spark = new.sparkSession
    last = max(versions(spark, root), default=None)
    manifest, streams = _manifest(spark, root, last)
    if batch is not None and streams.get(batch[0], -1) >= batch[1]:
        return
    new = latest_by_key(new, key, order) if order is not None else new
    new = materialize(new.select(*schema.fieldNames()), "delta")
    dealt = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    buckets = buckets or len(manifest) or LEAST_BUCKETS
    sizes = {r[0]: r[1] for r in new.groupBy(dealt(buckets)).count().collect()}  # MOST_BUCKETS at most
    total = sum(sizes.values()) + sum(rows for _, rows in manifest.values())
    if total > 4 * BUCKET_ROWS * buckets:
        buckets = min(MOST_BUCKETS, 2 * -(-total // BUCKET_ROWS))
    slot = dealt(buckets)
    if buckets != len(manifest):  # new, or dealt anew as a whole
        touched, old = set(range(buckets)), _read(spark, root, schema, manifest)
        manifest = {}
    else:
        touched = set(sizes)
        old = _read(spark, root, schema, {b: manifest[b] for b in touched & set(manifest)})
    version = 0 if last is None else last + 1
    data = f"{root}/v={version}/data"
    merged = merge_by_key(old, new, key).withColumn("_bucket", slot)
    merged.repartition(max(len(touched), 1), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(data)
    counts = {}
    if touched:
        written = spark.read.schema("_bucket int").parquet(data).groupBy("_bucket").count()
        counts = {r[0]: r[1] for r in written.collect()}
    manifest = {b: (0, 0) for b in range(buckets)} | manifest | {b: (version, counts.get(b, 0)) for b in touched}
    if batch is not None:
        streams[batch[0]] = batch[1]
    rows = [(b, v, n, None, None) for b, (v, n) in manifest.items()]
    rows += [(None, None, None, s, b) for s, b in streams.items()]
    _write_manifest(spark, rows, f"{root}/v={version}/manifest")
    vacuum(spark, root)


def vacuum(spark: SparkSession, root: str, keep: int = KEEP) -> None:
    """Removes what neither the last ``keep`` versions nor a pinned one names."""
    done = versions(spark, root)
    pins = {int(name.partition("-")[0]) for name in _names(spark, f"{root}/pins/*")}
    kept = {*done[-keep:], *(pins & set(done))}
    gone = [v for v in done if v not in kept]
    if not gone:
        return
    fs, path = _fs(spark, root)
    named = {(v, b) for k in kept for b, (v, _) in _manifest(spark, root, k)[0].items()}
    # folders of versions whose manifest went earlier may still hold buckets that were named until now
    below = [int(name[2:]) for name in _names(spark, f"{root}/v=*")]
    for v in (v for v in below if v <= done[-1]):
        if v in gone:
            fs.delete(path(f"{root}/v={v}/manifest"), True)
        for name in _names(spark, f"{root}/v={v}/data/_bucket=*"):
            if (v, int(name.partition("=")[2])) not in named:
                fs.delete(path(f"{root}/v={v}/data/{name}"), True)
