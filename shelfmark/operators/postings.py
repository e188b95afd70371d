"""Stored search index: postings by term, kept up to date by deltas.

An index is a folder of versions. The first holds a whole catalog, each later one the
documents of an upsert, so an update costs what the delta costs:

* ``docs``: doc, dl, terms, and the document's place (shard, num). A shard is what one task read
  of the catalog; ``num`` follows the order of the terms in it, so that documents that begin alike
  share blocks and a block's bound is close to what its documents score. Documents do not move.
* ``postings``: rows of (shard, term) with the numbers of its documents and its frequency in
  each, in blocks of ``BLOCK`` consecutive numbers with the largest frequency and the
  smallest length of each. These bound a block's weight whatever the mean length has become.
  A task packs the documents that it holds, so only packed rows are shuffled. Rows
  are stored by bucket of the term: a batch reads the buckets of its terms.
* ``dead`` (but for the first): places of documents that this version replaces, with their terms, so that document
  frequencies are sums over versions and nothing older is tokenised or rewritten.

``_meta`` is written last and makes a version count; a version without it is ignored and
written anew. After ``MERGE_AFTER`` versions the live documents become one version again, from their
stored terms.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as X

#: Small input partitions are put together to shards of so many documents, or to as many
#: shards as there are shuffle partitions, if these hold ``LEAST_DOCS``.
SHARD_DOCS, LEAST_DOCS = 1 << 17, 1 << 13
BLOCK = 64
#: Words whose postings share a bucket, and the most buckets.
BUCKET_WORDS, MAX_BUCKETS = 1 << 22, 1024
MERGE_AFTER = 16

_DOCS = "doc string, dl long, terms array<string>, shard long, num int"
_DEAD = "shard long, num int, terms array<string>"
_META = "n_docs long, n_words long, first_shard long, n_shards long, n_buckets int, base boolean"
_LISTS = ["nums", "tfs", "blocks", "starts", "top_tf", "least_dl"]
_POSTINGS = "shard long, token string, n long, " + ", ".join(f"{c} array<int>" for c in _LISTS)


def text_index(catalog: DataFrame, id_col="_id", text_col="search_string") -> DataFrame:
    """Tokenised documents: ``doc`` (key that is never null), ``dl``, ``terms``."""
    key = F.coalesce(F.concat(F.lit("k"), F.col(id_col).cast("string")), F.lit(""))
    terms = catalog.select(key.alias("doc"), X.tokens(text_col).alias("terms"))
    return terms.withColumn("dl", F.size("terms").cast("long"))


def doc_id(doc="doc"):
    """The document id behind an index key."""
    return F.when(F.col(doc) != "", F.substring(doc, 2, 2_147_483_647))


def _pack(batches):
    """Postings of the documents of each batch, a row per shard and term; see ``_LISTS``."""
    for batch in batches:
        terms = batch.column("terms")
        size = np.diff(terms.offsets.to_numpy())
        if not size.sum():
            continue
        shard, num, dl = (batch.column(c).to_numpy() for c in ("shard", "num", "dl"))
        coded = terms.flatten().dictionary_encode()
        n_terms = len(coded.dictionary)
        code, doc = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(size)), size)
        # one key for each (shard, term, document), in the order in which rows are packed
        runs, run = np.unique(shard, return_inverse=True)
        key = (run[doc] * n_terms + code) * len(size) + np.argsort(np.argsort(num, kind="stable"))[doc]
        key, tf = np.unique(key, return_counts=True)
        at = np.argsort(num, kind="stable")[key % len(size)]
        row = key // len(size)
        number, length, tf = num[at].astype(np.int32), dl[at].astype(np.int32), tf.astype(np.int32)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        block = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (number[1:] // BLOCK != number[:-1] // BLOCK)))
        ends, block_ends = np.append(first, len(row)), np.append(np.searchsorted(block, first), len(block))
        of = {
            "nums": number, "tfs": tf, "blocks": number[block] // BLOCK,
            "starts": block - np.repeat(first, np.diff(block_ends)),
            "top_tf": np.maximum.reduceat(tf, block), "least_dl": np.minimum.reduceat(length, block),
        }
        lists = [
            pa.ListArray.from_arrays(
                pa.array((ends if c in _LISTS[:2] else block_ends).astype(np.int32)), pa.array(of[c].astype(np.int32))
            )
            for c in _LISTS
        ]
        fixed = [pa.array(runs[row[first] // n_terms]), coded.dictionary.take(pa.array(row[first] % n_terms))]
        columns = [*fixed, pa.array(np.diff(ends).astype(np.int64)), *lists]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "token", "n", *_LISTS])


def bucket(n_buckets: int):
    return F.pmod(F.xxhash64("token"), F.lit(n_buckets)).cast("int")


@dataclass
class _Version:
    path: str
    meta: object


class PostingsIndex:
    """The index at ``root``; empty before the first version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    # ------------------------------------------------------------- versions

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[_Version]:
        """Committed versions from the last one that holds a whole catalog."""
        fs, path = self._fs()
        done = fs.globStatus(path(f"{self.root}/v=*/_meta/_SUCCESS")) or []
        paths = sorted((str(s.getPath().getParent().getParent().toString()) for s in done), key=lambda p: int(p.rpartition("=")[2]))
        found = [_Version(p, self.spark.read.schema(_META).parquet(f"{p}/_meta").first()) for p in paths]
        base = max((i for i, v in enumerate(found) if v.meta["base"]), default=0)
        return found[base:]

    def _read(self, versions, name: str, schema: str) -> DataFrame:
        paths = [f"{v.path}/{name}" for v in versions if name != "dead" or not v.meta["base"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def live_docs(self, versions=None) -> DataFrame:
        """docs without those that a later version replaced."""
        versions = self.versions() if versions is None else versions
        dead = self._read(versions, "dead", _DEAD).select("shard", "num")
        return self._read(versions, "docs", _DOCS).join(dead, ["shard", "num"], "left_anti")

    # --------------------------------------------------------------- writing

    def update(self, documents: DataFrame) -> None:
        """Adds ``text_index`` documents (a key once), replacing those of equal keys."""
        versions = self.versions()
        self._write(documents, versions, base=not versions)
        if len(versions) >= MERGE_AFTER:
            versions = self.versions()
            self._write(self.live_docs(versions), versions, base=True)

    def _write(self, new: DataFrame, versions, base: bool) -> None:
        number = int(versions[-1].path.rpartition("=")[2]) + 1 if versions else 0
        path = f"{self.root}/v={number}"
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        n_docs = new.select("doc").count()
        n_shards = max(1, min(n_docs // LEAST_DOCS, tasks), -(-n_docs // SHARD_DOCS))
        first = 0 if base else max(v.meta["first_shard"] + v.meta["n_shards"] for v in versions)
        # a document's place is the task and the row that wrote it; read back from the written table
        place = F.monotonically_increasing_id()
        placed = new.select("doc", "dl", "terms").coalesce(n_shards).sortWithinPartitions("terms", "doc").withColumns(
            {"shard": F.shiftright(place, 33) + first, "num": place.bitwiseAND(F.lit((1 << 33) - 1)).cast("int")}
        )
        placed.write.mode("overwrite").parquet(f"{path}/docs")
        docs = self.spark.read.schema(_DOCS).parquet(f"{path}/docs")
        n_words, n_shards = docs.agg(F.sum("dl"), F.max("shard") - first + 1).first()
        n_words, n_shards = n_words or 0, n_shards or 1
        n_buckets = int(min(MAX_BUCKETS, max(1, -(-n_words // BUCKET_WORDS))))
        (
            docs.select("shard", "num", "dl", "terms").mapInArrow(_pack, _POSTINGS)
            .withColumn("bucket", bucket(n_buckets))
            .repartition(n_buckets * max(1, -(-n_shards // 64)), "bucket", F.floor(F.col("shard") / 64))
            .sortWithinPartitions("bucket", "token", "shard")
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        )
        if not base:  # the delta's keys are looked up among the stored ones
            dead = self.live_docs(versions).join(docs.select("doc"), "doc", "left_semi").select("shard", "num", "terms")
            dead.write.mode("overwrite").parquet(f"{path}/dead")
            dead = self.spark.read.schema(_DEAD).parquet(f"{path}/dead")
            gone = dead.agg(F.count("*"), F.sum(F.size("terms"))).first()
            n_docs, n_words = n_docs - gone[0], n_words - (gone[1] or 0)
        meta = dict(n_docs=n_docs, n_words=n_words, first_shard=first, n_shards=n_shards, n_buckets=n_buckets, base=base)
        meta = self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in meta.items()])
        kinds = (c.split() for c in _META.split(", "))
        meta.select(*[F.col(c).cast(t) for c, t in kinds]).write.mode("overwrite").parquet(f"{path}/_meta")

    # --------------------------------------------------------------- reading

    def snapshot(self) -> "Snapshot":
        return Snapshot(self, self.versions())


class Snapshot:
    """One state of an index: what a batch of queries reads."""

    def __init__(self, index: PostingsIndex, versions: list[_Version]):
        self.index, self.versions = index, versions
        self.n_docs = sum(v.meta["n_docs"] for v in versions)
        self.mean = sum(v.meta["n_words"] for v in versions) / max(self.n_docs, 1)

    def postings(self, vocabulary: DataFrame) -> DataFrame:
        """Rows of the terms of ``vocabulary`` (token, distinct)."""
        spark, out = self.index.spark, None
        for v in self.versions:
            # at most MAX_BUCKETS numbers
            buckets = [r[0] for r in vocabulary.select(bucket(v.meta["n_buckets"])).distinct().collect()]
            part = spark.read.schema(_POSTINGS + ", bucket int").parquet(f"{v.path}/postings")
            part = part.filter(F.col("bucket").isin(buckets)).drop("bucket")
            out = part if out is None else out.unionByName(part)
        if out is None:
            return spark.createDataFrame([], _POSTINGS)
        return out.join(vocabulary, "token", "left_semi")

    def dead(self) -> DataFrame:
        return self.index._read(self.versions, "dead", _DEAD)

    def docs(self) -> DataFrame:
        return self.index._read(self.versions, "docs", _DOCS)
