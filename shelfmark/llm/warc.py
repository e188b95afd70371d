"""WARC archives: a writer that stores repeated payloads once, and a splittable reader.

Writing. Each task streams its rows to one archive of gzip members, one per record, under
a name of its own attempt; only archives named in the returned manifest belong to the
result, so a lost or repeated attempt leaves nothing but an unlisted file. Of rows with equal
payloads the one with the smallest id is a ``response`` and the others are ``revisit``
records without a payload. Rows meet their group's smallest id in a join by digest, whose large
side Spark splits where one payload is very frequent.

Reading. The archives are cut into byte ranges and a task takes some of them. It looks
for the gzip magic, keeps a candidate only if it decodes to a WARC header, and owns the
records that start inside its range, the last of which it reads beyond the end. A
record is held in memory whole, an archive is not. A record whose payload does not match its
digest, and an archive that ends inside a record, are errors.

Files are opened through ``pyarrow.fs`` by URI, in the folder all executors share.

Definitions: a null payload is empty; payloads shorter than ``dedup_from`` bytes are all
responses; rows without an id revisit the smallest id of their payload, and are responses if
there is none; rows that repeat the smallest id are responses too. A null url is left out.
"""

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.batches import small_batches
from shelfmark.session import materialize

SPLIT_BYTES = 4 << 20
_MAGIC = b"\x1f\x8b\x08"
_BLOCK = 1 << 18
#: Lines of headers end so; the fixed strings below are those of WARC 1.1.
_EOL = b"\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = b"WARC/1.1" + _EOL
    for name, value in [*fields, ("Content-Length", len(block))]:
        if value is not None:
            head += f"{name}: {value}".encode() + _EOL
    return gzip.compress(head + _EOL + block + 2 * _EOL, 6, mtime=0)


def _record_id(page_id) -> str:
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}") if page_id is not None else uuid.uuid4()
    return f"<urn:uuid:{own}>"


def page_record(page_id, url, payload: bytes, first_id, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if url is None else " ".join(url.split())),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Page-Id", page_id),
        ("X-Payload-Length", len(payload)),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", _REVISIT),
            ("WARC-Refers-To", _record_id(first_id)),
            ("X-Refers-To-Page-Id", first_id),
        ]
    return record(fields, http if revisit else http + payload)


def _writer(root):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, count = None, 0
        try:
            for batch in batches:
                if out is None and batch.num_rows:
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                # a few rows at a time as Python objects
                rows = (r for i in range(0, batch.num_rows, 64) for r in batch.slice(i, 64).to_pylist())
                for r in rows:
                    payload = r["payload"].encode()
                    out.write(page_record(r["page_id"], r["url"], payload, r["first_id"], r["revisit"]))
                    count += 1
        except BaseException:
            if out is not None:
                out.close()
                files.delete_file(f"{base}/{name}")
            raise
        if out is not None:
            out.close()
            size = files.get_file_info(f"{base}/{name}").size
            yield pa.RecordBatch.from_pylist([{"path": f"{root}/{name}", "size": size, "records": count}])

    return run


def write_archives(
    pages: DataFrame, root: str, id_col="page_id", url="url", payload="html", dedup_from: int = 0
) -> DataFrame:
    """Archives of ``pages`` under ``root``; returns their manifest (path, size, records)."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"),
    ).withColumn("key", F.sha1("payload"))
    first = rows.groupBy("key").agg(F.min("page_id").alias("first_id"))
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.join(first, "key").withColumn("revisit", other & (F.octet_length("payload") >= dedup_from))
    manifest = rows.drop("key").mapInArrow(_writer(root), "path string, size long, records long")
    with small_batches(pages.sparkSession, "8m"):
        return materialize(manifest, "manifest")


def _member(file, at: int):
    """(decoded member, offset behind it), or None if no WARC record starts here."""
    unpack, data, offset, size = zlib.decompressobj(31), bytearray(), at, 512
    while not unpack.eof:
        chunk = file.read_at(size, offset)
        valid = data[:7] == b"WARC/1."
        if not chunk:
            if valid:
                raise ValueError(f"the archive ends inside the record at {at}")
            return None
        try:
            data += unpack.decompress(chunk)
        except zlib.error:
            if valid:
                raise
            return None
        if not b"WARC/1.".startswith(data[:7]):
            return None
        offset += len(chunk)
        size = _BLOCK
    if data[:7] != b"WARC/1.":
        return None
    return bytes(data), offset - len(unpack.unused_data)


def members(file, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of the records that start in [start, stop)."""
    at = start
    while at < stop:
        # the magic may reach over the border, its first byte may not
        block = file.read_at(min(_BLOCK, stop - at) + len(_MAGIC) - 1, at)
        found = block.find(_MAGIC)
        if found < 0:
            at += max(len(block) - len(_MAGIC) + 1, 1)
            continue
        at += found
        got = _member(file, at)
        if got is None:
            at += 1
        else:
            yield at, got[0]
            at = got[1]


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = data.partition(2 * _EOL)
    fields = {}
    for line in head.split(_EOL)[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode().strip()] = value.decode().strip()
    return fields, rest[: int(fields["Content-Length"])]


_FIELDS = [
    ("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
    ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("payload", pa.binary()),
]
_READ = (
    "path string, offset long, record_type string, record_id string, target_uri string, page_id long,"
    " refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def _row(path: str, offset: int, data: bytes) -> dict:
    fields, block = parse(data)
    number = lambda name: int(fields[name]) if name in fields else None
    named = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    payload, length = None, number("X-Payload-Length")
    if fields["WARC-Type"] == "response":
        payload = block.partition(2 * _EOL)[2]
        length = len(payload)
        if digest(payload) != named:
            raise ValueError(f"{path}: the payload at {offset} does not match its digest")
    values = (
        path, offset, fields["WARC-Type"], fields.get("WARC-Record-ID"), fields.get("WARC-Target-URI"),
        number("X-Page-Id"), number("X-Refers-To-Page-Id"), length, named or None, payload,
    )
    return dict(zip((n for n, _ in _FIELDS), values, strict=True))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(_FIELDS)
    for batch in batches:
        for split in batch.to_pylist():
            files, path = fs.FileSystem.from_uri(split["path"])
            rows, held = [], 0
            with files.open_input_file(path) as file:
                for offset, data in members(file, split["start"], split["stop"]):
                    rows.append(_row(split["path"], offset, data))
                    held += len(data)
                    if held > SPLIT_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the archives of a manifest (path, size); see ``_READ`` for the columns."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))
    splits = manifest.filter("size > 0").select("path", "size", F.explode(starts).alias("start"))
    splits = splits.select("path", "start", F.least("size", F.col("start") + split_bytes).alias("stop"))
    # a number: how many byte ranges there are, each a unit of work
    n = manifest.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    return splits.repartition(int(n)).mapInArrow(_reader, _READ)


def list_archives(spark: SparkSession, glob: str) -> DataFrame:
    """A manifest of existing archives."""
    found = spark.read.format("binaryFile").load(glob)
    return found.select("path", F.col("length").alias("size"))
