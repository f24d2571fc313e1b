"""WARC archives: one gzip member per record, read sequentially with verified digests.

:func:`write` turns rows of (page_id, url, html) into archives in a shared folder and gives the manifest of
the files that finished tasks wrote; :func:`read` reads the files of a manifest, each as one stream: bytes
are decompressed as they come, a record ends where its gzip member ends, its block is framed by
Content-Length, and block and payload are held against their SHA-256 digests. A record is all that is in
memory. A failed task's file is named after its attempt and never enters the manifest, so lost
executors and speculative tasks do no harm.

Equal payloads of at least LEAST_BYTES bytes: the row with the smallest page_id is a ``response``, the others
are ``revisit`` records of it without a payload of their own. The search aggregates digests before they are
joined back, so a payload that a third of all rows share is one row of the smaller side.

Defined cases: null html is an empty payload; a null url leaves out its header; a null page_id is
carried (and refers to the smallest id that is not null); rows that repeat the smallest id are all
responses; an empty table gives no archives. Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm.shared import shared_path, written

LEAST_BYTES = 100
#: A file is closed once it holds so many compressed bytes.
FILE_BYTES = 256 << 20
CHUNK = 1 << 20
VERSION = b"WARC/1.1"
#: Fixed, so that a task that is run again writes the same bytes.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, problem string"


class BadRecord(ValueError):
    """A record that is cut off, wrongly framed or does not match its digest."""


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one record, as a gzip member."""
    block = b"" if revisit else HTTP % len(payload) + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="/:?#[]@!$&'()*+,;=%-._~")))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text) + packer.flush()


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one after another."""
    rest, unpacker, parts = b"", None, []
    for chunk in chunks:
        rest += chunk
        while rest:
            if unpacker is None:
                unpacker, parts = zlib.decompressobj(31), []
            try:
                parts.append(unpacker.decompress(rest))
            except zlib.error as error:
                raise BadRecord(f"not a gzip member: {error}") from None
            rest = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker = None
    if unpacker is not None:
        raise BadRecord("the last member is cut off")


def parsed(member: bytes) -> dict:
    """Headers (lower-case names), block and payload of a record; raises BadRecord if it is not whole."""
    head, found, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise BadRecord("no WARC header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    try:
        size = int(headers["content-length"])
    except (KeyError, ValueError):
        raise BadRecord("no content length") from None
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise BadRecord("the block does not match its content length")
    if headers.get("warc-block-digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise BadRecord("the block does not match its digest")
    payload = None
    if headers.get("warc-type") != "revisit":
        payload = block.partition(b"\r\n\r\n")[2]
        if headers.get("warc-payload-digest") != f"sha256:{hashlib.sha256(payload).hexdigest()}":
            raise BadRecord("the payload does not match its digest")
    return {"headers": headers, "payload": payload}


def decide(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to and revisit of each row."""
    rows = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count("*").alias("rows")
    ).filter("rows > 1 AND first_id IS NOT NULL")
    revisit = F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit")
    )


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives; the manifest (path, records, bytes) of the files that count."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        number = size = count = 0
        path, out = "", None

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{number}.warc.gz"
                    out, size, count = store.open_output_stream(path, compression=None), 0, 0
                data = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["revisit"])
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    yield closed()
                    number, out = number + 1, None
        if out is not None:
            yield closed()

    return written(decide(pages).mapInArrow(archive, "path string, records long, bytes long"), "warc-manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each record of the files of a manifest; ``problem`` says what is wrong with a bad one."""
    files = manifest.count()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("problem", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with store.open_input_stream(path, compression=None) as stream:
                    try:
                        for member in members(iter(lambda: stream.read(CHUNK), b"")):
                            rows.append(_row(member))
                            if len(rows) >= 5000:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                                rows = []
                    except BadRecord as error:
                        rows.append((None, None, None, None, None, str(error)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return manifest.select("path").repartition(max(1, files)).mapInArrow(records, RECORD)


def _row(member: bytes) -> tuple:
    try:
        found = parsed(member)
    except BadRecord as error:
        return None, None, None, None, None, str(error)
    headers, payload = found["headers"], found["payload"]
    number = lambda name: int(headers[name]) if name in headers else None
    return (
        number("x-page-id"), headers.get("warc-type"), number("x-refers-to-page-id"), None if payload is None else len(payload),
        headers.get("warc-payload-digest", "").removeprefix("sha256:"), None,
    )


def resolved(records: DataFrame) -> DataFrame:
    """Whole records; a revisit takes its payload's size from the response that it refers to."""
    whole = records.filter("problem IS NULL")
    responses = whole.filter("record_type = 'response'").groupBy(
        F.col("page_id").alias("to_id"), F.col("payload_digest").alias("to_digest")
    ).agg(F.max("payload_bytes").alias("to_bytes"))
    revisits = whole.filter("record_type = 'revisit'").join(
        responses, (F.col("refers_to") == F.col("to_id")) & (F.col("payload_digest") == F.col("to_digest")), "left"
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return whole.filter("record_type = 'response'").select(*columns).unionByName(
        revisits.withColumn("payload_bytes", F.col("to_bytes")).select(*columns)
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes the pages to archives in the shared folder and gives what reading them back finds."""
    folder = shared_path(spark, "warc")
    return resolved(written(read(write(pages, folder), folder), "warc-records"))


#: DuckDB: what the archives must hold.
SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
