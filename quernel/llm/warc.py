"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Every record is a gzip member of its own. The reader hands byte ranges of the
archives to tasks; a task scans its range for the gzip magic, takes a place as
a member only if a WARC header decodes from it, and owns the records that
start in its range, reading past its end to finish the last. Archives of ours
also carry each member's offset in a gzip extra field, so that a member inside
another's payload is never taken for a record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import durable, map_rows, new_path, prepare, table

MAGIC, EXTRA = b"\x1f\x8b\x08", b"QN"
#: Bytes of an archive file after which a writing task starts another, of a reader's range, and of one read.
FILE_BYTES, SPLIT_BYTES, READ_BYTES = 256 << 20, 4 << 20, 1 << 18
#: Reading tasks for each core at least, where there are so many ranges, and ranges of a task at most.
WAVES, RANGES = 8, 64
#: Payloads of at least this many bytes are stored once.
REVISIT_BYTES = 0


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of `uri` and the path in it; every task opens files this way."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def member(data: bytes, offset: int) -> bytes:
    """`data` as one gzip member that knows it starts at `offset`."""
    head = MAGIC + b"\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H2sHQ", 12, EXTRA, 8, offset)
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return head + packer.compress(data) + packer.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    clean = (url or "").replace("\r", " ").replace("\n", " ")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of page_id, url, html; returns path and bytes of the files.

    Rows with equal payloads of at least REVISIT_BYTES: that with the smallest
    page_id is the response, others revisit it (rows that repeat that id are
    responses too; null ids revisit unless all are null). A null html is an
    empty payload, a null url an empty one. Other columns are ignored. A file appears under its name only
    when whole and its name depends on the task's part alone, so a task that
    runs again replaces what it wrote.
    """
    prepare(pages.sparkSession)
    html = F.coalesce("html", F.lit("")).cast("binary")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"))
    first = slim.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("uses")).where("uses > 1 and first_id is not null")
    first = durable(first.select(F.col("digest").alias("f_digest"), "first_id"), "payloads")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    rows = rows.join(first, F.col("digest") == F.col("f_digest"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.select("page_id", "url", "html", F.when(revisit, F.col("first_id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        out, at, temporary = None, 0, ""

        def close() -> None:
            out.close()
            name = f"part-{task.partitionId():06d}-{len(done):04d}.warc.gz"
            store.move(temporary, f"{root}/{name}")
            done.append((f"{folder}/{name}", at))

        for batch in batches:
            for x in batch.to_pylist():
                if out is None:
                    temporary = f"{root}/.writing-{task.partitionId()}-{task.taskAttemptId()}-{len(done)}"
                    out, at = store.open_output_stream(temporary), 0
                packed = member(record(x["page_id"], x["url"], x["html"], x["refers_to"]), at)
                out.write(packed)
                at += len(packed)
                if at >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "bytes": [n for _, n in done]})

    return durable(rows.mapInArrow(run, "path string, bytes long"), "archives")


class _Reader:
    """Records of one byte range of one file."""

    def __init__(self, store: pafs.FileSystem, path: str, size: int):
        self.file, self.size = store.open_input_file(path), size
        self.buffer, self.base = b"", 0

    def at(self, offset: int, n: int) -> bytes:
        """Up to `n` bytes from `offset`, through a buffer of READ_BYTES."""
        if not (self.base <= offset and offset + n <= self.base + len(self.buffer)):
            self.file.seek(offset)
            self.base, self.buffer = offset, self.file.read(min(max(n, READ_BYTES), self.size - offset))
        return self.buffer[offset - self.base : offset - self.base + n]

    def next_magic(self, offset: int, end: int) -> int | None:
        while offset < end:
            chunk = self.at(offset, min(READ_BYTES, end + len(MAGIC) - 1 - offset))
            found = chunk.find(MAGIC)
            if found >= 0 and offset + found < end:
                return offset + found
            if len(chunk) < len(MAGIC):
                return None
            offset += len(chunk) - len(MAGIC) + 1
        return None

    def member(self, offset: int) -> tuple[bytes, int] | None:
        """The data of the member at `offset` and where it ends, if it is a whole WARC record's."""
        head = self.at(offset, 24)
        if len(head) >= 24 and head[3] & 4 and head[12:14] == EXTRA and struct.unpack_from("<Q", head, 16)[0] != offset:
            return None  # a copy of a member, inside another
        unpack, parts, here = zlib.decompressobj(31), [], offset
        try:
            while not unpack.eof:
                chunk = self.at(here, min(READ_BYTES, self.size - here))
                if not chunk:
                    return None
                here += len(chunk)
                parts.append(unpack.decompress(chunk))
                if len(parts) == 1 and not parts[0].startswith(b"WARC/1."[: max(1, len(parts[0]))]):
                    return None
        except zlib.error:
            return None
        data = b"".join(parts)
        return (data, here - len(unpack.unused_data)) if data.startswith(b"WARC/1.") and b"\r\n\r\n" in data else None

    def records(self, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        at = self.next_magic(start, end)
        while at is not None and at < end:
            got = self.member(at)
            if got:
                yield at, got[0]
            at = self.next_magic(got[1] if got else at + 1, end)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record; a block without HTTP headers is the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]))
    block = rest[: int(fields.get("content-length") or 0)]
    return fields, block.partition(b"\r\n\r\n")[2] if "application/http" in fields.get("content-type", "") else block


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of archives, given path and bytes of each.

    Returns path, offset, headers (map) and payload (binary). A range without a
    record start gives nothing; what is not a whole record is passed over.
    Ranges are rows of a few bytes, so they are dealt over a number of tasks
    that follows from theirs: a task each, up to WAVES for each core, and at
    most RANGES of them in a task. Other columns are ignored.
    """
    spark = files.sparkSession
    prepare(spark)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    ranges = files.where("bytes > 0").select("path", "bytes", starts.alias("start"))
    n = files.where("bytes > 0").agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    ranges = ranges.repartition(int(max(min(n, WAVES * spark.sparkContext.defaultParallelism), n // RANGES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        for batch in batches:
            for x in batch.to_pylist():
                store, path = filesystem(x["path"])
                rows, held = [], 0
                for offset, data in _Reader(store, path, x["bytes"]).records(x["start"], min(x["bytes"], x["start"] + split_bytes)):
                    fields, payload = parse(data)
                    rows.append((x["path"], offset, list(fields.items()), payload))
                    held += len(payload)
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return ranges.mapInArrow(run, "path string, offset long, headers map<string,string>, payload binary")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path and bytes of the archives in `folder`, by Spark's own listing."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", F.col("length").alias("bytes"))


def digests(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records.

    A response's bytes and digest are computed from the payload read, a
    revisit's come from its headers.
    """

    def make():
        def work(c):
            out = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            for fields, payload in zip(map(dict, c["headers"]), c["payload"], strict=True):
                number = lambda k: int(x) if (x := fields.get(k, "").removeprefix("<urn:page:").removesuffix(">")) else None  # noqa: B023, E731
                full = fields.get("warc-type") == "response"
                out["page_id"].append(number("warc-record-id"))
                out["payload_bytes"].append(len(payload) if full else int(fields["warc-payload-length"]))
                out["payload_digest"].append(base32_sha1(payload) if full else fields["warc-payload-digest"].removeprefix("sha1:"))
                out["record_type"].append(fields.get("warc-type"))
                out["refers_to"].append(number("warc-refers-to"))
            return out

        return work

    return map_rows(records.select("headers", "payload"), make, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Every row of `pages`, written to archives in the shared folder and read back."""
    return digests(read(write(table(spark, sf_dir, "pages"), new_path(spark, "warc"))))


OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (
  SELECT page_id, n, min(page_id) OVER (PARTITION BY h) AS first_id, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a,
         list_transform(range(32), lambda i: (('0x' || substr(d, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) AS vs
  FROM p),
r AS (SELECT *, array_to_string(list_transform(vs, lambda v: substr(a, v::INT + 1, 1)), '') AS b FROM q)
SELECT page_id, n AS payload_bytes, b AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM r
"""
