"""Web archives: compressed records, an index of where each one lies, and range reads by it.

Tasks write archives of one gzip member per record into a shared folder and return an index row
for each. A task that is run again writes files of other names, and only the rows of the attempt
that counted reach the index table, so left-over files are never read. Reading sorts the selected index
rows by file and offset and fetches neighbouring records with one request.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.session import new_folder

ARCHIVE_BYTES = 1 << 30
#: Two records are fetched together if at most so many bytes lie between them, up to a size.
GAP_BYTES, FETCH_BYTES = 64 << 10, 4 << 20
TASK_BYTES = 16 << 20  # of records that one task reads back
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, digest string, record_type string, refers_to long, payload_bytes long, file string, offset long, length long"


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if ":/" in path else (pa.fs.LocalFileSystem(), path)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _plain(value: str) -> str:
    """Header text without blanks, line ends or other control characters."""
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url:
        headers.append(f"WARC-Target-URI: {_plain(url)}")
    headers.append(f"WARC-Payload-Digest: sha1:{_digest(payload)}")
    if kind == "revisit":
        headers += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        block += payload
    headers += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, record_type, refers_to``: of equal payloads, the largest id is the response.

    A null payload is empty; payloads under ``least_bytes`` are all responses; rows that repeat the
    largest id are responses too. Among equal payloads without any id, all are responses.
    """
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("key", F.sha2(F.encode("html", "UTF-8"), 256))
    # Only what occurs twice is joined; counts are summed before they are shuffled.
    repeated = (
        keyed.where(F.octet_length("html") >= least_bytes)
        .groupBy("key")
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
        .where("n > 1 and response_id is not null")
    )
    again = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return keyed.join(repeated, "key", "left").select(
        "page_id",
        "url",
        "html",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("response_id")).alias("refers_to"),
    )


def write(rows: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row of ``with_revisits`` below ``folder``; the index, read from its table.

    ``folder`` is one that all executors share (a new one in the cluster's shared folder if None).
    The index has the file, offset and length of every record, its url, digest, type and full size.
    """
    spark = rows.sparkSession
    folder = folder or new_folder(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        name, stream, at = None, None, 0
        try:
            for batch in batches:
                out = []
                for page_id, url, html, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if stream is None or at >= ARCHIVE_BYTES:
                        if stream is not None:
                            stream.close()
                        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        fs.create_dir(f"{base}/archives", recursive=True)
                        stream, at = fs.open_output_stream(f"{base}/archives/{name}", compression=None, buffer_size=1 << 20), 0
                    payload = html.encode()
                    packer = zlib.compressobj(1, wbits=31)
                    packed = packer.compress(record(page_id, url, payload, kind, refers_to, date)) + packer.flush()
                    stream.write(packed)
                    out.append((page_id, url, _digest(payload), kind, refers_to, len(payload), name, at, len(packed)))
                    at += len(packed)
                columns = zip(*out, strict=True) if out else [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _INDEX_TYPES, strict=True)], _INDEX_NAMES)
        finally:
            if stream is not None:
                stream.close()

    rows.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index").withColumn("folder", F.lit(folder))


_INDEX_NAMES = [f.split()[0] for f in INDEX.split(", ")]
_INDEX_TYPES = [pa.string() if f.endswith("string") else pa.int64() for f in INDEX.split(", ")]


def parse(member: bytes) -> dict:
    """The headers and the payload of one compressed record; an error if its digest does not hold."""
    whole = zlib.decompress(member, wbits=31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no record begins here")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    headers["payload_bytes"] = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    headers["payload_digest"] = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response":
        if _digest(payload) != headers["payload_digest"] or len(payload) != headers["payload_bytes"]:
            raise ValueError(f"{headers['WARC-Record-ID']}: the payload is not what was written")
        headers["payload"] = payload
    return headers


def _id(urn: str | None) -> int | None:
    told = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(told) if told else None


def read(index: DataFrame) -> DataFrame:
    """The records that the index rows name: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload``.

    Select the rows beforehand. The payload of a revisit is null; its size and digest are those of the
    full one. Rows are sorted by file and offset over the whole cluster, so each task reads a stretch of
    few files, and neighbouring records come with one request. There are as many tasks as the records'
    bytes ask for, not as the small index does.
    """
    places = index.select("folder", "file", "offset", "length")
    tasks = -(-(places.agg(F.sum("length")).first()[0] or 1) // TASK_BYTES)
    wanted = places.repartitionByRange(tasks, "folder", "file", "offset").sortWithinPartitions("folder", "file", "offset")

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
        """Members of neighbouring records."""
        source, path, ranges = None, None, []

        def fetch() -> list[bytes]:
            begin = ranges[0][0]
            got = source.read_at(ranges[-1][0] + ranges[-1][1] - begin, begin)
            return [got[o - begin : o - begin + n] for o, n in ranges]

        for batch in batches:
            for folder, name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here = f"{folder}/archives/{name}"
                if ranges and (here != path or offset - sum(ranges[-1]) > GAP_BYTES or offset + length - ranges[0][0] > FETCH_BYTES):
                    yield fetch()
                    ranges = []
                if here != path:
                    if source is not None:
                        source.close()
                    fs, base = _filesystem(folder)
                    source, path = fs.open_input_file(f"{base}/archives/{name}"), here
                ranges.append((offset, length))
        if ranges:
            yield fetch()
        if source is not None:
            source.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in fetched(batches):
            got = [parse(m) for m in members]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_id(g["WARC-Record-ID"]) for g in got], pa.int64()),
                    pa.array([g.get("WARC-Target-URI") for g in got], pa.string()),
                    pa.array([g["payload_bytes"] for g in got], pa.int64()),
                    pa.array([g["payload_digest"] for g in got], pa.string()),
                    pa.array([g["WARC-Type"] for g in got], pa.string()),
                    pa.array([_id(g.get("WARC-Refers-To")) for g in got], pa.int64()),
                    pa.array([g.get("payload") for g in got], pa.binary()),
                ],
                ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
            )

    return wanted.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
