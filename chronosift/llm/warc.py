"""WARC archives written by tasks, with an index that comes first in reading.

A task writes its records as gzip members of files of its own, each record a
member, and returns one index row for each: file, offset, length, URL, digest
and what else selects a record. Only a file whose task ended well is in the
index, so a repeated task leaves an unused file and nothing else. Reading takes
the selected rows of the index, deals them by file and span of offsets, sorts
them, joins ranges that lie close to one another and reads each run at once.

Payloads that occur before are revisits without a payload: of equal payloads of
`least` bytes and more the record with the smallest page_id is the response.

The archive's folder must be reachable by pyarrow.fs from every executor: a
shared file system, HDFS, S3 or GCS.

Cases: null html is an empty payload; very long payloads are written and read
whole, one in memory at a time; rows that share the smallest page_id of their
payload are responses, each of them; a missing page_id is larger than any
other, and where no equal payload has one, all are responses; a null or empty
URL gives a record without a target, control characters and spaces in URLs are
percent-encoded in the header; an empty table gives an empty index; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.llm.common import slices
from chronosift.session import stored, work_path

#: Bytes after which a task begins another file.
FILE_BYTES = 256 << 20
#: Ranges at most so many bytes apart are read as one; a run ends when it has RUN_BYTES.
GAP, RUN_BYTES = 64 << 10, 4 << 20
#: Offsets of one file go to readers in spans of so many bytes; so many bytes are a reader's share.
SPAN_BYTES, TASK_BYTES = 8 << 20, 16 << 20
LEAST_PAYLOAD = 100
#: The capture time of records, which pages don't have.
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, so that revisits can name it."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}:{digest}'.encode()).digest())}>"


def _target(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member. The block is an HTTP response; a revisit's has no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    headers += [("WARC-Target-URI", _target(url))] if url else []
    headers += [("Page-ID", str(page_id))] if page_id is not None else []
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("Refers-To-Page-ID", str(refers_to))]
    return _member(headers, http if revisit else http + payload)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of the record (names in lower case) and its block."""
    z = zlib.decompressobj(31)
    data = z.decompress(member) + z.flush()
    if z.unused_data or not z.eof:
        raise ValueError("a range is not one record")
    at = data.index(b"\r\n\r\n")
    lines = data[:at].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("a range does not begin with a record")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    size = int(headers["content-length"])
    if data[at + 4 + size :] != b"\r\n\r\n":
        raise ValueError("a record's length is not that of its block")
    return headers, data[at + 4 : at + 4 + size]


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Spark's scheme for S3 is not that of pyarrow."""
    return pafs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)


def _qualified(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/").replace("file:/", "file:///", 1).replace("file://///", "file:///")


def roles(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null for responses)."""
    html = F.coalesce("html", F.lit(""))
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"))
    first = d.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    # a table of its own, so that the join can split a payload of many rows
    first = stored(first.where("n > 1 AND first_id IS NOT NULL").select("payload_digest", "first_id"), "first-payloads")
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id"))
    out = d.join(first.hint("merge"), "payload_digest", "left")
    return out.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(F.col("first_id").isNotNull() & later, F.col("first_id")).alias("refers_to"))


def write(pages: DataFrame, path: str, least: int = LEAST_PAYLOAD, file_bytes: int = FILE_BYTES) -> None:
    """Archives under `path`/data and their index under `path`/index."""
    spark = pages.sparkSession
    data = _qualified(spark, path) + "/data"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _fs(data)
        fs.create_dir(folder, recursive=True)
        out, name, at, rows = None, "", 0, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in INDEX.split(", ")])

        try:
            for s in slices(batches, "html"):
                for page_id, url, html, size, digest, refers_to in zip(*[s.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")]):
                    if out is None:
                        name, rows = f"{uuid.uuid4().hex}.warc.gz", []
                        out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                        info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        out.write(info)
                        at = len(info)
                    revisit = refers_to is not None
                    member = record(page_id, url, html.encode(), digest, refers_to, revisit)
                    out.write(member)
                    rows.append((page_id, url, "revisit" if revisit else "response", refers_to, size, digest, name, at, len(member)))
                    at += len(member)
                    if at >= file_bytes:
                        out.close()
                        out = None
                        yield batch()
            if out is not None:
                out.close()
                out = None
                yield batch()
        finally:
            if out is not None:
                out.close()

    roles(pages, least).mapInArrow(run, INDEX).write.parquet(f"{path}/index")


def index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, with the columns of INDEX."""
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def runs(ranges: list[tuple[int, int]], gap: int = GAP, most: int = RUN_BYTES) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) ranges to (first, after last, end offset): neighbours
    at most `gap` apart are one run, until it has `most` bytes."""
    out: list[tuple[int, int, int]] = []
    for i, (offset, length) in enumerate(ranges):
        if out and offset - out[-1][2] <= gap and offset + length - ranges[out[-1][0]][0] <= most:
            out[-1] = (out[-1][0], i + 1, max(out[-1][2], offset + length))
        else:
            out.append((i, i + 1, offset + length))
    return out


def read(spark: SparkSession, path: str, selected: DataFrame | None = None) -> DataFrame:
    """The records that `selected` (rows of the index; all where it is None)
    names, as their archives have them: RECORDS. A response's payload is
    compared with its digest; a revisit's is null."""
    data = _qualified(spark, path) + "/data"
    rows = (index(spark, path) if selected is None else selected).select("file", "offset", "length")
    # a fixed number of tasks: index rows are too small for Spark to tell what reading them costs
    tasks = -(-(rows.agg(F.sum("length").alias("n")).first()["n"] or 0) // TASK_BYTES)
    rows = rows.withColumn("span", F.floor(F.col("offset") / SPAN_BYTES)).repartition(max(tasks, 1), "file", "span").sortWithinPartitions("file", "offset").select("file", "offset", "length")

    def one(member: bytes) -> tuple:
        h, block = parse(member)
        digest = h["warc-payload-digest"].removeprefix("sha256:")
        payload = None if h["warc-type"] == "revisit" else block[block.index(b"\r\n\r\n") + 4 :]
        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{h['warc-record-id']}: payload and digest differ")
        number = lambda k: int(h[k]) if k in h else None
        return number("page-id"), h.get("warc-target-uri"), h["warc-type"], number("refers-to-page-id"), digest, payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _fs(data)
        name, source = None, None
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        for b in batches:
            files, places = b.column("file").to_pylist(), list(zip(b.column("offset").to_pylist(), b.column("length").to_pylist()))
            begins = [i for i in range(len(files)) if i == 0 or files[i] != files[i - 1]]
            for i, end in zip(begins, [*begins[1:], len(files)]):
                if files[i] != name:
                    if source is not None:
                        source.close()
                    name = files[i]
                    source = fs.open_input_file(f"{folder}/{name}")
                own = places[i:end]
                for first, last, upto in runs(own):
                    start = own[first][0]
                    chunk = source.read_at(upto - start, start)
                    out = [one(chunk[o - start : o - start + n]) for o, n in own[first:last]]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in RECORDS.split(", ")])
        if source is not None:
            source.close()

    return rows.mapInArrow(run, RECORDS)


def unused_files(spark: SparkSession, path: str) -> list[str]:
    """Files that no row of the index names: what repeated tasks left."""
    fs, folder = _fs(_qualified(spark, path) + "/data")
    have = [f.path for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))]
    known = {r.file for r in index(spark, path).select("file").distinct().toLocalIterator()}
    return [f for f in have if f.rpartition("/")[2] not in known]


def resolved(records: DataFrame, *columns: str) -> DataFrame:
    """Records with what their payload has: a revisit gets the columns (made from
    payload, see `described`) of the response it refers to."""
    own = records.where("record_type = 'response'")
    by = own.groupBy(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest")).agg(*[F.first(c).alias(f"__{c}") for c in columns])
    later = records.where("record_type = 'revisit'").drop(*columns)
    later = later.join(by.hint("merge"), (F.col("refers_to") == F.col("__id")) & (F.col("payload_digest") == F.col("__digest")), "left")
    later = later.withColumns({c: F.col(f"__{c}") for c in columns}).select(*records.columns)
    return own.unionByName(later)


def round_trip(pages: DataFrame, path: str | None = None, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Write the archives, read every record back: page_id, payload_bytes,
    payload_digest (of the payload as read, a revisit's from its response),
    record_type, refers_to."""
    spark = pages.sparkSession
    path = path or work_path(spark, "warc")
    write(pages, path, least)
    sizes = F.octet_length("payload").cast("long").alias("payload_bytes")
    # without payloads, so that the archives are read once
    records = stored(read(spark, path).select("page_id", "record_type", "refers_to", "payload_digest", sizes), "records")
    return resolved(records, "payload_bytes").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = r"""
WITH d AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages),
r AS (SELECT *, payload_bytes >= 100 AND first_id < page_id AS again FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM r
"""
