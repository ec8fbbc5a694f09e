"""Sorted hits as a Spark data source: `spark.read.format("hits")` and
`readStream`.

`write_hits` sorts hits once by (time, id) into pages, Parquet files that hold
stretches of that order, and writes a catalog row for each page with its first
and last key. The reader plans one partition per page that meets [start, end),
so a page is read by one task and nothing is sorted or collected again. The
stream's offset is the key of the last hit delivered, which is its resume token:
a query that starts again with its checkpoint goes on behind it.

The folder must be reachable by pyarrow.fs from driver and executors. What is
written later must lie behind what is there (its first key after the last one's),
as a resumed scan asks only for what is behind its token; anything else is
refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "_id string, ts_us long, value string"
PAGES = "file string, first_us long, first_id string, last_us long, last_id string, n long"
NOWHERE = {"ts_us": -(1 << 62), "_id": ""}


def write_hits(hits: DataFrame, path: str, pages: int) -> None:
    """Append hits (_id, ts_us, value; rows without a time or an id are left to
    the rejects) as some `pages` pages of equal size."""
    spark = hits.sparkSession
    path, batch = path.rstrip("/"), uuid.uuid4().hex[:12]
    known = hits.where("_id IS NOT NULL AND ts_us IS NOT NULL").select("_id", F.col("ts_us").cast("long"), "value")
    known.repartitionByRange(pages, "ts_us", "_id").sortWithinPartitions("ts_us", "_id").write.parquet(f"{path}/pages/{batch}")
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/pages/{batch}").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    key = F.struct("ts_us", "_id")
    found = rows.groupBy("file").agg(F.min(key).alias("a"), F.max(key).alias("z"), F.count("*").alias("n"))
    found = found.select(F.concat(F.lit(f"{batch}/"), "file").alias("file"), F.col("a.ts_us").alias("first_us"), F.col("a._id").alias("first_id"), F.col("z.ts_us").alias("last_us"), F.col("z._id").alias("last_id"), "n")
    first, last = found.agg(F.min(F.struct("first_us", "first_id")).alias("k")).first().k, None
    from chronosift.sources.extraction import _fs

    fs, p = _fs(spark, f"{path}/catalog")
    if fs.exists(p):
        last = spark.read.schema(PAGES).parquet(f"{path}/catalog").agg(F.max(F.struct("last_us", "last_id")).alias("k")).first().k
    if first and last and tuple(first) <= tuple(last):
        raise ValueError(f"hits from {tuple(first)} on lie before {tuple(last)}, which is there")
    found.coalesce(1).write.mode("append").parquet(f"{path}/catalog")


def _catalog(path: str) -> list[dict]:
    """One row per page, in order; pages are as few as their size makes them."""
    fs, folder = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(f"{folder}/catalog").type == pafs.FileType.NotFound:
        return []
    return sorted(ds.dataset(f"{folder}/catalog", filesystem=fs, format="parquet").to_table().to_pylist(), key=lambda r: (r["first_us"], r["first_id"]))


@dataclass
class Page(InputPartition):
    """A page, and the keys beyond which (exclusive) and up to which (inclusive) its hits count."""

    file: str
    after: tuple[int, str]
    upto: tuple[int, str]


def _micros(text: str | None) -> int | None:
    """Micros of an ISO time, UTC where it names no zone."""
    if text is None:
        return None
    t = datetime.fromisoformat(text)
    return round((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp() * 1_000_000)


class _Pages:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.start, self.end = _micros(options.get("start")), _micros(options.get("end"))

    def _between(self, after: tuple[int, str], upto: tuple[int, str]) -> list[Page]:
        """Pages that hold keys in (after, upto] and times in [start, end)."""
        out = []
        for r in _catalog(self.path):
            a, z = (r["first_us"], r["first_id"]), (r["last_us"], r["last_id"])
            if z > after and a <= upto and (self.start is None or z[0] >= self.start) and (self.end is None or a[0] < self.end):
                out.append(Page(r["file"], after, upto))
        return out

    def _read(self, page: Page) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(f"{folder}/pages/{page.file}") as f:
            for b in pq.ParquetFile(f).iter_batches(columns=["_id", "ts_us", "value"]):
                t, i = b.column("ts_us"), b.column("_id")
                beyond = pc.or_(pc.greater(t, page.after[0]), pc.and_(pc.equal(t, page.after[0]), pc.greater(i, page.after[1])))
                within = pc.or_(pc.less(t, page.upto[0]), pc.and_(pc.equal(t, page.upto[0]), pc.less_equal(i, page.upto[1])))
                keep = pc.and_(beyond, within)
                if self.start is not None:
                    keep = pc.and_(keep, pc.greater_equal(t, self.start))
                if self.end is not None:
                    keep = pc.and_(keep, pc.less(t, self.end))
                b = b.filter(keep)
                if b.num_rows:
                    yield b


LOWEST, HIGHEST = (NOWHERE["ts_us"], ""), (1 << 62, "")


class HitsReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return self._between(LOWEST, HIGHEST) or [Page("", LOWEST, LOWEST)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return self._read(partition) if partition.file else iter(())


class HitsStreamReader(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return dict(NOWHERE)

    def latestOffset(self) -> dict:  # noqa: N802
        pages = _catalog(self.path)
        return {"ts_us": pages[-1]["last_us"], "_id": pages[-1]["last_id"]} if pages else dict(NOWHERE)

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self._between((start["ts_us"], start["_id"]), (end["ts_us"], end["_id"]))

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return self._read(partition)

    def commit(self, end: dict) -> None: ...


class HitsSource(DataSource):
    """Options: path; start and end (ISO times, start <= time < end), all where absent."""

    @classmethod
    def name(cls) -> str:
        return "hits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return HitsReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return HitsStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HitsSource)


def resume_token(spark: SparkSession, checkpoint: str) -> dict | None:
    """The key behind which a stream with this checkpoint goes on."""
    offsets = [r.value for r in spark.read.text(f"{checkpoint.rstrip('/')}/offsets").collect() if r.value.startswith("{") and "ts_us" in r.value]  # a line per batch Spark keeps, some hundred
    return max(map(json.loads, offsets), key=lambda o: (o["ts_us"], o["_id"]), default=None)
