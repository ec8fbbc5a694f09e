"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. New rows are reduced to
one row per digest, anti-joined to the index by sort-merge (the index side
needs no shuffle) and appended. A table is taken in two batches, its longer
texts first: as the longest of equal texts stays, what a batch finds in the
index is settled, and the result is that of one batch.

Cases: null text counts as empty, empty texts are equal to each other, very long
texts are digested whole; of ties in length the smallest doc_id stays; repeated
ids are separate rows that share their decision; rows without a doc_id lose ties
to those that have one; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.llm.common import SPACES, texts_of
from chronosift.session import stored, work_path
from chronosift.sources.extraction import read_text, write_text

#: Rows of a bucket that a new index is laid out for (some 100 bytes each), and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 2_000_000, 8
#: Ending of the file beside the index's folder that has its number of buckets.
BUCKETS_FILE = ".buckets"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points of the text as given), text_sha256."""
    t = texts_of(docs)
    return t.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.translate("text", SPACES, ""), 256).alias("text_sha256"))


class DigestIndex:
    """One row per digest: text_sha256, keep_id, batch (who added it). `name` is
    a table of the session's catalog, `path` its folder; both may exist already.
    A new one has buckets for `rows` digests, a number fixed when it is made and
    kept beside the data, from where another session takes it; another number
    than that is refused."""

    def __init__(self, spark: SparkSession, path: str | None = None, name: str | None = None, rows: int = 0, buckets: int | None = None):
        self.spark = spark
        self.path = (path or work_path(spark, "digest-index")).rstrip("/")
        self.name = name or f"digest_index_{uuid.uuid4().hex[:12]}"
        if spark.catalog.tableExists(self.name):
            found = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").collect()}
            self.path, self.buckets = found["Location"], int(found["Num Buckets"])
        else:
            kept = read_text(spark, self.path + BUCKETS_FILE)
            if kept is None and self._has_data():
                raise ValueError(f"{self.path} has data but no file {BUCKETS_FILE}")
            self.buckets = int(kept) if kept else buckets or max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
            if kept is None:
                write_text(spark, self.path + BUCKETS_FILE, str(self.buckets))
            spark.sql(
                f"CREATE TABLE {self.name} (text_sha256 STRING, keep_id BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )
        if buckets not in (None, self.buckets):
            raise ValueError(f"{self.path} has {self.buckets} buckets, not {buckets}")

    def _has_data(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(p) and len(fs.listStatus(p)) > 0

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        (rows.select("text_sha256", "keep_id", "batch").repartition(self.buckets, "text_sha256").write.mode("append").format("parquet")
            .bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").option("path", self.path).saveAsTable(self.name))

    def drop(self) -> None:
        """Take the table out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def add(index: DigestIndex, part: DataFrame, batch: str) -> None:
    """Append those digests of `part` (see `digests`) that the index doesn't hold."""
    least = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    groups = part.groupBy("text_sha256").agg(least.alias("best")).select("text_sha256", F.col("best.id").cast("long").alias("keep_id"), F.lit(batch).alias("batch"))
    index.append(groups.hint("merge").join(index.rows().select("text_sha256"), "text_sha256", "left_anti"))


def dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size (rows of this call with the same
    digest), kept, text_sha256. Of equal texts the row with the most code
    points, then the smallest doc_id, stays; where the index held the digest
    before this call none stays and keep_id is the indexed row."""
    d = stored(digests(docs), "digests")
    about = d.agg(F.count("*").alias("n"), F.percentile_approx("n_chars", 0.5).alias("middle")).first()
    own = index or DigestIndex(docs.sparkSession, rows=about["n"])
    batch = uuid.uuid4().hex
    middle = about["middle"] or 0
    for part in (d.where(F.col("n_chars") >= middle), d.where(F.col("n_chars") < middle)):
        add(own, part, batch)
    sizes = d.groupBy("text_sha256").agg(F.count("*").alias("group_size"))
    resolved = stored(sizes.hint("merge").join(own.rows(), "text_sha256"), "resolved")
    if index is None:
        own.drop()
    out = d.hint("merge").join(resolved, "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", ((F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
       text_sha256
FROM d
"""
