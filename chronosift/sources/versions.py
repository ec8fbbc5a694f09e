"""Tables whose content changes in one step: versions in folders of their own,
and a pointer to the current one that a single rename replaces."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.sources.extraction import _fs, read_text, write_text

POINTER = "CURRENT"


class NoVersionError(FileNotFoundError):
    """A versioned table that was never written."""


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name, length and SHA-256 of the data files under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def schema_hash(df: DataFrame) -> str:
    """Of names, types and nullability in order."""
    return hashlib.sha256(df.schema.json().encode()).hexdigest()


class VersionedTable:
    """`path`/v-<number>-<unique> holds a version's Parquet files, beside it its
    digests (a table, as it grows with the files) and its manifest (rows, bytes,
    schema hash, details). Readers follow the pointer, so whenever a writer stops
    they see the version before or the new one, whole. Of two writers at once the
    later pointer counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> str | None:
        return read_text(self.spark, f"{self.path}/{POINTER}")

    def versions(self) -> list[str]:
        fs, p = _fs(self.spark, self.path)
        if not fs.exists(p):
            return []
        return sorted(n for s in fs.listStatus(p) if s.isDirectory() and (n := s.getPath().getName()).startswith("v-"))

    def stage(self, df: DataFrame, **details) -> str:
        """Write a version that nobody reads yet; df may read this table itself."""
        numbers = [int(v.split("-")[1]) for v in self.versions()]
        name = f"v-{max(numbers, default=0) + 1:08d}-{uuid.uuid4().hex[:8]}"
        base = f"{self.path}/{name}"
        df.write.parquet(f"{base}/data")
        written = self.spark.read.schema(df.schema).parquet(f"{base}/data")
        file_digests(self.spark, f"{base}/data").write.parquet(f"{base}/digests")
        files = self.spark.read.parquet(f"{base}/digests").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
        manifest = {"version": name, "rows": written.count(), "files": files.n, "bytes": files.bytes, "schema_hash": schema_hash(written), "details": details}
        write_text(self.spark, f"{base}/manifest.json", json.dumps(manifest, sort_keys=True))
        return name

    def publish(self, version: str) -> None:
        if read_text(self.spark, f"{self.path}/{version}/manifest.json") is None:
            raise NoVersionError(f"{self.path}/{version}")
        write_text(self.spark, f"{self.path}/{POINTER}", version)

    def write(self, df: DataFrame, **details) -> str:
        version = self.stage(df, **details)
        self.publish(version)
        return version

    def _base(self, version: str | None) -> str:
        version = version or self.current()
        if version is None:
            raise NoVersionError(self.path)
        return f"{self.path}/{version}"

    def read(self, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self._base(version)}/data")

    def manifest(self, version: str | None = None) -> dict:
        return json.loads(read_text(self.spark, f"{self._base(version)}/manifest.json"))

    def verify(self, version: str | None = None) -> list[str]:
        """What of a version differs from its manifest: files that are missing,
        new or changed, and the schema; empty if nothing does."""
        base = self._base(version)
        was = self.spark.read.parquet(f"{base}/digests").select("name", F.col("sha256").alias("was"))
        wrong = file_digests(self.spark, f"{base}/data").join(was, "name", "full").where("NOT (sha256 <=> was)")
        kind = F.when(F.col("was").isNull(), "new").when(F.col("sha256").isNull(), "missing").otherwise("changed")
        out = [f"{r.kind} file {r['name']}" for r in wrong.select("name", kind.alias("kind")).orderBy("name").toLocalIterator()]
        return out + ["schema"] * (schema_hash(self.read(version)) != self.manifest(version)["schema_hash"])

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all but the newest `keep` versions and the current one; readers of others lose them."""
        old = [v for v in self.versions()[: -keep or None] if v != self.current()]
        for v in old:
            fs, p = _fs(self.spark, f"{self.path}/{v}")
            fs.delete(p, True)
        return old
