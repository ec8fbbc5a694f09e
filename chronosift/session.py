"""Session construction and small helpers about storage and sizes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "chronosift", **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow; `conf` keys use `__` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    base |= {k.replace("__", "."): v for k, v in conf.items()}
    return b.config(map=base).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as named in spark.checkpoint.dir.

    Where that setting is absent and all runs on one machine (tests, a local
    run) a temporary folder is chosen once and stored in the session; on a
    cluster executors would not see it, so the setting is required there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        base = "file://" + tempfile.mkdtemp(prefix="chronosift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the shared folder."""
    return f"{shared_dir(spark)}/chronosift/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clean(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results that still read them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/chronosift/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table whose readers are all done."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str, by: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Write `df` to the shared folder (to `path`, where its caller removes it)
    and read it again: lineage is cut by a table that survives lost executors."""
    spark = df.sparkSession
    path = path or work_path(spark, name)
    w = df.write
    if by:
        w = w.partitionBy(*by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
