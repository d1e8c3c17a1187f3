"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local master without one (a test) gets a temporary folder, one for each application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="wireloom-llm-")
    return _own[sc.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table once and reads it back: later readers, and retries after a lost executor, see the same rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made, once nothing reads them any more."""
    for table in tables:
        remove(table.sparkSession, table.written_path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, through the file system that Spark itself uses."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


def fold(key, parts: int):
    """``crc32(key as text) mod parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it if the table has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Python tasks of the jobs run inside get so many rows at once, which bounds their memory when rows are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
