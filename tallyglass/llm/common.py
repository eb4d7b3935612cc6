"""Staging, hashing and text helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new local one where that is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyglass-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/tallyglass/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def open_shared(path: str, mode: str):
    """A stream over a file of the shared folder, from a task."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    if mode == "w":
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(name, compression=None)
    return system.open_input_file(name)


_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession):
    """Deletes what `staged` writes inside, but for what it is told to keep: that goes with the scratch around this one, if any."""
    paths: list[str] = []
    token = _scratch.set((*_scratch.get(), paths))
    try:
        yield
    finally:
        _scratch.reset(token)
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def brief_shuffles(spark: SparkSession):
    """Shuffle files that an action writes inside go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(frame: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = frame.sparkSession
    path = stage_path(spark, name)
    if around := _scratch.get()[: -1 if keep else None]:
        around[-1].append(path)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def few_rows(spark: SparkSession, most: int = 1000) -> None:
    """At most `most` rows in a batch between Spark and Python: texts may be long. A smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `rows` rows, so that a task holds few texts at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def crc_bucket(col: Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def crc_bucket_py(value, modulus: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus


def utf8(value: str | None) -> bytes:
    """Null counts as empty."""
    return b"" if value is None else value.encode("utf-8", "surrogatepass")
