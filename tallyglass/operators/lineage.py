"""Cutting lineage between the steps of an iterative or staged job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a new local one on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallyglass-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(frame: DataFrame) -> DataFrame:
    """The frame from Parquet files in the shared folder: smaller than a checkpoint, and each later step reads only its columns."""
    folder = f"{shared_folder(frame.sparkSession)}/tallyglass/staged-{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def cut(frame: DataFrame) -> DataFrame:
    """The frame from a checkpoint in the shared folder."""
    spark = frame.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return frame.checkpoint()
