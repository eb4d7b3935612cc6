"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket

TRAIN_MODULUS, HELD_OUT = 3, 1


def held_out(id_col):
    return crc_bucket(id_col, TRAIN_MODULUS) == HELD_OUT


def training_labels(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(id, y): the labels that may be learnt from."""
    known = labels.select(labels[id_col].alias("id"), labels[label].cast("int").alias("y")).filter("id is not null and y in (0, 1)").distinct()
    return known.filter(~held_out(F.col("id")))


def class_counts(labels: DataFrame, label: str, id_col: str = "doc_id") -> dict[int, int]:
    """How many rows of each class may be learnt from."""
    return {0: 0, 1: 0} | {r.y: r["count"] for r in training_labels(labels, label, id_col).groupBy("y").count().collect()}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most_per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of at most about most_per_class training rows of each class, picked by a hash of the id.

    Rows whose id falls in the held-out bucket, null labels and null ids are never used. The picked ids are few by
    construction, so they are broadcast to the scan of the texts.
    """
    known = training_labels(labels, label, id_col)
    have = class_counts(labels, label, id_col)
    rate = lambda y: min(1.0, most_per_class / max(1, have.get(y, 0)))
    share = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    picked = known.filter(share < F.when(F.col("y") == 1, rate(1)).otherwise(rate(0)))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return texts.join(F.broadcast(picked), "id").select("text", "y")
