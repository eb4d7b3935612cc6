"""Exact duplicates by two-pass Bloom filtering.

Pass one: each task marks the Bloom cells of its rows in bitmaps of its own, cells seen and cells seen twice, cut into
segments; what travels is a segment's bitmap, or its list of cells where that is shorter, never a row. Merged by
segment, the cells seen twice form the filter of possibly repeated hashes. Pass two tests every row against it: rows
that fail some cell are certainly unique and go straight through, only the others are shuffled and compared by their
whole SHA-256.

A filter of up to `max_filter_bits` bits is broadcast. A larger one stays in the shared folder, a file a segment; then
hashes, not texts, are dealt to their segment once (a rebalancing exchange, which splits a hot segment) and tested
there, and a text finds its group by a join on its hash. A false positive costs a little shuffle, never a wrong result.

Defined results: null text counts as empty (so empty and null texts are one group); texts are equal when identical
after lower-casing A-Z; of equal texts the largest id stays; a null id stays only if its whole group has none; of
rows that repeat both id and text exactly one is kept; other columns, whatever their names, are carried untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few_rows, open_shared, slices, stage_path, staged, utf8

CELLS = 3
BITS_PER_ROW = 16
SEGMENT_BITS = 1 << 23


def text_sha256(text: str | None) -> str:
    """SHA-256, lowercase hex, of the text with A-Z lower-cased."""
    return hashlib.sha256(utf8(text).lower()).hexdigest()


def _digests(batches):
    for batch in slices(batches):
        ids, texts = batch.column(0), batch.column(1)
        shas = pa.array(map(text_sha256, texts.to_pylist()), pa.string())
        yield pa.RecordBatch.from_arrays([ids, shas], ["id", "sha"])


def hashes_of(shas) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, shas), np.uint64)


def cells_of(h: np.ndarray, segments: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each 64-bit hash, and its cells (CELLS rows) in that segment."""
    segment = (h >> np.uint64(40)) % np.uint64(segments)
    cells = np.empty((CELLS, len(h)), np.uint64)
    for k in range(CELLS):
        x = (h ^ np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        cells[k] = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(24)
    return segment, cells % np.uint64(bits)


def _packed(cells: np.ndarray, bits: int) -> bytes:
    """A list of cells, or a bitmap where that is shorter."""
    if 4 * len(cells) < bits // 8:
        return b"l" + cells.astype("<u4").tobytes()
    marks = np.zeros(bits, bool)
    marks[cells] = True
    return b"b" + np.packbits(marks, bitorder="little").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"l":
        return np.frombuffer(data, "<u4", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1), bitorder="little"))


def _bitmaps(segments: int, bits: int, most: int = 2_000_000):
    def out(held):
        segment, cells = cells_of(np.concatenate(held), segments, bits)
        found, count = np.unique((segment[None] * np.uint64(bits) + cells).ravel(), return_counts=True)
        at = found // np.uint64(bits)
        numbers, first = np.unique(at, return_index=True)
        rows = []
        for n, lo, hi in zip(numbers.tolist(), first, np.append(first[1:], len(found)), strict=True):
            own = (found[lo:hi] - np.uint64(n * bits)).astype(np.int64)
            rows.append((n, _packed(own, bits), _packed(own[count[lo:hi] > 1], bits)))
        n, seen, twice = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(seen, pa.binary()), pa.array(twice, pa.binary())], ["segment", "seen", "twice"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(hashes_of(batch.column(0).to_pylist()))
            size += batch.num_rows
            if size >= most:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    return run


def _merged(bits: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        seen, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for some, more in zip(frame.seen, frame.twice, strict=True):
            cells = _unpacked(some)
            twice[cells[seen[cells]]] = True
            twice[_unpacked(more)] = True
            seen[cells] = True
        return pd.DataFrame({"segment": frame.segment[:1], "bits": [np.packbits(twice, bitorder="little").tobytes()]})

    return run


def _filed(folder: str):
    def run(batches):
        for batch in batches:
            for segment, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_shared(f"{folder}/{segment}", "w") as file:
                    file.write(bits)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["segment"])

    return run


def _tested(folder: str, segments: int, bits: int):
    """Rows (id, sha) with `repeated`, by the filters of their segments, each read once for a run of rows."""

    def run(batches):
        number, marks = -1, None
        for batch in batches:
            segment, cells = cells_of(hashes_of(batch.column(1).to_pylist()), segments, bits)
            hit = np.zeros(batch.num_rows, bool)
            for n in np.unique(segment).tolist():
                if n != number:
                    with open_shared(f"{folder}/{n}", "r") as file:
                        number, marks = n, np.frombuffer(file.read(), np.uint8)
                own = np.flatnonzero(segment == n)
                c = cells[:, own].astype(np.int64)
                hit[own] = ((marks[c >> 3] >> (c & 7)) & 1).all(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit)], ["id", "sha", "repeated"])

    return run


class RepeatFilter:
    """The filter of possibly repeated hashes of a frame with `id` and `sha`."""

    def __init__(self, hashed: DataFrame, rows: int, max_filter_bits: int):
        need = max(1 << 15, rows * BITS_PER_ROW)
        self.bits = min(SEGMENT_BITS, 1 << (need - 1).bit_length(), 1 << (max(8, max_filter_bits).bit_length() - 1))
        self.segments = -(-need // self.bits)
        self.small = self.segments * self.bits <= max_filter_bits
        self.hashed = hashed
        maps = hashed.select("sha").mapInArrow(_bitmaps(self.segments, self.bits), "segment int, seen binary, twice binary")
        filters = maps.groupBy("segment").applyInPandas(_merged(self.bits), "segment int, bits binary")
        spark = hashed.sparkSession
        if self.small:
            packed = np.zeros((self.segments, self.bits // 8), np.uint8)
            for row in filters.collect():
                packed[row.segment] = np.frombuffer(row.bits, np.uint8)
            self.shared = spark.sparkContext.broadcast(packed)
        else:
            self.folder = stage_path(spark, "filter")
            filters.mapInArrow(_filed(self.folder), "segment int").count()

    def test(self, text: Column, digest: Callable[[str | None], str]) -> Column:
        """A struct (sha, repeated) of a text: repeated if all of its cells are marked in the broadcast filter."""
        shared, segments, bits = self.shared, self.segments, self.bits

        @F.pandas_udf("sha string, repeated boolean")
        def tested(texts: pd.Series) -> pd.DataFrame:
            shas = [digest(t) for t in texts]
            segment, cells = cells_of(hashes_of(shas), segments, bits)
            cells = cells.astype(np.int64)
            return pd.DataFrame({"sha": shas, "repeated": ((shared.value[segment.astype(np.int64), cells >> 3] >> (cells & 7)) & 1).all(0)})

        return tested(text)

    def split_hashes(self) -> tuple[DataFrame, DataFrame]:
        """(certainly unique rows, possibly repeated rows) of the filter's own frame."""
        if self.small:
            tested = self.hashed.withColumn("t", self.test(F.col("sha"), str)).select(*self.hashed.columns, "t.repeated")
        else:
            of = F.pmod(F.xxhash64("sha"), F.lit(self.segments))
            dealt = self.hashed.select("id", "sha", of.alias("segment")).hint("rebalance", F.col("segment")).sortWithinPartitions("segment")
            kind = self.hashed.schema["id"].dataType.simpleString()
            tested = staged(dealt.select("id", "sha").mapInArrow(_tested(self.folder, self.segments, self.bits), f"id {kind}, sha string, repeated boolean"), "tested")
        return tuple(tested.filter(c).drop("repeated") for c in (~F.col("repeated"), F.col("repeated")))

    def split_texts(self, frame: DataFrame, text: str, digest: Callable[[str | None], str], groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows outside the groups of `sha` to compare, the others), with their `sha`, of a frame of texts."""
        if self.small:
            tested = frame.withColumn("t", self.test(F.col(text), digest)).select(*frame.columns, "t.sha", "t.repeated")
        else:
            sha = F.pandas_udf(lambda texts: texts.map(digest, na_action=None), T.StringType())
            tested = frame.withColumn("sha", sha(text)).join(groups.select("sha", F.lit(True).alias("repeated")), "sha", "left")
            tested = tested.withColumn("repeated", F.coalesce("repeated", F.lit(False)))
        return tuple(tested.filter(c).drop("repeated") for c in (~F.col("repeated"), F.col("repeated")))


def _groups(repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    members = repeated.groupBy("sha", "id").agg(F.count(F.lit(1)).alias("copies"))
    groups = members.groupBy("sha").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    return members, groups


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = 1 << 28) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept and text_sha256."""
    few_rows(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    hashed = staged(
        docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(_digests, f"id {id_type}, sha string"),
        "digests",
    )
    unique, repeated = RepeatFilter(hashed, hashed.count(), max_filter_bits).split_hashes()
    members, groups = _groups(repeated)
    # Written first: the join then has a shuffle of its own on either side, so a hot group's members can be split.
    groups = staged(groups, "groups")
    marked = members.join(groups, "sha", "left").select(
        "id",
        "keep_id",
        "group_size",
        F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "copies"), lambda i: (i == 1) & F.col("id").eqNullSafe(F.col("keep_id")))).alias("kept"),
        "sha",
    )
    alone = unique.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return alone.unionByName(marked).withColumnsRenamed({"id": id_col, "sha": "text_sha256"})


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = 1 << 28) -> DataFrame:
    """The rows that stay, with all their columns."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    pid, ptext = (f"c{names.index(c)}" for c in (id_col, text_col))
    few_rows(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    hashed = staged(
        plain.select(F.col(pid).alias("id"), F.col(ptext).cast("string").alias("text")).mapInArrow(_digests, f"id {id_type}, sha string"),
        "digests",
    )
    bloom = RepeatFilter(hashed, hashed.count(), max_filter_bits)
    groups = staged(_groups(bloom.split_hashes()[1])[1], "groups")
    unique, perhaps = bloom.split_texts(plain.withColumn("text", F.col(ptext).cast("string")), "text", text_sha256, groups)
    stay = groups.select(F.col("sha").alias("g_sha"), "keep_id")
    survivors = perhaps.join(stay, (F.col("sha") == F.col("g_sha")) & F.col(pid).eqNullSafe(F.col("keep_id")), "left_semi")
    survivors = survivors.dropDuplicates(["sha"])
    return unique.unionByName(survivors).drop("sha", "text").toDF(*names)


ORACLE = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
