"""Embedding columns as matrices of whole numbers, for the operators on vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components beyond this can't be squared and summed in 64 bits.
MOST = 1 << 26


def clean(vec: Column) -> Column:
    """True if a vector is not null and holds neither nulls nor NaN nor infinities."""
    return vec.isNotNull() & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole_numbers(frame: DataFrame, vec: Column, keep: Column, scale: int, shift: int, id_col: str) -> DataFrame:
    """(id, x array<int>): floor(scale * component) + shift, by the component as double, of the rows that `keep` names."""
    x = F.transform(vec, lambda c: c.cast("double"))
    rows = frame.select(frame[id_col].alias("id"), x.alias("x")).filter(keep)
    value = F.transform("x", lambda c: F.floor(scale * c))
    small = F.forall("x", lambda c: F.abs(scale * c) < MOST)
    return rows.select("id", F.when(small, F.transform(value, lambda c: (c + shift).cast("int"))).otherwise(F.raise_error(F.lit(f"a component times {scale} reaches {MOST}: its squares don't fit in a long"))).alias("x"))


def matrices(batches: Iterator[pa.RecordBatch], column: int = 1, rows: int = 8192) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Record batches of at most `rows` rows with their list column, all lists of one length, as a matrix."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            flat = part.column(column).flatten().to_numpy(zero_copy_only=False)
            yield part, flat.reshape(part.num_rows, -1)
