"""Embedding whitening by a tiled covariance.

The dimensions are cut into tiles. Rows are cut into row-blocks, and each row-block into one column block per tile; the
column blocks are dealt by row-block, so those of the same rows meet, and each pair of them is multiplied to a partial tile
of the covariance. A task adds up its partial tiles, and the tiles are summed by their key (pair of tiles). The tiles are
assembled to the covariance, whose eigenvectors scale the centred rows.

All of it is exact up to the eigenvectors: components are whole numbers, centred on the floor of their mean before they are
multiplied; what the floor leaves out is a fraction of one and is taken off the sums of products as a whole-number term.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are vectors of
another length than the most frequent one (ties: the longer); repeated rows and ids count each for itself, a null id stays
null; no rows give no rows; with fewer dimensions than components there are as many components as dimensions. A component
without variance (as of a single row, or repeats alone) has null `whitened`, explains 0 and is no part of identity_error. A
deviation beyond a long is null. Components of 2^26 or more after scaling are refused with an error. Other columns aren't
looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged
from .vectors import clean, matrices, whole_numbers

SCALE, SHIFT, COMPONENTS, TILE, BLOCK_ROWS, MOST_DIMS = 1024, 100_000, 8, 16, 1024, 8192


def _tiles(dims: int, tile: int) -> list[tuple[int, int]]:
    return [(lo, min(dims, lo + tile)) for lo in range(0, dims, tile)]


def sums(vectors: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Rows, and the exact sum of each dimension."""

    def run(batches):
        n, total = 0, [0] * dims
        for _, x in matrices(batches):
            n += len(x)
            total = [a + b for a, b in zip(total, x.sum(axis=0, dtype=np.int64).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(v) for v in total]])], ["n", "s"])

    parts = vectors.mapInArrow(run, "n long, s array<string>").select("n", F.posexplode("s").alias("d", "s"))
    rows = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = np.zeros(dims, object)
    for r in rows:
        out[r.d] = int(r.s)
    return (rows[0].n if rows else 0), out


def column_blocks(vectors: DataFrame, centre: np.ndarray, tile: int, block_rows: int) -> DataFrame:
    """(row_block, tile, block binary): the centred columns of some rows, as 32-bit integers, row by row."""
    cuts = _tiles(len(centre), tile)

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        for _, x in matrices(batches, rows=block_rows):
            d = (x - centre).astype("<i4")
            names = pa.array([f"{part}:{k}"] * len(cuts))
            k += 1
            yield pa.RecordBatch.from_arrays([names, pa.array(range(len(cuts)), pa.int32()), pa.array([np.ascontiguousarray(d[:, lo:hi]).tobytes() for lo, hi in cuts], pa.binary())], ["row_block", "tile", "block"])

    return vectors.mapInArrow(run, "row_block string, tile int, block binary")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact whole-number product a' b: in doubles where every sum stays below 2^53, in 64 bits or beyond otherwise."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * len(a)
    if most < 1 << 53:
        return (a.astype(float).T @ b.astype(float)).astype(np.int64)
    kind = np.int64 if most < 1 << 62 else object
    return a.astype(kind).T @ b.astype(kind)


def covariance_tiles(blocks: DataFrame, dims: int, tile: int) -> DataFrame:
    """(a, b, i, s array<decimal>): row i of each pair of tiles, a <= b, summed over all row-blocks."""
    cuts = _tiles(dims, tile)

    def run(batches):
        waiting: dict[str, dict[int, np.ndarray]] = {}
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for name, t, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lo, hi = cuts[t]
                here = waiting.setdefault(name, {})
                here[t] = np.frombuffer(raw, "<i4").reshape(-1, hi - lo)
                if len(here) == len(cuts):
                    del waiting[name]
                    for a in range(len(cuts)):
                        for b in range(a, len(cuts)):
                            part = product(here[a], here[b])
                            old = total.get((a, b))
                            if old is None:
                                total[a, b] = part
                            elif max(np.abs(old).max(initial=0), np.abs(part).max(initial=0)) < 1 << 61:
                                total[a, b] = old + part
                            else:
                                total[a, b] = old.astype(object) + part.astype(object)
        if waiting:
            raise RuntimeError("a row-block's column blocks came to different tasks")
        for (a, b), p in total.items():
            own = [[str(v) for v in [*row, *[0] * (tile - len(row))]] for row in p.tolist()]
            cols = [pa.array([v] * len(own), pa.int32()) for v in (a, b)] + [pa.array(range(len(own)), pa.int32()), pa.array(own, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "i", "s"])

    parts = blocks.repartition("row_block").mapInArrow(run, "a int, b int, i int, s array<string>")
    added = parts.groupBy("a", "b", "i").agg(*[F.sum(F.col("s")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(tile)])
    return added.select("a", "b", "i", F.array(*[f"s{j}" for j in range(tile)]).alias("s"))


def covariance(vectors: DataFrame, n: int, total: np.ndarray, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """The covariance of the rows, divisor n: each entry the nearest double to the exact one."""
    dims = len(total)
    centre = np.array([int(s) // n for s in total], np.int64)
    rest = [int(s) - n * int(c) for s, c in zip(total, centre, strict=True)]
    cuts, v = _tiles(dims, tile), np.zeros((dims, dims))
    for r in covariance_tiles(column_blocks(vectors, centre, tile, block_rows), dims, tile).toLocalIterator():
        i, (lo, hi) = cuts[r.a][0] + r.i, cuts[r.b]
        for j, s in zip(range(lo, hi), r.s, strict=False):
            v[i, j] = v[j, i] = (n * int(s) - rest[i] * rest[j]) / (n * n)
    return v


def principal(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, their unit eigenvectors as columns, and whether each has variance above rounding."""
    e, p = np.linalg.eigh(v)
    e, p = e[::-1][:count], p[:, ::-1][:, :count]
    return e, p, e > 1e-12 * max(np.trace(v), 0)


def whitener(n: int, total: np.ndarray, e: np.ndarray, p: np.ndarray, on: np.ndarray):
    """A function from rows of whole numbers to their whitened components; not-a-number where there is no variance."""
    centre = np.array([int(s) // n for s in total], np.int64)
    rest = np.array([(int(s) - n * int(c)) / n for s, c in zip(total, centre, strict=True)])
    scale = np.where(on, 1 / np.sqrt(np.where(on, e, 1)), np.nan)
    return lambda x: ((x - centre) - rest) @ p * scale


def identity_error(vectors: DataFrame, n: int, white, on: np.ndarray) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, from one more pass over the rows."""
    keep = np.flatnonzero(on)
    count = len(keep)
    if not count:
        return 0.0

    def run(batches):
        s, q = np.zeros(count), np.zeros((count, count))
        for _, x in matrices(batches):
            w = white(x)[:, keep]
            s += w.sum(axis=0)
            q += w.T @ w
        flat = np.concatenate([s, q.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["k", "s"])

    got = np.zeros(count + count * count)
    for r in vectors.mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
        got[r.k] = r.s
    mean, q = got[:count] / n, got[count:].reshape(count, count) / n  # the rows are centred: the mean is rounding only
    return float(np.abs(q - np.outer(mean, mean) - np.eye(count)).max())


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Of each row the exact sum of (n * x - total)^2, null beyond a long."""
    centre = np.array([int(s) // n for s in total], np.int64)
    rest = [int(s) - n * int(c) for s, c in zip(total, centre, strict=True)]
    d = x - centre
    if (n * (int(np.abs(d).max(initial=0)) + 1)) ** 2 * x.shape[1] < 1 << 63:
        return ((n * d - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    out = ((n * d.astype(object) - np.array(rest, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in out]


def whiten(frame: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, tile: int = TILE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    spark = frame.sparkSession
    rows = whole_numbers(frame, frame[vec_col], clean(F.col("x")) & (F.size("x") > 0), scale, shift, id_col)
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = staged(rows, "vectors", keep=True)
    lengths = vectors.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], shape)
    dims = lengths[0].dims
    if dims > MOST_DIMS:
        raise ValueError(f"{dims} dimensions: the covariance is assembled on the driver for up to {MOST_DIMS}")
    vectors = vectors.filter(F.size("x") == dims)
    n, total = sums(vectors, dims)
    v = covariance(vectors, n, total, tile)
    e, p, on = principal(v, components)
    white = whitener(n, total, e, p, on)
    explained = np.where(on, e / max(np.trace(v), 1e-300), 0.0)
    error = identity_error(vectors, n, white, on)
    count = len(e)

    def run(batches):
        for batch, x in matrices(batches):
            each = np.repeat(np.arange(len(x)), count)
            deviation = pa.array(deviations(x, n, total), pa.int64())
            w = white(x).ravel()
            cols = [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()), pa.array(np.full(len(each), n)), deviation.take(pa.array(each)),
                    pa.array(w, mask=np.isnan(w)), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, shape)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")).withColumnRenamed("id", "vec_id")
