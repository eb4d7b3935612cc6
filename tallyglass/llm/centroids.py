"""Centroid clustering of whole-number vectors with block-norm screening.

Each vector is compressed once to the Euclidean norms of its segments. By Cauchy and Schwarz, a segment of a vector and the
same segment of a centroid are at least as far apart as their norms, so the squared differences of the norms add up to a
lower bound of the squared distance. A vector's distance to the centroid of the smallest bound is computed first; after it
only centroids whose bound doesn't exceed the best exact distance so far receive one. Distances and sums are whole numbers
in 64 bits and thus exact, so the order of tasks never matters; bounds are lowered by a margin that covers their rounding.

Vectors with their norms are staged in the shared folder. A round is one pass over them: a task sums the vectors of each
cluster and sends one row per cluster, so that a cluster with a third of all rows costs no more than another; the driver
gets one row per cluster. Two more passes with the final centroids give the inertias and the rows of the result.

Defined results: vectors of another length, or with null or non-finite components, don't count, and there may be none; a
null id is the empty decimal; rows that repeat an id or a vector count each for itself, and of equal hashes the smaller
vector is the earlier centroid; with fewer vectors than centroids there are as many centroids as vectors; a tie goes to the
smaller number; a cluster without vectors keeps its centroid. Components of 2^20 or more in size are refused with an error,
as their squares don't fit; an inertia beyond a long is null. Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged
from .vectors import clean, matrices, whole_numbers

DIMS, SCALE, CENTROIDS, ROUNDS, SEGMENTS = 64, 64, 16, 3, 16


def segment_norms(x: np.ndarray, segments: int) -> np.ndarray:
    """The norm of each segment of each row: runs of components, as even as the dimensions allow."""
    at = np.linspace(0, x.shape[1], segments + 1).astype(int)[:-1]
    return np.sqrt(np.add.reduceat(x.astype(np.int64) ** 2, np.unique(at), axis=1).astype(float))


def compressed(rows: DataFrame, segments: int) -> DataFrame:
    """Adds norms array<double> to (id, x)."""

    def run(batches):
        for batch, x in matrices(batches):
            norms = segment_norms(x, segments)
            ends = pa.array(np.arange(0, norms.size + 1, norms.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(norms.ravel()))], [*batch.schema.names, "norms"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, x array<int>, norms array<double>")


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, centroid_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (ties: the smaller number), its squared distance, and how many distances were computed."""
    bound = (norms**2).sum(axis=1)[:, None] + (centroid_norms**2).sum(axis=1) - 2 * (norms @ centroid_norms.T)
    margin = 1e-9 * ((norms**2).sum(axis=1)[:, None] + (centroid_norms**2).sum(axis=1)) + 1e-6
    bound -= margin
    x = x.astype(np.int64)
    exact = lambda rows, k: ((x[rows] - centroids[k]) ** 2).sum(axis=1)
    best = bound.argmin(axis=1)
    least = exact(slice(None), best)
    done = len(x)
    first = best.copy()
    for k in range(len(centroids)):
        rows = np.flatnonzero((bound[:, k] <= least) & (first != k))
        d = exact(rows, k)
        done += len(rows)
        better = (d < least[rows]) | ((d == least[rows]) & (k < best[rows]))
        best[rows[better]], least[rows[better]] = k, d[better]
    return best, least, done


def _with_norms(batches: Iterator[pa.RecordBatch]):
    for batch, x in matrices(batches):
        yield batch, x, batch.column(2).flatten().to_numpy().reshape(len(x), -1)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray, segments: int, inertia: bool = False) -> DataFrame:
    """(cluster, n, sums array<bigint>) of the nearest centroids: one row per cluster that has vectors.

    Tasks add up before the shuffle. With `inertia`, sums holds the summed distance alone.
    """
    dims = 1 if inertia else centroids.shape[1]
    centroid_norms = segment_norms(centroids, segments)

    def run(batches):
        n, sums = np.zeros(len(centroids), np.int64), [[0] * dims for _ in centroids]
        for _, x, norms in _with_norms(batches):
            best, least, _ = nearest(x, norms, centroids, centroid_norms)
            for k in np.unique(best).tolist():
                mine = best == k
                n[k] += mine.sum()
                part = [int(least[mine].astype(object).sum())] if inertia else x[mine].sum(axis=0, dtype=np.int64).tolist()
                sums[k] = [a + b for a, b in zip(sums[k], part, strict=True)]
        have = np.flatnonzero(n)
        sums = [[str(v) for v in sums[k]] for k in have]
        if len(have):
            yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(n[have]), pa.array(sums, pa.list_(pa.string()))], ["cluster", "n", "sums"])

    parts = vectors.mapInArrow(run, "cluster int, n long, sums array<string>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(dims)])
    return added.select("cluster", "n", F.array(*[f"s{k}" for k in range(dims)]).alias("sums"))


def first_centroids(vectors: DataFrame, count: int) -> np.ndarray:
    """The vectors with the smallest sha256 of `1:<id>`, in order; equal hashes by the vectors."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(count).collect()], np.int64)


def moved(centroids: np.ndarray, vectors: DataFrame, segments: int) -> np.ndarray:
    """The floored means of the centroids' vectors; a centroid without any stays."""
    out = centroids.copy()
    for r in cluster_sums(vectors, centroids, segments).collect():
        out[r.cluster] = [int(s) // r.n for s in r.sums]
    return out


def cluster(
    frame: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE, count: int = CENTROIDS, rounds: int = ROUNDS, segments: int = SEGMENTS
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that counts."""
    spark = frame.sparkSession
    rows = whole_numbers(frame, frame[vec_col], clean(F.col("x")) & (F.size("x") == dims), scale, 0, id_col)
    vectors = staged(compressed(rows, segments), "vectors", keep=True)
    centroids = first_centroids(vectors, count)
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], shape)
    for _ in range(rounds):
        centroids = moved(centroids, vectors, segments)
    held = {r.cluster: int(r.sums[0]) for r in cluster_sums(vectors, centroids, segments, inertia=True).collect()}
    fits = lambda v: v if v < 1 << 63 else None
    own, total = [fits(held.get(k, 0)) for k in range(len(centroids))], fits(sum(held.values()))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    centroid_norms = segment_norms(centroids, segments)

    def run(batches):
        for batch, x, norms in _with_norms(batches):
            best, least, _ = nearest(x, norms, centroids, centroid_norms)
            pick = pa.array(best)
            cols = [batch.column(0), pa.array(best, pa.int32()), pa.array(least), pa.array(own, pa.int64()).take(pick), pa.array([total] * len(x), pa.int64()), pa.array(digests).take(pick)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return vectors.mapInArrow(run, shape)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")).withColumnRenamed("id", "vec_id")


def _oracle() -> str:
    """The same rounds as a chain of common table expressions; division floors by hand."""
    dist = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    near = f"SELECT v.vec_id, v.x, arg_min(c.k, struct_pack(d := {dist}, k := c.k)) AS k, min({dist}) AS d FROM v, {{c}} c GROUP BY v.vec_id, v.x, v.row"
    steps = [
        f"v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {DIMS} AND list_aggregate(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), 'bool_and'))",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY 1, 2 LIMIT {CENTROIDS}))",
    ]
    for r in range(ROUNDS):
        steps += [
            f"a{r} AS ({near.format(c=f'c{r}')})",
            f"e{r} AS (SELECT k, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM a{r})",
            f"m{r} AS (SELECT k, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM e{r} GROUP BY 1, 2))",
            f"c{r + 1} AS (SELECT c{r}.k, coalesce(g.x, c{r}.x) AS x FROM c{r} LEFT JOIN (SELECT k, list(x ORDER BY i) AS x FROM m{r} GROUP BY 1) g ON c{r}.k = g.k)",
        ]
    steps.append(f"z AS ({near.format(c=f'c{ROUNDS}')})")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(z.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY z.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM z JOIN c{ROUNDS} c ON z.k = c.k"""


ORACLE = _oracle()
