"""Centroid clustering and whitening against plain whole-number and linear-algebra versions."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyglass.llm import centroids as C
from tallyglass.llm import whitening as W

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def plain_clusters(rows, dims, count, rounds, scale=64):
    kept = [(k, [math.floor(scale * x) for x in v]) for k, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:count]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cents))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(own[k]) for x in zip(*own[k], strict=True)] if k in own else c for k, c in enumerate(cents)]
    got = [(k, *near(v)) for k, v in kept]
    held = Counter()
    for _, d, c in got:
        held[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((k, c, d, held[c], sum(held.values()), sha[c]) for k, d, c in got)


def odd_rows(dims, n, seed):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(5, dims)) * 0.4
    rows = [(k, (heads[k % 5] + rng.normal(size=dims) * 0.05).tolist()) for k in range(n)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (900, [0.0] * dims), (901, [-1.0] * dims), (902, [30.0] * dims)]
    rows += [(903, rows[1][1])] * 40
    rows += [(910, None), (911, []), (912, [1.0] * (dims - 1)), (913, [NAN] + [0.0] * (dims - 1)), (914, [0.0] * (dims - 1) + [INF]), (915, [-INF] * dims), (916, [None] + [0.0] * (dims - 1))]
    return rows


@pytest.mark.parametrize("segments", [1, 3, 8])
def test_clusters_equal_brute_force(spark, segments):
    rows = odd_rows(8, 150, 1)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, x string").repartition(5)
    rounded = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows]
    got = Counter(tuple(r) for r in C.cluster(frame, dims=8, count=6, segments=segments).collect())
    assert got == plain_clusters(rounded, 8, 6, 3)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [9.0, -9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(tuple(r) for r in C.cluster(frame, dims=2).collect()) == plain_clusters(rows, 2, 16, 3)
    assert C.cluster(frame.filter("vec_id > 5"), dims=2).collect() == []
    with pytest.raises(Exception, match="a component times 64"):
        C.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dims=2).collect()


def test_screening_leaves_out_distances_and_no_centroid():
    rng = np.random.default_rng(4)
    centroids = rng.integers(-60, 60, (16, 64)) * rng.integers(1, 9, (16, 1))
    x = centroids[rng.integers(0, 16, 3000)] + rng.integers(-9, 9, (3000, 64))
    full = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    best, least, done = C.nearest(x, C.segment_norms(x, 16), centroids, C.segment_norms(centroids, 16))
    assert (best == full.argmin(axis=1)).all() and (least == full.min(axis=1)).all()
    assert done < 0.25 * full.size
    best, least, _ = C.nearest(x[:9] * 0, C.segment_norms(x[:9] * 0, 16), np.array([[1] * 64, [-1] * 64, [1] * 64]), C.segment_norms(np.array([[1] * 64, [-1] * 64, [1] * 64]), 16))
    assert (best == 0).all() and (least == 64).all()


def test_cluster_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = con.execute(f"select {', '.join(names)} from ({C.ORACLE})").fetchall()
    got = [tuple(r[n] for n in names) for r in C.op12_centroid_clustering(spark, SF).collect()]
    assert Counter(got) == Counter(want) and len(got) == 500


def plain_whitening(x, count):
    n, s = len(x), x.sum(axis=0)
    d = x - s / n
    v = d.T @ d / n
    e, p = np.linalg.eigh(v)
    e, p = e[::-1][:count], p[:, ::-1][:, :count]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return deviation, d @ p / np.sqrt(e), e / np.trace(v)


def check_whitening(got, ids, x, count=8):
    deviation, w, explained = plain_whitening(x, count)
    count = w.shape[1]
    assert len(got) == len(ids) * count
    assert {r.n for r in got} == {len(x)} and {r.identity_error < 1e-9 for r in got} == {True}
    have = {(r.vec_id, r.component): r for r in got}
    for k, i in enumerate(ids):
        for c in range(count):
            r = have[i, c + 1]
            assert r.deviation == deviation[k] and abs(r.explained - explained[c]) < 1e-9
    signs = np.sign([have[i, c + 1].whitened for c in range(count) for i in ids[:1]] * w[0])
    mine = np.array([[have[i, c + 1].whitened for c in range(count)] for i in ids])
    assert np.abs(mine * signs - w).max() < 1e-6


def test_whitening_query_equals_linear_algebra(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in t["embedding"]])
    check_whitening(W.op13_embedding_whitening(spark, SF).collect(), t["vec_id"], x)


@pytest.mark.parametrize("tile", [3, 7, 64])
def test_tiles_of_any_width_give_one_covariance(spark, tile):
    rows = [r for r in odd_rows(7, 120, 2) if r[0] not in (902,)]
    frame = spark.createDataFrame([(k, n, *r) for k, (r, n) in enumerate(zip(rows, range(len(rows)), strict=True))], "key long, component long, vec_id long, embedding array<double>").repartition(4)
    good = [(k, v) for k, (_, v) in enumerate(rows) if v and len(v) == 7 and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in good])
    got = W.whiten(frame, id_col="key", tile=tile).withColumnRenamed("id", "vec_id").collect()
    check_whitening(got, [k for k, _ in good], x)
    vectors = W.whole_numbers(frame, frame.embedding, W.clean(W.F.col("x")) & (W.F.size("x") == 7), 1024, 100_000, "key")
    n, total = W.sums(vectors, 7)
    exact = [[sum((n * int(a) - int(total[i])) * (n * int(b) - int(total[j])) for a, b in x[:, [i, j]]) / n**3 for j in range(7)] for i in range(7)]
    assert np.allclose(W.covariance(vectors, n, total, tile, block_rows=10), exact, rtol=1e-15, atol=0)


def test_large_products_stay_exact():
    a = np.array([[2**26, -(2**26) + 1], [2**26 - 3, 5]] * 3000)
    want = [[sum(int(r[i]) * int(r[j]) for r in a) for j in range(2)] for i in range(2)]
    assert W.product(a, a).tolist() == want
    assert W.deviations(np.array([[2**26, 0], [0, 0]]), 10**12, np.array([10**12, 0], object)) == [None, 10**24 if 10**24 < 1 << 63 else None]


def test_edges_of_whitening(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert W.whiten(make([(1, None), (2, [NAN]), (3, [])])).collect() == []
    one = W.whiten(make([(1, [0.5, 0.25])])).collect()
    assert [(r.id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [(1, 1, 1, 0, None, 0.0, 0.0), (1, 2, 1, 0, None, 0.0, 0.0)]
    line = W.whiten(make([(1, [0.0, 1.0]), (None, [1.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (9, [1.0])])).collect()
    assert len(line) == 8 and {r.n for r in line} == {4} and {r.whitened is None for r in line if r.component == 2} == {True}
    assert sorted(round(abs(r.whitened), 9) for r in line if r.component == 1) == [round(1 / 3**0.5, 9)] * 3 + [round(3**0.5, 9)]
