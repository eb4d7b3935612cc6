import zlib
from collections import Counter
from math import isclose, log10
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tallyglass.llm import lm_scoring as L

SF = "/root/testdata/sf0.01"


def brute(rows):
    toks = {k: [*(t or "").encode().lower().split(), None] for k, (_, t) in enumerate(rows)}
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for k, t in toks.items() if not held[k] for w in t)
    n, v = sum(c.values()), len(c)
    return {k: (held[k], len(t), sum(c[w] > 0 for w in t), n, sum(log10((c[w] + 1) / (n + v + 1)) for w in t)) for k, t in toks.items()}


def check(rows, got):
    want = sorted((str(rows[k][0]), *x) for k, x in brute(rows).items())
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert len(want) == len(have)
    for a, b in zip(want, have, strict=True):
        assert a[:5] == b[:5] and isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9), (a, b)
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = L.op2_lm_scoring(spark, SF).collect()
    check(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (5, "É é A a  x"), (6, "w " * 40_000), (7, " \t\n")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, row int, word string")
    check(rows, L.score_documents(docs).collect())
    assert L.score_documents(docs.limit(0)).count() == 0


def test_probabilities_sum_to_one_and_gradients():
    class V:
        head, count = 40, np.arange(60, 0, -1)
        tail_mass = np.ones(L.TAILS)
        word_class = np.arange(40) * L.CLASSES // 40
        lo = np.searchsorted(word_class, np.arange(L.CLASSES))
        hi = np.searchsorted(word_class, np.arange(L.CLASSES), "right")

    V.word_class = np.sort(np.arange(40) % 7)
    V.lo, V.hi = (np.searchsorted(V.word_class, np.arange(L.CLASSES), s) for s in ("left", "right"))
    m = L.Model(V)
    m.p = {k: x.astype(np.float64) for k, x in m.p.items()}
    h = np.random.default_rng(1).standard_normal((1, L.HIDDEN))
    codes = np.concatenate([np.arange(40), np.full(L.TAILS + L.CLASSES - 7, -1)])
    cls = np.concatenate([V.word_class, np.arange(7, L.CLASSES + L.TAILS)])
    logp, _ = m.output(np.repeat(h, len(codes), 0), codes, cls)
    assert abs(np.exp(logp).sum() - 1) < 1e-6
    g = {k: np.zeros_like(x) for k, x in m.p.items()}
    m.output(h, np.array([3]), V.word_class[[3]], g)
    for name in ("wc", "bc", "wo", "bo"):
        at = (3,) + (0,) * (m.p[name].ndim - 1) if name in ("wo", "bo") else (0,) * m.p[name].ndim
        old = m.p[name][at]
        m.p[name][at] = old + 1e-5
        up = m.output(h, np.array([3]), V.word_class[[3]])[0][0]
        m.p[name][at] = old - 1e-5
        down = m.output(h, np.array([3]), V.word_class[[3]])[0][0]
        m.p[name][at] = old
        assert abs(-(up - down) / 2e-5 - g[name][at]) < 1e-4


def test_trains_on_whole_texts(spark):
    texts = [None, "", *(" ".join(f"w{(k * j) % 97}" for j in range(n)) for k, n in enumerate([1, 23, 24, 25, 3000] + [150] * 200))]
    counted = spark.createDataFrame([(w, 0, n) for w, n in Counter(w for t in texts for w in [*L.tokens(t), L.END]).items()], "word binary, tail int, n long")
    vocab = L.Vocabulary(counted)
    start = L.Model(vocab)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    out = list(L._train(SimpleNamespace(value=(vocab, start.p)))(iter([batch])))
    assert out[0].column(1)[0].as_py() == sum(len(L.tokens(t)) + 1 for t in texts)
    flat = np.frombuffer(b"".join(out[0].column(2).to_pylist()), np.float32)
    assert np.isfinite(flat).all()


def test_warm_up_rows_by_id(spark):
    docs = spark.range(9000).selectExpr("id", "if(id % 3 = 0, 'a copy of one text', concat('text ', id)) as text")
    rows = L.warm_rows(docs, 300)
    assert len(rows) == 300 and 60 <= sum(r.text == "a copy of one text" for r in rows) <= 140
    assert sorted(rows) == sorted(L.warm_rows(docs.repartition(7), 300))
