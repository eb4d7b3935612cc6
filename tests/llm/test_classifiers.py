import zlib

import numpy as np

from tallyglass.llm import quality as Q
from tallyglass.llm import toxicity as T


def test_gradients_agree_with_differences():
    net = T.Network(["a", "b"], ["xyz", "xy"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, doc, ids, size = T.layout([["a", "xyz", "b", "a"], ["q"] * 70])

    def loss():
        x = net.inputs(net.features(words))
        return float((net.forward(net.project(x).astype(np.float64), ids, size) * (1 + np.arange(len(doc)))).sum())

    x = net.inputs(net.features(words))
    gates = net.project(x)
    _, saved = net.forward(gates, ids, size, keep=True)
    g, dgates = net.backward((1 + np.arange(len(doc))).astype(float), saved, gates.shape[1])
    g["bx"] = dgates.sum(1, keepdims=True)
    for name in ("u", "wa", "v", "wo", "bx"):
        at = tuple(0 for _ in net.p[name].shape)
        old, eps = net.p[name][at], 1e-3
        net.p[name][at] = old + eps
        up = loss()
        net.p[name][at] = old - eps
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-2 * max(1, abs(g[name][at])), name


def tables(spark, n=240):
    rng = np.random.default_rng(4)
    plain = [f"w{k}" for k in range(50)]
    rows, marks = [], []
    for i in range(n):
        words = list(rng.choice(plain, 40))
        bad = i % 4 == 0
        if bad:
            words[rng.integers(40)] = "grimblix" + "aeiou"[i % 5]
        poor = i % 3 == 0
        rows.append((i, " ".join(w.upper() + "%%%" if poor else w for w in words), "k"))
        marks.append((i, int(not poor), int(bad)))
    rows += [(1000, None, "k"), (1001, "", "k"), (1001, "", "k"), (None, "w1 grimblixa", "k"), (1002, "w1 " * 60_000 + "grimblixe", "k")]
    marks += [(1000, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 3 == 1


def test_toxicity(spark):
    docs, labels = tables(spark)
    model = T.fit(docs, labels)
    out = T.score_toxicity(docs, model).collect()
    assert len(out) == 245 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == held(r.doc_id) for r in out)
    wrong = sum(r.predicted != int(r.doc_id % 4 == 0) for r in out if r.doc_id is not None and r.doc_id < 1000 and r.held_out)
    assert wrong <= 4
    assert {r.predicted for r in out if r.doc_id == 1002} == {1}
    left = T.drop_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == sum(r.predicted == 0 for r in out)
    assert T.score_toxicity(docs.limit(0), T.fit(docs.limit(0), labels)).count() == 0


def test_quality(spark):
    docs, labels = tables(spark)
    out = Q.score_quality(docs, Q.fit(docs, labels)).collect()
    assert len(out) == 245 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == held(r.doc_id) for r in out)
    assert all(r.predicted == int(r.doc_id % 3 != 0) for r in out if r.doc_id is not None and r.doc_id < 1000)
    assert Q.score_quality(docs.limit(0), Q.fit(docs, labels.limit(0))).count() == 0


def test_the_quality_threshold_is_the_same_quantile_for_an_evened_sample():
    from tallyglass.llm.quality import Ranker

    rng = np.random.default_rng(3)
    good, poor = rng.normal(1.0, 1.0, (6000, 3)), rng.normal(-0.5, 1.0, (600, 3))
    whole = Ranker(np.concatenate([good, poor]), np.repeat([1, 0], [6000, 600]))
    even = Ranker(np.concatenate([good[:600], poor]), np.repeat([1, 0], [600, 600]), {0: 600, 1: 6000})
    plain = Ranker(np.concatenate([good[:600], poor]), np.repeat([1, 0], [600, 600]))
    rows = np.concatenate([good, poor])
    share = lambda m: (m.score(rows) < 0.5).mean()
    assert abs(share(whole) - 600 / 6600) < 0.001
    assert abs(share(even) - 600 / 6600) < 0.02 < abs(share(plain) - 600 / 6600)


def test_quality_gradient_steps_follow_the_logistic_loss():
    """The fitted weights are near a minimum of the loss on the pairs: small moves along any of them don't lower it."""
    from tallyglass.llm.quality import Ranker

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0.4, 1.0, (300, 2)), rng.normal(-0.4, 1.0, (300, 2))])
    y = np.repeat([1, 0], [300, 300])
    model = Ranker(x, y, rounds=3000)
    z = model.expand(x)
    pick = np.random.default_rng(7)
    d = z[pick.choice(np.flatnonzero(y == 1), 40_000)] - z[pick.choice(np.flatnonzero(y == 0), 40_000)]
    loss = lambda w: np.log1p(np.exp(-(d @ w))).mean() + 0.5e-4 * w @ w
    least = loss(model.weights)
    for k in range(len(model.weights)):
        for step in (-0.3, 0.3):
            w = model.weights.copy()
            w[k] += step
            assert loss(w) > least - 1e-3
