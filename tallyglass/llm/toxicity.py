"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a word are its own embedding (unknown words share one), the mean embedding of its hashed character
trigrams and the sum of the embeddings of its known beginnings (stems of 3 to 8 letters), so that inflected and unseen
forms are recognised by their letters. In training, words and stems are left out at random. A text is cut into overlapping windows;
in each, a GRU runs in both directions and attention pools the states into one logit. The text's score is that of its
highest window, and training follows the same rule: a document's loss goes to its highest window.

Fitting uses at most `most_per_class` labelled rows of each class (a documented bound), whole texts of any length, of
which a step draws at most `most_windows` windows; scoring covers every window of every whole text, in place, without a
shuffle.

Defined results: null text counts as empty; a text without words has one window without states, whose score is the
model's bias; rows that repeat an id are scored each; without training rows of both classes every score is the share.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_rows, slices
from .sampling import held_out, labelled_sample

WORDS = re.compile(r"\w+")
WINDOW, STRIDE = 64, 48
HIDDEN, WORD_DIM, CHAR_DIM, STEM_DIM, ATTEND = 12, 8, 8, 8, 12
GRAMS = 1 << 13
STEMS = range(3, 9)


def sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def trigram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram codes of all words, one after the other, and where each word's begin."""
    raw = [b"^" + w.encode() + b"$" for w in words]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    code = flat[:-2] * 961_748_927 + flat[1:-1] * 982_451_653 + flat[2:] * 32_452_843
    ends = np.cumsum(size)
    keep = np.ones(len(code), bool)
    keep[ends[:-1] - 1] = keep[ends[:-1] - 2] = False
    count = size - 2
    return ((code ^ (code >> 17)) % GRAMS)[keep], np.cumsum(count) - count


def stems_of(word: str) -> list[str]:
    return [word[:k] for k in STEMS if len(word) >= k]


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the overlapping windows that cover texts of these lengths."""
    n = np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(lengths)), n)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return doc, start, np.minimum(WINDOW, lengths[doc] - start)


class Network:
    def __init__(self, vocabulary: list[str], stems: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.vocab = {w: k + 1 for k, w in enumerate(vocabulary)}
        self.stems = {w: k + 1 for k, w in enumerate(stems)}
        d, h = WORD_DIM + CHAR_DIM + STEM_DIM, HIDDEN
        f = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else s[0])).astype(np.float32)
        self.p = {
            "words": (rng.standard_normal((len(vocabulary) + 1, WORD_DIM)) * 0.1).astype(np.float32),
            "grams": (rng.standard_normal((GRAMS, CHAR_DIM)) * 0.5).astype(np.float32),
            "stems": (rng.standard_normal((len(stems) + 1, STEM_DIM)) * 0.1).astype(np.float32),
            "wx": f(2, d, 3 * h),
            "bx": np.zeros((2, 1, 3 * h), np.float32),
            "u": f(2, h, 3 * h),
            "wa": f(2 * h, ATTEND),
            "ba": np.zeros(ATTEND, np.float32),
            "v": f(ATTEND),
            "wo": f(2 * h),
            "bo": np.full(1, -1.0, np.float32),
        }

    def features(self, words: list[str]):
        """Of distinct words: ids, and runs (flat, starts, sizes) of trigram codes and of known stems."""
        ids = np.array([self.vocab.get(w, 0) for w in words], np.int64)
        known, stems, ends = self.stems.get, [], []
        for word in words:
            stems.append(0)
            for n in range(STEMS.start, min(len(word) + 1, STEMS.stop)):
                # A stem is at least as frequent as its extensions, so after an unknown one no longer one is known.
                if (k := known(word[:n])) is None:
                    break
                stems.append(k)
            ends.append(len(stems))
        stems, sizes = np.array(stems, np.int64), np.diff(np.array([0, *ends], np.int64))
        codes, starts = trigram_rows(words)
        return ids, (codes, starts, np.diff(np.append(starts, len(codes)))), (stems, np.cumsum(sizes) - sizes, sizes)

    def inputs(self, features):
        """Input vectors of distinct words."""
        ids, (codes, at, count), (stems, stem_at, _) = features
        grams = np.add.reduceat(self.p["grams"][codes], at, axis=0) / count[:, None]
        leads = np.add.reduceat(self.p["stems"][stems], stem_at, axis=0)
        return np.concatenate([self.p["words"][ids], grams, leads], 1).astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of distinct words for both directions, with a last row for padding."""
        g = np.matmul(x[None], self.p["wx"]) + self.p["bx"]
        return np.concatenate([g, np.zeros((2, 1, g.shape[2]), np.float32)], 1)

    def forward(self, gates: np.ndarray, ids: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logits of windows: ids (B, T) into the rows of gates, padded at the end; size: the real lengths."""
        b, t = ids.shape
        h3, k = gates.shape[2], HIDDEN
        back = ids[:, ::-1]
        mask = np.arange(t)[None] < size[:, None]
        masks = np.stack([mask, mask[:, ::-1]]).astype(np.float32)
        h = np.zeros((2, b, k), np.float32)
        states = np.empty((t, 2, b, k), np.float32)
        tape = []
        x = np.empty((2, b, h3), np.float32)
        for i in range(t):
            np.take(gates[0], ids[:, i], axis=0, out=x[0])
            np.take(gates[1], back[:, i], axis=0, out=x[1])
            g = np.matmul(h, self.p["u"])
            rz = sigmoid(x[..., : 2 * k] + g[..., : 2 * k])
            r, z = rz[..., :k], rz[..., k:]
            n = np.tanh(x[..., 2 * k :] + r * g[..., 2 * k :])
            m = masks[:, :, i, None]
            new = (n + z * (h - n)) * m
            if keep:
                tape.append((h, r.copy(), z.copy(), n, g[..., 2 * k :].copy(), m))
            states[i] = h = new
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
        a = np.tanh(both @ self.p["wa"] + self.p["ba"])
        e = a @ self.p["v"] + np.where(mask.T, 0, -1e9).astype(np.float32)
        e -= e.max(0)
        w = np.exp(e) * mask.T
        w /= np.maximum(w.sum(0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", w, both)
        logit = pooled @ self.p["wo"] + self.p["bo"]
        return (logit, (ids, back, tape, both, a, w, pooled)) if keep else logit

    def backward(self, dlogit, saved, gates_rows: int):
        """Gradients of the parameters above the inputs, and of the gate rows."""
        ids, back, tape, both, a, w, pooled = saved
        p, k, g = self.p, HIDDEN, {}
        g["wo"], g["bo"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
        dpool = dlogit[:, None] * p["wo"]
        dboth = w[..., None] * dpool[None]
        dw = np.einsum("tbh,bh->tb", both, dpool)
        de = w * (dw - (w * dw).sum(0))
        g["v"] = np.einsum("tba,tb->a", a, de)
        da = de[..., None] * p["v"] * (1 - a * a)
        g["wa"], g["ba"] = np.einsum("tbh,tba->ha", both, da), da.sum((0, 1))
        dboth = dboth + da @ p["wa"].T
        t = len(tape)
        dstate = np.stack([dboth[:, :, :k], dboth[::-1, :, k:]], 1)
        g["u"] = np.zeros_like(p["u"])
        dgates = np.zeros((2, gates_rows, 3 * k), np.float32)
        dh = np.zeros_like(dstate[0])
        ut = p["u"].transpose(0, 2, 1)
        for i in range(t - 1, -1, -1):
            h, r, z, n, gn, m = tape[i]
            d = (dh + dstate[i]) * m
            dz = d * (h - n) * z * (1 - z)
            dn = d * (1 - z) * (1 - n * n)
            dr = dn * gn * r * (1 - r)
            dx = np.concatenate([dr, dz, dn], -1)
            dg = np.concatenate([dr, dz, dn * r], -1)
            g["u"] += np.matmul(h.transpose(0, 2, 1), dg)
            dh = d * z + np.matmul(dg, ut)
            np.add.at(dgates[0], ids[:, i], dx[0])
            np.add.at(dgates[1], back[:, i], dx[1])
        return g, dgates[:, :-1]


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.k = p, rate, 0
        self.m, self.v = ({n: np.zeros_like(x) for n, x in p.items()} for _ in range(2))

    def step(self, g: dict):
        self.k += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        for n, x in g.items():
            x = x * np.float32(clip)
            self.m[n] += np.float32(0.1) * (x - self.m[n])
            self.v[n] += np.float32(0.01) * (x * x - self.v[n])
            self.p[n] -= np.float32(self.rate) * (self.m[n] / np.float32(1 - 0.9**self.k)) / (np.sqrt(self.v[n] / np.float32(1 - 0.99**self.k)) + np.float32(1e-7))


def layout(texts: Iterable[list[str]]):
    """Distinct words, and the windows of all texts as ids into them (the padding id is their number).

    Texts are read one after the other and let go, so only their ids are held.
    """
    known: dict[str, int] = {}
    flat, lengths = array("i"), []
    for words in texts:
        flat.extend([known.setdefault(w, len(known)) for w in words])
        lengths.append(len(words))
    flat = np.append(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), np.zeros(WINDOW, np.int32))
    lengths = np.array(lengths, np.int64)
    doc, start, size = windows(lengths)
    base = (np.cumsum(lengths) - lengths)[doc] + start
    ids = flat[base[:, None] + np.arange(WINDOW)]
    ids[np.arange(WINDOW)[None] >= size[:, None]] = len(known)
    return list(known), doc, ids, size


def some_features(features, pick: np.ndarray):
    """The features of some of the words."""
    ids, *runs = features
    out = []
    for flat, starts, sizes in runs:
        n = sizes[pick]
        ends = np.cumsum(n)
        out.append((flat[np.arange(n.sum()) + np.repeat(starts[pick] - (ends - n), n)], ends - n, n))
    return ids[pick], *out


def noisy(features, rng, share: float):
    """Features with a share of the words and stems made unknown, so that the letters have to serve."""
    ids, grams, (stems, at, sizes) = features
    return np.where(rng.random(len(ids)) < share, 0, ids), grams, (np.where(rng.random(len(stems)) < share, 0, stems), at, sizes)


def train(texts: list[str], y: np.ndarray, steps: int = 360, batch: int = 48, rate: float = 0.006, most_windows: int = 25, left_out: float = 0.3, seed: int = 3) -> Network:
    """Fit on texts of any length; a step draws at most most_windows windows of a text, others the next time."""
    split = lambda: (WORDS.findall((t or "").lower()) for t in texts)
    use = [k for k, w in enumerate(split()) if w]
    texts, y = [texts[k] for k in use], np.asarray(y)[use]
    counts, begun = Counter(), Counter()
    for words in split():
        counts.update(set(words))
        begun.update({s for w in set(words) for s in stems_of(w)})
    most = lambda found, n, least: [w for w, c in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:n] if c >= least]
    net = Network(most(counts, 6000, 3), most(begun, 20000, 5))
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(pos) or not len(neg):
        return net
    opt, rng = Adam(net.p, rate), np.random.default_rng(seed)
    words, whose, all_ids, sizes = layout(split())
    features = net.features(words)
    first = np.searchsorted(whose, np.arange(len(texts) + 1))

    def used(rows):
        """The words of some windows, and the windows as ids into them (the padding id sorts last)."""
        seen, ids = np.unique(all_ids[rows], return_inverse=True)
        return some_features(features, seen[seen < len(words)]), ids.reshape(len(rows), WINDOW)

    for step in range(steps):
        opt.rate = rate * min(1.0, 3 * (1 - step / steps) + 0.05)
        some = [*rng.choice(pos, batch // 3), *rng.choice(neg, batch - batch // 3)]
        parts = [np.arange(first[k], first[k + 1]) for k in some]
        parts = [p if len(p) <= most_windows else rng.choice(p, most_windows, replace=False) for p in parts]
        rows, doc = np.concatenate(parts), np.repeat(np.arange(batch), [len(p) for p in parts])
        if step >= steps // 6:
            part, ids = used(rows)
            logit = net.forward(net.project(net.inputs(noisy(part, rng, left_out))), ids, sizes[rows])
            order = np.lexsort((logit, doc))
            pick = order[np.append(doc[order][1:] != doc[order][:-1], True)]
        else:
            pick = rng.permutation(len(doc))[: 4 * batch]
        doc, rows = doc[pick], rows[pick]
        part, ids = used(rows)
        part = wid, (codes, _, count), (stems, _, runs) = noisy(part, rng, left_out)
        x = net.inputs(part)
        gates = net.project(x)
        logit, saved = net.forward(gates, ids, sizes[rows], keep=True)
        d = (sigmoid(logit) - y[some][doc]) / len(doc)
        g, dgates = net.backward(d.astype(np.float32), saved, gates.shape[1])
        g["wx"] = np.matmul(x.T[None], dgates)
        g["bx"] = dgates.sum(1, keepdims=True)
        dx = np.split(np.matmul(dgates, net.p["wx"].transpose(0, 2, 1)).sum(0), [WORD_DIM, WORD_DIM + CHAR_DIM], axis=1)
        for name, at, grad in (("words", wid, dx[0]), ("grams", codes, np.repeat(dx[1] / count[:, None], count, axis=0)), ("stems", stems, np.repeat(dx[2], runs, axis=0))):
            g[name] = np.zeros_like(net.p[name])
            np.add.at(g[name], at, grad)
        opt.step(g)
    return net


def score_texts(net: Network, texts: list[str | None], chunk: int = 1024) -> np.ndarray:
    words, doc, ids, size = layout(WORDS.findall((t or "").lower()) for t in texts)
    gates = net.project(net.inputs(net.features(words))) if words else np.zeros((2, 1, 3 * HIDDEN), np.float32)
    best = np.full(len(texts), -np.inf)
    for lo in range(0, len(doc), chunk):
        part = slice(lo, lo + chunk)
        np.maximum.at(best, doc[part], net.forward(gates, ids[part], size[part]))
    return sigmoid(best.astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text"):
    """The network, or the share of label 1 where one class is missing."""
    rows = labelled_sample(docs, labels, label, most_per_class, id_col, text_col).collect()
    rows.sort(key=lambda r: (r.y, r.text or ""))
    y = np.array([r.y for r in rows], int)
    if len(set(y.tolist())) < 2:
        return float((y.sum() + 1) / (len(y) + 2))
    return train([r.text for r in rows], y)


def _scores(shared, step: int = 256):
    def run(batches):
        net = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                texts = some.column(1).to_pylist()
                score = np.full(len(texts), net) if isinstance(net, float) else score_texts(net, texts)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(score)], ["id", "score"])

    return run


def score_toxicity(docs: DataFrame, model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, held_out, score and predicted."""
    few_rows(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = rows.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(model)), f"id {id_type}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows scored below the threshold, with all their columns."""
    few_rows(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    plain = plain.withColumn("text", F.col(f"c{names.index(text_col)}").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches):
        net = shared.value
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            score = np.full(len(texts), net) if isinstance(net, float) else score_texts(net, texts)
            yield batch.filter(pa.array(score < threshold))

    return plain.mapInArrow(kept, plain.schema).drop("text").toDF(*names)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs, fit(docs, labels))
