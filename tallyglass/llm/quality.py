"""Document quality by Bradley-Terry pairwise ranking.

Each document has a feature vector of its own text. Pairs of a good and a poor document are preferences; the logistic
loss on differences of their features fits linear document scores, and the quantile of the training scores at the
share of poor documents is the threshold. The reported score is the logistic of the distance to that threshold.

A sample of at most `most_per_class` labelled rows of each class is used for fitting; only its feature vectors reach
the driver. Every whole text is scored in place, without a shuffle.

Defined results: null text counts as empty; an empty text has the features of no words and a score like any other;
rows that repeat an id are scored each; if only one class (or none) is labelled, every score is that class's share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import utf8
from .sampling import class_counts, held_out, labelled_sample

UPPER = bytes(range(65, 91))
SYMBOLS = b"#$%&*@^~=+<>{}[]\\_|/"
MARKS = b"!?"
DIGITS = b"0123456789"
BINS = 10


def features(text: str | None) -> list[float]:
    raw = utf8(text)
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda what: (len(raw) - len(raw.translate(None, what))) / size
    four = list(zip(words, words[1:], words[2:], words[3:], strict=False))
    return [
        np.log1p(n),
        share(UPPER),
        share(SYMBOLS),
        share(MARKS),
        share(b"|"),
        share(DIGITS),
        share(b".,;:"),
        (size - n) / max(1, n),
        len(set(words)) / max(1, n) ** 0.9,
        sum(map(bytes.__eq__, words, words[1:])) / max(1, n),
        1 - len(set(four)) / max(1, len(four)),
        1 - len(set(lines)) / max(1, len(lines)),
        max(map(len, words), default=0) / 50,
        sum(w[-1:] in b".!?" for w in words) / max(1, n),
    ]


def _features(batches):
    for batch in batches:
        x = np.array([features(t) for t in batch.column(0).to_pylist()]).reshape(-1)
        width = len(features(""))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(0, len(x) + 1, width, dtype=np.int32), pa.array(x)), batch.column(1)], ["x", "y"])


class Ranker:
    """Linear scores over quantile bins of the features.

    counts are the rows of each class that the sample stands for; the threshold is the quantile of the scores at the share
    of poor rows among them, each sampled row counting for those of its class.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, counts: dict[int, int] | None = None, pairs: int = 40_000, rounds: int = 400, ridge: float = 1e-4):
        self.share = (float(y.sum()) + 1) / (len(y) + 2)
        good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.weights = None
        if not len(good) or not len(poor):
            return
        rng = np.random.default_rng(7)
        self.cuts = [np.unique(np.concatenate([np.quantile(x[y == c, j], np.linspace(0, 1, BINS + 1)[1:-1]) for c in (0, 1)])) for j in range(x.shape[1])]
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        z = self.expand(x)
        d = z[rng.choice(good, pairs)] - z[rng.choice(poor, pairs)]
        w, m, v = np.zeros(z.shape[1]), 0.0, 0.0
        for k in range(1, rounds + 1):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            g = -(p @ d) / pairs + ridge * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        self.weights = w
        order = np.argsort(z @ w, kind="stable")
        s = (z @ w)[order]
        counts = counts or {0: len(poor), 1: len(good)}
        weight = np.where(y == 1, counts[1] / len(good), counts[0] / len(poor))[order]
        at = min(max(1, int(np.searchsorted(np.cumsum(weight), counts[0] * (1 - 1e-9))) + 1), len(s) - 1)
        self.threshold = (s[at - 1] + s[at]) / 2
        self.scale = max(1e-6, (np.median((z @ w)[good]) - np.median((z @ w)[poor])) / 8)

    def expand(self, x: np.ndarray) -> np.ndarray:
        parts = [np.clip((x - self.mean) / self.spread, -5, 5)]
        for j, cuts in enumerate(self.cuts):
            parts.append((x[:, j : j + 1] > cuts).astype(float))
        return np.concatenate(parts, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip((self.expand(x) @ self.weights - self.threshold) / self.scale, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_per_class: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> Ranker:
    sample = labelled_sample(docs, labels, label, most_per_class, id_col, text_col)
    rows = sample.mapInArrow(_features, "x array<double>, y int").collect()
    rows.sort(key=lambda r: (r.y, r.x))
    width = len(features(""))
    return Ranker(np.array([r.x for r in rows]).reshape(-1, width), np.array([r.y for r in rows]), class_counts(labels, label, id_col))


def _scores(shared, step: int = 1024):
    def run(batches):
        model = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                x = np.array([features(t) for t in some.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(model.score(x))], ["id", "score"])

    return run


def score_quality(docs: DataFrame, model: Ranker, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, held_out, score and predicted."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = rows.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(model)), f"id {id_type}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, fit(docs, labels))
