"""Log-likelihood of documents under a gated recurrent language model with a class-factored output.

Counts of all training tokens come from one distributed pass and fix the vocabulary. The most frequent words (a
bounded head) are grouped into classes; P(word) = P(class | state) P(word | class, state). Every other word belongs
to a tail class read off its letters, whose words share the class's probability in proportion to their counts plus
one, with one more share for words never seen. So the model spreads its mass over the same open vocabulary as the
add-one base, and rare words need nothing but their count.

Training is truncated backpropagation in numpy: a bounded warm-up on the driver, then one pass over every training
document, whole, by as many trainers as the cluster has slots, each starting from the warm-up, and the average of
their weights by tokens. A trainer reads many texts side by side, a segment of each at a time; the state is carried to
each text's end, the gradient is cut between segments. Scoring reads every whole text in lock-step
batches, carrying the state from window to window until each document ends. Counts of words beyond a bounded table of
frequent ones are joined by word, with equal words of a document merged first.

Defined results: null text counts as empty, which is one end token; rows that repeat an id are scored each; a null id
counts as the empty text for the split; without training rows the base and the model give log10(1) and their priors.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, staged, utf8

END = b"\n"
HEAD, KNOWN = 8192, 150_000
CLASSES, TAILS = 96, 48
HIDDEN = 16
SPLIT, HELD = 7, 2
WINDOW_CHARS = 500
SEGMENT, BATCH, LANES = 24, 128, 256


def tail_class(word: bytes) -> int:
    """A class of rare words, read off the word: first non-ASCII letter, last character, length."""
    sign = 0
    if not word.isascii():
        sign = 1 + next(b for b in word if b >= 0x80 and b not in (0xC2, 0xC3)) % 7
    last = word[-1]
    end = 0 if last >= 0x80 or chr(last).isalnum() else 1 if last in b".,;:" else 2
    return (sign * 3 + end) * 2 + (len(word) > 8)


def tokens(text: str | None) -> list[bytes]:
    return utf8(text).lower().split()


def _counts(most: int = 400_000):
    def out(counts):
        words = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(map(tail_class, words), pa.int32()), pa.array(counts.values(), pa.int64())], ["word", "tail", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens(text))
                counts[END] += 1
                if len(counts) > most:
                    yield out(counts)
                    counts.clear()
        if counts:
            yield out(counts)

    return run


class Vocabulary:
    """Bounded facts of the counted words: the head by class, the known table, the tail classes' masses."""

    def __init__(self, counted: DataFrame):
        total = counted.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.tokens, self.types = int(total.n or 0), int(total.v)
        # Thresholds come from a histogram of some hundred count bands, so nothing large is sorted or gathered.
        band = F.floor(F.log2("n") * 16).cast("int")
        bands = sorted(((r.band, r["count"]) for r in counted.groupBy(band.alias("band")).count().collect()), reverse=True)
        rows = counted.filter(band >= self._least(bands, KNOWN)).select("word", "tail", "n").collect()
        rows.sort(key=lambda r: (-r.n, bytes(r.word)))
        head_band = self._least(bands, HEAD)
        sizes = sum(c for b, c in bands if b >= head_band)
        self.known_band = self._least(bands, KNOWN)
        self.head = sizes
        self.code = {bytes(r.word): k for k, r in enumerate(rows)}
        self.count = np.array([r.n for r in rows], np.int64)
        self.tail = np.array([r.tail for r in rows], np.int64)
        mass, kinds = np.zeros(TAILS), np.zeros(TAILS)
        for r in counted.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
            mass[r.tail], kinds[r.tail] = r.n, r.v
        np.subtract.at(mass, self.tail[: self.head], self.count[: self.head])
        np.subtract.at(kinds, self.tail[: self.head], 1)
        self.tail_mass = mass
        self.tail_log = np.log10(mass + kinds + 1)
        self.base_log = np.log10(self.tokens + self.types + 1)
        weight = np.cumsum(np.sqrt(self.count[: self.head]))
        self.word_class = np.minimum((weight / (weight[-1] if self.head else 1) * CLASSES).astype(np.int64), CLASSES - 1)
        self.lo = np.searchsorted(self.word_class, np.arange(CLASSES))
        self.hi = np.searchsorted(self.word_class, np.arange(CLASSES), "right")

    @staticmethod
    def _least(bands, most: int) -> int:
        have, least = 0, (bands[0][0] + 1) if bands else 0
        for b, c in bands:
            have += c
            if have > most:
                break
            least = b
        return least

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Codes (-1: not in the known table) and tail classes of tokens."""
        codes = np.fromiter(map(self.code.get, words, repeat(-1)), np.int32, len(words))
        tails = self.tail[codes].astype(np.int32) if len(self.tail) else np.zeros(len(words), np.int32)
        for k in np.flatnonzero(codes < 0).tolist():
            tails[k] = tail_class(words[k])
        return codes, tails


class Model:
    def __init__(self, v: Vocabulary, seed: int = 5):
        rng = np.random.default_rng(seed)
        h, k = HIDDEN, max(1, v.head)
        f = lambda s, a: (rng.standard_normal(s) * a).astype(np.float32)
        mass = np.zeros(CLASSES + TAILS)
        np.add.at(mass, v.word_class, v.count[: v.head])
        mass[CLASSES:] = v.tail_mass
        self.p = {
            "x": f((k + TAILS + 1, 3 * h), 0.3),
            "u": f((h, 3 * h), 1 / np.sqrt(h)),
            "wc": f((h, CLASSES + TAILS), 0.05),
            "bc": np.log((mass + 0.5) / (mass.sum() + 0.5 * len(mass))).astype(np.float32),
            "wo": f((k, h), 0.05),
            "bo": np.zeros(k, np.float32),
        }
        self.p["bo"][: v.head] = np.log(v.count[: v.head])
        self.head, self.lo, self.hi, self.word_class = v.head, v.lo, v.hi, v.word_class

    def symbols(self, codes, tails):
        """Input symbols and output classes of tokens; the symbol after all others begins a text."""
        inside = (codes >= 0) & (codes < self.head)
        rows = len(self.p["x"])
        cls = np.where(inside, self.word_class[np.where(inside, codes, 0)] if self.head else 0, CLASSES + tails)
        return np.where(inside, codes, rows - 1 - TAILS + tails).astype(np.int32), cls.astype(np.int16)

    def cell(self, x, h):
        k = HIDDEN
        g = h @ self.p["u"]
        rz = 0.5 * (np.tanh(0.5 * (x[:, : 2 * k] + g[:, : 2 * k])) + 1)
        r, z, gn = rz[:, :k], rz[:, k:], g[:, 2 * k :]
        n = np.tanh(x[:, 2 * k :] + r * gn)
        return n + z * (h - n), (r, z, n, gn)

    def output(self, h, codes, cls, grads: dict | None = None, block: int = 2048):
        """Natural log probabilities of (class, head word in class); adds gradients of their negative sum."""
        p = self.p
        out = np.empty(len(h), np.result_type(h, p["wc"]))
        dh = None if grads is None else np.empty_like(out, shape=h.shape)
        for lo in range(0, len(h), block):
            part = slice(lo, lo + block)
            own, kind = h[part], cls[part]
            # A column per token: sums and maxima then run along rows that lie together in memory.
            logit = p["wc"].T @ own.T
            logit += p["bc"][:, None]
            logit -= logit.max(0)
            row = np.arange(len(own))
            out[part] = logit[kind, row]
            e = np.exp(logit, out=logit)
            s = e.sum(0)
            out[part] -= np.log(s)
            if grads is not None:
                e /= s
                e[kind, row] -= 1
                grads["wc"] += (e @ own).T
                grads["bc"] += e.sum(1)
                dh[part] = (p["wc"] @ e).T
        order = np.argsort(cls.astype(np.int16), kind="stable")
        edges = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        own_h, own_codes, inner = h[order], codes[order], np.zeros(len(h), out.dtype)
        d_inner = None if grads is None else np.zeros_like(own_h)
        for c in np.flatnonzero(np.diff(edges)):
            part = slice(edges[c], edges[c + 1])
            lo, hi = self.lo[c], self.hi[c]
            if hi - lo < 2:
                continue
            w, hs = p["wo"][lo:hi], own_h[part]
            q = w @ hs.T + p["bo"][lo:hi, None]
            q -= q.max(0)
            e = np.exp(q)
            s = e.sum(0)
            at, k = own_codes[part] - lo, np.arange(len(hs))
            inner[part] = q[at, k] - np.log(s)
            if grads is not None:
                e /= s
                e[at, k] -= 1
                grads["wo"][lo:hi] += e @ hs
                grads["bo"][lo:hi] += e.sum(1)
                d_inner[part] = e.T @ w
        out[order] += inner
        if grads is not None:
            dh[order] += d_inner
        return out, dh

    def score(self, sym, codes, cls, lengths, buffer: int = 16_384):
        """Natural log probability of each text of the given token counts, one after the other in the flat arrays."""
        order = np.argsort(-lengths, kind="stable")
        start = (np.cumsum(lengths) - lengths)[order]
        active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(int(lengths.max(initial=0))), "right")
        h = np.zeros((len(lengths), HIDDEN), np.float32)
        total = np.zeros(len(lengths))
        begin = np.full(len(lengths), len(self.p["x"]) - 1)
        held, at, who, rows = [], [], [], 0
        for t, a in enumerate(active.tolist()):
            pos = start[:a] + t
            x = self.p["x"][sym[pos - 1] if t else begin[:a]]
            h = h[:a]
            h, _ = self.cell(x, h)
            held.append(h)
            at.append(pos)
            who.append(order[:a])
            rows += a
            if rows >= buffer or t + 1 == len(active):
                pos = np.concatenate(at)
                logp, _ = self.output(np.concatenate(held), codes[pos], cls[pos])
                total += np.bincount(np.concatenate(who), logp, len(total))
                held, at, who, rows = [], [], [], 0
        return total


class Trainer:
    """Truncated backpropagation over windows, with Adam."""

    def __init__(self, model: Model, rate: float = 0.004):
        self.model, self.rate, self.k = model, rate, 0
        self.m, self.v = ({n: np.zeros_like(x) for n, x in model.p.items()} for _ in range(2))
        self.trained = 0

    def windows(self, vocab: Vocabulary, texts: list[list[bytes]]) -> None:
        """One pass over a batch of token windows, in segments; the state is carried, the gradient is not."""
        model = self.model
        longest = max(map(len, texts), default=0)
        if not longest or not model.head:
            return
        n = len(texts)
        sym = np.zeros((n, longest), np.int64)
        codes, cls = np.zeros_like(sym), np.zeros_like(sym)
        mask = np.zeros((n, longest), bool)
        flat = [w for t in texts for w in t]
        c, tails = vocab.encode(flat)
        s, k = model.symbols(c, tails)
        at = 0
        for i, t in enumerate(texts):
            part = slice(at, at + len(t))
            sym[i, : len(t)], codes[i, : len(t)], cls[i, : len(t)], mask[i, : len(t)] = s[part], c[part], k[part], True
            at += len(t)
        before = np.concatenate([np.full((n, 1), len(model.p["x"]) - 1), sym[:, :-1]], 1)
        h = np.zeros((n, HIDDEN), np.float32)
        for lo in range(0, longest, SEGMENT):
            part = slice(lo, lo + SEGMENT)
            h = self._segment(before[:, part], codes[:, part], cls[:, part], mask[:, part], h)

    def stream(self, vocab: Vocabulary, texts) -> None:
        """One pass over whole texts (token lists): a lane takes the next text when its own has ended."""
        model, texts = self.model, iter(texts)
        rate, begin = self.rate, len(model.p["x"]) - 1
        lanes: list = []
        h = np.zeros((0, HIDDEN), np.float32)
        while model.head:
            while len(lanes) < LANES and (words := next(texts, None)):
                codes, tails = vocab.encode(words)
                sym, cls = model.symbols(codes, tails)
                lanes.append((0, np.concatenate([[begin], sym]).astype(np.int32), codes, cls))
            if not lanes:
                break
            h = np.concatenate([h, np.zeros((len(lanes) - len(h), HIDDEN), np.float32)])
            # The last long texts run beside few others: their segments are longer, so that a step keeps its tokens.
            long = min(max(SEGMENT, BATCH * SEGMENT // len(lanes)), max(len(code) - at for at, _, code, _ in lanes))
            before, codes, cls = (np.zeros((len(lanes), long), np.int64) for _ in range(3))
            mask = np.zeros((len(lanes), long), bool)
            for k, (at, sym, code, kind) in enumerate(lanes):
                size = min(long, len(code) - at)
                before[k, :size], codes[k, :size], cls[k, :size] = (x[at : at + size] for x in (sym, code, kind))
                mask[k, :size] = True
            self.rate = rate * min(1.0, 2 * int(mask.sum()) / (LANES * SEGMENT))
            h = self._segment(before, codes, cls, mask, h)
            going = [k for k, (at, _, code, _) in enumerate(lanes) if at + long < len(code)]
            lanes, h = [(lanes[k][0] + long, *lanes[k][1:]) for k in going], h[going]
        self.rate = rate

    def _segment(self, before, codes, cls, mask, h):
        """A step over a segment of each lane; a lane's mask is true up to its text's end. Arrays are laid out by time."""
        model, p, k = self.model, self.model.p, HIDDEN
        before, real = before.T, mask.T
        steps, lanes = before.shape
        x = p["x"][before]
        states = np.empty((steps + 1, lanes, k), np.float32)
        states[0], tape = h, []
        for t in range(steps):
            states[t + 1], saved = model.cell(x[t], states[t])
            tape.append(saved)
        g = {n: np.zeros_like(p[n]) for n in ("wc", "bc", "wo", "bo")}
        _, dh_out = model.output(states[1:][real], codes.T[real], cls.T[real], g)
        dstate = np.zeros((steps, lanes, k), np.float32)
        dstate[real] = dh_out
        dx, dg = (np.empty((steps, lanes, 3 * k), np.float32) for _ in range(2))
        dh = np.zeros((lanes, k), np.float32)
        for t in range(steps - 1, -1, -1):
            r, z, n, gn = tape[t]
            d = dh + dstate[t]
            dn = d * (1 - z) * (1 - n * n)
            dx[t, :, :k] = dn * gn * r * (1 - r)
            dx[t, :, k : 2 * k] = d * (states[t] - n) * z * (1 - z)
            dx[t, :, 2 * k :] = dn
            dg[t] = dx[t]
            dg[t, :, 2 * k :] *= r
            dh = d * z + dg[t] @ p["u"].T
        g["u"] = states[:-1].reshape(-1, k).T @ dg.reshape(-1, 3 * k)
        # Only the input rows of the segment's symbols have a gradient, and only they are moved.
        sym = before[real]
        order = np.argsort(sym, kind="stable")
        rows, at = np.unique(sym[order], return_index=True)
        g["x"] = np.add.reduceat(dx[real][order], at, axis=0)
        scale = np.float32(1 / max(1, len(sym)))
        self.trained += len(sym)
        self.k += 1
        norm = scale * np.sqrt(sum(float(np.vdot(y, y)) for y in g.values()))
        scale *= np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        a, b = np.float32(1 - 0.9**self.k), np.float32(1 - 0.99**self.k)
        for name, y in g.items():
            y *= scale
            own = rows if name == "x" else slice(None)
            m, v = self.m[name][own], self.v[name][own]
            m += np.float32(0.1) * (y - m)
            y *= y
            v += np.float32(0.01) * (y - v)
            step = np.sqrt(v / b)
            step += np.float32(1e-6)
            np.divide(m, step, out=step)
            step *= np.float32(self.rate) / a
            p[name][own] -= step
            if name == "x":
                self.m[name][own], self.v[name][own] = m, v
        return states[-1]


def window_texts(docs: DataFrame) -> DataFrame:
    """A window of each of `id`, `text`, placed by a hash: (id, text, first, last), whether it begins or ends the text."""
    docs = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")
    at = F.when(size > WINDOW_CHARS, F.pmod(F.xxhash64("text"), F.greatest(size - WINDOW_CHARS + 1, F.lit(1)))).otherwise(0).cast("int")
    cut = docs.withColumn("at", at)
    return cut.select("id", F.substring("text", F.col("at") + 1, F.lit(WINDOW_CHARS)).alias("text"), (F.col("at") == 0).alias("first"), (F.col("at") + WINDOW_CHARS >= size).alias("last"))


def window_tokens(text: str, first: bool, last: bool) -> list[bytes]:
    words = tokens(text)
    if not last:
        words = words[:-1]
    return (words if first else words[1:]) + ([END] if last else [])


def warm_rows(train: DataFrame, most: int) -> list:
    """Windows of the `most` rows whose ids have the smallest hashes, so copies of a text count as often as they occur."""
    return window_texts(train).orderBy(F.xxhash64("id", F.lit(3)), F.xxhash64("text")).limit(most).collect()


def warm_up(vocab: Vocabulary, rows: list, updates: int = 500) -> Model:
    model = Model(vocab)
    trainer, rng = Trainer(model, 0.01), np.random.default_rng(9)
    windows = [w for r in rows if (w := window_tokens(r.text, r.first, r.last))]
    while windows and model.head and trainer.k < updates:
        trainer.rate = 0.012 * max(0.2, 1 - trainer.k / updates)
        trainer.windows(vocab, [windows[k] for k in rng.choice(len(windows), min(len(windows), BATCH), replace=False)])
    return model


def _train(shared, chunk: int = 16_384):
    def run(batches):
        vocab, start = shared.value
        model = Model(vocab)
        model.p = {n: x.copy() for n, x in start.items()}
        trainer = Trainer(model, 0.006)
        trainer.stream(vocab, ([*tokens(t), END] for b in batches for lo in range(0, b.num_rows, 256) for t in b.column(0).slice(lo, 256).to_pylist()))
        if trainer.trained:
            flat = np.concatenate([x.ravel() for x in model.p.values()])
            parts = [flat[k : k + chunk].tobytes() for k in range(0, len(flat), chunk)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([float(trainer.trained)] * len(parts)), pa.array(parts, pa.binary())], ["part", "weight", "data"])

    return run


def _average(frame):
    import pandas as pd

    w = frame.weight.to_numpy()
    mean = sum(np.frombuffer(d, np.float32) * k for d, k in zip(frame.data, w, strict=True)) / w.sum()
    return pd.DataFrame({"part": [frame.part.iloc[0]], "data": [mean.astype(np.float32).tobytes()]})


def fit(train: DataFrame, warm_windows: int = 3000) -> tuple[Vocabulary, Model, DataFrame]:
    """The vocabulary's bounded facts, the model, and the counted words (word, tail, n) of a frame with `id` and `text`."""
    spark = train.sparkSession
    counted = train.select("text").mapInArrow(_counts(), "word binary, tail int, n long").groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))
    counted = staged(counted, "counts")
    vocab = Vocabulary(counted)
    model = warm_up(vocab, sorted(warm_rows(train, warm_windows), key=lambda r: r.text))
    slots = 2 * spark.sparkContext.defaultParallelism
    shared = spark.sparkContext.broadcast((vocab, model.p))
    sums = train.select("text").coalesce(slots).mapInArrow(_train(shared), "part int, weight double, data binary")
    mean = sorted(sums.groupBy("part").applyInPandas(_average, "part int, data binary").collect(), key=lambda r: r.part)
    if mean:
        flat, at = np.concatenate([np.frombuffer(r.data, np.float32) for r in mean]), 0
        for name, x in model.p.items():
            model.p[name] = flat[at : at + x.size].reshape(x.shape).copy()
            at += x.size
    return vocab, model, counted


RARE = "array<struct<word: binary, n: int>>"


def _scores(shared, most_docs: int = 4096, most_bytes: int = 24 << 20):
    kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))

    def flush(vocab, model, ids, texts, first):
        # A text's words are coded and let go one text at a time; only words outside the known table are kept.
        parts, rare, sizes, lengths = [], [], np.zeros(len(texts) + 1, np.int32), np.empty(len(texts), np.int64)
        for k, t in enumerate(texts):
            words = tokens(t)
            words.append(END)
            lengths[k] = len(words)
            parts.append(vocab.encode(words))
            rare += Counter(words[j] for j in np.flatnonzero(parts[-1][0] < 0).tolist()).items()
            sizes[k + 1] = len(rare)
        codes, tails = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        sym, cls = model.symbols(codes, tails)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        known = codes >= 0
        count_log = np.where(known, np.log10(vocab.count + 1.0)[codes] if len(vocab.count) else 0.0, 0.0)
        base = np.bincount(doc, count_log, len(texts)) - lengths * vocab.base_log
        in_tail = cls >= CLASSES
        inner = np.bincount(doc, np.where(in_tail, count_log - vocab.tail_log[tails], 0.0), len(texts))
        n_known = np.bincount(doc, known, len(texts)).astype(np.int64)
        del doc, known, count_log, in_tail, tails
        score = model.score(sym, codes, cls, lengths) / np.log(10) + inner
        cols = zip(*rare, strict=True) if rare else ((), ())
        w, n = cols
        lists = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays([pa.array(w, pa.binary()), pa.array(n, pa.int32())], ["word", "n"]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(first + np.arange(len(texts))),
                pa.concat_arrays(ids),
                pa.array(lengths),
                pa.array(n_known),
                pa.array(base),
                pa.array(score),
                lists.cast(kind),
            ],
            ["row", "id", "n_tokens", "n_known", "base", "score", "rare"],
        )

    def run(batches):
        vocab, model = shared.value
        row = TaskContext.get().partitionId() << 36
        ids, texts, size = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                ids.append(some.column(0))
                texts += some.column(1).to_pylist()
                size += some.column(1).nbytes
                if len(texts) >= most_docs or size >= most_bytes:
                    yield flush(vocab, model, ids, texts, row)
                    row += len(texts)
                    ids, texts, size = [], [], 0
        if texts:
            yield flush(vocab, model, ids, texts, row)

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    held = crc_bucket(F.col("id"), SPLIT) == HELD
    vocab, model, counted = fit(rows.filter(~held))
    shared = spark.sparkContext.broadcast((vocab, model))
    schema = f"row long, id {id_type}, n_tokens long, n_known long, base double, score double, rare {RARE}"
    scored = staged(rows.mapInArrow(_scores(shared), schema), "scored")
    uncommon = counted.filter(F.floor(F.log2("n") * 16) < vocab.known_band).select("word", F.col("n").alias("c"))
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(uncommon, "word")
    more = rare.groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    extra = F.coalesce("more", F.lit(0.0))
    return scored.drop("rare").join(more, "row", "left").select(
        F.col("id").alias(id_col),
        held.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"),
        (F.col("score") + extra).alias("score"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
