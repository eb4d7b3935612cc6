"""Pattern packing of token sequences by non-negative least squares.

Documents are tokenised and cut into pieces of at most `capacity` tokens. The lengths form a histogram, whatever the
corpus size. Patterns of two to six lengths, in bars of some tokens' width, that fill a sequence are enumerated;
non-negative least squares fits a repeat count to each so that together they use up the histogram, with at most as many
patterns in use as there are bars. The counts are rounded, each repetition takes pieces of its bars and, as its last,
the one that fits best, and the residual pieces are packed best-fit-decreasing, by lengths rather than by documents,
into what is left free and into new sequences. The plan is thus a bounded table. Pieces get their rank within their length from per-partition
counts, and look their place up in the plan, so no document list ever gathers anywhere.

Defined results: null text counts as empty and gives one piece holding the end id alone; rows that repeat an id are
packed separately; only documents longer than `capacity` are cut.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few_rows, staged

CAPACITY = 2048
END_ID = 0
#: Bars of the histogram that patterns are made of, most pieces of a pattern, and most tokens that a pattern leaves free.
BARS, MOST_DOCUMENTS, SLACK = 64, 6, 4
#: The tokenizer's own pre-tokens: fixed by its vocabulary file.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 as is, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


class WordNumbers(dict):
    """Numbers of words: one not met before gets the next number and is noted in `new`."""

    def __init__(self, words=()):
        super().__init__(words)
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordTokens:
    """Token ids of texts, by a bounded memory of the ids of single words.

    White space never reaches the vocabulary, so a text's ids are its words' ids in order. New words are split into
    pre-tokens, and each distinct pre-token goes through the vocabulary's merges once.
    """

    def __init__(self, path: str, most_words: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.piece_ids = self.tokenizer.model.tokenize
        self.most_words = most_words
        self.words = WordNumbers()
        self.pieces: dict[str, tuple[int, ...]] = {}  # tuples of numbers are none of the garbage collector's business
        self.ids = np.zeros(1 << 18, np.uint32)
        self.at, self.size, self.hits = (np.zeros(1 << 16, np.int64) for _ in range(3))
        self.used = 0

    def _forget(self):
        """Keep the words met most often, a third of the bound; the others are learnt anew when they return."""
        n = len(self.words)
        least = max(2, int(np.partition(self.hits[:n], -(self.most_words // 3))[-(self.most_words // 3)]) + 1)
        keep = np.flatnonzero(self.hits[:n] >= least)
        size = self.size[keep]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(keep) else 0
        self.ids[:total] = self.ids[np.arange(total) + np.repeat(self.at[keep] - (ends - size), size)]
        place = np.full(n, -1, np.int64)
        place[keep] = np.arange(len(keep))
        self.words = WordNumbers((w, k) for w, k in zip(self.words, place.tolist(), strict=True) if k >= 0)
        self.at[: len(keep)], self.size[: len(keep)], self.hits[: len(keep)] = ends - size, size, self.hits[keep] // 2
        self.hits[len(keep) :] = 0
        self.used = total
        self.pieces.clear()

    def _piece(self, piece: str) -> tuple[int, ...]:
        raw = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        if len(self.pieces) >= self.most_words // 2:
            self.pieces.clear()
        found = self.pieces[piece] = tuple([t.id for t in self.piece_ids(raw)])
        return found

    def _learn(self, new: list[bytes]) -> None:
        """The ids of words that just got their numbers, the last ones."""
        text = b" ".join(new).decode()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        flat: list[int] = []
        cut, known, piece_of = np.zeros(len(new) + 1, np.int64), self.pieces.get, self._piece
        for k, w in enumerate(text.lower().split(" "), 1):
            if w.isalpha():
                flat += known(w) or piece_of(w)
            elif w[-1] in ".,;:!?" and w[:-1].isalpha():
                flat += known(w[:-1]) or piece_of(w[:-1])
                flat += known(w[-1]) or piece_of(w[-1])
            else:
                for piece in PRETOKEN.findall(w):
                    flat += known(piece) or piece_of(piece)
            cut[k] = len(flat)
        ids = np.array(flat, np.uint32)
        first = len(self.words) - len(new)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(new) > len(self.at):
            self.at, self.size, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.hits))
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[first : first + len(new)] = self.used + cut[:-1]
        self.size[first : first + len(new)] = np.diff(cut)
        self.used += len(ids)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.words) > self.most_words:
            self._forget()
        split, odd = [], {}
        for k, text in enumerate(texts):
            text = text or ""
            # Special tokens, and letters whose lower case depends on what follows, take the plain way.
            if "<|" in text or "Σ" in text:
                odd[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                text = ""
            words = text.encode().split()
            split.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        if new := self.words.new:
            self.words.new = []
            self._learn(new)
        out, met = [], []
        for k, w in enumerate(split):
            if k in odd:
                out.append(odd[k])
                continue
            met.append(w)
            size = self.size[w]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(w) else 0
            out.append(self.ids[np.arange(total) + np.repeat(self.at[w] - (ends - size), size)])
        if met:
            self.hits += np.bincount(np.concatenate(met), minlength=len(self.hits))
        return out


def _pieces(path: str, capacity: int, keep_ids: bool, step: int = 256):
    def run(batches):
        tokens = WordTokens(path)  # goes with the task: what a worker keeps adds to every later stage's peak
        part, rank = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                rows, kept = [], []
                for k, ids in enumerate(tokens.encode(some.column(1).to_pylist())):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for n, start in enumerate(range(0, len(ids), capacity)):
                        piece = ids[start : start + capacity]
                        rows.append((k, n, start, len(piece), zlib.crc32(piece.tobytes()), rank[len(piece)]))
                        rank[len(piece)] += 1
                        if keep_ids:
                            kept.append(piece)
                k, n, start, length, crc, at = (np.array(x) for x in zip(*rows, strict=True))
                cols = [some.column(0).take(pa.array(k)), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(k), part), pa.int32()), pa.array(at, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32", "part", "local"]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.concatenate(kept).astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def patterns_of(bars: int, most: int) -> list[tuple[int, ...]]:
    """The multisets of two to `most` bar numbers that fill a sequence; a piece lies half a bar below its bar's top."""
    rows: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], least: int, left: int, k: int) -> None:
        if k == 1:
            if least <= left <= bars:
                rows.append((*head, left))
            return
        for b in range(least, left // k + 1):
            grow((*head, b), b, left - b, k - 1)

    for k in range(2, most + 1):
        grow((), 1, bars + k // 2, k)
    return rows


def fit_counts(a: np.ndarray, bars: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Non-negative least squares by active sets: a repeat count for each pattern, at most as many of them as bars."""
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (bars - a @ x)
        gain[on] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * max(1.0, float(bars.max())):
            break
        on[best] = True
        while on.any():
            at = np.flatnonzero(on)
            free = np.linalg.lstsq(a[:, at], bars, rcond=None)[0]
            if free.min() > 0:
                x[:] = 0
                x[at] = free
                break
            # Go towards the free solution until the first count is used up, and leave that pattern out.
            low = free <= 0
            step = float(np.min(x[at][low] / (x[at][low] - free[low])))
            x[at] += step * (free - x[at])
            gone = at[low & (x[at] <= 1e-12)] if (low & (x[at] <= 1e-12)).any() else at[[int(np.argmin(x[at]))]]
            x[gone], on[gone] = 0, False
    return x


def plan(bars: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(repeat count, lengths) groups that use up a histogram of lengths (bars[n]: pieces of n tokens)."""
    left = bars.astype(np.int64).copy()
    groups: list[tuple[int, tuple[int, ...]]] = []
    if left[capacity]:
        groups.append((int(left[capacity]), (capacity,)))
        left[capacity] = 0
    if not left.any():
        return groups
    width = -(-capacity // BARS)
    wide = np.bincount(-(-np.arange(capacity + 1) // width), left, BARS + 1)[1:]
    mean = float((left * np.arange(capacity + 1)).sum() / left.sum())
    # Half of the short pieces stay out of the fit: they fill what the patterns leave free.
    wide[: BARS // 8] *= 0.5
    patterns = patterns_of(BARS, int(np.clip(np.ceil(2 * capacity / mean), 2, MOST_DOCUMENTS)))
    a = np.zeros((BARS, len(patterns)))
    for k, pattern in enumerate(patterns):
        for b in pattern:
            a[b - 1, k] += 1
    x = fit_counts(a, wide)
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 0.5:
            break
        groups += _repeat(left, patterns[k], int(np.rint(x[k])), width, capacity)
    return _best_fit(left, capacity, groups)


def _repeat(left: np.ndarray, pattern: tuple[int, ...], times: int, width: int, capacity: int):
    """Up to `times` sequences of a pattern, many equal ones at once; what they use is taken from `left`.

    All pieces but the shortest come from their bars, the most frequent length first; the last is the longest that
    fits, at most SLACK tokens short of a full sequence.
    """
    groups = []
    while times:
        lengths: list[int] = []
        for place, b in enumerate(reversed(pattern)):
            last = place + 1 == len(pattern)
            room = capacity - sum(lengths)
            low, high = (max(1, room - SLACK), room) if last else ((b - 1) * width + 1, min(b * width, capacity))
            if high < low:
                return groups
            some = left[low : high + 1].copy()
            for n in lengths:
                if low <= n <= high:
                    some[n - low] -= 1
            there = np.flatnonzero(some > 0)
            if not len(there):
                return groups
            lengths.append(low + int(there[-1] if last else np.argmax(some)))
        used, each = np.unique(lengths, return_counts=True)
        n = int(min(times, (left[used] // each).min()))
        left[used] -= n * each
        times -= n
        groups.append((n, tuple(lengths)))
    return groups


def _best_fit(left: np.ndarray, capacity: int, groups=()) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit-decreasing over lengths, into the groups' free room first: many equal pieces go into many equal bins."""
    free: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    room = np.zeros(capacity + 1, bool)
    for group in groups:
        rest = capacity - sum(group[1])
        free.setdefault(rest, []).append(group)
        room[rest] = True
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = int(np.argmax(room[length:])) + length
            if room[fits]:
                count, held = free[fits].pop()
                take = min(n, count)
                if take < count:
                    free[fits].append((count - take, held))
                room[fits] = bool(free[fits])
                new = (take, (*held, length))
            else:
                most = capacity // length
                take, each = (n // most, most) if n >= most else (1, n)
                fits, new, take = capacity, (take, (length,) * each), take * each
            n -= take
            rest = capacity - sum(new[1])
            free.setdefault(rest, []).append(new)
            room[rest] = True
    return [g for rest in free.values() for g in rest]


def _slots(groups, capacity: int):
    """The plan by piece: sorted keys (length, first rank), and sequence and offset of the piece of that rank."""
    ranks = np.zeros(capacity + 1, np.int64)
    rows, base = [], 0
    for count, lengths in groups:
        offset = 0
        for n in lengths:
            rows.append(((n << 44) + ranks[n], base - ranks[n], offset))
            ranks[n] += count
            offset += n
        base += count
    return np.array(sorted(rows), np.int64).reshape(-1, 3)


def _place(shared):
    def run(batches):
        slots = shared.value
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(slots[:, 0], (batch.column("length").to_numpy() << 44) + rank, "right") - 1
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(slots[at, 1] + rank), pa.array(slots[at, 2])], [*keep, "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32, the token ids (if kept), sequence_id and offset."""
    few_rows(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long, part int, local long" + ", ids array<int>" * keep_ids
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    pieces = staged(source.mapInArrow(_pieces(tokenizer_path, capacity, keep_ids), schema), "pieces")
    counts = staged(pieces.groupBy("length", "part").count(), "lengths")
    bars = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():
        bars[row.length] = row.n
    shared = docs.sparkSession.sparkContext.broadcast(_slots(plan(bars, capacity), capacity))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local"))
    columns = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    out = f"id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(_place(shared), out).withColumnRenamed("id", id_col)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
