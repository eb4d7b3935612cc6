"""Byte-level BPE encoding and decoding through a minimal acyclic transducer.

All documents are cut into pre-tokens and counted; the most frequent ones, with the ids that the merges give them, become
a lexicon. It is compiled into a minimal acyclic automaton, where words share their endings as well as their beginnings,
and each arc carries a number: the sum along a word's path is the word's rank, which is the place of its ids. The automaton
is laid out as a double array in one file of the shared folder, and the workers map that file into memory. Encoding walks
all pre-tokens of a chunk of text through it side by side, a byte at a time; words that it doesn't accept go through the
vocabulary's merges one by one, so the lexicon decides the speed and never the ids. Decoding looks the bytes of each id up.

Defined results: null text counts as empty and has no ids; a special token's string in a text is that token, as in the
tokenizer's file; ids outside the vocabulary decode to nothing, bytes that aren't UTF-8 to replacement characters; rows that
repeat an id are encoded each for itself; other columns, whatever their names, aren't looked at; no documents give no rows.
A very long text is worked on in parts that end between two words, and its ids are put together again.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_rows, open_shared, scratch, slices, stage_path, staged
from .packing import BYTE_LETTERS

LEXICON_WORDS, LEXICON_BYTES = 131_072, 32
#: Characters worked on at once.
CHUNK = 1 << 19
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
ARRAYS = ("base", "final", "check", "target", "out", "id_at", "ids")


def minimal_automaton(words: Iterable[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """Arcs and final flags of the states of the minimal acyclic automaton of sorted, distinct words; state 0 is the start.

    Words are added in order. What the next word can't extend any more is replaced by an equal state where one is known.
    """
    arcs, final = [{}], [False]
    known: dict[tuple, int] = {}
    free: list[int] = []
    path, last = [0], b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            key = (final[state], tuple(arcs[state].items()))
            if (same := known.setdefault(key, state)) != state:
                arcs[path[-1]][last[len(path) - 1]] = same
                free.append(state)

    for word in words:
        shared = os.path.commonprefix([word, last])
        settle(len(shared))
        for byte in word[len(shared) :]:
            if free:
                state = free.pop()
                arcs[state], final[state] = {}, False
            else:
                state = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[path[-1]][byte] = state
            path.append(state)
        final[path[-1]] = True
        last = word
    settle(0)
    return arcs, final


def transducer(words: list[bytes], ids: list[list[int]]) -> dict[str, np.ndarray]:
    """The double array of the automaton of sorted words: a slot for each arc, the numbers that add up to ranks, ids by rank."""
    arcs, final = minimal_automaton(words)
    below = [-1] * len(arcs)
    order, seen = [], [False] * len(arcs)
    stack = [(0, False)]
    while stack:
        state, done = stack.pop()
        if done:
            below[state] = final[state] + sum(below[t] for t in arcs[state].values())
            order.append(state)
        elif not seen[state]:
            seen[state] = True
            stack.append((state, True))
            stack.extend((t, False) for t in arcs[state].values() if not seen[t])
    number = {state: k for k, state in enumerate(reversed(order))}
    counts = [len(arcs[s]) for s in order]
    base, used = _placed([sorted(arcs[s]) for s in order])
    size = used + 512
    check, target, out = (np.full(size, v, np.int32) for v in (-1, 0, 0))
    at = np.zeros(len(arcs), np.int32)
    at[order] = base
    me = [number[s] for s, n in zip(order, counts, strict=True) for _ in range(n)]
    arc = [(b, t) for s in order for b, t in sorted(arcs[s].items())]
    slot = np.repeat(base, counts) + np.array([b for b, _ in arc], np.int32)
    check[slot], target[slot] = me, [number[t] for _, t in arc]
    before = []
    for state in order:
        n = int(final[state])
        for _, t in sorted(arcs[state].items()):
            before.append(n)
            n += below[t]
    out[slot] = before
    by_number = order[::-1]
    return {
        "base": at[by_number], "final": np.array([final[s] for s in by_number], np.int32), "check": check, "target": target, "out": out,
        "id_at": np.cumsum([0, *map(len, ids)]).astype(np.int32), "ids": np.array([i for x in ids for i in x], np.int32),
    }


def _placed(states: list[list[int]], window: int = 1024) -> tuple[np.ndarray, int]:
    """A base for each state so that no two arcs share the slot base + byte, many arcs first; and the end of the slots."""
    base, free, start = np.zeros(len(states), np.int32), np.ones(4 * window, bool), 256
    for k in sorted(range(len(states)), key=lambda k: -len(states[k])):
        if len(states[k]) < 2:
            continue
        steps, lo, slots = np.array(states[k]) - states[k][0], start, None
        while slots is None:
            if lo + window + 256 > len(free):
                free = np.append(free, np.ones(len(free), bool))
            at = lo + np.flatnonzero(free[lo : lo + window])
            fits = np.flatnonzero(free[at[:, None] + steps].all(axis=1))
            slots = at[fits[0]] + steps if len(fits) else None
            lo += window
        free[slots], base[k] = False, slots[0] - states[k][0]
        if free[start : start + window].sum() < window // 16:
            start += window
    one = [k for k, own in enumerate(states) if len(own) == 1]
    room = 256 + np.flatnonzero(free[256:])
    room = np.append(room, len(free) + np.arange(max(0, len(one) - len(room))))[: len(one)]
    base[one] = room - np.array([states[k][0] for k in one], np.int64)
    return base, int(max([len(free), *(room[-1:] + 1)]))


def write_lexicon(arrays: dict[str, np.ndarray], path: str) -> None:
    """A line that gives the arrays' lengths, then the arrays as 32-bit integers."""
    head = (json.dumps([len(arrays[n]) for n in ARRAYS]) + "\n").encode()
    with open_shared(path, "w") as f:
        f.write(head)
        for name in ARRAYS:
            f.write(arrays[name].astype("<i4").tobytes())


def map_lexicon(path: str) -> dict[str, np.ndarray]:
    """The arrays, mapped from the file; a file of a remote store is copied once to a file without a name and mapped from there."""
    if path.startswith("file:"):
        f = open("/" + path.removeprefix("file:").lstrip("/"), "rb")  # noqa: SIM115
    else:
        f = tempfile.TemporaryFile()  # noqa: SIM115
        with open_shared(path, "r") as far:
            shutil.copyfileobj(far, f)
        f.flush()
        f.seek(0)
    with f:
        head = f.readline()
        at, arrays = len(head), {}
        for name, n in zip(ARRAYS, json.loads(head), strict=True):
            arrays[name] = np.memmap(f, "<i4", "r", at, (n,)) if n else np.zeros(0, np.int32)
            at += 4 * n
    return arrays


class Codec:
    """Ids of texts and texts of ids, by a lexicon and a tokenizer's file."""

    def __init__(self, path: str, lexicon: dict[str, np.ndarray] | None = None, most_words: int = 100_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merged, self.pretokens = self.tokenizer.model.tokenize, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.lexicon = lexicon or transducer([], [])
        self.most_words = most_words
        self.new: dict[bytes, list[int]] = {}
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @cached_property
    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each token's bytes begin, and the bytes of all tokens."""
        byte_of = {letter: byte for byte, letter in BYTE_LETTERS.items()}
        names = {i: t for t, i in self.tokenizer.get_vocab().items()}
        raw = [b"".join(bytes([byte_of[c]]) if c in byte_of else c.encode() for c in names.get(i, "")) for i in range(max(names, default=-1) + 1)]
        return np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)

    def _class(self, c: str) -> int:
        """What the tokenizer's own pattern takes a character for: its tables may be older than Python's."""
        if [o for _, o in self.pretokens(f"a{c}")] == [(0, 2)]:
            return LETTER
        if [o for _, o in self.pretokens(f"1{c}")] == [(0, 2)]:
            return NUMBER
        return OTHER if [o for _, o in self.pretokens(f"!{c}")] == [(0, 2)] else SPACE

    def cut(self, parts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The parts' UTF-8 bytes, where each pre-token begins and its length, and how many pre-tokens precede each part.

        Runs of letters, numbers, other characters and white space, each part for itself. White space before a word is a
        pre-token without its last character, which belongs to the word if it is a space; an apostrophe takes the letters
        of a contraction with it.
        """
        text = "".join(parts)
        raw = text.encode()
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        n = len(codes)
        ends = np.cumsum([len(p) for p in parts])
        cls = self.classes[codes]
        if (cls == UNKNOWN).any():
            for c in np.unique(codes[cls == UNKNOWN]).tolist():
                self.classes[c] = self._class(chr(c))
            cls = self.classes[codes]
        first = np.zeros(n + 1, bool)
        first[0] = first[n] = True
        first[ends] = True
        start = first.copy()
        start[1:n] |= cls[1:] != cls[:-1]
        runs = np.flatnonzero(start)
        a, b = runs[:-1], runs[1:]
        kind = cls[a]
        last = b[(kind == SPACE) & ~first[b]] - 1
        start[last] = True
        start[last[codes[last] == 32] + 1] = False
        lone = a[(kind == OTHER) & (b - a == 1) & ~first[b]]
        lone = lone[(codes[lone] == 39) & start[lone]]
        one, two = codes[lone + 1], codes[np.minimum(lone + 2, n - 1)]
        short = lone[np.isin(one, [ord(c) for c in "stmd"])]
        long = lone[~first[np.minimum(lone + 2, n)] & np.logical_or.reduce([(one == ord(x)) & (two == ord(y)) for x, y in ("re", "ve", "ll")])]
        for at, size in ((short, 2), (long, 3)):
            start[at + 1] = False
            start[at + size] = True
        begin = np.flatnonzero(start[:n])
        if len(raw) == n:
            at, end = begin, n
        else:
            width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
            upto = np.concatenate([[0], np.cumsum(width)])
            at, end = upto[begin], upto[n]
        return raw, at, np.diff(np.append(at, end)), np.searchsorted(begin, np.concatenate([[0], ends]))

    def ranks(self, raw: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The rank of each word in the lexicon, -1 for those that it doesn't accept."""
        x = self.lexicon
        base, final, check, target, out = (x[n] for n in ARRAYS[:5])
        found = np.full(len(at), -1, np.int32)
        if not len(base):
            return found
        data = np.frombuffer(raw, np.uint8)
        row, state, rank = np.arange(len(at)), np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        k = 0
        while len(row):
            slot = base[state] + data[at[row] + k]
            k += 1
            ok = check[slot] == state
            row, slot, rank = row[ok], slot[ok], rank[ok]
            state = target[slot]
            rank = rank + out[slot]
            over = size[row] == k
            hit = over & (final[state] > 0)
            found[row[hit]] = rank[hit]
            row, state, rank = row[~over], state[~over], rank[~over]
        return found

    def _merge(self, word: bytes) -> list[int]:
        if len(self.new) >= self.most_words:
            self.new.clear()
        ids = [t.id for t in self.merged(word.decode("latin-1").translate(BYTE_LETTERS))]
        if len(word) <= 8 * LEXICON_BYTES:
            self.new[word] = ids
        return ids

    def _encode(self, parts: list[str]) -> list[np.ndarray]:
        raw, at, size, before = self.cut(parts)
        rank = self.ranks(raw, at, size)
        id_at, ids = self.lexicon["id_at"], self.lexicon["ids"]
        missed = np.flatnonzero(rank < 0)
        flat: list[int] = []
        extra = np.zeros(len(missed) + 1, np.int64)
        known, merge = self.new.get, self._merge
        for k, (lo, n) in enumerate(zip(at[missed].tolist(), size[missed].tolist(), strict=True), 1):
            word = raw[lo : lo + n]
            flat += known(word) or merge(word)
            extra[k] = len(flat)
        pool = np.concatenate([ids, np.array(flat, np.int32)])
        where = np.zeros(len(at), np.int64)
        many = np.zeros(len(at), np.int64)
        hit = rank >= 0
        where[hit], many[hit] = id_at[rank[hit]], id_at[rank[hit] + 1] - id_at[rank[hit]]
        where[missed], many[missed] = len(ids) + extra[:-1], np.diff(extra)
        return np.split(pool[_spread(where, many)], np.concatenate([[0], np.cumsum(many)])[before[1:-1]])

    def parts(self, text: str) -> Iterator[str | int]:
        """A text's parts between special tokens, and those tokens' ids; a long part is cut before a space between two words."""
        for k, part in enumerate(self.special_cut.split(text) if self.special_cut else [text]):
            if k % 2:
                yield self.special[part]
                continue
            lo = 0
            while len(part) - lo > 2 * CHUNK:
                found = re.compile(r"(?<=\S) (?=\S)").search(part, lo + CHUNK)
                if not found:
                    break
                yield part[lo : found.start()]
                lo = found.start()
            yield part[lo:]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text in order, some CHUNK characters at a time."""
        whole: list[list] = []
        some, size = [], 0

        def work() -> None:
            ids = self._encode([p for _, p in some]) if some else []
            for (slot, _), x in zip(some, ids, strict=True):
                slot[0] = x
            some.clear()

        for text in texts:
            slots: list[list] = []
            for part in self.parts(text or ""):
                if isinstance(part, int):
                    slots.append([np.array([part], np.int32)])
                elif part:
                    slots.append([None])
                    some.append((slots[-1], part))
                    size += len(part)
                if size >= CHUNK:
                    work()
                    size = 0
            whole.append(slots)
            if not some:
                yield from self._joined(whole)
                whole.clear()
        work()
        yield from self._joined(whole)

    @staticmethod
    def _joined(whole: list[list]) -> Iterator[np.ndarray]:
        for slots in whole:
            yield np.concatenate([np.zeros(0, np.int32), *(s[0] for s in slots)]).astype("<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids, in UTF-8."""
        at, raw = self.tokens
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(at) - 1)]
        parts = []
        for lo in range(0, len(ids), CHUNK):
            some = ids[lo : lo + CHUNK]
            parts.append(raw[_spread(at[some], at[some + 1] - at[some])].tobytes())
        return b"".join(parts).decode("utf-8", "replace").encode()


def _spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ... of each run, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - size), size)


#: A worker's codec with its mapped lexicon, for the tasks that it runs one after the other.
_held: dict[tuple[str, str | None], Codec] = {}


def _codec(path: str, lexicon: str | None = None) -> Codec:
    codec = _held.get((path, lexicon))
    if codec is None:
        _held.clear()
        codec = _held[path, lexicon] = Codec(path, map_lexicon(lexicon) if lexicon else None)
    codec.new.clear()
    return codec


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))


def word_counts(docs: DataFrame, path: str, text_col: str = "text", most_bytes: int = LEXICON_BYTES, held: int = 200_000) -> DataFrame:
    """(word binary, n): how often each pre-token of at most most_bytes bytes occurs, over all whole texts."""

    def run(batches):
        codec, seen = _codec(path), Counter()

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            some, size = [], 0
            for text in [*batch.column(0).to_pylist(), None]:
                for part in codec.parts(text or ""):
                    if isinstance(part, str) and part:
                        some.append(part)
                        size += len(part)
                    if size >= CHUNK:
                        _count(codec, some, most_bytes, seen)
                        some, size = [], 0
            if some:
                _count(codec, some, most_bytes, seen)
            if len(seen) >= held:
                yield table()
                seen.clear()
        if seen:
            yield table()

    few_rows(docs.sparkSession)
    found = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _count(codec: Codec, parts: list[str], most_bytes: int, seen: Counter) -> None:
    raw, at, size, _ = codec.cut(parts)
    keep = size <= most_bytes
    seen.update([raw[a:b] for a, b in zip(at[keep].tolist(), (at + size)[keep].tolist(), strict=True)])


def frequent(counts: DataFrame, words: int) -> list[bytes]:
    """The most frequent words in byte order, at most `words`: whole classes of counts, sixteen to each doubling.

    Only the classes' sizes and the words above the bound come to the driver.
    """
    level = F.floor(16 * F.log2("n"))
    room, least = words, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if r["count"] > room:
            break
        room, least = room - r["count"], r.level
    return [] if least is None else sorted(bytes(r.word) for r in counts.filter(level >= least).select("word").collect())


def build_lexicon(docs: DataFrame, path: str, text_col: str = "text", words: int = LEXICON_WORDS, most_bytes: int = LEXICON_BYTES) -> str:
    """Compile the most frequent pre-tokens of the documents, at most `words`; the file's path in the shared folder.

    The lexicon's size is a parameter, whatever the corpus: its words come to the driver, which merges and compiles them.
    """
    spark = docs.sparkSession
    with scratch(spark):
        top = frequent(staged(word_counts(docs, path, text_col, most_bytes), "words"), words)
    codec = Codec(path)
    target = stage_path(spark, "lexicon") + ".bin"
    write_lexicon(transducer(top, [codec._merge(w) for w in top]), target)
    return target


def encode(docs: DataFrame, path: str, lexicon: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each document."""

    def run(batches):
        codec = _codec(path, lexicon)
        for batch in slices(batches):
            ids = [x.astype(np.int32) for x in codec.encode(batch.column(1).to_pylist())]
            ends = np.cumsum([0, *map(len, ids)])
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["id", "ids"])

    few_rows(docs.sparkSession)
    rows = _named(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each row of ids; null ids give the empty text."""

    def run(batches):
        codec = _codec(path)
        for batch in slices(batches):
            texts = [codec.decode([i for i in x or () if i is not None]).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    few_rows(rows.sparkSession)
    some = rows.select(rows[id_col].alias("id"), rows[ids_col].alias("ids"))
    return some.mapInArrow(run, f"id {some.schema['id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, lexicon: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each document: encoded, and decoded again, in one task."""

    def run(batches):
        codec = _codec(path, lexicon)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in slices(batches):
            rows = [(len(ids), sha(ids.tobytes()), sha(codec.decode(ids))) for ids in codec.encode(batch.column(1).to_pylist())]
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    few_rows(docs.sparkSession)
    rows = _named(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, path, build_lexicon(docs, path)).withColumnRenamed("id", "doc_id")
