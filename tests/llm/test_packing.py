import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import Row
from tokenizers import Tokenizer

from tallyglass.llm import packing as P

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, capacity=2048, ids=False):
    """Every piece is its document's tokens, and sequences are full without gaps or overlaps."""
    t = Tokenizer.from_file(PATH)
    want = {}
    for i, text in texts:
        full = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for n, s in enumerate(range(0, len(full), capacity)):
            part = full[s : s + capacity]
            want.setdefault((i, n), []).append((s, len(part), zlib.crc32(part.tobytes())))
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece), []).append((r.start, r.length, r.ids_crc32))
        if ids:
            assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs), -(-sum(r.length for r in rows) // capacity)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    used, least = check(P.op7_best_fit_packing(spark, SF).collect(), [(d.doc_id, d.text) for d in docs])
    assert used <= least * 1.02 + 1, (used, least)


def test_edges(spark):
    texts = [(1, None), (2, ""), (3, " \n"), (3, "a b"), (None, "x"), (5, "don't  é \u001cB1 <|endoftext|> ΣΣ it's!!? 2024 ǅ"), (6, "word " * 9000)]
    docs = spark.createDataFrame([Row(doc_id=a, text=b, part=1, ids="x", rank=None) for a, b in texts], "doc_id long, text string, part int, ids string, rank int")
    check(P.pack(docs, PATH, capacity=64).collect(), texts, 64, ids=True)
    assert P.pack(docs.limit(0), PATH).count() == 0


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(1)
    for n in (0, 5, 5000, 200_000):
        bars = np.bincount(np.clip(rng.lognormal(4, 1, n), 1, 512).astype(int), minlength=513)
        groups = P.plan(bars, 512)
        back = np.zeros(513, np.int64)
        for count, lengths in groups:
            assert sum(lengths) <= 512
            for v in lengths:
                back[v] += count
        assert (back == bars).all()
        if n > 1000:
            assert sum(c for c, _ in groups) <= -(-int((bars * np.arange(513)).sum()) // 512) * 1.005 + 1


def test_most_short_pieces_come_from_patterns(spark, monkeypatch):
    for sf in ("sf0.01", "sf0.1"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        lengths = docs.select("doc_id", "text").mapInArrow(P._pieces(PATH, 2048, False), "id long, piece int, start long, length long, ids_crc32 long, part int, local long")
        bars = np.zeros(2049, np.int64)
        for r in lengths.groupBy("length").count().collect():
            bars[r.length] = r["count"]
        real, left = P._best_fit, []
        monkeypatch.setattr(P, "_best_fit", lambda rest, *a: left.append(rest.sum()) or real(rest, *a))
        groups = P.plan(bars, 2048)
        monkeypatch.undo()
        assert left[0] <= 0.5 * bars[:2048].sum(), (sf, left, bars.sum())
        assert sum(c for c, _ in groups) <= -(-int((bars * np.arange(2049)).sum()) // 2048) * 1.001 + 1


def test_forgetting_keeps_the_ids(spark):
    texts = [" ".join(f"w{(k * j) % 997}x{j % 7}," for j in range(300)) for k in range(40)] + ["É é, don't 12"]
    t, few = Tokenizer.from_file(PATH), P.WordTokens(PATH, most_words=500)
    for _ in range(2):
        for k in range(0, len(texts), 3):
            for text, ids in zip(texts[k : k + 3], few.encode(texts[k : k + 3]), strict=True):
                assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_words_are_numbered_as_they_are_met():
    """One look-up a word of the text, which numbers new words; ids are the tokenizer's, also of words learnt again."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdeéßΔ"))
    words = ["".join(rng.choice(letters, 6)) + rng.choice(["", ".", ",", "!?", "'s", ";", "3"]) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(40)]
    tokens, t = P.WordTokens(PATH, most_words=150), Tokenizer.from_file(PATH)
    first = tokens.encode(texts[:1])
    assert list(tokens.words) == list(dict.fromkeys(texts[0].encode().split()))
    for lo in range(0, 40, 5):
        first = tokens.encode(texts[lo : lo + 5])
        assert [x.tolist() for x in first] == [t.encode(x, add_special_tokens=False).ids for x in texts[lo : lo + 5]]
        assert sorted(tokens.words.values()) == list(range(len(tokens.words))) and not tokens.words.new
