"""The transducer codec against the tokenizers library, and its lexicon against plain counts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tallyglass.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
BITS = ["'s", "'re", "'", "''", " ", "  ", "\n", "\t", " \n", "a", "b", "don't", "é", "ß", "1", "२", "!", "...", "<|endoftext|>", "<|endof", " ", "　", "日本", "\U0001f600", "'ll", "'v", "'LL", "\r\n", "՘", "ՠ", "\x85", "l", "s", "q" * 50]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def lexicon(words):
    words = sorted(words)
    codec = bpe.Codec(PATH)
    return bpe.transducer(words, [codec._merge(w) for w in words])


def test_automaton_is_minimal_and_ranks_its_words():
    words = sorted({f"{a}{b}{c}".encode() for a in ("be", "re", "un", "") for b in ("load", "lock", "pack") for c in ("", "ed", "ing", "s")})
    arcs, final = bpe.minimal_automaton(words)
    live, todo = {0}, [0]
    while todo:
        for t in arcs[todo.pop()].values():
            if t not in live:
                live.add(t)
                todo.append(t)

    def language(state):
        return frozenset([b""] * final[state]) | {bytes([b]) + rest for b, t in arcs[state].items() for rest in language(t)}

    assert language(0) == set(words)
    assert len({language(s) for s in live}) == len(live) < 40
    codec = bpe.Codec(PATH, bpe.transducer(words, [[k] for k in range(len(words))]))
    others = [b"load", b"loa", b"unpacks!", b"x", b"loadingg", b"\xff\xff"]
    raw = b"".join(words + others)
    size = np.array(list(map(len, words + others)))
    got = codec.ranks(raw, np.cumsum(size) - size, size).tolist()
    assert got == [*range(len(words)), words.index(b"load"), -1, -1, -1, -1, -1]


@pytest.mark.parametrize("chunk", [1 << 19, 60])
def test_ids_and_texts_equal_the_librarys(library, monkeypatch, chunk):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    texts = [*odd_texts(4000), "", None, " ", "\n\n ", " ".join(odd_texts(300, 5)), "z" * 3000, "'", "'s", "x's ", "a 's"]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for words in ([], [b"a", b"'s", b" \n", b"b", b"don", b"'t", b" don", b"!", b"...", "é".encode()]):
        codec = bpe.Codec(PATH, lexicon(words))
        got = list(codec.encode(texts))
        assert [x.tolist() for x in got] == want
        assert [codec.decode(x).decode() for x in got] == [t or "" for t in texts]


def test_any_ids_decode_as_the_librarys(library):
    codec, rng = bpe.Codec(PATH), np.random.default_rng(1)
    for n in (0, 1, 2, 5, 40):
        for _ in range(200):
            ids = rng.integers(0, 50_300, n)
            assert codec.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_words_are_counted_in_all_texts(spark, library):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(odd_texts(500))] + [(None, None), (3, "")], "doc_id long, text string")
    want, codec = Counter(), bpe.Codec(PATH)
    for r in docs.collect():
        for part in codec.parts(r.text or ""):
            if isinstance(part, str):
                want.update(part[a:b].encode() for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(part))
    got = {bytes(r.word): r.n for r in bpe.word_counts(docs, PATH, held=50).collect()}
    assert got == {w: n for w, n in want.items() if len(w) <= bpe.LEXICON_BYTES}


def test_frequent_words_in_whole_classes_of_counts(spark):
    counts = spark.createDataFrame([(b"a", 900), (b"c", 40), (b"b", 41), (b"x", 2), (b"y", 2), (b"z", 2), (b"w", 1)], "word binary, n long")
    assert [bpe.frequent(counts, k) for k in (0, 1, 2, 3, 5, 6, 100)] == [[], [b"a"], [b"a"], [b"a", b"b", b"c"], [b"a", b"b", b"c"], [b"a", b"b", b"c", b"x", b"y", b"z"], [b"a", b"b", b"c", b"w", b"x", b"y", b"z"]]
    assert bpe.frequent(counts.filter("false"), 9) == []


def test_frames(spark, library):
    rows = [(k, t, "x") for k, t in enumerate(odd_texts(200))] + [(None, None, "x"), (1, "again", "x"), (1, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    name = bpe.build_lexicon(docs, PATH, words=20)
    ids = bpe.encode(docs, PATH, name)
    got = Counter((r.id, tuple(r.ids)) for r in ids.collect())
    assert got == Counter((k, tuple(library.encode(t or "", add_special_tokens=False).ids)) for k, t, _ in rows)
    back = Counter((r.id, r.text) for r in bpe.decode(ids, PATH).collect())
    assert back == Counter((k, t or "") for k, t, _ in rows)
    none = docs.filter("false")
    name = bpe.build_lexicon(none, PATH)
    assert bpe.encode(none, PATH, name).collect() == []
    assert [list(r.ids) for r in bpe.encode(docs.filter("text = 'again'"), PATH, name).collect()] == [library.encode("again", add_special_tokens=False).ids] * 2


def test_query_equals_the_library(spark, library):
    table = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for k, t in zip(table["doc_id"], table["text"], strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[k] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op11_bpe_transducer(spark, SF).collect()}
    assert got == want
