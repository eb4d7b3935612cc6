"""Each stage against brute force on the small tables."""

import hashlib
import re

import corpus_pipeline as P
from tallyglass.llm import toxicity

from .test_packing import check as check_packing
from .test_simhash_dedup import near_kept

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    n = min(5, len(w))
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept = docs.collect()
        if name == "best_fit_packing":
            used, least = check_packing(kept, [(i, r.text) for i, r in rows.items()])
            assert used <= least * 1.05 + 1
            break
        assert docs.columns == columns and len(kept) == len({r.doc_id for r in kept})
        assert all(rows[r.doc_id] == r for r in kept)
        kept = {r.doc_id for r in kept}
        if name == "toxicity":
            clean = [i for i in rows if labels.get(i) == 0]
            assert sum(i in kept for i in clean) >= 0.97 * len(clean)
        elif name == "exact_dedup":
            last = {}
            for i, r in sorted(rows.items()):
                last[hashlib.sha256((r.text or "").encode().lower()).digest()] = i
            assert kept == set(last.values())
        elif name == "simhash_near_dedup":
            assert kept == {i for i, _ in near_kept([(i, r.text) for i, r in sorted(rows.items())])}
        else:
            for i, r in rows.items():
                s = shingles(r.text)
                assert (i in kept) == all(not q or len(q & s) < 0.8 * len(q) - 1e-9 for q in items), i
        rows = {i: r for i, r in rows.items() if i in kept}


def test_stages_take_odd_rows(spark, monkeypatch):
    """Exactly these rows stay after each stage, of nulls, empty texts, ties, repeated rows and repeated ids."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (3, "other words, same id"), (None, "x y z"), (None, "unlike it"), (None, None)]
    rows += [(4, near), (4, near.replace("w30", "z")), (None, near.replace("w10", "z")), (5, item), (None, item), (5, "clean, as 5 goes"), (6, "vile " * 9)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], kind)
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: 0.1)
    monkeypatch.setattr(toxicity, "score_texts", None)
    gone = {
        "toxicity": [],
        "exact_dedup": [(1, None), (3, "a b"), (None, None)],
        "simhash_near_dedup": [(4, near.replace("w30", "z")), (None, near.replace("w10", "z"))],
        "benchmark_decontamination": [(5, item)],
    }
    want = list(rows)
    want.remove((None, item))  # of equal texts the largest id stays, a null id only alone
    docs = odd
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns
        for row in gone[name]:
            want.remove(row)
        got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        if name == "toxicity":
            assert got == sorted(rows, key=str)
        elif name == "simhash_near_dedup":
            # Of the two near copies under one id either may stay.
            plain = lambda x: sorted(((i, (t or "").replace(" z ", " w30 ")) for i, t in x), key=str)
            assert plain(got) == plain(want)
        elif name == "exact_dedup":
            assert got == sorted(want, key=str)
    pieces = P.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in pieces if r.piece == 0) == sorted(str(i) for i, _ in want)
    empty = odd.limit(0)
    for name, stage in P.STAGES:
        empty = stage(spark, empty, SF)
        assert name == P.STAGES[-1][0] or empty.columns == odd.columns
    assert empty.count() == 0
