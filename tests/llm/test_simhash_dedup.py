import random

import numpy as np
import xxhash
from pyspark.sql import Row

from tallyglass.llm import simhash_dedup as S

SF = "/root/testdata/sf0.01"


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(pairs):
    root = {i: i for i, _ in pairs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in pairs:
        for j, b in pairs:
            if j > i and (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in pairs}


def test_whole_table(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op3_simhash_near_dedup(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fps = [(d.doc_id, brute_fp(d.text)) for d in docs]
    want = brute(fps)
    assert got == {i: (f"{fp:016x}", want[i]) for i, fp in fps}


def test_trie_and_components(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)] + [0]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for b in base for _ in range(25)}
    fps = sorted({f & (2**64 - 1) for f in fps})
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    want = brute(list(enumerate(fps)))
    for node_rows, most_bits in ((20_000, 16), (3, 6), (3, 12)):
        roots = {r.node: r.root for r in S.connected(S.link_edges(frame, node_rows=node_rows, most_bits=most_bits)).collect()}
        name = {i: roots.get(int(np.uint64(f).view(np.int64)), int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)}
        first = {}
        assert all(first.setdefault(want[i], name[i]) == name[i] for i in want)
        assert len(set(name.values())) == len(set(want.values()))


def test_edges(spark):
    rows = [(1, "a b c d e"), (2, "A B c d e"), (3, None), (4, ""), (5, "  \t"), (5, "one"), (None, "zz yy xx"), (7, "w " * 50_000)]
    docs = spark.createDataFrame([Row(doc_id=a, text=b, fp=1, id=2) for a, b in rows], "doc_id long, text string, fp int, id int")
    out = S.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    comp = {(r.doc_id, r.fingerprint): r.component_id for r in out}
    assert {c for (i, f), c in comp.items() if f == "0" * 16} == {3}
    assert {c for (i, f), c in comp.items() if i in (1, 2)} == {1}
    left = S.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    kept = sorted((str(r.doc_id), r.text[:9] if r.text else r.text) for r in left.collect())
    assert kept == sorted([("1", "a b c d e"), ("3", None), ("5", "one"), ("7", "w w w w w"), ("None", "zz yy xx")])
    assert S.near_duplicates(docs.limit(0)).count() == 0


def jaccard_sets(text):
    w = (text or "").encode().lower().split()
    n = min(5, len(w))
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if w else {b""}


def near_components(rows, threshold=0.8):
    """Rows linked by exact 5-word Jaccard, by brute force over an index of all shingles: root of each position."""
    sets = [jaccard_sets(t) for _, t in rows]
    where = {}
    for k, x in enumerate(sets):
        for g in x:
            where.setdefault(g, []).append(k)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, x in enumerate(sets):
        for j in {j for g in x for j in where[g] if j < k}:
            both = len(x & sets[j])
            if both >= threshold * (len(x) + len(sets[j]) - both) - 1e-9:
                a, b = find(j), find(k)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(rows))]


def near_kept(rows):
    """The (id, text) rows that stay: of each component the smallest id, nulls last."""
    groups = {}
    for k, r in enumerate(near_components(rows)):
        groups.setdefault(r, []).append(rows[k])
    return sorted((min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()), key=str)


def test_near_copies_by_jaccard(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = " ".join(word() for _ in range(60))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([40, 90, 200]))]
        rows.append((len(rows), " ".join(base)))
        for edits in (1, 1, 2, 4):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            rows.append((rng.choice([len(rows), 7, None]), " ".join(copy)))
    rows += [(1000 + k, " ".join(word() for _ in range(80)) + " " + shared) for k in range(40)]
    rows += [(5, "one two"), (5, "ONE two"), (5, "one three"), (None, None), (None, ""), (3, " \t"), (None, rows[0][1])]
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, row string, digest int")
    got = sorted(((r.doc_id, r.text) for r in S.drop_near_duplicates(docs).collect()), key=str)
    want = near_kept(rows)
    norm = lambda x: sorted(str((a, sorted(jaccard_sets(t)))) for a, t in x)
    assert norm(got) == norm(want)
    assert S.drop_near_duplicates(docs.limit(0)).count() == 0


def test_chains_and_thin_links_in_large_groups(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line, rows = " ".join(word() for _ in range(12)), []
    for _ in range(12):
        text = [word() for _ in range(50)]
        for k in range(40):  # each text is linked to the one before and the one after, no other
            rows.append((len(rows), " ".join(text) + " " + line))
            text[k] = word()
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in S.drop_near_duplicates(docs).collect()), key=str)
    assert got == near_kept(rows) and len(got) == 12


def test_stage_holds_texts_and_one_turn_at_a_time(spark, monkeypatch):
    """No set of shingles is staged or shuffled, a turn's tables go with it, and shuffles go with their action."""
    import glob

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before, kinds, held, set_now = set(glob.glob(f"{root}/tallyglass/*/*")), {}, [], []
    real_staged, real_between = S.staged, S.links_between

    def staged(frame, table, keep=False):
        kinds.setdefault(table, dict(frame.dtypes))
        set_now.append(spark.conf.get(name))
        return real_staged(frame, table, keep)

    def between(*a):
        held.extend(set(glob.glob(f"{root}/tallyglass/*/*")) - before)
        return real_between(*a)

    monkeypatch.setattr(S, "staged", staged)
    monkeypatch.setattr(S, "links_between", between)
    docs = spark.createDataFrame([(k, f"a b c d e f g h i j k l m n o p q r s t {k // 5}") for k in range(40)], "doc_id long, text string")
    was = spark.conf.get(name)
    assert S.drop_near_duplicates(docs).count() == 1
    assert [t for t, k in kinds.items() if any(c != "prints" and x.startswith("array") for c, x in k.items())] == []
    tables = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in held}
    assert "found" in tables and not tables & {"wanted", "groups", "members", "pairs"}
    assert set(set_now) == {"true"} and spark.conf.get(name) == was
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{root}/tallyglass/*/*")) - before}
    assert left == {"fate"}


def test_near_copies_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Copies of which about half the pairs are similar, in one group: some comparisons a row, not the group's pairs."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, rows, asked = [word() for _ in range(400)], [], []
    for k in range(300):
        copy = list(base)
        for _ in range(rng.randrange(2, 9)):
            copy[rng.randrange(len(copy))] = word()
        rows.append((k, " ".join(copy)))
    real = S.similar

    def similar(pairs, *a):
        asked.append(pairs.count())
        return real(pairs, *a)

    monkeypatch.setattr(S, "similar", similar)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in S.drop_near_duplicates(docs).collect()), key=str) == near_kept(rows)
    assert sum(asked) <= 20 * len(rows)


def test_a_shared_passage_is_one_meeting(spark, monkeypatch):
    """However many of their first shingles two texts share, they meet once; texts under the similarity stay."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, met = [], []
    for _ in range(20):
        passage = " ".join(word() for _ in range(100))
        rows += [(len(rows) + j, passage + " " + " ".join(word() for _ in range(25))) for j in range(2)]
    real = S.staged

    def staged(frame, name, keep=False):
        out = real(frame, name, keep)
        if name == "prefixes":
            met.append(out.count())
        return out

    monkeypatch.setattr(S, "staged", staged)
    assert S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)
    assert met and max(met) <= len(rows)
