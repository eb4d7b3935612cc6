"""SimHash near-duplicates by a binary-trie self-join under a Hamming budget.

Equal fingerprints collapse first. Two fingerprints within the budget of three bits agree on at least one of four
16-bit blocks, so each distinct fingerprint is rotated to bring each block to the front and dealt to the trie node
that the block names. A task walks its tries by node pairs: a pair of subtrees is opened one bit at a time, the bits
in which their prefixes differ are added up, and the pair is given up once they exceed the budget. A node with more
than `node_rows` fingerprints is first opened by further bits, and its child pairs are dealt out as tasks of their
own. Each walk returns a spanning star of the links found, not the links themselves, so groups of copies never turn
into pairs; components are then joined by alternating large-star and small-star rounds over those edges.

`drop_near_duplicates` removes texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more. Three
bits of 64 reach only such pairs as are nearly equal, so the whole-text fingerprint, linked by the trie, is one of
several candidate tables; each of the others holds the SimHash of PICKED shingles chosen by a min-wise hash, and two
texts meet there with probability about similarity to that power, in one of TABLES tables at least nearly always. In
each group of candidates the rows are compared exactly with one head, the row that shares most tables with most rows; so
a group of copies costs some comparisons a row, not its pairs. What that misses is found exactly: rows of different components that share one of their first
shingles are compared as well (`links_between`), so the components are those of all links.

Defined results: null text counts as empty; texts without words have fingerprint zero and link like any other; rows
that repeat an id each have their own text's component; null ids are never a component's name unless the component has
no other. `drop_near_duplicates` keeps exactly one row of each component, that of the smallest id (a null id only where
there is no other; of rows that repeat id and text one), so ids that repeat, or are null, never take other rows along.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import brief_shuffles, few_rows, scratch, slices, staged, utf8

SEED = 42
BUDGET = 3
BLOCKS = 4
BLOCK_BITS = 16
WIDTH, SIMILARITY = 5, 0.8
TABLES, PICKED = 14, 5
#: Most rows of a table of ids that is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shingle_hashes(text: str | None, width: int = 3) -> list[int]:
    """XXH64 of every `width`-word shingle of the lower-cased text, repeats included."""
    words = utf8(text).lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    flat, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-width])]
    digest = xxhash.xxh64_intdigest
    return [digest(flat[s:e], SEED) for s, e in zip(starts, ends[width - 1 :], strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """Bits set in over half the hashes; zero for none."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = np.array(hashes[k : k + 65536], dtype=np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return int(value) if hashes else 0


def _fingerprints(batches):
    for batch in slices(batches):
        values = [fingerprint(shingle_hashes(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["id", "fp"])


def trie_links(keys: np.ndarray, pairs: list[np.ndarray], budget: int = BUDGET, leaf: int = 512, chunk: int = 1 << 20):
    """Yield (i, j) index arrays of keys that differ in at most `budget` bits.

    keys: sorted uint64 within each node. pairs: arrays a_lo, a_hi, b_lo, b_hi, depth of the node pairs to start from;
    both nodes of a pair share a depth, and all pairs of one call the same depth.
    """
    a_lo, a_hi, b_lo, b_hi, depth = pairs
    if not len(a_lo):
        return
    start = int(depth[0])
    ones = [None] * 64
    differ = np.bitwise_count((keys[a_lo] ^ keys[b_lo]) >> np.uint64(64 - start)) if start else np.zeros(len(a_lo), np.uint8)
    stack = [(start, a_lo, a_hi, b_lo, b_hi, differ.astype(np.int8))]
    while stack:
        d, a_lo, a_hi, b_lo, b_hi, err = stack.pop()
        while len(a_lo):
            if len(a_lo) > chunk:
                half = len(a_lo) // 2
                stack.append((d, a_lo[half:], a_hi[half:], b_lo[half:], b_hi[half:], err[half:]))
                a_lo, a_hi, b_lo, b_hi, err = a_lo[:half], a_hi[:half], b_lo[:half], b_hi[:half], err[:half]
                continue
            na, nb = a_hi - a_lo, b_hi - b_lo
            done = (na * nb <= leaf) | (d >= 64)
            if done.any():
                yield from _compare(keys, a_lo[done], na[done], b_lo[done], nb[done], budget, chunk)
                go = ~done
                a_lo, a_hi, b_lo, b_hi, err = a_lo[go], a_hi[go], b_lo[go], b_hi[go], err[go]
                if not len(a_lo):
                    break
            if ones[d] is None:
                bit = ((keys >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int64)
                ones[d] = np.concatenate([[0], np.cumsum(bit)])
            c = ones[d]
            a_mid, b_mid = a_hi - (c[a_hi] - c[a_lo]), b_hi - (c[b_hi] - c[b_lo])
            own = (a_lo == b_lo) & (a_hi == b_hi)
            near = err < budget
            cross = near & ~own
            parts = [
                (a_lo, a_mid, b_lo, b_mid, err),
                (a_mid, a_hi, b_mid, b_hi, err),
                (a_lo[near], a_mid[near], b_mid[near], b_hi[near], err[near] + 1),
                (a_mid[cross], a_hi[cross], b_lo[cross], b_mid[cross], err[cross] + 1),
            ]
            a_lo, a_hi, b_lo, b_hi, err = (np.concatenate(x) for x in zip(*parts, strict=True))
            full = (a_hi > a_lo) & (b_hi > b_lo) & ~((a_lo == b_lo) & (a_hi - a_lo == 1) & (b_hi - b_lo == 1))
            a_lo, a_hi, b_lo, b_hi, err = a_lo[full], a_hi[full], b_lo[full], b_hi[full], err[full]
            d += 1


def _compare(keys, a_lo, na, b_lo, nb, budget, chunk):
    size = na * nb
    ends = np.cumsum(size)
    cuts = np.searchsorted(ends, np.arange(chunk, int(ends[-1]) + chunk, chunk), "right")
    at = 0
    for cut in np.unique(np.append(cuts, len(size))):
        part = slice(at, max(int(cut), at + 1))
        if at >= len(size):
            break
        at = part.stop
        s = size[part]
        which = np.repeat(np.arange(len(s)), s)
        k = np.arange(len(which)) - np.repeat(np.cumsum(s) - s, s)
        i = a_lo[part][which] + k // nb[part][which]
        j = b_lo[part][which] + k % nb[part][which]
        hit = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
        yield i[hit], j[hit]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the label trees of linked positions; labels point to the smallest position reached so far."""
    while len(i):
        i, j = label[i], label[j]
        apart = i != j
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        lo, hi = np.minimum(i, j), np.maximum(i, j)
        np.minimum.at(label, hi, lo)
        while True:
            short = label[label]
            if np.array_equal(short, label):
                break
            label[:] = short


def _walk(frame: pd.DataFrame):
    """Spanning edges of the node pairs in a frame sorted by group, then key."""
    keys = frame.key.to_numpy().view(np.uint64)
    group = frame.group.to_numpy()
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    last = np.append(first[1:], len(keys))
    depth = frame.depth.to_numpy()[first]
    label = np.arange(len(keys))
    for d in np.unique(depth):
        take = depth == d
        lo, hi = first[take], last[take]
        shift = np.uint64(64 - int(d))
        # A group holds one node, or the two nodes of a pair, one after the other in key order.
        head = keys >> shift
        change = np.concatenate([[0], np.cumsum(head[1:] != head[:-1])])
        single = change[hi - 1] == change[lo]
        keep = ~(single & frame.pair.to_numpy()[lo])  # one side of a pair of nodes has no rows
        lo, hi, single = lo[keep], hi[keep], single[keep]
        if not len(lo):
            continue
        mid = np.searchsorted(change, change[lo], "right")
        a_hi = np.where(single, hi, np.minimum(mid, hi))
        b_lo = np.where(single, lo, a_hi)
        for i, j in trie_links(keys, [lo, a_hi, b_lo, hi, np.full(len(lo), d)]):
            _merge(label, i, j)
    moved = np.flatnonzero(label != np.arange(len(keys)))
    fp = _rotate(keys, (64 - BLOCK_BITS * frame.block.to_numpy().astype(np.int64)) % 64)
    return fp[moved].view(np.int64), fp[label[moved]].view(np.int64)


def _rotate(keys: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint64)
    return (keys << by) | np.where(by == 0, np.uint64(0), keys >> ((np.uint64(64) - by) % np.uint64(64)))


def _edges(batches, rows: int = 200_000):
    held: list[pd.DataFrame] = []
    count = 0

    def out(frame):
        a, b = _walk(frame.reset_index(drop=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        held.append(batch.to_pandas())
        count += batch.num_rows
        if count >= rows:
            frame = pd.concat(held, ignore_index=True)
            final = frame.group.iloc[-1]
            cut = int(np.argmax(frame.group.to_numpy() == final))
            if cut:
                yield out(frame.iloc[:cut])
            held, count = [frame.iloc[cut:]], len(frame) - cut
    if count:
        yield out(pd.concat(held, ignore_index=True))


def _rotl(col, by: int):
    return col if by == 0 else F.shiftleft(col, by).bitwiseOR(F.shiftrightunsigned(col, 64 - by))


def _masks(bits: int) -> list[int]:
    return [m for m in range(1 << bits) if m.bit_count() <= BUDGET]


def link_edges(fps: DataFrame, node_rows: int = 20_000, most_bits: int = 16) -> DataFrame:
    """Edges (a, b) that span every component of distinct fingerprints `fp` linked within the budget.

    A node of up to node_rows fingerprints is one task's work; a larger one is opened by as many further bits as bring
    its children to a quarter of that on average (most_bits at most), so a row is copied for the pairs of its own node's
    size: 15 times at four bits, 176 at ten.
    """
    turned = fps.select(F.explode(F.array(*[F.struct(F.lit(b).alias("block"), _rotl(F.col("fp"), b * BLOCK_BITS).alias("key")) for b in range(BLOCKS)])).alias("t")).select("t.*")
    turned = staged(turned.withColumn("node", F.shiftrightunsigned("key", 64 - BLOCK_BITS)), "trie")
    bits = F.least(F.ceil(F.log2(F.col("count") / node_rows)).cast("int") + 2, F.lit(most_bits))
    large = staged(turned.groupBy("block", "node").count().filter(F.col("count") > node_rows).select("block", "node", bits.alias("bits")), "large")
    placed = turned.join(large, ["block", "node"], "left")
    whole = placed.filter("bits is null").select("block", "key", F.lit(BLOCK_BITS).alias("depth"), F.lit(False).alias("pair"), F.xxhash64("block", "node").alias("group"))
    dealt = whole
    for n in sorted(r.bits for r in large.select("bits").distinct().collect()):
        sub = F.shiftrightunsigned("key", 64 - BLOCK_BITS - n).bitwiseAND(F.lit((1 << n) - 1))
        opened = (
            placed.filter(F.col("bits") == n)
            .withColumn("sub", sub)
            .withColumn("other", F.explode(F.lit(_masks(n)).cast("array<bigint>")))
            .withColumn("other", F.col("sub").bitwiseXOR(F.col("other")))
            .select("block", "key", F.lit(BLOCK_BITS + n).alias("depth"), (F.col("sub") != F.col("other")).alias("pair"), F.xxhash64("block", "node", F.least("sub", "other"), F.greatest("sub", "other")).alias("group"))
        )
        dealt = dealt.unionByName(opened)
    dealt = dealt.repartition("group").sortWithinPartitions("group", F.col("key").bitwiseXOR(F.lit(-(1 << 63))))
    return dealt.select("group", "block", "key", "depth", "pair").mapInArrow(_edges, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge list (a, b): root is the smallest node reached.

    Large-star hangs each node's larger neighbours on its smallest one, small-star the smaller ones; rounds alternate
    until every edge points at a root. Each round is written to the shared folder, so lineage stays short.
    """
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return staged(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "roots")
        seen = state
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        # Written first: a hub's edges are then a shuffle of their own, which can be split.
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        star = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        star = star.filter("hi <> lo").distinct()
        star = staged(star, "star")
        least = staged(star.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = star.join(least, "hi")
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(small.select("hi", "m"))
        edges = staged(small.filter("hi <> lo").distinct(), "edges")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, fingerprint (16 hex digits) and component_id."""
    few_rows(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    prints = staged(
        docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(_fingerprints, f"id {id_type}, fp long"),
        "fingerprints",
    )
    fps = staged(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct")
    roots = connected(link_edges(fps.select("fp")))
    named = staged(fps.join(roots, fps.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "named")
    least = staged(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    of_fp = staged(named.join(least, "root").select("fp", "component_id"), "components")
    return prints.join(of_fp, "fp", "left").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `width`-word shingles; of fewer words, the whole sequence; of none, zero."""
    words = utf8(text).lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return np.zeros(1, np.uint64)
    width = min(width, len(h))
    n = len(h) - width + 1
    mixed = np.full(n, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def picked_prints(shingles: np.ndarray) -> np.ndarray:
    """TABLES fingerprints, each the SimHash of the PICKED shingles that its own min-wise hash puts first."""
    order = (shingles[None] ^ (np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[:, None]) * np.uint64(0xC2B2AE3D27D4EB4F)
    order ^= order >> np.uint64(31)
    order *= np.uint64(0x9E3779B97F4A7C15)
    n = min(PICKED, len(shingles))
    first = np.argpartition(order, n - 1, axis=1)[:, :n]
    votes = np.unpackbits(shingles[first].view(np.uint8).reshape(TABLES, n, 8), axis=2, bitorder="little").sum(1)
    return np.packbits(2 * votes > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


def _sets(batches):
    for batch in slices(batches):
        sets = [shingle_set(t) for t in batch.column(3).to_pylist()]
        prints = [np.append(np.uint64(fingerprint(x.tolist())), picked_prints(x)) for x in sets]
        wide = np.arange(0, (TABLES + 1) * len(sets) + 1, TABLES + 1, dtype=np.int32)
        prints = pa.ListArray.from_arrays(pa.array(wide), pa.array(np.concatenate(prints).view(np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.array([len(x) for x in sets], np.int32)), batch.column(3), prints], ["row", "id", "digest", "n", "text", "prints"])


def candidate_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the rows of `texts` (row, n, prints) that share an entry of a table, each with the head of that group.

    The head is the row that meets most rows in all its groups. Pairs whose numbers of shingles rule the similarity out are left out.
    """
    prints = texts.select("row", "n", F.posexplode("prints").alias("table", "fp"))
    members = prints.filter("table > 0").select("row", "n", F.xxhash64("table", "fp").alias("group"))
    whole = texts.select("row", "n", F.col("prints")[0].alias("fp"))
    roots = connected(link_edges(whole.select("fp").distinct()))
    whole = whole.join(roots, whole.fp == roots.node, "left").select("row", "n", F.xxhash64(F.lit(0), F.coalesce("root", "fp")).alias("group"))
    members = staged(whole.unionByName(members), "members")
    several = staged(members.groupBy("group").count().filter("count > 1"), "several")
    members = staged(members.join(several, "group"), "members")
    rank = staged(members.groupBy("row").agg(F.sum("count").alias("rank")), "ranks")
    heads = members.join(rank, "row").groupBy("group").agg(F.max(F.struct("rank", "row", "n")).alias("head"))
    heads = staged(heads.select("group", F.col("head.row").alias("head"), F.col("head.n").alias("head_n")), "heads")
    asked = members.join(heads, "group").filter("row <> head")
    asked = asked.filter(F.least("n", "head_n") >= F.lit(threshold) * F.greatest("n", "head_n") - 1e-9)
    return staged(asked.select(F.col("row").alias("a"), F.col("head").alias("b")).distinct(), "pairs")


def ends(links: DataFrame) -> DataFrame:
    """(row, other) of links (a, b), either way round."""
    return links.select(F.col("a").alias("row"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("row"), F.col("a").alias("other")))


def _similar(threshold: float):
    def run(batches):
        for batch in slices(batches):
            sets: dict[int, np.ndarray] = {}  # the heads of a group come again and again
            keep = np.zeros(batch.num_rows, bool)
            for k, (a, b, x, y) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                for row, text in ((a, x), (b, y)):
                    if row not in sets:
                        sets[row] = shingle_set(text)
                total = len(sets[a]) + len(sets[b])
                common = total - len(np.union1d(sets[a], sets[b]))
                keep[k] = common >= threshold * (total - common) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def few(rows: DataFrame) -> DataFrame:
    """A staged table, marked for broadcast unless it has more than BROADCAST_ROWS rows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def similar(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose `texts` (row, text) have sets of shingles with a Jaccard similarity of `threshold` or more.

    Texts go to the pairs rather than their sets, which take twice the room and don't compress. Only texts that a pair
    asks for are shuffled: the ids of up to BROADCAST_ROWS of them are broadcast, more meet the texts by a shuffle.
    """
    rows = staged(ends(pairs).select("row").distinct(), "asked_rows")
    texts = staged(texts.join(few(rows), "row", "left_semi"), "wanted")
    both = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("row").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_similar(threshold), "a long, b long")


def similar_texts(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of `rows` (row, n, prints) to the heads of their groups in the tables, where `texts` (row, text) are similar.

    That links most of a group of copies at a comparison or a few a row; what it misses is left to `links_between`.
    """
    with scratch(rows.sparkSession):
        return staged(similar(candidate_pairs(rows, threshold), texts, threshold), "found", keep=True)


def _shingles(batches):
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(t) for t in batch.column(0).to_pylist()]).view(np.int64))], ["shingle"])


def common_shingles(texts: DataFrame, rows: int = 80_000, least: int = 3, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur `least` times or more among about `rows` rows of `texts`, ascending, and their counts.

    They only order shingles: any order gives `links_between` the same links, this one fewer candidates.
    """
    part = max(1, texts.count() // rows)
    seen = texts.filter(F.pmod(F.xxhash64("row"), F.lit(part)) == 0).select("text").mapInArrow(_shingles, "shingle long").groupBy("shingle").count()
    top = seen.filter(F.col("count") >= least).orderBy(F.desc("count"), "shingle").limit(most).toPandas()
    keys = top["shingle"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], top["count"].to_numpy(np.int64)[order]


def _prefixes(common: np.ndarray, counts: np.ndarray, threshold: float):
    def run(batches):
        for batch in slices(batches):
            rows, shingles, places = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                x = shingle_set(text).view(np.int64)
                rank = np.zeros(len(x), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
                    rank = np.where(common[at] == x, counts[at], 0)
                first = np.lexsort((x, rank))[: len(x) - int(np.ceil(threshold * len(x) - 1e-9)) + 1]
                rows.append(np.full(len(first), k))
                shingles.append(x[first])
                places.append((len(x) << 32) + np.arange(len(first)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(shingles)), pa.array(np.concatenate(places))], ["row", "shingle", "place"])

    return run


def shared_prefixes(texts: DataFrame, threshold: float) -> DataFrame:
    """(group, row, n, place) of the first shingles that rows of `texts` (row, text) share.

    Shingles that the same rows share are one group, where a row has its earliest place: a passage of two texts is one
    meeting of them. (Groups that the hash of their rows confuses only ask for more pairs.)
    """
    common, counts = common_shingles(texts)
    firsts = texts.select("row", "text").mapInArrow(_prefixes(common, counts, threshold), "row long, shingle long, place long")
    by = Window.partitionBy("shingle")
    # Most shingles are one row's alone: only the others go on.
    met = firsts.select("row", "place", F.min("row").over(by).alias("lo"), F.max("row").over(by).alias("hi"), F.bit_xor(F.xxhash64("row")).over(by).alias("group"))
    met = met.filter("lo < hi").groupBy("group", "row").agg(F.min("place").alias("place"))
    return staged(met.select("group", "row", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).alias("place")), "shared")


def links_between(texts: DataFrame, roots: DataFrame, threshold: float, rounds: int = 3) -> DataFrame:
    """Links (a, b) at a similarity of `threshold` or more that join all components of such links among rows of `texts` (row, text), given `roots` (row, root) that links known before join.

    Two sets as similar as that share one of their first shingles, in whatever order all shingles are taken: of n, those
    that may be missing and one more. Their first common one stands so early that enough others can follow. Rare shingles
    come first, so that a line that many texts hold is among the first of few. Rows without a root are left out.

    Where groups hold many more pairs than rows, as those of near copies do that are not linked yet, their rows are
    compared with a few heads of each group, one, two, four and so on, and links join roots before the next round. Heads
    are the rows that have least before the shingle, so fewest shingles of their own. Rounds end when few of their comparisons are links. Then all pairs of different roots are asked
    for, so what heads leave apart is found as well.
    """
    shared = shared_prefixes(texts, threshold)
    links, tried, enough_heads = None, None, False
    for turn in range(rounds + 1):
        by = Window.partitionBy("group")
        named = shared.join(roots, "row").select("*", F.min("root").over(by).alias("lo"), F.max("root").over(by).alias("hi"))
        named = staged(named.filter("lo < hi").drop("lo", "hi"), "prefixes")
        of_root = named.groupBy("group", "root").count()
        pairs = of_root.groupBy("group").agg(F.sum("count").alias("n"), F.sum(F.col("count").cast("double") * F.col("count")).alias("own"))
        size = pairs.agg(F.sum("n").alias("rows"), F.sum(F.col("n").cast("double") * F.col("n") - F.col("own")).alias("pairs")).first()
        last = turn == rounds or (size.pairs or 0) <= 8 * (size.rows or 0) or enough_heads
        other = named
        if not last:
            place = F.row_number().over(by.orderBy(F.col("place") / F.col("n"), "row"))
            other = staged(named.withColumn("head", place).filter(F.col("head") <= 1 << turn).drop("head"), "heads")
        other = other.select("group", *[F.col(c).alias(f"{c}2") for c in ("row", "n", "root", "place")])
        enough = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("n2")) - 1e-9
        may = (F.col("root") != F.col("root2")) & (F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) >= enough)
        may = may & (F.col("row") > F.col("row2")) if last else may
        asked = named.join(other, "group").filter(may).select(F.greatest("row", "row2").alias("a"), F.least("row", "row2").alias("b")).distinct()
        asked = staged(asked if tried is None else asked.join(tried, ["a", "b"], "left_anti"), "asked")
        found = staged(similar(asked, texts, threshold), "links", keep=True)
        links = found if links is None else links.unionByName(found)
        if last:
            return links
        tried = asked if tried is None else tried.unionByName(asked)
        enough_heads = found.count() * 32 < asked.count()
        joined = found.join(roots.select(F.col("row").alias("a"), F.col("root").alias("x")), "a").join(roots.select(F.col("row").alias("b"), F.col("root").alias("y")), "b")
        tops = connected(joined.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("root", "top")
        roots = staged(roots.join(tops, roots.root == tops.node, "left").select("row", F.coalesce("top", "root").alias("root")), "rooted")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies (that of the smallest id), with all its columns."""
    if width != WIDTH:
        raise ValueError(f"shingles have {WIDTH} words")
    few_rows(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    pid, ptext = (f"c{names.index(c)}" for c in (id_col, text_col))
    text = F.coalesce(F.col(ptext).cast("string"), F.lit(""))
    plain = plain.withColumn("digest", F.unhex(F.sha2(text.cast("binary"), 256)))
    id_type = docs.schema[id_col].dataType.simpleString()
    with scratch(docs.sparkSession), brief_shuffles(docs.sparkSession):
        rows = plain.select(F.monotonically_increasing_id().alias("row"), F.col(pid).alias("id"), "digest", text.alias("text"))
        sets = staged(rows.mapInArrow(_sets, f"row long, id {id_type}, digest binary, n int, text string, prints array<long>"), "sets")
        # Rows of one text are one node, named by its first row.
        texts = staged(sets.groupBy("digest").agg(F.min("row").alias("row")), "texts")
        firsts = staged(sets.select("row", "n", "prints").join(texts.select("row"), "row", "left_semi"), "firsts")
        links = similar_texts(firsts, sets.select("row", "text"), threshold)
        # What the tables leave apart is asked for exactly.
        with scratch(docs.sparkSession):
            roots = connected(links)
            roots = texts.join(roots, texts.row == roots.node, "left").select("row", F.coalesce("root", "row").alias("root"))
            more = links_between(sets.select("row", "text"), staged(roots, "rooted"), threshold)
        roots = connected(links.unionByName(more))
        named = texts.join(roots, texts.row == roots.node, "left").select("digest", F.coalesce("root", "row").alias("root"))
        marked = staged(sets.select("row", "id", "digest").join(staged(named, "named"), "digest"), "marked")
        stays = staged(marked.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row")).alias("m")).select(F.col("m.row").alias("row")), "stays")
        # What becomes of the rows of an (id, text): all go, or one stays where several have both; of others all stay.
        fate = marked.join(stays.withColumn("stay", F.lit(1)), "row", "left").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("rows"), F.count("stay").alias("stay"))
        fate = staged(fate.filter("rows > stay").select(F.col("id").alias("f_id"), F.col("digest").alias("f_digest"), "stay"), "fate", keep=True)
    same = F.col(pid).eqNullSafe(F.col("f_id")) & (F.col("digest") == F.col("f_digest"))
    out = plain.join(few(fate), same, "left_anti")
    again = fate.filter("stay > 0")
    if not again.isEmpty():
        out = out.unionByName(plain.join(again, same, "left_semi").dropDuplicates([pid, "digest"]))
    return out.drop("digest").toDF(*names)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
