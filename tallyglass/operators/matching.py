"""Many patterns against many texts, and keeping the first of records that share one of several keys.

`find` looks all patterns up in one pass over each text, by an automaton over the patterns that every task builds; a pattern
counts wherever its letters stand in the text, in a word too, in lower case on both sides. Patterns are cut into shards of at
most SHARD_BYTES, so an automaton has a bounded size; texts are read once per shard. The patterns are a dictionary and go
out from the driver: beyond DICTIONARY_BYTES together they are refused. `first_match`
gives the pattern of the lowest position instead of all, `longest` those that remain if at each place the longest pattern
wins and what it covers is not looked at again.

The rows that a pass finds meet their patterns by a broadcast, so that only what is aggregated from them is dealt anew.

Null and empty texts and patterns match nothing; patterns that are equal in lower case each count.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

SHARD_BYTES, DICTIONARY_BYTES = 8 << 20, 256 << 20


def shards(patterns: DataFrame, most: int = SHARD_BYTES) -> list[list[str]]:
    """The distinct lower-case patterns, in lists whose bytes stay below `most`."""
    words = patterns.select(F.lower("pattern").alias("p")).filter("p <> ''").distinct().orderBy("p")
    total = words.agg(F.sum(F.octet_length("p").cast("long")).alias("n")).first().n or 0
    if total > DICTIONARY_BYTES:
        raise ValueError(f"the patterns hold {total} bytes; {DICTIONARY_BYTES} are the most that go out to the tasks")
    out: list[list[str]] = [[]]
    size = 0
    for r in words.toLocalIterator():
        n = len(r.p.encode())
        if out[-1] and size + n > most:
            out.append([])
            size = 0
        out[-1].append(r.p)
        size += n
    return [x for x in out if x]


def _automaton(words: list[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for w in words:
        made.add_word(w, w)
    made.make_automaton()
    return made


def _scan(texts: DataFrame, words: list[str], longest: bool) -> DataFrame:
    """(id, p, n, at) of the words of one shard in each text: how often, and where first, counted from 0."""

    def run(batches):
        made = _automaton(words)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                row, word, count, place = [], [], [], []
                for k, text in enumerate(some.column(1).to_pylist()):
                    seen: dict[str, list[int]] = {}
                    for end, w in (made.iter_long(text) if longest else made.iter(text)) if text else ():
                        if w in seen:
                            seen[w][0] += 1
                        else:
                            seen[w] = [1, end - len(w) + 1]
                    for w, (n, at) in seen.items():
                        row.append(k)
                        word.append(w)
                        count.append(n)
                        place.append(at)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row, pa.int64())), pa.array(word, pa.string()), pa.array(count, pa.int64()), pa.array(place, pa.int64())], ["id", "p", "n", "at"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, p string, n long, at long")


def find(docs: DataFrame, patterns: DataFrame, id_col: str, text_col: str, longest: bool = False, most: int = SHARD_BYTES) -> DataFrame:
    """(id, pattern_id, position, n, at) for each pattern in each text.

    patterns has pattern_id, position and pattern. With `longest` all patterns go into one automaton.
    """
    texts = docs.select(docs[id_col].alias("id"), F.lower(docs[text_col].cast("string")).alias("text"))
    parts = shards(patterns, most)
    if longest:
        parts = [[w for part in parts for w in part]]
    empty = docs.sparkSession.createDataFrame([], f"id {texts.schema['id'].dataType.simpleString()}, p string, n long, at long")
    hits = reduce(DataFrame.unionByName, [_scan(texts, part, longest) for part in parts if part], empty)
    named = patterns.select("pattern_id", "position", F.lower("pattern").alias("p")).filter("p <> ''")
    return hits.join(F.broadcast(named), "p").select("id", "pattern_id", "position", "n", "at")


def ranked(patterns: DataFrame, *order: str) -> DataFrame:
    """patterns plus `rank`, from 1 in that order: a number that a hash aggregate can hold. The dictionary is bounded, so one task ranks it."""
    return patterns.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def first_match(docs: DataFrame, patterns: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pattern_id): of the patterns in a text that of the lowest position (ties: smaller pattern_id)."""
    numbered = ranked(patterns, "position", "pattern_id")
    hits = find(docs, numbered.select(F.col("rank").alias("pattern_id"), "position", "pattern"), id_col, text_col)
    best = hits.groupBy("id").agg(F.min("pattern_id").alias("rank"))
    return best.join(F.broadcast(numbered.select("rank", "pattern_id")), "rank").select("id", "pattern_id")


def keep_first(rows: DataFrame, position: str, keys: list[str]) -> DataFrame:
    """rows, in order of `position`, without those that share a key with an earlier row that is kept.

    A row that is dropped blocks nobody. In each round the rows that are first among those left in all of their groups are
    kept and the rows that share a key with them go; the rounds are at most as many as rows block each other in a chain.
    A null key is shared with nobody; `position` is unique.
    """
    left = cut(rows.select(F.col(position).alias("_at"), *[F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)]))
    names = [f"_k{i}" for i in range(len(keys))]
    kept = []
    while left.limit(1).count():
        first = left
        for k in names:
            lead = left.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("_at").alias(f"_min{k}"))
            first = first.join(lead, k, "left")
        now = cut(first.filter(reduce(lambda a, b: a & b, [F.col(k).isNull() | (F.col(f"_min{k}") == F.col("_at")) for k in names])).select("_at", *names))
        kept.append(now)
        rest = left.join(now.select("_at"), "_at", "left_anti")
        for k in names:
            rest = rest.join(now.select(k).filter(F.col(k).isNotNull()).distinct(), k, "left_anti")
        left = cut(rest)
    if not kept:
        return rows.limit(0)
    chosen = reduce(DataFrame.unionByName, kept).select(F.col("_at").alias(position))
    return rows.join(chosen, position, "left_semi")


def quota(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of each group, ranked from 1 as selection_rank."""
    return rows.withColumn("selection_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("selection_rank") <= most)
