"""Benchmark decontamination by size-partitioned MinHash containment search, with DataFrame functions only.

Items are partitioned by their number of distinct word shingles, a class for each power of two. An item of n shingles is
contained to at least `threshold` only if no more than floor((1 - threshold) n) of its shingles are missing, so of its
bottom-k MinHash sketch with k = floor((1 - threshold) n) + 1 at least one value occurs in the document. The largest
value of a class's sketches bounds what a document has to show for that class: its own min-wise sketch for the class
are the hashes of its shingles up to that bound (about a fifth of them for large items, all for the smallest), found
without a miss, unlike a sketch of fixed size, however long the document. Documents are probed class by class; each
candidate is then verified by the exact containment of the item's shingle texts, in the same row, so document texts are
never shuffled and a passage that many documents share makes no pairs among them.

The sketches are broadcast while the benchmark has at most `broadcast_items` items (it is counted first); beyond
that they are joined by hash.

Defined results: null text counts as empty; words are runs of letters and digits, lower-cased; an item of fewer than
`width` words is one shingle of its own length, searched at that length; an item without words never matches; items
that repeat an id are told apart by their text and reported under the id; `leaks` unites documents that repeat an id,
`drop_contaminated` judges each row by its own text, so rows with a repeated or null id never take others along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

WIDTH = 5
THRESHOLD = 0.8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _last(ws: Column, width: Column | int) -> Column:
    return F.size(ws) - F.lit(width)


def _hashes(ws: Column, width: int) -> Column:
    """A 64-bit hash of every shingle, in text order."""
    last = _last(ws, width)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)]))).otherwise(F.array().cast("array<bigint>"))


def _texts(ws: Column, width: Column) -> Column:
    last = F.size(ws) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(ws, i + 1, width), " "))).otherwise(F.array().cast("array<string>"))


def sketches(items: DataFrame, id_col: str, text_col: str, width: int, threshold: float) -> DataFrame:
    """One row per item: key, item_id, width, shingles (distinct texts), size_class, sketch (bottom-k hashes)."""
    ws = items.select(items[id_col].alias("item_id"), words(items[text_col]).alias("ws")).filter(F.size("ws") > 0).distinct()
    ws = ws.withColumn("width", F.least(F.lit(width), F.size("ws")))
    by_width = F.lit(None).cast("array<bigint>")
    for w in range(width, 0, -1):
        by_width = F.when(F.col("width") == w, _hashes(F.col("ws"), w)).otherwise(by_width)
    out = ws.select("item_id", "width", F.array_distinct(_texts(F.col("ws"), F.col("width"))).alias("shingles"), F.array_sort(F.array_distinct(by_width)).alias("hashes"))
    n = F.size("shingles")
    missing = F.floor(n * F.lit(1 - threshold) + 1e-9).cast("int")
    return out.select(
        F.xxhash64("item_id", "shingles").alias("key"),
        "item_id",
        "width",
        "shingles",
        F.floor(F.log2(n)).cast("int").alias("size_class"),
        F.slice("hashes", 1, missing + 1).alias("sketch"),
    )


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, broadcast_items: int = 20_000) -> DataFrame:
    """(id, item_id, n_shingles, n_found, containment) for every item contained to at least the threshold."""
    index = staged(sketches(items, item_id_col, item_text_col, width, threshold), "sketches")
    facts = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("shingles")).alias("longest")).first()
    small = facts.n <= broadcast_items and facts.n * (facts.longest or 0) <= 64 * broadcast_items
    bounds = index.groupBy("width", "size_class").agg(F.max(F.array_max("sketch")).alias("most")).collect()
    probe = index.select("width", "size_class", "key", F.explode("sketch").alias("hash"))
    probe = probe.select(F.col("width").alias("of_width"), _probe(F.col("hash"), F.col("size_class")).alias("probe"), "key")
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).withColumn("ws", words(F.col("text")))
    found = None
    for w in sorted({b.width for b in bounds}) or [width]:
        wanted = probe.filter(F.col("of_width") == w).drop("of_width")
        # The hashes are a column of their own, so explodes run inside generated code and copy no text.
        hashed = source.select("id", "text", "ws", _hashes(F.col("ws"), w).alias("hashes"))
        own = sorted((b.size_class, b.most) for b in bounds if b.width == w)
        by_class = [F.struct(F.lit(c).alias("size_class"), F.filter("hashes", lambda h, most=most: h <= most).alias("sketch")) for c, most in own] or [F.struct(F.lit(0).alias("size_class"), F.col("hashes").alias("sketch"))]
        sketched = hashed.select("id", "text", "ws", F.explode(F.array(*by_class)).alias("s")).select("id", "text", "ws", "s.size_class", F.col("s.sketch").alias("sketch"))
        probes = sketched.select("id", "text", "ws", "size_class", F.explode("sketch").alias("hash")).withColumn("probe", _probe(F.col("hash"), F.col("size_class")))
        if small:
            hits = probes.join(F.broadcast(wanted), "probe").select("id", "ws", "key")
        else:
            # Documents are told apart by id and text here, so that each meets its own candidates only.
            mark = F.sha2(F.coalesce("text", F.lit("")), 256)
            hits = probes.select(F.struct("id", mark.alias("mark")).alias("doc"), "probe").join(wanted, "probe").select("doc", "key").distinct()
            hits = source.select(F.struct("id", mark.alias("mark")).alias("doc"), "id", "ws").dropDuplicates(["doc"]).join(hits, "doc")
        entries = index.select("key", "item_id", "width", "shingles")
        pairs = hits.join(F.broadcast(entries) if small else entries, "key")
        shared = F.size(F.array_intersect("shingles", _texts(F.col("ws"), F.col("width"))))
        pairs = pairs.select("id", "item_id", F.size("shingles").alias("n_shingles"), shared.alias("n_found"))
        pairs = pairs.filter(F.col("n_found") >= F.ceil(F.col("n_shingles") * F.lit(threshold) - 1e-9))
        found = pairs if found is None else found.unionByName(pairs)
    best = found.groupBy("id", "item_id").agg(F.max(F.struct((F.col("n_found") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_found")).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item_id").alias(item_id_col), "m.n_shingles", "m.n_found", "m.containment")


def _probe(value: Column, size_class: Column) -> Column:
    """One long for a hash within a size class."""
    return F.xxhash64(size_class, value)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    pid, ptext = (f"c{names.index(c)}" for c in (id_col, text_col))
    own = F.struct(F.col(pid).alias("id"), F.sha2(F.coalesce(F.col(ptext).cast("string"), F.lit("")), 256).alias("mark"))
    gone = leaks(plain.select(own.alias("id"), F.col(ptext).alias("text")), items, "id", "text", **options)
    gone = gone.select(F.col("id.id").alias("gone_id"), F.col("id.mark").alias("gone_mark")).distinct()
    kept = plain.withColumn("mark", own["mark"]).join(gone, (F.col("mark") == F.col("gone_mark")) & F.col(pid).eqNullSafe(F.col("gone_id")), "left_anti")
    return kept.drop("mark").toDF(*names)


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, least(5, len(ws)) AS w FROM b WHERE len(ws) > 0),
bs AS (SELECT DISTINCT item_id, w, array_to_string(ws[i : i + w - 1], ' ') AS s FROM (SELECT item_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM bi)),
ds AS (SELECT DISTINCT doc_id, w, array_to_string(ws[i : i + w - 1], ' ') AS s
       FROM (SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM d, (SELECT DISTINCT w FROM bs) WHERE len(ws) >= w)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY 1),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN bs USING (w, s) GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(n_shingles AS INTEGER) AS n_shingles, CAST(n_found AS INTEGER) AS n_found, n_found / n_shingles AS containment
FROM f JOIN n USING (item_id) WHERE n_found >= ceil(n_shingles * 0.8 - 1e-9)
"""


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
