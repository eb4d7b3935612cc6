"""Verified imports, partition manifests, and releases that readers see whole or not at all.

An import manifest is judged entry by entry, in the tasks: hash and size of what it carries, whether its address is allowed,
its path inside the folder, its address named once. A release of a partitioned dataset writes its partitions beside those
of earlier releases, under a version of their own, and then makes one small file that says which version of each partition
counts; that file is written aside and renamed, so a release appears at once, and a second writer of the same number fails.
Readers filter by partition and version, so files of other partitions and versions are never opened.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut

SCHEMA_VERSION = "import-manifest-v1"


# -- imports


def gate(header: dict, source_id: str) -> list[str]:
    """What is wrong with a manifest as a whole."""
    faults = []
    if header.get("schema_version") != SCHEMA_VERSION:
        faults.append("schema_version")
    if header.get("source_id") != source_id:
        faults.append("source_id")
    if header.get("portal_terms_acknowledged") is not True:
        faults.append("portal_terms_not_acknowledged")
    if not header.get("retrieved_at"):
        faults.append("retrieved_at")
    return faults


def inside(path: Column) -> Column:
    """A relative path that doesn't leave its folder."""
    return path.isNotNull() & (path != "") & ~path.rlike("^/|^[A-Za-z][A-Za-z0-9+.-]*:|(^|/)\\.\\.(/|$)|\\\\|\\x00")


def allowed(url: Column, hosts: list[str]) -> Column:
    """An https address of one of the hosts without credentials or port."""
    host = F.regexp_extract(url, "^https://([^/?#]+)", 1)
    return F.coalesce(F.lower(host).isin(hosts), F.lit(False))


def verified(entries: DataFrame, hosts: list[str]) -> DataFrame:
    """entries (entry, source_url, path, body binary, response_sha256, byte_count) plus `faults`, sorted; none: the entry is sound.

    A repeated address is a fault of all entries that name it; it is found by counting addresses, so bodies don't move.
    """
    counts = entries.filter("source_url is not null").groupBy("source_url").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    rows = entries.join(counts, "source_url", "left")
    lacking = F.col("source_url").isNull() | F.col("body").isNull() | F.col("response_sha256").isNull()
    faults = F.array(
        F.when(lacking, "incomplete_entry"), F.when(F.col("source_url").isNotNull() & ~allowed(F.col("source_url"), hosts), "address_not_allowed"), F.when(F.col("path").isNotNull() & ~inside(F.col("path")), "path_outside"),
        F.when(F.sha2("body", 256) != F.lower("response_sha256"), "hash_mismatch"), F.when(F.length("body") != F.col("byte_count"), "size_mismatch"), F.when(F.col("_n") > 1, "duplicate_address"),
    )
    return rows.withColumn("faults", F.array_sort(F.array_compact(faults))).drop("_n")


def reconciled(rows: DataFrame, header: dict) -> DataFrame:
    """One row: entries, sound ones, bytes, faults by kind, and whether the manifest's own totals agree."""
    kinds = ["incomplete_entry", "address_not_allowed", "path_outside", "hash_mismatch", "size_mismatch", "duplicate_address"]
    out = rows.agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.size("faults") == 0).alias("sound"), F.coalesce(F.sum(F.length("body").cast("long")), F.lit(0)).alias("bytes"),
        *[F.count_if(F.array_contains("faults", k)).alias(k) for k in kinds],
    )
    totals = (F.col("entries") == header.get("entry_count", -1)) & (F.col("bytes") == header.get("total_bytes", -1))
    return out.withColumn("totals_agree", totals)


def binary_entries(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Entries of a manifest (entry, source_url, path, response_sha256, byte_count) with the bodies of their files under root."""
    base = _path(spark, root).getFileSystem(_conf(spark)).makeQualified(_path(spark, root)).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select(F.expr(f"substring(path, {len(base) + 1})").alias("path"), F.col("content").alias("body"))
    return manifest.join(files, "path", "left")


# -- partitions


def partition_manifest(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(keys, n_rows, n_ids, digest) of each partition; the digest is the same in whatever order its rows are."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(id_col).alias("n_ids"), multiset_digest(rows).alias("digest"))


def multiset_digest(rows: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """An aggregate over whole rows that no order, partitioning or file layout changes, and any other, lost or repeated row does.

    The 256 bits of each row's hash are added up as eight numbers, so partial sums merge; the row's text is its columns in
    order of name as JSON, nulls included.
    """
    columns = sorted(c for c in rows.columns if c not in but)
    h = F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")) for k in range(8)]
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[F.coalesce(p, F.lit(0)).cast("string") for p in parts]), 256)


def verify_partitions(have: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fault) of partitions that are missing, unlisted, or differ in rows, ids or content; no rows if all is well."""
    want = manifest.select(*keys, *[F.col(c).alias(f"want_{c}") for c in ("n_rows", "n_ids", "digest")])
    both = have.join(want, keys, "full_outer")
    fault = (
        F.when(F.col("n_rows").isNull(), "missing").when(F.col("want_n_rows").isNull(), "unlisted").when(F.col("n_rows") != F.col("want_n_rows"), "row_count")
        .when(F.col("n_ids") != F.col("want_n_ids"), "ids").when(F.col("digest") != F.col("want_digest"), "content")
    )
    return both.select(*keys, fault.alias("fault")).filter("fault is not null")


# -- releases


def _conf(spark: SparkSession):
    return spark._jsparkSession.sessionState().newHadoopConf()


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def write_file(spark: SparkSession, name: str, text: str) -> None:
    """One small file, written aside and renamed: it is there whole or not at all, and never replaces another."""
    target, aside = _path(spark, name), _path(spark, f"{name}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(_conf(spark))
    fs.mkdirs(target.getParent())
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise FileExistsError(f"{name} is there already")


def read_file(spark: SparkSession, name: str) -> str:
    path = _path(spark, name)
    stream = path.getFileSystem(_conf(spark)).open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """The newest release's number (0: none) and the version of each partition that counts in it."""
    folder = _path(spark, f"{root}/releases")
    fs = folder.getFileSystem(_conf(spark))
    if not fs.exists(folder):
        return 0, {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()]
    if not numbers:
        return 0, {}
    return max(numbers), json.loads(read_file(spark, f"{root}/releases/{max(numbers)}.json"))["partitions"]


def _write(rows: DataFrame, root: str, key: str) -> tuple[str, list[str]]:
    """Write rows as a new version of their partitions; the version and the partitions, as the folders have them."""
    version = uuid.uuid4().hex
    if rows.isEmpty():
        return version, []
    rows.withColumn("version", F.lit(version)).repartition(key).write.mode("append").partitionBy(key, "version").parquet(f"{root}/data")
    there = rows.sparkSession.read.option("basePath", f"{root}/data").parquet(f"{root}/data").filter(F.col("version") == version)
    values = [r[0] for r in there.select(F.col(key).cast("string")).distinct().collect()]
    if None in values:
        raise ValueError(f"{key} is null in some rows")
    return version, values


def publish(rows: DataFrame, root: str, key: str, replace: bool = True) -> int:
    """Release `rows`, a partition for each value of `key`; with replace False partitions that rows doesn't touch stay as they are.

    The release's number. Until its file is there readers see the release before; a job that fails leaves only files that no
    release names. Rows with a null key are refused, as no reader could ask for them.
    """
    spark = rows.sparkSession
    number, partitions = current(spark, root)
    version, values = _write(rows, root, key)
    partitions = ({} if replace else partitions) | dict.fromkeys(values, version)
    write_file(spark, f"{root}/releases/{number + 1}.json", json.dumps({"partitions": partitions, "key": key}, sort_keys=True))
    return number + 1


def read(spark: SparkSession, root: str, key: str, values: list | None = None) -> DataFrame:
    """The newest release, or its partitions with the given values; other files aren't opened. Without any release an error."""
    number, partitions = current(spark, root)
    if not number:
        raise FileNotFoundError(f"{root} has no release")
    wanted = {k: v for k, v in partitions.items() if values is None or k in {str(x) for x in values}}
    rows = spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data")
    by_version: dict[str, list[str]] = {}
    for k, v in wanted.items():
        by_version.setdefault(v, []).append(k)
    keep = F.lit(False)
    for v, ks in sorted(by_version.items()):
        keep = keep | ((F.col("version") == v) & F.col(key).cast("string").isin(sorted(ks)))
    return rows.filter(keep).drop("version")


def refresh(root: str, refreshed: DataFrame, key: str, document: str) -> int:
    """Release the dataset with all rows of refreshed documents replaced; only partitions that hold or get such rows are rewritten."""
    spark = refreshed.sparkSession
    refreshed = cut(refreshed)
    if not current(spark, root)[1]:
        return publish(refreshed, root, key)
    have = read(spark, root, key)
    documents = refreshed.select(document).distinct()
    touched = refreshed.select(F.col(key).cast("string").alias("k")).union(have.join(documents, document, "left_semi").select(F.col(key).cast("string"))).distinct()
    names = [r.k for r in touched.collect()]
    stay = read(spark, root, key, names).join(documents, document, "left_anti").select(*refreshed.columns)
    number, partitions = current(spark, root)
    version, left = _write(stay.unionByName(refreshed), root, key)
    partitions = {k: v for k, v in partitions.items() if k not in names} | dict.fromkeys(left, version)
    write_file(spark, f"{root}/releases/{number + 1}.json", json.dumps({"partitions": partitions, "key": key}, sort_keys=True))
    return number + 1
