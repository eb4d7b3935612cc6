"""Releases that fail half-way or race, pruned reads, refreshed documents, digests, and files checked where they lie."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyglass.sources import releases as R

ROWS = "doc string, year int, v int"


def rows(frame):
    return sorted((r.doc, r.year, r.v) for r in frame.collect())


def test_a_release_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = f"file://{tmp_path}/d"
    assert R.current(spark, root) == (0, {})
    first = spark.createDataFrame([("a", 2001, 1), ("b", 2002, 2)], ROWS)
    assert R.publish(first, root, "year") == 1
    second = spark.createDataFrame([("c", 2001, 3)], ROWS)
    # A writer that dies after its data, before its release.
    second.withColumn("version", F.lit("lost")).write.mode("append").partitionBy("year", "version").parquet(f"{root}/data")
    assert rows(R.read(spark, root, "year")) == [("a", 2001, 1), ("b", 2002, 2)]
    with pytest.raises(Exception, match="boom"):
        R.publish(second.withColumn("v", F.when(F.col("v") == 3, F.raise_error(F.lit("boom"))).cast("int")), root, "year")
    assert rows(R.read(spark, root, "year")) == [("a", 2001, 1), ("b", 2002, 2)]
    assert R.publish(second, root, "year", replace=False) == 2
    assert rows(R.read(spark, root, "year")) == [("b", 2002, 2), ("c", 2001, 3)]
    with pytest.raises(FileExistsError):
        R.write_file(spark, f"{root}/releases/2.json", "{}")
    with pytest.raises(ValueError, match="null"):
        R.publish(spark.createDataFrame([("a", None, 1)], ROWS), root, "year")
    assert R.publish(first, root, "year") == 3 and rows(R.read(spark, root, "year")) == rows(first)
    assert R.publish(first.filter("false"), root, "year", replace=False) == 4 and rows(R.read(spark, root, "year")) == rows(first)
    assert R.publish(first.filter("false"), root, "year") == 5 and R.read(spark, root, "year").collect() == []
    with pytest.raises(FileNotFoundError):
        R.read(spark, f"{root}/none", "year")


def test_reads_open_only_the_partitions_asked_for(spark, tmp_path):
    root = f"file://{tmp_path}/d"
    R.publish(spark.createDataFrame([(f"d{y}", y, y) for y in range(2000, 2010)], ROWS), root, "year")
    some = R.read(spark, root, "year", [2003])
    assert rows(some) == [("d2003", 2003, 2003)] and len(some.inputFiles()) == 10
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    some = R.read(spark, root, "year", [2003])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2003" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert rows(R.read(spark, root, "year", [1990])) == []


def test_refreshed_documents_lose_their_old_rows_and_others_stay(spark, tmp_path):
    root = f"file://{tmp_path}/d"
    R.refresh(root, spark.createDataFrame([("a", 2001, 1), ("a", 2002, 2), ("b", 2002, 3), ("c", 2003, 4)], ROWS), "year", "doc")
    before = R.current(spark, root)[1]
    R.refresh(root, spark.createDataFrame([("a", 2004, 9)], ROWS), "year", "doc")
    after = R.current(spark, root)[1]
    assert rows(R.read(spark, root, "year")) == [("a", 2004, 9), ("b", 2002, 3), ("c", 2003, 4)]
    assert after["2003"] == before["2003"] and after["2002"] != before["2002"] and "2001" not in after


def test_digest_ignores_order_and_finds_changes(spark):
    frame = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("b", 2, 3)], ROWS)
    digest = lambda f: f.agg(R.multiset_digest(f).alias("d")).first().d
    one = digest(frame)
    assert one == digest(frame.repartition(3)) == digest(frame.select("v", "doc", "year"))
    assert len({one, digest(frame.distinct()), digest(frame.unionByName(frame.limit(1))), digest(frame.na.fill(0)), digest(frame.filter("false"))}) == 5


def test_files_against_their_manifest(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.html").write_bytes(b"one")
    (tmp_path / "two.html").write_bytes(b"two!")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = [(1, "https://ok.example/1", "p/one.html", sha(b"one"), 3), (2, "https://ok.example/2", "two.html", sha(b"two"), 3), (3, "https://ok.example/3", "p/three.html", sha(b""), 0), (4, "https://no.example/4", "p/../../one.html", sha(b"one"), 3), (5, "https://ok.example/1", None, None, None)]
    manifest = spark.createDataFrame(listed, "entry int, source_url string, path string, response_sha256 string, byte_count long")
    got = {r.entry: r.faults for r in R.verified(R.binary_entries(spark, f"file://{tmp_path}", manifest), ["ok.example"]).collect()}
    assert got == {1: ["duplicate_address"], 2: ["hash_mismatch", "size_mismatch"], 3: ["incomplete_entry"], 4: ["address_not_allowed", "incomplete_entry", "path_outside"], 5: ["duplicate_address", "incomplete_entry"]}
    assert R.gate({"schema_version": R.SCHEMA_VERSION, "source_id": "s", "portal_terms_acknowledged": True, "retrieved_at": "x"}, "s") == []
    assert R.gate({"portal_terms_acknowledged": 1}, "s") == ["schema_version", "source_id", "portal_terms_not_acknowledged", "retrieved_at"]
