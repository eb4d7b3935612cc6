import pytest

from tallyglass.sources import artifacts as A


def test_json_and_delimited(spark, tmp_path):
    assert A.read_json_artifact(spark, f"{tmp_path}/none.json", "a int").count() == 0
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert A.read_json_artifact(spark, f"{tmp_path}/a.json", "a int").count() == 2
    (tmp_path / "x.tsv").write_text("Last\tDocID\tExtra\nA\t1\tz\nB\t \tz\n")
    assert [r.Last for r in A.read_delimited(spark, f"{tmp_path}/x.tsv", ["Last", "DocID"], key="DocID").collect()] == ["A"]
    with pytest.raises(ValueError):
        A.read_delimited(spark, f"{tmp_path}/x.tsv", ["Year"])


def test_partitions_verify(spark, tmp_path):
    rows = spark.range(20).selectExpr("id", "id % 3 year")
    path = f"{tmp_path}/out"
    listed = spark.createDataFrame(A.write_partitions(rows, path, ["year"]).collect())
    assert A.verify(spark, path, listed).count() == 0
    wrong = listed.selectExpr("path", "bytes", "upper(sha256) sha256")
    assert {r.fault for r in A.verify(spark, path, wrong).collect()} == {"hash"}
    assert {r.fault for r in A.verify(spark, path, listed.limit(1)).collect()} == {"unlisted"}


def test_rows(spark):
    known = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, n int")
    fresh = spark.createDataFrame([("b", 3), ("c", 4)], "document_id string, n int")
    assert sorted(tuple(r) for r in A.upsert(known, fresh, "document_id").collect()) == [("a", 1), ("b", 3), ("c", 4)]
    zipped = A.zip_columns(spark.createDataFrame([("k", [1, 2], ["x"])], "cik string, n array<int>, f array<string>"), ["cik"], ["n", "f"])
    assert [tuple(r) for r in zipped.collect()] == [("k", 1, "x"), ("k", 2, None)]
    obs = A.observations(spark.createDataFrame([("2024-01-02", "."), ("2024-01-03", "1.5")], "date string, value string"))
    assert [r.value for r in obs.collect()] == [None, 1.5]
    prices = spark.createDataFrame([("$1,234.50",), ("n/a",)], "p string").select(A.price("p").alias("p"))
    assert [r.p for r in prices.collect()] == [1234.5, None]
    words = spark.createDataFrame([(1, 1, 1, 1, 2, 5, "b", 90.0), (1, 1, 1, 1, 1, 5, "a", 80.0), (1, 1, 1, 1, 0, 4, "", -1.0)], "page int, block int, paragraph int, line int, word int, level int, text string, confidence double")
    assert [(r.text, r.confidence) for r in A.ocr_lines(words).collect()] == [("a b", 85.0)]
    xml = spark.createDataFrame([("<l><member><name>A</name></member><member><name>B</name></member></l>",)], "x string")
    assert [r.name for r in A.parse_members(xml, "x", "member array<struct<name: string>>").collect()] == ["A", "B"]
    files = spark.createDataFrame([("/a/x.PDF", b"1"), ("/a/y.pdf", b"1"), ("/a/z.pdf", b"2")], "path string, content binary")
    held = spark.createDataFrame([("d4735e3a265e16eee03f59718b9b5d03019c07d8b6c51f90da3a666eec13ab35",)], "sha256 string")
    assert [r.path for r in A.missing_from_archive(files, held).collect()] == ["/a/x.PDF"]
