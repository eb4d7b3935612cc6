import hashlib

import duckdb
from pyspark.sql import Row

from tallyglass.llm import exact_dedup as X

SF = "/root/testdata/sf0.01"


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({X.ORACLE}) order by 1").fetchall()
    got = sorted(tuple(r) for r in X.op1_exact_dedup(spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want


def test_edges(spark):
    rows = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (None, "x"), (None, "x"), (7, "r"), (7, "r"), (8, "y" * 100_000)]
    docs = spark.createDataFrame([Row(doc_id=a, text=b, sha="s", id=9, __repeated=True) for a, b in rows], "doc_id long, text string, sha string, id int, __repeated boolean")
    for bits in (1 << 28, 32768):
        out = [r.asDict() for r in X.mark_duplicates(docs, max_filter_bits=bits).collect()]
        assert len(out) == len(rows)
        assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in out if r["doc_id"] in (1, 2, 3, 4, 5, 6)) == [(1, 2, False), (2, 2, True), (3, 4, False), (4, 4, True), (5, 5, True), (6, 6, True)]
        assert sum(r["kept"] for r in out if r["doc_id"] == 7) == 1 and sum(r["kept"] for r in out if r["doc_id"] is None) == 1
        assert {r["text_sha256"] for r in out if r["doc_id"] == 1} == {hashlib.sha256(b"ab").hexdigest()}
        left = X.drop_duplicates(docs, max_filter_bits=bits)
        assert left.columns == docs.columns
        assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "4", "5", "6", "7", "8", "None"]
    assert X.mark_duplicates(docs.limit(0)).count() == 0 and X.drop_duplicates(docs.limit(0)).count() == 0


def test_segments(spark):
    docs = spark.range(6000).selectExpr("id doc_id", "concat('t', id % 5000) text")
    out = X.mark_duplicates(docs, max_filter_bits=32768).groupBy("kept").count().collect()
    assert {r["kept"]: r["count"] for r in out} == {True: 5000, False: 1000}
