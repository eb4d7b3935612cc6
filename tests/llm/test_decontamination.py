import re

import duckdb

from tallyglass.llm import decontamination as D

SF = "/root/testdata/sf0.01"


def test_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(f"select doc_id, item_id, n_shingles, n_found, containment from ({D.ORACLE}) order by 1, 2").fetchall()
    got = sorted(tuple(r) for r in D.op8_benchmark_decontamination(spark, SF).select("doc_id", "item_id", "n_shingles", "n_found", "containment").collect())
    assert got == want and want


def test_edges(spark):
    item = " ".join(f"w{i}" for i in range(24))  # 20 shingles; a changed first word leaves 19, a changed middle word 15
    short = "only three words"
    rows = [(1, "x " * 50 + item.upper() + "! tail"), (2, item.replace("w0 ", "z ")), (3, item.replace("w12", "z")), (4, None), (5, ""), (6, "say ONLY, three words."), (6, "other"), (None, item), (7, item + " q" * 60_000)]
    docs = spark.createDataFrame([(a, b, 1, "k") for a, b in rows], "doc_id long, text string, key int, item_id string")
    items = spark.createDataFrame([(1, item), (2, short), (3, None), (4, "!!"), (5, ""), (2, short)], "item_id int, text string")
    for most in (20_000, 0):
        got = {(r.doc_id, r.item_id): r.containment for r in D.leaks(docs, items, broadcast_items=most).collect()}
        assert got == {(1, 1): 1.0, (2, 1): 0.95, (6, 2): 1.0, (None, 1): 1.0, (7, 1): 1.0}
    left = D.drop_contaminated(docs, items)
    want = [rows[k][0] for k in (2, 3, 4, 6)]
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == want
    assert D.leaks(docs.limit(0), items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = D.op8_benchmark_decontamination(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_null_and_repeated_ids_take_no_other_rows_along(spark):
    item = " ".join(f"w{i}" for i in range(24))
    rows = [(None, item), (None, "clean"), (None, None), (4, item), (4, "clean"), (4, "clean"), (5, f"so {item}"), (5, f"so {item}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id int, text string")
    for most in (20_000, 0):
        left = D.drop_contaminated(docs, items, broadcast_items=most)
        assert sorted(map(str, map(tuple, left.collect()))) == ["(4, 'clean')", "(4, 'clean')", "(None, 'clean')", "(None, None)"]


def test_size_classes_bound_the_sketches(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    index = D.sketches(items, "item_id", "text", 5, 0.8).collect()
    assert len({r.size_class for r in index}) > 1
    for r in index:
        assert 2**r.size_class <= len(r.shingles) < 2 ** (r.size_class + 1)
        assert len(r.sketch) == int(0.2 * len(r.shingles) + 1e-9) + 1
