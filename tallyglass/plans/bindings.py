"""Domain views over the star-schema tables, for Spark and as SQL common table expressions.

Amounts are whole cents and confidences whole per cents, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def people(spark, sf):
    branch = F.when(F.col("c_custkey") % 3 == 0, "Legislative").when(F.col("c_custkey") % 3 == 1, "Executive").otherwise("Judicial")
    geo = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "customer").join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("person_id"), F.col("c_name").alias("full_name"), branch.alias("branch"), F.col("n_name").alias("state"), F.col("r_name").alias("chamber"), F.col("c_mktsegment").alias("party")
    )


def filings(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").alias("person_id"), F.col("o_orderdate").cast("date").alias("filed_date"),
        F.col("o_orderpriority").alias("filing_type"), F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )


def trades(spark, sf, parts: bool = False):
    """Line items with their orders; `asset_class` needs the parts table, which is joined only where asked for."""
    action = F.when(F.col("l_returnflag") == "R", "SELL").when(F.col("l_returnflag") == "A", "BUY").otherwise("EXCHANGE")
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if parts:
        rows = rows.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    else:
        rows = rows.withColumn("p_type", F.lit(None).cast("string"))
    return rows.select(
        F.col("l_orderkey").alias("filing_id"), F.col("l_linenumber").cast("long").alias("line"), F.col("o_custkey").alias("person_id"),
        F.col("l_shipdate").cast("date").alias("trade_date"), F.col("o_orderdate").cast("date").alias("reported_date"), action.alias("action"),
        F.concat(F.lit("P"), F.col("l_partkey") % 20).alias("ticker"), F.col("p_type").alias("asset_class"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("value_cents"),
        F.datediff(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")).cast("long").alias("lag_days"),
        (100 - 6 * F.round(F.col("l_discount") * 100)).cast("long").alias("confidence_pct"),
    )


def series(spark, sf):
    """A daily price per filing type: the largest filing of the day."""
    return filings(spark, sf).groupBy(F.col("filing_type").alias("symbol"), F.col("filed_date").alias("date")).agg(F.max("cents").alias("cents"))


def civic_events(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.date_sub(F.col("ts").cast("date"), 9000).alias("date"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), F.get_json_object("props", "$.k").cast("long").alias("k")
    )


SQL = {
    "people": """people AS (SELECT c_custkey AS person_id, c_name AS full_name, CASE c_custkey % 3 WHEN 0 THEN 'Legislative' WHEN 1 THEN 'Executive' ELSE 'Judicial' END AS branch,
 n_name AS state, r_name AS chamber, c_mktsegment AS party FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "filings": """filings AS (SELECT o_orderkey AS filing_id, o_custkey AS person_id, CAST(o_orderdate AS DATE) AS filed_date, o_orderpriority AS filing_type, o_orderstatus AS status,
 CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)""",
    "trades": """trades AS (SELECT l_orderkey AS filing_id, CAST(l_linenumber AS BIGINT) AS line, o_custkey AS person_id, CAST(l_shipdate AS DATE) AS trade_date, CAST(o_orderdate AS DATE) AS reported_date,
 CASE l_returnflag WHEN 'R' THEN 'SELL' WHEN 'A' THEN 'BUY' ELSE 'EXCHANGE' END AS action, 'P' || (l_partkey % 20) AS ticker, p_type AS asset_class, CAST(round(l_extendedprice * 100) AS BIGINT) AS value_cents,
 CAST(date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) AS BIGINT) AS lag_days, CAST(100 - 6 * round(l_discount * 100) AS BIGINT) AS confidence_pct
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    "series": """series AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1, 2)""",
    "civic_events": """civic_events AS (SELECT event_id, CAST(CAST(ts AS DATE) - 9000 AS DATE) AS date, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
}


def sql(body: str, *views: str) -> str:
    """A query over the named domain views."""
    return "WITH " + ",\n".join(SQL[v] for v in views) + ("\n" + body if not body.lstrip().startswith(",") else "\n" + body.lstrip())
