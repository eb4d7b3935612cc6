"""Files in and out: artifacts with a fallback, verified partitions, feeds, tables in XML and OCR words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(p))


def read_json_artifact(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    """Rows of a JSON artifact under an explicit schema; no rows where the path is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType.fromDDL(schema))
    return spark.read.schema(schema).json(path, multiLine=multiline)


def read_delimited(spark: SparkSession, path: str, required: list[str], sep: str = "\t", encoding: str = "UTF-8", key: str | None = None) -> DataFrame:
    """Delimited text with a header; unknown columns are kept, missing required ones are an error, rows without key go."""
    rows = spark.read.csv(path, sep=sep, header=True, encoding=encoding, inferSchema=False)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows.filter(F.nullif(F.trim(key), F.lit("")).isNotNull()) if key else rows


def write_partitions(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Write Parquet by key and return its manifest (path, bytes, sha256), computed where the files are."""
    rows.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return manifest(rows.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files that are missing, unlisted, outside the folder, or differ in size or hash; no rows if all is well."""
    have = manifest(spark, path)
    both = expected.select("path", F.col("bytes").alias("want_bytes"), F.col("sha256").alias("want_sha")).join(have, "path", "full_outer")
    fault = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("want_sha").isNull(), "unlisted")
        .when(F.col("path").contains("/../"), "outside")
        .when(F.col("bytes") != F.col("want_bytes"), "size")
        .when(F.col("sha256") != F.col("want_sha"), "hash")
    )
    return both.select("path", fault.alias("fault")).filter("fault is not null")


def upsert(known: DataFrame, refreshed: DataFrame, key: str) -> DataFrame:
    """Rows of refreshed documents replace all earlier rows of the same key; other rows stay."""
    return known.join(refreshed.select(key).distinct(), key, "left_anti").unionByName(refreshed, allowMissingColumns=True)


def missing_from_archive(files: DataFrame, archived: DataFrame) -> DataFrame:
    """Content-addressed plan: (path, sha256, target) of contents that the archive does not hold yet, each once."""
    hashed = files.select("path", F.sha2("content", 256).alias("sha256")).groupBy("sha256").agg(F.min("path").alias("path"))
    kind = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    fresh = hashed.join(archived.select("sha256"), "sha256", "left_anti")
    return fresh.select("path", "sha256", F.concat(F.substring("sha256", 1, 2), F.lit("/"), "sha256", kind).alias("target"))


def zip_columns(rows: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """Rows from parallel arrays, by position; shorter arrays give nulls."""
    return rows.select(*keys, F.explode(F.arrays_zip(*arrays)).alias("r")).select(*keys, *[F.col("r")[a].alias(a) for a in arrays])


def parse_members(rows: DataFrame, xml: str, tag_schema: str) -> DataFrame:
    """Rows of an XML list held in column `xml`, under the schema of the document element."""
    return rows.select(F.explode(F.from_xml(xml, tag_schema)["member"]).alias("m")).select("m.*")


def price(text: str):
    """A price such as $1,234.50 as a double; anything else is null."""
    return F.expr(f"try_cast(regexp_replace({text}, '[$,\\\\s]', '') as double)")


def observations(rows: DataFrame) -> DataFrame:
    """Macro observations (date, value text): "." is null."""
    return rows.select(F.expr("try_to_date(date, 'yyyy-MM-dd')").alias("date"), F.expr("try_cast(nullif(value, '.') as double)").alias("value"))


def ocr_lines(words: DataFrame) -> DataFrame:
    """Text lines from level-5 OCR words: grouped by block, paragraph and line, in word order."""
    keys = ["page", "block", "paragraph", "line"]
    real = words.filter((F.col("level") == 5) & (F.trim("text") != ""))
    ordered = F.array_sort(F.collect_list(F.struct("word", "text")))
    return real.groupBy(*keys).agg(ordered.alias("ws"), F.round(F.avg("confidence"), 2).alias("confidence")).select(*keys, F.array_join(F.transform("ws", lambda w: w.text), " ").alias("text"), "confidence")
