"""Files as tables and tables as files: manuscripts, ledgers, bundles, key-value settings, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def binary(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length, content) of all files below a folder whose names match."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length", "content")


def manuscripts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, path, media_type, sha256, byte_length, text, problem): Markdown and PDF files; of files of one name the PDF counts, else the first.

    The text is null where the bytes are no UTF-8 and for PDF files, whose conversion is a source of its own."""
    files = binary(spark, folder, "*.{md,markdown,pdf}")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]+$", "")
    media = F.when(F.lower("path").endswith(".pdf"), "application/pdf").otherwise("text/markdown")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    rows = files.select(
        stem.alias("doc_id"), "path", media.alias("media_type"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_length"),
        F.when((media == "text/markdown") & valid, F.decode("content", "UTF-8")).alias("text"), F.when((media == "text/markdown") & ~valid, "not valid UTF-8").alias("problem"),
    )
    first = F.struct(F.col("media_type"), F.col("path"))  # application/pdf sorts before text/markdown
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("path", "media_type", "sha256", "byte_length", "text", "problem"), first).alias("r")).select("doc_id", "r.*")


def pdf_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, pages) of PDF files whose page objects are not compressed; null where none is seen."""
    count = F.regexp_count(F.decode("content", "ISO-8859-1"), F.lit("/Type\\s*/Page(?![a-zA-Z])"))
    return binary(spark, folder, "*.pdf").select("path", F.when(count > 0, count).alias("pages"))


def ledgers(spark: SparkSession, folder: str, name: str = "experiments.jsonl") -> DataFrame:
    """(doc_id, path, line, raw): lines of all ledgers below a folder; doc_id is the first folder under it."""
    files = binary(spark, folder, name)
    relative = F.expr("substring(path, locate('" + folder.rstrip("/").replace("'", "\\'") + "/', path) + " + str(len(folder.rstrip("/")) + 1) + ")")
    rows = files.select(relative.alias("path"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n", -1)).alias("at", "raw"))
    return rows.select(F.element_at(F.split("path", "/"), 1).alias("doc_id"), "path", (F.col("at") + 1).alias("line"), "raw")


def bundle_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256) of every file of an evidence bundle."""
    return binary(spark, folder, "*").select("path", F.sha2("content", 256).alias("sha256"))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the lines KEY=VALUE of a file; comments and blank lines are skipped."""
    rows = spark.read.text(path).select(F.regexp_extract("value", "^\\s*(?:export\\s+)?([A-Za-z_]\\w*)\\s*=\\s*(.*?)\\s*$", 1).alias("key"), F.regexp_extract("value", "^\\s*(?:export\\s+)?[A-Za-z_]\\w*\\s*=\\s*(.*?)\\s*$", 1).alias("value"))
    return rows.where("key != ''").select("key", F.regexp_replace("value", "^[\"']|[\"']$", "").alias("value"))


def write(table: DataFrame, path: str, by: str | None = None) -> None:
    """A result as Parquet, whole or not at all; rows of one run replace those of an earlier one."""
    writer = table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(by) if by else writer).parquet(path)


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str) -> DataFrame:
    """The table at path with the rows of which it lacks the key; written by the caller to another place."""
    old = spark.read.parquet(path)
    return old.unionByName(rows.join(old.select(key), key, "left_anti"))
