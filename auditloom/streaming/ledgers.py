"""Ledger lines as a stream: parsed while they arrive, counted by window, delivered once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines of ledgers as they arrive.
SCHEMA = T.StructType([
    T.StructField("line_id", T.LongType()), T.StructField("paper_id", T.LongType()), T.StructField("ledger_path", T.StringType()), T.StructField("run_tag", T.StringType()),
    T.StructField("line_no", T.IntegerType()), T.StructField("raw_line", T.StringType()), T.StructField("logged_at", T.TimestampNTZType()), T.StructField("received_at", T.TimestampNTZType()),
])


def read(spark: SparkSession, folder: str, per_batch: int = 8) -> DataFrame:
    """Lines from Parquet files that are dropped into a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(folder)


def once(lines: DataFrame, late: str = "28 days") -> DataFrame:
    """Each line of a file once, however often it is delivered within the watermark."""
    timed = lines.withColumn("seen", F.col("received_at").cast("timestamp"))
    return timed.withWatermark("seen", late).dropDuplicatesWithinWatermark(["ledger_path", "line_no", "raw_line"])


def outcomes(lines: DataFrame, window: str = "1 day", late: str = "28 days") -> DataFrame:
    """(window_start, status, n): how many runs were kept, discarded or crashed by day of arrival; final when the watermark has passed."""
    record = F.try_parse_json("raw_line")
    status = F.lower(F.try_variant_get(record, "$.status", "string"))
    timed = lines.select(F.col("received_at").cast("timestamp").alias("seen"), status.alias("status")).where("status IN ('keep', 'discard', 'crash')")
    return timed.withWatermark("seen", late).groupBy(F.window("seen", window), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "status", "n")


def write(frame: DataFrame, path: str, checkpoint: str):
    """Append to Parquet, each row exactly once; ends when what is there has been read."""
    return frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
