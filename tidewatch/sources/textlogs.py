"""Log files as lines: batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(text: DataFrame) -> DataFrame:
    return text.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Non-empty lines (path, block, line, as read) with their 1-based number in the file.

    A file is read in blocks by many tasks. Each block numbers its own lines; only the line counts per block are
    accumulated per file, so a file of any size is numbered without passing through one task.
    """
    filled = lines.withColumn("__id", F.monotonically_increasing_id()).filter(F.col("line") != "")
    ranked = filled.withColumn("__n", F.row_number().over(Window.partitionBy("path", "block").orderBy("__id")))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = filled.groupBy("path", "block").agg(F.count("*").alias("__lines"))
    offsets = counts.select(
        "path", "block", F.coalesce(F.sum("__lines").over(before), F.lit(0)).alias("__before")
    )
    numbered = ranked.join(offsets, ["path", "block"])
    return numbered.select("path", (F.col("__before") + F.col("__n")).alias("line_number"), "line")


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines of all files under ``path``: path, line_number, line."""
    return number_lines(_lines(spark.read.text(path)))


def stream_log_files(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Lines of new files under ``path`` as they appear, for :func:`tidewatch.streaming.ingest.write_logs`.

    Progress is kept in the query's checkpoint. A file is taken whole when it appears, so files must be rolled in,
    not appended to.
    """
    return _lines(spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(path))
