"""The folder that driver and executors share, and tables written there between the steps of an operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXACT = 1000  # counts up to this are told apart when the smallest count of a table is chosen


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a local session without that setting gets one of its own."""
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if top is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        top = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        context.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{context.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A step that several later steps read runs once, the plan starts anew at the files, and a lost executor costs at
    most its own tasks. The files stay until the folder of the application is removed.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest count ``n`` such that at most ``most`` words have it or more."""
    step = F.when(F.col("n") <= EXACT, F.col("n")).otherwise(F.pow(2.0, F.ceil(F.log2("n") * 8) / 8).cast("long"))
    rows = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()  # EXACT + 8 * 63 at most
    least, total = 2**62, 0
    for row in sorted(rows, reverse=True):
        total += row["words"]
        if total > most:
            break
        least = row["step"]
    return least
