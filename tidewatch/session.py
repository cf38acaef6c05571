"""Session settings and small configuration tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tidewatch", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators expect. On a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def config_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Configuration rows (sources, channels, thresholds) as a local relation.

    Built from Arrow so that the optimizer knows its real size and decides on a broadcast by itself; a frame made
    from Python rows is taken for unboundedly large.
    """
    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    columns = list(zip(*rows)) if rows else [[] for _ in struct.fields]
    arrow = to_arrow_schema(struct)
    table = pa.Table.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema=struct)


def set_shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one; whoever writes it may delete it when the application has ended."""
    return f"{set_shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read, so that it is computed once and survives lost executors.

    It goes to the session's ``spark.checkpoint.dir`` (see :func:`set_shared_folder`).
    """
    set_shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like :func:`cut_lineage` for a wide result of which the later steps read some columns each."""
    folder = new_shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def grouped(df: DataFrame, *keys: str) -> GroupedData:
    """``groupBy`` for Python work that is heavy per group.

    The explicit number of partitions keeps adaptive execution from packing many small groups into one task.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys).groupBy(*keys)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, for sessions started without it on their path (``--py-files``)."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="tidewatch-")) / package.name
    archive = shutil.make_archive(str(base), "zip", package.parent, package.name)
    context.addPyFile(archive)  # Spark sends it to the executors
    _shipped.add(context.applicationId)
