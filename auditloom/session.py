"""Session settings the engine relies on; a cluster's own settings always win."""

from __future__ import annotations

import atexit
import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("auditloom")
    conf = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.driver.host": "127.0.0.1",
        "spark.checkpoint.dir": os.path.join(tempfile.gettempdir(), "auditloom-checkpoints"),
    }
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. A temporary one stands in for it in local mode only; a cluster without one is an error."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = os.path.join(tempfile.gettempdir(), "auditloom-checkpoints")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    """Drops a folder of the shared file system, if the session still runs."""
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended; its cluster clears the folder
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the program ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def kept(frame: DataFrame, name: str = "stage") -> DataFrame:
    """The frame, written once as Parquet to the shared folder and read back: what reads it prunes columns, pushes filters down, and survives lost executors."""
    spark = frame.sparkSession
    path = scratch(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def merged(frame: DataFrame) -> DataFrame:
    """The frame, to be met by sorting and merging, whatever size the planner takes it for.

    Its guess for Parquet is the compressed size, and for exploded arrays that of the rows before; a table of the corpus that is
    twenty times larger in memory would pass for a small one and be sent through the driver."""
    return frame.hint("merge")


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Fewer rows in a batch that Python gets, for rows that hold whole texts; a setting of the cluster's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))
