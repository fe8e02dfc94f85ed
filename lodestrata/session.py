"""Session helpers: shared folders, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(module_name: str) -> None:
    """Pickle the functions of a module by value, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


#: Settings for large runs; none is needed for right results.
TUNING = {
    "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.parquet.filterPushdown": "true", "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """The builder with the settings that the operators are planned for."""
    return builder.config(map=TUNING)


def share(spark: SparkSession, value):
    """A broadcast of any value, classes of this package by value; ``pickle.loads`` its ``.value``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only for a local master."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _local_dir
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return _local_dir


_local_dir: str | None = None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable ``checkpoint()`` in the shared folder: survives the loss of executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same as a written table in the shared folder: cuts lineage, compressed, and read by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, most_rows: int) -> DataFrame:
    """Hint a broadcast only where a counted size is under the bound; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= most_rows else df
