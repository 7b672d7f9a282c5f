"""Session helpers: shared scratch tables and shipping of in-task helpers."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for tables that cut lineage.

    The session names it in ``spark.checkpoint.dir`` (or by
    ``SparkContext.setCheckpointDir``); without one nothing can be staged.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/")


def ensure_shared_dir(spark: SparkSession) -> None:
    """For local sessions that name no shared folder: take one beside the warehouse's tables.

    On a cluster that folder could be one machine's own disk, so there the session has to name one.
    """
    if spark.sparkContext.master.startswith("local") and not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        spark.sparkContext.setCheckpointDir(f"{warehouse}/staging")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the result.

    Unlike a local checkpoint the table outlives the executors that wrote it,
    and each reader prunes it to the columns it needs. It stays until
    ``drop_staged``, because results that read it are lazy.
    """
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, deleted with the staged tables."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


#: Folders written by ``stage_table`` in this process and not dropped yet.
_STAGED: list[str] = []


def drop_staged(spark: SparkSession, since: int = 0) -> None:
    """Delete the staged tables; whatever reads them must have been run by now."""
    conf = spark._jsc.hadoopConfiguration()
    while len(_STAGED) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables staged inside the block are deleted at its end.

    >>> with scratch(spark):
    ...     rnn_particles(points, 8).write.parquet(out)
    """
    since = len(_STAGED)
    try:
        yield
    finally:
        drop_staged(spark, since)


def ship(module) -> None:
    """Send the helpers of ``module`` to the workers by value, not by import."""
    cloudpickle.register_pickle_by_value(module)
