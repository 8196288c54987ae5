"""Session helpers shared by operators that need durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver's file system delete a folder when the application ends."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder to use, setting one only where none is configured.

    On a cluster ``spark.checkpoint.dir`` names a folder that all executors
    share; it is read from the session's configuration. Only when neither it
    nor a directory set through the context exists (a local test session) is a
    temporary folder chosen. The subfolder that Spark makes there for this
    application is deleted when the application ends.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    present = sc._jsc.sc().getCheckpointDir()
    if not present.isDefined():
        if not configured:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="plenora-checkpoint-")
            _delete_at_end(spark, configured)
        sc.setCheckpointDir(configured)
        present = sc._jsc.sc().getCheckpointDir()
        _delete_at_end(spark, present.get())
    return present.get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """``df`` as a table written once in the shared checkpoint folder: unlike a checkpoint it is compressed, and
    readers take only the columns and (with ``partition_by``) the parts they need. Deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    out = df.write.partitionBy(partition_by) if partition_by else df.write
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
