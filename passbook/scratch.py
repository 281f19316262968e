"""Run-time tables on the shared file system."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
# keys are digests in hexadecimal text, half of which is left by zstd and all of it by snappy
STORED_AS = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}


class NoSharedFolder(RuntimeError):
    """A cluster names no shared folder for run-time tables."""


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder on the shared file system the cluster names for checkpoints.

    Without that setting a session on one machine (master ``local``) uses a temporary folder of that
    machine; on a cluster it is an error, as executors would each write to their own disk.
    """
    base = spark.conf.get(CHECKPOINT_SETTING, None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise NoSharedFolder(f"set {CHECKPOINT_SETTING} to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="passbook-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` as a table of its own: used several times, computed once, safe from lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("errorifexists").options(**STORED_AS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
