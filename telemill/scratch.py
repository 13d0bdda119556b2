"""Where intermediate tables go: the shared folder the cluster names, never a machine's own."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; it gets a temporary folder, removed when
    the process ends.
    """
    global _local_folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    already_set = spark.sparkContext.getCheckpointDir()
    if already_set and _local_folder is None:
        return already_set.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="telemill-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def enable_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable where the cluster has not done so."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
