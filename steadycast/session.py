"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. On a cluster, use the one it gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("steadycast")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: executors on other
    machines could not read it.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can read")
        configured = tempfile.mkdtemp(prefix="steadycast-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def run_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder for one run."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
