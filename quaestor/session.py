"""Session construction and the settings jobs read from it."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quaestor", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps; ``conf`` overrides any setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A temporary folder is used only on a local master, where driver and tasks
    share one disk; on a cluster an unset folder is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        configured = tempfile.mkdtemp(prefix="quaestor-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new name in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid4()}"


def materialised(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written once to the checkpoint folder.

    For results that several branches of a job read: they are not computed
    again, neither by the branches nor after the loss of an executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
