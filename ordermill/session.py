"""Session settings and the shared folder for checkpoints and written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ordermill", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs rely on.

    On a cluster the master, memory and checkpoint folder come from the submit
    command; only correctness and adaptive-execution settings are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # split a skewed join even where that costs one more shuffle
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # checkpoint files go when the frame that owns them does
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # no call-site lookup for every column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Local mode falls back to a fresh temporary folder, because there the driver
    is the only machine. On a cluster an unset folder is an error: a
    machine-local path would be lost together with its executor.
    """
    context = spark.sparkContext
    configured = (spark.conf.get("spark.checkpoint.dir", None)
                  or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir())
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="ordermill-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, without lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, whose files go when the frame does (cleanCheckpoints)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
