"""Session helpers: building a session, cutting lineage and bounded broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "mnemograph") -> SparkSession:
    """A local session for tests and benches; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only in local mode, and only where neither that setting nor a checkpoint folder exists
    (tests), is a temporary folder of this machine used. On a cluster without the setting
    this raises ``RuntimeError``: such a folder would be lost with an executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="mnemograph-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    Checkpoint files are written through Hadoop's file system, so the loss of an
    executor does not lose them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only when ``df`` is proven to hold at most ``rows`` rows.

    Counting stops after ``rows + 1`` rows; beyond that the join is left to Catalyst
    and adaptive execution, which shuffle both sides.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unpriced(df: DataFrame) -> DataFrame:
    """A side of a join that must not be broadcast on an estimate: both sides are shuffled and sorted.

    Catalyst prices rows behind Python functions, exploded arrays and checkpoints like the
    input they came from, which can be a hundred times too low.
    """
    return df.hint("merge")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
