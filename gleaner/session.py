"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Largest matrix (bytes) that may be shipped to every task.
BROADCAST_BYTES = 64 << 20

#: Bytes of vectors in one block of a block-by-block similarity join.
BLOCK_BYTES = 16 << 20


def local_session(app: str, cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and local runs; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point Spark at the cluster's shared checkpoint folder.

    Where the session names none, a local run gets a folder of its own; on a cluster that is
    an error, since the executors don't share the driver's disk.
    """
    context = spark.sparkContext
    active = context.getCheckpointDir()
    if active:
        return active
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gleaner-checkpoint-"))
    return context.getCheckpointDir()


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and continue from the files.

    Used where a result must not change when a lost task is run again, such as
    positions that depend on how a sort was split into partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written once to the checkpoint folder as Parquet, and its path for ``discard``."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str | None) -> None:
    """Remove what ``stored`` wrote, when nothing reads it any more."""
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
