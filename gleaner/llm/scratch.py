"""Tables written once to the shared folder, and removed when nothing reads them any more."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from gleaner.session import ensure_checkpoint_dir


class Scratch:
    """Parquet tables of one operator call in the folder of ``spark.checkpoint.dir``.

    A written table cuts the lineage: a lost executor costs the tasks that read it, not
    the work that made it. ``drop`` removes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def settle(self) -> None:
        """Let Spark remove the shuffle files of finished steps.

        It does so when the driver collects its garbage, which a driver with little to do puts
        off while the executors' disks fill up.
        """
        gc.collect()
        self.spark._jvm.System.gc()
