"""Scratch tables in the folder that driver and executors share.

Lineage is cut by writing Parquet there and reading it back, so a lost executor
costs a retry of a task and never the data of an earlier step.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from sparkassay.session import shared_dir

BATCH_ROWS, MOST_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


class Scratch:
    """A folder for the tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        # rows here hold whole texts or sets: ten thousand of them are too much for one Arrow batch
        if int(spark.conf.get(BATCH_ROWS)) > MOST_ROWS:
            spark.conf.set(BATCH_ROWS, str(MOST_ROWS))
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def cut(self, df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
        """Write ``df``, in folders by the column ``by`` if given, and return it read back: later plans start from the files."""
        at = self.path(name)
        (df.write.partitionBy(by) if by else df.write).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at  # for drop()
        return out

    def drop(self, frames: Iterable[DataFrame]) -> None:
        """Remove tables that no later plan reads."""
        for df in frames:
            at = getattr(df, "_scratch_path", None)
            if at:
                self.remove(at)

    def forget(self) -> None:
        """Let the driver notice which shuffles no plan can read any more, so executors delete their files.

        Spark frees them when the driver's collector finds them unused, which a driver with little to do may put off.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def remove(self, at: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
