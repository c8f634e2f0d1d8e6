"""Tables written to the folder that all machines share, to cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder in /tmp only where it is unset and everything runs on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "/tmp/sparkwright-checkpoints"
    return at.rstrip("/")


class Scratch:
    """Named tables in a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/sparkwright-{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """Writes a table and reads it again."""
        frame.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Deletes a table that nothing reads any more."""
        self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        """Deletes all its tables; nothing that is still to be read may come from them."""
        self._delete(self.root)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
