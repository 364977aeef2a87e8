"""Reliable cuts: tables written once and read from there.

A :class:`Cut` writes tables to the folder that the cluster names in
``spark.checkpoint.dir``.  What is read from it doesn't repeat the work that made it, and
a lost executor repeats none of it either, as the folder is shared.  Frames that
come from a cut can be used until it is released: by ``release()``, at the end of a
``with`` block, or when the application ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kpiforge.session import ensure_checkpoint_dir


class Cut:
    """A folder of written tables with a defined end."""

    def __init__(self, spark: SparkSession, label: str = "cut"):
        self.spark = spark
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kpiforge-{label}-{uuid.uuid4().hex}"
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.deleteOnExit(self._folder)
        self._n = 0

    def table(self, df: DataFrame) -> DataFrame:
        """``df``, written once and read back."""
        self._n += 1
        path = f"{self.path}/{self._n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Delete the tables; frames that read them can't be used any more."""
        self._files.delete(self._folder, True)

    def __enter__(self) -> Cut:
        return self

    def __exit__(self, *_) -> None:
        self.release()
