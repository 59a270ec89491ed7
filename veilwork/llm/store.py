"""Intermediate tables in the shared checkpoint folder, and removal of those no longer needed."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from veilwork.session import shared_folder


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go when their query ends, not when the driver collects its garbage."""
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


class Workspace:
    """A folder of written tables.  A lost executor costs one step: every step reads files that all executors reach."""

    opened: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        Workspace.opened.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` under ``name`` and read it back."""
        with freed_shuffles(self.spark):
            df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    @classmethod
    def drop_all(cls) -> None:
        """Remove every workspace so far.  Only for callers that have written all results that read them."""
        for space in cls.opened:
            space.drop()
        cls.opened.clear()
