"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import work_folder


#: Spark's setting by which a statement's shuffle files go when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Writes tables into a shared folder of its own; a reader of one needs no executor that made it, and the
    shuffle files that went into it are removed."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, work_folder(spark, what)
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            self._delete(path)

    def clear(self) -> None:
        """Drops all tables."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
