"""Continuous ingest into a log, and a view of latest values kept by a stream."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.resolve import CELL
from ..operators.write import require_columns
from ..plans.model import LOG_COLUMNS


def ingest(store, name: str, records: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends a stream of records to a table.

    A record of a column that the table does not have fails the stream. Batches that are done are marked, for each
    checkpoint apart, so that one repeated after a failure is passed over; one that failed
    between its files and its mark adds the same versions again, which resolution counts once. Late
    records need no watermark, for resolution does not depend on order.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        spark, schema = batch.sparkSession, store.schema(name)
        done = f"{store.catalog.root}/{name}/_batches/{stream}/{number}"
        jvm = spark._jvm
        mark = jvm.org.apache.hadoop.fs.Path(done)
        fs = mark.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(mark):
            return
        known = require_columns(batch.select(*LOG_COLUMNS), schema)
        known.write.mode("append").partitionBy("column_name").parquet(store.catalog.log_path(name))
        fs.create(mark, True).close()

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_view(records: DataFrame) -> DataFrame:
    """A streaming aggregate, for update or complete mode: each cell's newest version; a consumer hides
    those that are delete markers. State is one version for each cell."""
    top = F.max(F.struct("ts", "deleted", "seq", "value")).alias("top")
    return records.groupBy(*CELL).agg(top).select(*CELL, "top.value", "top.ts", "top.deleted")
