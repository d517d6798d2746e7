"""Log records of writes: puts, delete markers, bulk loads and compaction. None of them changes a log in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import LOG_COLUMNS, TableSchema
from .resolve import CELL, latest, retained


def records(df: DataFrame, row_key: Column, column_name: str | Column, cell_key: Column, value: Column, ts: Column, seq: Column, deleted: Column | None = None) -> DataFrame:
    """The columns of a table as log records."""
    column = F.lit(column_name) if isinstance(column_name, str) else column_name
    return df.select(row_key.alias("row_key"), column.alias("column_name"), F.coalesce(cell_key, F.lit("")).alias("cell_key"), value.alias("value"), ts.cast("long").alias("ts"), (deleted if deleted is not None else F.lit(False)).alias("deleted"), seq.cast("long").alias("seq"))


def tombstones(log: DataFrame, ts: Column, seq: Column, row_key: str | None = None, column: str | None = None, cell_key: str | None = None) -> DataFrame:
    """Delete markers for the live cells of a row, narrowed to a column and a cell. An empty cell key
    stands for every live cell. Nothing live gives no marker."""
    where = F.lit(True)
    for name, x in (("row_key", row_key), ("column_name", column), ("cell_key", cell_key or None)):
        if x is not None:
            where = where & (F.col(name) == x)
    live = latest(log.where(where))
    kind = dict(log.dtypes)["value"]
    return live.select(*CELL, F.lit(None).cast(kind).alias("value"), ts.cast("long").alias("ts"), F.lit(True).alias("deleted"), seq.cast("long").alias("seq"))


def mark_cell(log: DataFrame, ts: Column, seq: Column, row_key: str, column: str, cell_key: str) -> DataFrame:
    """A delete marker for a named cell, whether it is live or not."""
    kind = dict(log.dtypes)["value"]
    one = log.sparkSession.range(1)
    return records(one, F.lit(row_key), column, F.lit(cell_key), F.lit(None).cast(kind), ts, seq, F.lit(True))


def require_columns(log: DataFrame, schema: TableSchema) -> DataFrame:
    """The records, failing where one is of a column that the table does not have."""
    shown = F.coalesce(F.col("column_name"), F.lit("null"))
    fault = F.raise_error(F.concat(F.lit("Invalid columnName ["), shown, F.lit("]"))).cast("boolean")
    return log.where(F.when(F.col("column_name").isin(*schema.columns), F.lit(True)).otherwise(fault))


def drop_column(log: DataFrame, column: str) -> DataFrame:
    return log.where(F.col("column_name") != column)


def compact(log: DataFrame, schema: TableSchema, purge_deleted: bool = False) -> DataFrame:
    """The log with the retained versions only. Delete markers stay, for an older store may still hold
    what they hide; ``purge_deleted`` drops those that nothing older follows."""
    out = retained(log, schema.num_versions)
    if purge_deleted:
        from pyspark.sql import Window

        last = F.max("version").over(Window.partitionBy(*CELL))
        out = out.withColumn("last", last).where(~F.col("deleted") | (F.col("version") < F.col("last"))).drop("last")
    return out.select(*LOG_COLUMNS)


def sorted_load(log: DataFrame, partitions: int | None = None) -> DataFrame:
    """Records in key ranges, sorted within each: written as Parquet, row groups can be skipped by key."""
    order = [F.col("row_key"), F.col("column_name"), F.col("cell_key"), F.col("ts").desc()]
    split = log.repartitionByRange(partitions, "row_key", "cell_key") if partitions else log.repartitionByRange("row_key", "cell_key")
    return split.sortWithinPartitions(*order)


def require_sorted(log: DataFrame) -> DataFrame:
    """The records as they come, failing where a partition's row keys are not ascending."""
    from pyspark.sql import Window

    part = log.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    before = F.lag("row_key").over(Window.partitionBy("_part").orderBy("_at"))
    checked = part.withColumn("_before", before)
    good = F.when(F.col("_before").isNull() | (F.col("_before") <= F.col("row_key")), F.lit(True)).otherwise(F.raise_error(F.lit("Not sorted")).cast("boolean"))
    return checked.where(good).select(*log.columns)


def faults(log: DataFrame) -> DataFrame:
    """(fault, n): null keys, versions stored twice, and values under delete markers."""
    keys = log.where("row_key is null or column_name is null or cell_key is null").select(F.lit("null key").alias("fault"))
    twice = log.groupBy(*CELL, "ts", "deleted").count().where("count > 1").select(F.lit("repeated version").alias("fault"))
    value = log.where("deleted and value is not null").select(F.lit("value of a delete marker").alias("fault"))
    return keys.unionByName(twice).unionByName(value).groupBy("fault").agg(F.count("*").alias("n"))
