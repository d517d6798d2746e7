"""Merge joins on row keys."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_join(inputs: list[DataFrame], names: list[str], how: str = "full_outer", keys: list[Callable[[Column], Column]] | None = None, condition: Callable[..., Column] | None = None) -> DataFrame:
    """row_key and one struct for each input, null for a side that has no row with the key.

    ``keys``: for each input a map from its row key to the join key. ``condition``: a further predicate
    over the two structs, for two inputs. Keys that repeat pair up as in SQL. Both sides are sorted by
    the key within hash partitions, so inputs bucketed alike are joined without a shuffle.
    """
    maps = keys or [lambda k: k] * len(inputs)
    sides = [df.select(m(F.col("row_key")).alias("row_key"), F.struct(*df.columns).alias(n)) for df, m, n in zip(inputs, maps, names)]
    if condition is not None:
        (a, b), (x, y) = sides, names
        b = b.withColumnRenamed("row_key", "_key")
        joined = a.join(b, (F.col("row_key") == F.col("_key")) & condition(F.col(x), F.col(y)), how)
        return joined.select(F.coalesce("row_key", "_key").alias("row_key"), x, y)
    return reduce(lambda a, b: a.join(b, "row_key", how), sides)


def lookup(found: DataFrame, cells: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Adds to each line of ``found`` the empty-key cells of the row that ``key`` names, as
    {column family: output name}; null where absent."""
    value = lambda c: F.max(F.when(F.col("column_name") == c, F.col("value")))
    rows = cells.where((F.col("cell_key") == "") & F.col("column_name").isin(*columns)).groupBy("row_key").agg(*(value(c).alias(n) for c, n in columns.items()))
    return found.join(rows, found[key] == rows["row_key"], "left").drop("row_key")
