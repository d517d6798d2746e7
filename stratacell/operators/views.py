"""Shapes of a result: rows with an array of cells for each column, and the flat grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_view(cells: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """row_key and for each column an array of (cell_key, values), versions newest first; null where the
    row has no cell in it. Rows without any cell are absent."""
    version = F.struct((-F.col("ts")).alias("o"), (~F.col("deleted")).alias("p"), F.struct("value", "ts", "deleted").alias("v"))
    cell = cells.groupBy("row_key", "column_name", "cell_key").agg(F.transform(F.array_sort(F.collect_list(version)), lambda x: x["v"]).alias("values"))
    own = [F.array_sort(F.collect_list(F.when(F.col("column_name") == c, F.struct("cell_key", "values")))) for c in columns]
    return cell.groupBy("row_key").agg(*(F.when(F.size(a) > 0, a).alias(c) for a, c in zip(own, columns)))


def grid_view(cells: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """As many lines for a row as its fullest column has cells; line i has the i-th cell of each column,
    null where it has no more: row_key, cell_idx, <column>_key, <column>_value, <column>_ts."""
    w = Window.partitionBy("row_key", "column_name").orderBy("cell_key", F.col("ts").desc(), F.col("deleted").desc())
    numbered = cells.withColumn("cell_idx", F.row_number().over(w) - 1)
    pick = lambda c, x: F.max(F.when(F.col("column_name") == c, F.col(x)))
    return numbered.groupBy("row_key", "cell_idx").agg(*(pick(c, x).alias(f"{c}_{n}") for c in columns for x, n in (("cell_key", "key"), ("value", "value"), ("ts", "ts"))))


def printed(cells: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The grid as text, ``key:value(n)`` in each field."""
    shown = cells.withColumn("value", F.concat(F.col("cell_key"), F.lit(":"), F.coalesce(F.col("value").cast("string"), F.lit("")), F.lit("("), F.col("num_of_values").cast("string"), F.lit(")")))
    return grid_view(shown, columns).select("row_key", "cell_idx", *(F.col(f"{c}_value").alias(c) for c in columns))


def to_json(rows: DataFrame) -> DataFrame:
    """(row_key, json) of a row view."""
    return rows.select("row_key", F.to_json(F.struct("*")).alias("json"))


def to_xml(cells: DataFrame) -> DataFrame:
    """(row_key, xml): a row element with its cells in order."""
    text = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    cell = F.concat(F.lit('<cell column="'), text("column_name"), F.lit('" key="'), text("cell_key"), F.lit('" timestamp="'), text("ts"), F.lit('">'), text("value"), F.lit("</cell>"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("column_name", "cell_key", (-F.col("ts")).alias("o"), cell.alias("x")))), lambda s: s["x"])
    return cells.groupBy("row_key").agg(F.concat(F.lit('<row key="'), text("row_key"), F.lit('">'), F.array_join(own, ""), F.lit("</row>")).alias("xml"))
