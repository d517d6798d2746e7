"""Version resolution over the mutation log.

Everything follows one order of a cell's versions: ts descending, delete markers before live values of
the same ts, then seq descending. Writes that agree in ts and deleted are one version, the last wins.
The steps, in order: key filters (pushed below the window, as they are its partition keys), retention of
the newest num_versions, the version rule of each column, matchers, cell pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import CellFilter, RowFilter, TableSchema

CELL = ("row_key", "column_name", "cell_key")


def _order(*more: Column) -> list[Column]:
    return [F.col("ts").desc(), F.col("deleted").desc(), *more]


def rows_where(f: RowFilter) -> Column:
    c, k = F.lit(True), F.col("row_key")
    if f.key is not None:
        c = k == f.key
    elif f.prefix is not None:
        c = k.startswith(f.prefix)
    if f.start is not None:
        c = c & (k >= f.start)
    if f.end is not None:
        c = c & (k <= f.end)
    return c & (k > f.after) if f.after is not None else c


def cells_where(f: CellFilter) -> Column:
    c, k = F.col("column_name") == f.column, F.col("cell_key")
    if f.cell_key is not None:
        c = c & (k == f.cell_key)
    if f.start is not None:
        c = c & (k >= f.start)
    if f.end is not None:
        c = c & (k <= f.end)
    if f.below is not None:
        c = c & (k < f.below)
    return c & (k > f.page.after) if f.page and f.page.after is not None else c


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def latest(log: DataFrame) -> DataFrame:
    """The newest version of each cell; none where that is a delete marker."""
    w = Window.partitionBy(*CELL).orderBy(*_order(F.col("seq").desc()))
    return log.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").where(~F.col("deleted"))


def latest_by_aggregate(log: DataFrame) -> DataFrame:
    """As ``latest``, by an aggregate with map-side combining: fewer rows move where cells have many versions."""
    top = F.max_by(F.struct("value", "ts", "deleted", "seq"), F.struct("ts", "deleted", "seq")).alias("top")
    return log.groupBy(*CELL).agg(top).select(*CELL, "top.*").where(~F.col("deleted"))


def retained(log: DataFrame, num_versions: int) -> DataFrame:
    """The newest ``num_versions`` versions of each cell (0: all), numbered in ``version``, with
    ``num_of_values``, how many there are. Delete markers count."""
    cell = Window.partitionBy(*CELL)
    ranked = log.withColumn("version", F.dense_rank().over(cell.orderBy(*_order())))
    if num_versions:
        ranked = ranked.where(F.col("version") <= num_versions)
    first = F.row_number().over(Window.partitionBy(*CELL, "version").orderBy(F.col("seq").desc()))
    return ranked.withColumn("copy", first).where("copy = 1").drop("copy").withColumn("num_of_values", F.count("*").over(cell).cast("int"))


def read_cells(log: DataFrame, schema: TableSchema, f: RowFilter) -> DataFrame:
    """row_key, column_name, cell_key, value, ts, deleted, num_of_values: the cells a filter selects,
    before any cap on rows. A predicate narrows its own column and never drops a row's other columns."""
    schema.check(c.column for c in f.cells)
    out = retained(log.where(rows_where(f) & _any([cells_where(c) for c in f.cells])), schema.num_versions)
    kept, counted, paged = [], [], []
    for c in f.cells:
        own = F.col("column_name") == c.column
        match = c.matcher(F.col("value"), F.col("ts")) if c.matcher else None
        if c.ts_range:
            kept.append(own & F.col("ts").between(*c.ts_range))
        elif c.versions > 1 and match is not None:
            kept.append(own & match)
            counted.append((own, c.versions))
        elif c.versions > 1:
            kept.append(own & (F.col("version") <= c.versions))
        else:
            rule = own & (F.col("version") == 1) & ~F.col("deleted")
            kept.append(rule & match if match is not None else rule)
        if c.page:
            paged.append((own, c.page.size))
    out = out.where(_any(kept))
    if counted:
        n = F.row_number().over(Window.partitionBy(*CELL).orderBy("version"))
        out = out.withColumn("n", n).where(_all([~own | (F.col("n") <= k) for own, k in counted])).drop("n")
    if paged:
        n = F.dense_rank().over(Window.partitionBy("row_key", "column_name").orderBy("cell_key"))
        out = out.withColumn("n", n).where(_all([~own | (F.col("n") <= k) for own, k in paged])).drop("n")
    return out.select(*CELL, "value", "ts", "deleted", "num_of_values")


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def first_rows(cells: DataFrame, n: int) -> DataFrame:
    """The cells of the first n rows in key order. The n keys, no more, go to all tasks."""
    keys = cells.select("row_key").distinct().orderBy("row_key").limit(n)
    return cells.join(F.broadcast(keys) if n <= 100_000 else keys, "row_key", "left_semi")


def page_cursor(cells: DataFrame) -> DataFrame:
    """(row_key, column_name, after): the cursor of each row's next cell page."""
    return cells.groupBy("row_key", "column_name").agg(F.max("cell_key").alias("after"))
