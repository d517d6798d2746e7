"""Tables of versioned cells over append-only logs, with the client operations on them."""

from __future__ import annotations

import itertools
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators import resolve, scan, views, write
from .plans.catalog import Catalog
from .plans.model import LOG_COLUMNS, CellFilter, RowFilter, TableSchema

LOG_SCHEMA = "row_key string, column_name string, cell_key string, value string, ts long, deleted boolean, seq long"


class Store:
    """A folder of tables. ``attach`` adds a log that lies elsewhere, for reading."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], int] | None = None):
        self.spark, self.catalog = spark, Catalog(spark, root)
        self.clock = clock or (lambda: int(time.time() * 1000))
        self._attached: dict[str, tuple[TableSchema, DataFrame]] = {}
        self._step = itertools.count()
        self._buffers: dict[str, list[tuple]] = {}
        self.charset = "UTF-8"

    # Definitions

    def attach(self, schema: TableSchema, log: DataFrame) -> None:
        self._attached[schema.name] = schema, log

    def create(self, name: str, *columns: str, num_versions: int = 3, comment: str = "", bounds: tuple[str, ...] = (), owner: str = "") -> None:
        if len(bounds) > 5000:
            raise ValueError("at most 5000 ranges")
        self.catalog.create(TableSchema(name, columns, num_versions, comment, owner, bounds=tuple(sorted(bounds))))

    def drop(self, name: str) -> None:
        self.catalog.drop(name)

    def schema(self, name: str) -> TableSchema:
        return self._attached[name][0] if name in self._attached else self.catalog.describe(name)

    def add_column(self, name: str, column: str) -> None:
        self.catalog.add_column(name, column)

    def log(self, name: str) -> DataFrame:
        """All records; reading a column family prunes the others' folders."""
        if name in self._attached:
            return self._attached[name][1]
        path, fs = self.catalog._path(name, self.schema(name).folder)
        if not fs.exists(path):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        stored = "row_key string, cell_key string, value string, ts long, deleted boolean, seq long, column_name string"
        return self.spark.read.schema(stored).parquet(self.catalog.log_path(name)).select(*LOG_COLUMNS)

    # Writes

    def next_seq(self) -> int:
        """Ascending over the calls of a client and, by the clock, over clients."""
        return time.time_ns() // 1000 * 1000 + next(self._step) % 1000

    def append(self, name: str, records: DataFrame) -> None:
        schema = self.schema(name)
        if name in self._attached:
            raise ValueError(f"table is attached for reading [{name}]")
        write.require_columns(records.select(*LOG_COLUMNS), schema).write.mode("append").partitionBy("column_name").parquet(self.catalog.log_path(name))

    def put(self, name: str, row_key: str, cells: dict[str, list[tuple]], flush: bool = True) -> None:
        """One row: {column: [(cell_key, value[, ts]), ...]}. Without ts the clock's milliseconds. With
        ``flush`` false the row waits for ``flush()``."""
        if not row_key:
            raise ValueError("rowkey is null")
        self.schema(name).check(cells)
        now, seq = self.clock(), self.next_seq()
        own = [(row_key, c, k or "", v, t[0] if t else now, False, seq) for c, x in cells.items() for k, v, *t in x]
        self._buffers.setdefault(name, []).extend(own)
        if flush:
            self.flush(name)

    def flush(self, name: str) -> None:
        rows = self._buffers.pop(name, [])
        if rows:
            self.append(name, self.spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1))

    def remove(self, name: str, row_key: str, column: str, cell_key: str | None = None) -> None:
        """Deletes a cell; without key, all live cells of the column."""
        self.schema(name).check([column])
        ts, seq = F.lit(self.clock()), F.lit(self.next_seq())
        if cell_key:
            self.append(name, write.mark_cell(self.log(name), ts, seq, row_key, column, cell_key))
        else:
            self.append(name, write.tombstones(self.log(name), ts, seq, row_key, column))

    def remove_row(self, name: str, row_key: str, ts: int | None = None) -> None:
        """Delete markers for all live cells of a row, written as a job of their own. It reads the files that the
        log had when it was planned, so its own do not disturb it."""
        self.append(name, write.tombstones(self.log(name), F.lit(self.clock() if ts is None else ts), F.lit(self.next_seq()), row_key))

    def load(self, name: str, records: DataFrame, sorted_input: bool = False) -> None:
        """Bulk load. Sorted input is checked and written as it lies, other input is range-sorted. A failed
        load leaves no record, as files appear when the job commits."""
        self.append(name, write.require_sorted(records) if sorted_input else write.sorted_load(records))

    def _replace(self, name: str, log: DataFrame) -> None:
        """Writes a new log beside the old one and points the definition to it; a stop at any moment leaves the
        table with one of the two. Records appended meanwhile stay in the old log, so writers must wait."""
        schema = self.schema(name)
        fresh = replace(schema, folder=f"log-{uuid.uuid4().hex[:8]}")
        log.write.partitionBy("column_name").parquet(f"{self.catalog.root}/{name}/{fresh.folder}")
        self.catalog.save(fresh)
        old, fs = self.catalog._path(name, schema.folder)
        fs.delete(old, True)

    def compact(self, name: str, purge_deleted: bool = False) -> None:
        self._replace(name, write.sorted_load(write.compact(self.log(name), self.schema(name), purge_deleted)))

    def truncate(self, name: str, clear_ranges: bool = False) -> None:
        schema = self.schema(name)
        path, fs = self.catalog._path(name, schema.folder)
        fs.delete(path, True)
        if clear_ranges:
            self.catalog.save(replace(schema, bounds=()))

    def truncate_column(self, name: str, column: str) -> None:
        schema = self.schema(name)
        schema.check([column])
        path, fs = self.catalog._path(name, schema.folder, f"column_name={column}")
        fs.delete(path, True)

    # Reads

    def get(self, name: str, row_key: str, *columns: str) -> Row | None:
        """One row as arrays of cells, None if nothing is live."""
        schema = self.schema(name)
        rows = views.row_view(scan.get(self.log(name), schema, row_key, *columns), columns or schema.columns).collect()
        return rows[0] if rows else None

    def get_value(self, name: str, row_key: str, column: str, cell_key: str = "") -> str | None:
        rows = scan.get_cell(self.log(name), self.schema(name), row_key, column, cell_key).collect()
        return rows[0].value if rows else None

    def get_row(self, name: str, f: RowFilter) -> DataFrame:
        if f.key is None:
            raise ValueError("a single row is read by its key")
        return self.gets(name, f)

    def gets(self, name: str, f: RowFilter) -> DataFrame:
        return views.row_view(scan.gets(self.log(name), self.schema(name), f), tuple(c.column for c in f.cells))

    def iterator(self, name: str, f: RowFilter) -> Iterator[Row]:
        return scan.iterate(self.log(name), self.schema(name), f)

    def cells(self, name: str, f: RowFilter | None = None) -> DataFrame:
        return scan.scan(self.log(name), self.schema(name), f)

    def has_value(self, name: str, column: str, row_key: str, cell_key: str | None = None) -> bool:
        keys = self.spark.createDataFrame([(row_key,)], "row_key string")
        return scan.exists(self.log(name), self.schema(name), keys, column, cell_key).first().has_value

    def page_of_cells(self, name: str, row_key: str, column: str, size: int, after: str | None = None) -> tuple[list[Row], str | None]:
        """A page of one row's cells and the cursor of the next, None after the last page."""
        from .plans.model import CellPage

        rows = self.cells(name, RowFilter((CellFilter(column, page=CellPage(size, after)),), key=row_key)).orderBy("cell_key").collect()
        return rows, rows[-1].cell_key if len(rows) == size else None

    def ranges(self, name: str) -> list[tuple[str | None, str | None]]:
        """The table's key ranges, start exclusive and end inclusive."""
        bounds = [None, *self.schema(name).bounds, None]
        return list(zip(bounds[:-1], bounds[1:]))

    def range_of(self, name: str, row_key: str) -> tuple[str | None, str | None]:
        return next(r for r in self.ranges(name) if (r[0] is None or row_key > r[0]) and (r[1] is None or row_key <= r[1]))

    def add_range(self, name: str, bound: str) -> None:
        schema = self.schema(name)
        self.catalog.save(replace(schema, bounds=tuple(sorted({*schema.bounds, bound}))))

    def report(self, name: str) -> DataFrame:
        """(column_name, files, records, value_bytes)"""
        log = self.log(name).withColumn("file", F.input_file_name())
        return log.groupBy("column_name").agg(F.countDistinct("file").alias("files"), F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("value_bytes"))

    def sql(self, text: str, charset: str | None = None):
        """Executes a statement. ``charset``: of binary values, from this statement on."""
        from .plans.cql import execute

        self.charset = charset or self.charset
        return execute(self, text)

    @staticmethod
    def decoded(cells: DataFrame, charset: str) -> DataFrame:
        """Binary values as text of a character set."""
        return cells.withColumn("value", F.decode("value", charset))


def cast_value(kind: str, lenient: bool = False) -> Callable[[str | Column], Column]:
    """Reads a value as a number, date or truth; text that is none fails, or gives null if ``lenient``."""
    if kind == "boolean":
        return lambda c: (F.col(c) if isinstance(c, str) else c) == "true"
    return lambda c: (F.col(c) if isinstance(c, str) else c).try_cast(kind) if lenient else (F.col(c) if isinstance(c, str) else c).cast(kind)
