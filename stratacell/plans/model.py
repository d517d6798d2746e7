"""Table schemas and read filters; legality is checked before any plan is built."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

NAME = re.compile(r"[_a-zA-Z][a-zA-Z0-9_]+")
RESERVED = frozenset({"ROOT", "META"})
DEFAULT_VERSIONS = 3
#: Least bytes of a prefix in query-language LIKE.
LEAST_PREFIX = 4
LOG_COLUMNS = ("row_key", "column_name", "cell_key", "value", "ts", "deleted", "seq")


@dataclass(frozen=True)
class TableSchema:
    """Column families and how many versions of a cell are kept (0: all)."""

    name: str
    columns: tuple[str, ...]
    num_versions: int = DEFAULT_VERSIONS
    comment: str = ""
    owner: str = ""
    permissions: tuple[tuple[str, str], ...] = ()
    bounds: tuple[str, ...] = ()
    kinds: tuple[tuple[str, str], ...] = ()
    #: The folder of the table's records; a rewritten log is a new one.
    folder: str = "log"

    def __post_init__(self):
        if not NAME.fullmatch(self.name) or self.name in RESERVED:
            raise ValueError(f"Invalid table name [{self.name}]")
        if not self.columns or len(set(self.columns)) != len(self.columns):
            raise ValueError("a table needs distinct columns")
        if self.num_versions < 0:
            raise ValueError("num_versions must not be negative")

    def check(self, names) -> None:
        for n in names:
            if n not in self.columns:
                raise ValueError(f"Invalid columnName [{n}]")


@dataclass(frozen=True)
class CellPage:
    """The first ``size`` cells after ``after`` (None: from the start), in every row."""

    size: int
    after: str | None = None

    def __post_init__(self):
        if self.size < 1:
            raise ValueError("a page holds one cell at least")


@dataclass(frozen=True)
class CellFilter:
    """Which cells and versions of one column are read.

    ``cell_key`` is an exact key ('' is the empty one); ``start`` and ``end`` an inclusive range, None
    for an open end, ``below`` an exclusive end. ``ts_range`` returns every retained version inside it, ``versions`` the newest n;
    both show delete markers. ``matcher`` maps (value, ts) columns to a boolean one; it applies after
    version resolution, so a newest version that fails hides the cell.
    """

    column: str
    cell_key: str | None = None
    start: str | None = None
    end: str | None = None
    below: str | None = None
    ts_range: tuple[int, int] | None = None
    versions: int = 1
    page: CellPage | None = None
    matcher: Callable[[Column, Column], Column] | None = field(default=None, compare=False)

    def __post_init__(self):
        if self.versions < 1:
            raise ValueError("versions must be positive")
        if self.versions > 1 and self.ts_range:
            raise ValueError("a number of versions and a timestamp range exclude each other")
        if self.versions > 1 and self.page:
            raise ValueError("a number of versions and a cell page exclude each other")
        if self.matcher and self.ts_range:
            raise ValueError("a matcher and a timestamp range exclude each other")
        if self.cell_key is not None and any(x is not None for x in (self.start, self.end, self.below)):
            raise ValueError("a cell key and a cell range exclude each other")


@dataclass(frozen=True)
class RowFilter:
    """Which rows are read: one key, a prefix, an inclusive range, or all; and of which columns."""

    cells: tuple[CellFilter, ...]
    key: str | None = None
    prefix: str | None = None
    start: str | None = None
    end: str | None = None
    page_size: int | None = None
    after: str | None = None

    def __post_init__(self):
        if not self.cells:
            raise ValueError("at least one cell filter is needed")
        if len({c.column for c in self.cells}) != len(self.cells):
            raise ValueError("one filter for each column")
        if sum(x is not None for x in (self.key, self.prefix)) + (self.start is not None or self.end is not None) > 1:
            raise ValueError("key, prefix and range exclude each other")
        if self.page_size is not None and self.page_size < 1:
            raise ValueError("a page holds one row at least")

    @staticmethod
    def of(*columns: str, **rows) -> RowFilter:
        return RowFilter(tuple(CellFilter(c) for c in columns), **rows)
