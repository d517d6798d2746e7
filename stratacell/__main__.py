"""``python -m stratacell <root> -q <statement> | -file <path> | -check <table> | -upload <table> <path> | -backup <table> <path> | -restore <table> <path>``"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .operators.write import faults
from .sources.files import backup_csv, delimited, read_lines, restore_csv
from .store import Store


def main(args: list[str]) -> int:
    if len(args) < 3:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("stratacell").getOrCreate()
    root, mode, *rest = args
    store = Store(spark, root)
    if mode in ("-q", "-file"):
        text = rest[0] if mode == "-q" else "\n".join(r.value for r in spark.read.text(rest[0]).toLocalIterator())
        for statement in filter(str.strip, text.split(";")):
            out = store.sql(statement)
            print(out.message)
            if out.rows is not None:
                out.rows.show(1000, truncate=False)
    elif mode == "-check":
        faults(store.log(rest[0])).show()
    elif mode == "-upload":
        columns = list(store.schema(rest[0]).columns)
        store.load(rest[0], delimited(read_lines(spark, rest[1]), columns, list(range(len(columns) + 1)), ts=store.clock()))
    elif mode == "-backup":
        backup_csv(store.log(rest[0]), rest[1])
    elif mode == "-restore":
        store.load(rest[0], restore_csv(spark, rest[1]))
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
