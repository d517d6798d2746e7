"""Text loading, backup and restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.write import records

BACKUP = "rowkey string, column string, cellkey string, value string, timestamp long, deleted boolean"


def delimited(lines: DataFrame, columns: list[str], fields: list[int], delimiter: str = "\t", key_value: bool = False, ts: int = 0) -> DataFrame:
    """Records from lines (value): the first of ``fields`` is the row key's place; then, for each column,
    the place of its cell key and, with ``key_value``, the next place's field is its value.

    Blank lines and lines without a row key give nothing, a missing field an empty cell key or a null value.
    """
    if len(fields) != len(columns) + 1:
        raise ValueError("a place for the row key and one for each column are needed")
    parts = lines.where("trim(value) != ''").select(F.split("value", _literal(delimiter), -1).alias("p"), F.monotonically_increasing_id().alias("seq"))
    cells = F.array(*(F.struct(F.lit(c).alias("c"), F.coalesce(F.get("p", F.lit(i)), F.lit("")).alias("k"), (F.get("p", F.lit(i + 1)) if key_value else F.lit(None).cast("string")).alias("v")) for c, i in zip(columns, fields[1:])))
    flat = parts.select(F.get("p", F.lit(fields[0])).alias("row_key"), "seq", F.explode(cells).alias("x")).where("row_key is not null and row_key != ''")
    return records(flat, F.col("row_key"), F.col("x.c"), F.col("x.k"), F.col("x.v"), F.lit(ts), F.col("seq"))


def _literal(s: str) -> str:
    return "\\Q" + s + "\\E"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


_CSV = {"quote": '"', "escape": '"', "quoteAll": True, "nullValue": "\\N", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _one_line(c: str) -> Column:
    """Text with its line breaks written as \\n and \\r, and backslashes doubled."""
    out = F.replace(F.col(c), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")).alias(c)


def _many_lines(c: str) -> Column:
    """The reverse of ``_one_line``."""
    parts = F.split(F.col(c), r"\\\\", -1)
    plain = F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(plain, "\\").alias(c)


_TEXTS = ("row_key", "column_name", "cell_key", "value")


def backup_csv(log: DataFrame, path: str) -> None:
    """All versions, a quoted line each; nulls are kept apart from empty values, quotes are doubled, and line
    breaks escaped, so that a backup can be read in splits."""
    log = log.select(*(_one_line(c) if c in _TEXTS else c for c in log.columns))
    log.select(F.col("row_key").alias("rowkey"), F.col("column_name").alias("column"), F.col("cell_key").alias("cellkey"), "value", F.col("ts").alias("timestamp"), "deleted", "seq").write.options(**_CSV, header=True).csv(path)


def restore_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records of a backup. Lines that start with # are comments."""
    df = spark.read.options(**_CSV, header=True, comment="#").schema(BACKUP + ", seq long").csv(path)
    out = df.select(F.col("rowkey").alias("row_key"), F.col("column").alias("column_name"), F.coalesce("cellkey", F.lit("")).alias("cell_key"), "value", F.col("timestamp").alias("ts"), "deleted", "seq")
    return out.select(*(_many_lines(c) if c in _TEXTS else c for c in out.columns))


def restore_triples(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """Records of lines that hold a row key, column, cell key and then (value, timestamp, deleted) for each version."""
    p = lines.select("value", F.monotonically_increasing_id().alias("line")).where("value not like '#%' and trim(value) != ''")
    parts = p.select("line", F.split("value", _literal(delimiter), -1).alias("p"))
    each = parts.select("line", "p", F.explode(F.expr("CASE WHEN size(p) >= 6 THEN sequence(0, (size(p) - 3) div 3 - 1) END")).alias("i"))
    at = lambda k: F.get("p", (F.col("i") * 3 + k).cast("int"))
    return records(each, F.get("p", F.lit(0)), F.get("p", F.lit(1)), F.get("p", F.lit(2)), at(3), at(4), F.col("line"), at(5) == "true")


def backup_parquet(log: DataFrame, path: str) -> None:
    log.write.parquet(path)


def restore_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
