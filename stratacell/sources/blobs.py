"""Large values in files, and a tree of files in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A blob file is rewritten once this share of its bytes is dead.
DEAD_SHARE = 0.3


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, length, content) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.lit(0).cast("long").alias("offset"), "length", "content")


def packed(cells: DataFrame, name: str, value: str, per_file: int) -> tuple[DataFrame, DataFrame]:
    """(pointers, files) of large values: files (path, content) hold about ``per_file`` values each, one behind
    the other, and pointers (the other columns, path, offset, length) say where. Rows are dealt by the hash of
    ``name``, so files need no common count, and lie by name, size and digest, so that values of one name stand in
    one order in pointers and files. A null value has no bytes and a null length."""
    n = F.greatest(F.ceil(cells.select(F.count("*").alias("n")).first().n / F.lit(per_file)), F.lit(1))
    content = F.coalesce(F.col(value).cast("binary"), F.lit(b""))
    dealt = cells.withColumn("path", F.concat(F.lit("blob-"), F.pmod(F.xxhash64(name), n).cast("string"))).withColumn("_content", content)
    dealt = dealt.withColumn("_size", F.octet_length("_content").cast("long")).withColumn("_digest", F.md5("_content"))
    dealt = dealt.withColumn("length", F.when(F.col(value).isNotNull(), F.col("_size")))
    own = Window.partitionBy("path").orderBy(name, "_size", "_digest")
    placed = dealt.withColumn("offset", F.sum("_size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size")).drop("_size", "_digest")
    joined = F.transform(F.array_sort(F.collect_list(F.struct("offset", "length", "_content"))), lambda x: F.hex(x["_content"]))
    files = placed.groupBy("path").agg(F.unhex(F.array_join(joined, "")).alias("content"))
    return placed.drop("_content", value), files


def slices(pointers: DataFrame, files: DataFrame) -> DataFrame:
    """Adds the bytes that each pointer (path, offset, length) stands for, null without its file."""
    whole = files.select("path", F.col("content").alias("_content"))
    bytes_ = F.expr("substring(_content, cast(offset + 1 AS int), cast(length AS int))")
    return pointers.join(whole, "path", "left").withColumn("content", bytes_).drop("_content")


def garbage(pointers: DataFrame, dead_share: float = DEAD_SHARE) -> DataFrame:
    """(path, bytes, dead_bytes, dead_share): files to rewrite, from pointers (path, length, deleted)."""
    dead = F.coalesce(F.sum(F.when(F.col("deleted"), F.col("length"))), F.lit(0))
    sums = pointers.groupBy("path").agg(F.sum("length").alias("bytes"), dead.alias("dead_bytes"))
    return sums.withColumn("dead_share", F.col("dead_bytes") / F.col("bytes")).where(F.col("dead_share") >= dead_share)


def tree_key(path: Column) -> Column:
    """A path with its depth before it, so that the entries of a folder are one key range."""
    clean = F.concat(F.lit("/"), F.trim(path, F.lit("/")))
    depth = F.when(clean == "/", F.lit(0)).otherwise(F.size(F.split(clean, "/")) - 1)
    return F.concat(F.lit("/"), depth.cast("string"), F.lit("_"), clean)


def children(rows: DataFrame, folder: str) -> DataFrame:
    """Rows whose key is that of an entry right inside the folder."""
    clean = "/" + folder.strip("/")
    depth = 0 if clean == "/" else clean.count("/")
    return rows.where(F.col("row_key").startswith(f"/{depth + 1}_{clean.rstrip('/')}/"))


def subtree(rows: DataFrame, folder: str) -> DataFrame:
    """Rows of the folder and of all below it."""
    clean = "/" + folder.strip("/")
    path = F.regexp_replace("row_key", r"^/\d+_", "")
    return rows.where((path == clean) | path.startswith(clean.rstrip("/") + "/"))


def moved(rows: DataFrame, source: str, target: str) -> DataFrame:
    """The rows of a subtree under their new keys."""
    a, b = "/" + source.strip("/"), "/" + target.strip("/")
    path = F.regexp_replace("row_key", r"^/\d+_", "")
    return subtree(rows, source).withColumn("row_key", tree_key(F.concat(F.lit(b), F.substring(path, len(a) + 1, 1 << 30))))
