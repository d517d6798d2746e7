"""Bounded samples of labelled texts, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo a number; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % modulus


def chosen(labels: DataFrame, label: str, per_class: int, held_out: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, y): at most ``per_class`` labelled ids of each class, by an order of hashes.

    ``held_out``: ids whose remainder modulo the first number is the second are never chosen. Null ids
    and labels are left out; an id with contradictory labels counts by their maximum.
    """
    y = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if held_out:
        y = y.where(remainder("doc_id", held_out[0]) != held_out[1])
    y = y.groupBy("doc_id").agg(F.max("y").alias("y"))
    parts = [y.where(F.col("y") == v).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(per_class) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def trusted(labels: DataFrame) -> DataFrame:
    """(doc_id): the ids with label ``quality`` 1, among others or alone; not null ones."""
    return labels.where("doc_id is not null and cast(quality as int) = 1").select("doc_id").distinct()


def with_trust(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, trusted) of every document, trusted where its id has label ``quality`` 1, joined in the
    cluster. An id with contradictory labels is trusted; null ids are not, and are not shuffled."""
    marks = trusted(labels).withColumn("trusted", F.lit(True))
    rows = documents.select("doc_id", "text")
    known = rows.where("doc_id is not null").join(marks.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    return known.unionByName(rows.where("doc_id is null").withColumn("trusted", F.lit(False)))


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, per_class: int, held_out: tuple[int, int] | None = None, most_bytes: int = 48 << 20) -> list[tuple[str, int]]:
    """Whole texts with labels, at most ``per_class`` of each and ``most_bytes`` in all.

    A text that does not fit into what is left is passed over. If that leaves no text of a class that has
    some, ValueError is raised.
    """
    ids = chosen(labels, label, per_class, held_out)
    rows = ids.sparkSession.createDataFrame(ids.collect(), ids.schema)  # at most 2 * per_class pairs of numbers
    found = documents.select("doc_id", "text").join(F.broadcast(rows), "doc_id").where("text is not null").select("text", "y", F.xxhash64("doc_id", F.lit(18)).alias("h"), "doc_id", F.octet_length("text").alias("n"))
    sizes = found.select("h", "doc_id", "n", "y").orderBy("h", "doc_id", "n").limit(4 * per_class).collect()
    total, fit = 0, []
    for r in sizes:
        if total + r.n <= most_bytes:
            total += r.n
            fit.append(r)
    if {r.y for r in fit} != {r.y for r in sizes}:
        raise ValueError(f"no text with label {label} of some class fits into {most_bytes} bytes")
    if not fit:
        return []
    keys = ids.sparkSession.createDataFrame(sorted({(r.doc_id, r.n) for r in fit}), "doc_id long, n int")  # at most 4 * per_class
    out, total = [], 0
    for r in found.join(F.broadcast(keys), ["doc_id", "n"]).orderBy("h", "doc_id", "n", "text").limit(4 * per_class).select("text", "y", "n").toLocalIterator():
        if total + r.n <= most_bytes:
            total += r.n
            out.append((r.text, r.y))
    return out
