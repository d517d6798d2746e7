"""Cases that only larger or odd tables have."""

import pyarrow as pa
from pyspark.sql import functions as F

from stratacell.operators import scan
from stratacell.plans import cql, jobs
from stratacell.plans.model import RowFilter
from stratacell.sources import blobs, encoders
from stratacell.store import Store


def test_packed_values_of_one_name(spark):
    """Pointers and files of the same rows, read in another order each; a null value stays null."""
    rows = [("u", f"{i}" * (1 + i % 7)) for i in range(200)] + [("none", None), ("empty", ""), (None, "x")]
    pages = spark.createDataFrame(rows, "row_key string, html string")
    turned = spark.createDataFrame(rows[::-1], "row_key string, html string")
    pointers, _ = blobs.packed(pages.coalesce(1), "row_key", "html", 40)
    _, packed = blobs.packed(turned.coalesce(1), "row_key", "html", 40)
    out = blobs.slices(pointers, packed).select("row_key", F.decode("content", "UTF-8").alias("value")).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, rows))


def test_a_select_returns_all_rows(spark):
    """More rows than a client of the reference fetches at once, with and without a cap asked for."""
    store = Store(spark, "attached")
    log = spark.range(5200).select(F.lpad(F.col("id").cast("string"), 10, "0").alias("row_key"), F.lit("ev").alias("column_name"), F.lit("click").alias("cell_key"), F.lit(1.0).alias("value"), F.lit(1704844800000000).alias("ts"), F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("seq"))
    store.attach(encoders.EVENTS, log)
    text = "SELECT ev FROM t_events WHERE rowkey LIKE '0000' AND ev.timestamp BETWEEN '20240110' AND '20240120'"
    assert cql.execute(store, text, ticks_per_ms=1000).rows.count() == 5200
    assert cql.execute(store, text, ticks_per_ms=1000, row_cap=5000).rows.count() == 5000
    assert scan.gets(log, encoders.EVENTS, RowFilter.of("ev", prefix="0000")).count() == 5200


def test_an_iterator_reads_its_log_once(spark):
    """However many pages its rows make, each record is read in one or two passes: for the bounds and the sort."""
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    log = spark.range(200).select(F.lpad(F.col("id").cast("string"), 10, "0").alias("row_key"), F.lit("ev").alias("column_name"), F.lit("click").alias("cell_key"), F.lit(1.0).alias("value"), F.lit(0).cast("long").alias("ts"), F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("seq"))
    rows = scan.iterate(log.mapInArrow(noted, log.schema), encoders.EVENTS, RowFilter.of("ev", page_size=20, start=f"{50:010d}"))
    assert [r.row_key for r in rows] == [f"{i:010d}" for i in range(50, 200)]
    assert seen.value <= 400


def test_postings_of_a_large_term(spark):
    """A term of more documents than one task ranks: all of them, tied weights too, by id."""
    docs = spark.createDataFrame([(i, "common " * (1 + i % 3) + ("seldom" if i % 10 == 0 else "never" if i % 10 < 5 else "")) for i in range(300)], "doc_id long, text string")
    common, others = jobs.weight_parts(docs, broadcast_bytes=50)
    assert {r.term for r in common.collect()} == {"common"} and {r.term for r in others.collect()} == {"seldom", "never"}
    got = [(r.term, r["rank"], r.doc_id) for r in jobs.postings(common, others=others, large=20).collect()]
    rows = sorted((r.term, -r.weight, r.doc_id) for r in jobs.term_weights(docs).collect())
    place = {t: [x[2] for x in rows if x[0] == t] for t in ("common", "seldom", "never")}
    assert sorted(got) == sorted((t, i + 1, d) for t, ids in place.items() for i, d in enumerate(ids)) and len(got) == 450
    few = [(r.term, r["rank"], r.doc_id) for r in jobs.postings(common, cap=7, others=others, large=20).collect()]
    assert sorted(few) == sorted(x for x in got if x[1] <= 7)


def test_term_weights_move_few_rows(spark):
    """Rows of common terms are not shuffled; repeated ids of one length are one document."""
    docs = spark.createDataFrame([(1, "aa bb aa"), (1, "bb bb cc"), (None, "aa cc"), (None, "aa dd"), (2, ""), (3, None)], "doc_id long, text string")
    got = sorted((r.term, r.doc_id or 0, r.n, r.tf) for r in jobs.term_frequencies(docs).collect())
    assert got == [("aa", 0, 5, 2), ("aa", 1, 8, 2), ("bb", 1, 8, 3), ("cc", 0, 5, 1), ("cc", 1, 8, 1), ("dd", 0, 5, 1)]
    plan = jobs.term_weights(docs.where("doc_id = 1"))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_numbers_go_on_across_batches():
    batches = [pa.RecordBatch.from_arrays([pa.array(x)], names=["term"]) for x in (["a", "a", "b"], [], ["b", "b"], ["b", "c"], ["c"])]
    assert [b.column(1).to_pylist() for b in jobs._numbered(iter(batches))] == [[1, 2, 1], [2, 3], [4, 1], [2]]
