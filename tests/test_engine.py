"""The reference's golden cases, store operations and the query language."""

import random

import pytest
from pyspark.sql import functions as F

from stratacell.operators import join, resolve, scan, views, write
from stratacell.plans import cql
from stratacell.plans.model import CellFilter, CellPage, RowFilter, TableSchema
from stratacell.sources import blobs, files
from stratacell.store import LOG_SCHEMA, Store, cast_value
from stratacell.streaming.ingest import ingest

SCHEMA = TableSchema("T_TEST", ("Col1", "Col2"))


@pytest.fixture(scope="module")
def golden(spark):
    """100 rows: Col1 with 3 cells (even rows) or 20 (odd) of two versions, Col2 with one empty-key cell."""
    rows, seq = [], 0
    for i in range(100):
        key, ts = f"{i:010d}", 10 if i % 2 == 0 else 100
        for j in range(3 if i % 2 == 0 else 20):
            for k in range(2):
                rows.append((key, "Col1", f"{j:010d}", f"{key}_{j:010d}_Cell1DataV{k}", ts, False, seq))
                ts, seq = ts + 1, seq + 1
        rows.append((key, "Col2", "", f"{key}_Cell2Data", 0, False, seq))
        seq += 1
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, LOG_SCHEMA).repartition(5).cache()


def counts(df):
    return {int(r.row_key): r["count"] for r in df.groupBy("row_key").count().collect()}


def by_parity(even, odd):
    return {i: even if i % 2 == 0 else odd for i in range(100) if (even if i % 2 == 0 else odd)}


def read(log, *cells, **rows):
    return scan.scan(log, SCHEMA, RowFilter(cells, **rows))


def test_row_get(golden):
    assert counts(read(golden, CellFilter("Col1"))) == by_parity(3, 20)
    assert counts(read(golden, CellFilter("Col2"))) == by_parity(1, 1)
    assert scan.get(golden, SCHEMA, "0000000007").count() == 21
    assert scan.get(golden, SCHEMA, "none").count() == 0


def test_cell_get(golden):
    for i, j in ((0, 0), (0, 2), (1, 19), (99, 5)):
        v = scan.get_cell(golden, SCHEMA, f"{i:010d}", "Col1", f"{j:010d}").collect()
        assert [r.value for r in v] == [f"{i:010d}_{j:010d}_Cell1DataV1"]


def test_time_range(golden):
    assert counts(read(golden, CellFilter("Col1", ts_range=(10, 12)))) == by_parity(3, 0)  # both versions of cell 0, one of cell 1
    assert {r.cell_key for r in read(golden, CellFilter("Col1", ts_range=(10, 12))).collect()} == {"0000000000", "0000000001"}
    assert counts(read(golden, CellFilter("Col2", ts_range=(-(1 << 63), (1 << 63) - 1)))) == by_parity(1, 1)


def test_two_versions_newest_first(golden):
    rows = views.row_view(read(golden, CellFilter("Col1", versions=2)), ("Col1",)).collect()
    assert len(rows) == 100
    for r in rows:
        for c in r.Col1:
            assert [v.value[-2:] for v in c["values"]] == ["V1", "V0"]


def test_cell_pages(golden):
    def pages(key):
        out, after = [], None
        while True:
            f = CellFilter("Col1", start=f"{2:010d}", end=f"{15:010d}", page=CellPage(5, after))
            rows = read(golden, f, key=key).orderBy("cell_key").collect()
            if rows:
                out.append(len(rows))
            if len(rows) < 5:
                return out
            after = rows[-1].cell_key

    assert pages("0000000004") == [1] and pages("0000000005") == [5, 5, 4]


def test_cell_ranges_of_two_columns(golden):
    a, b = f"{1:010d}", f"{9:010d}"
    assert counts(read(golden, CellFilter("Col1", start=a, end=b), CellFilter("Col2", start=a, end=b))) == by_parity(2, 9)
    a = f"{5:010d}"
    assert counts(read(golden, CellFilter("Col1", start=a, end=b), CellFilter("Col2", start=a, end=b))) == by_parity(0, 5)


def test_scan_order_and_inclusive_range(golden):
    rows = scan.ordered_rows(read(golden, CellFilter("Col1")), ("Col1",)).collect()
    assert [r.row_key for r in rows] == [f"{i:010d}" for i in range(100)]
    assert read(golden, CellFilter("Col1"), start=f"{10:010d}", end=f"{30:010d}").select("row_key").distinct().count() == 21
    assert [r.row_key for r in scan.iterate(golden, SCHEMA, RowFilter.of("Col1", page_size=30))] == [f"{i:010d}" for i in range(100)]
    assert scan.scan_range(golden, SCHEMA, f"{10:010d}", f"{30:010d}", "Col2").count() == 20


def test_exact_duplicates_count_once(golden):
    twice = golden.unionByName(golden)
    assert counts(read(twice, CellFilter("Col1", versions=2))) == by_parity(6, 40)
    assert read(twice, CellFilter("Col2")).first().num_of_values == 1


@pytest.mark.parametrize("stores, expected", [(((1, False), (2, False)), [2] * 10), (((1, False), (2, True)), []), (((1, False), (2, True), (3, False)), [3] * 10), (((1, False), (2, "even")), [1] * 5)])
def test_versions_and_delete_markers(spark, stores, expected):
    rows = [("r", "Col1", f"{j:02d}", f"v{ts}", ts, d is True or d == "even" and j % 2 == 0, ts) for ts, d in stores for j in range(10) if d != "even" or j % 2 == 0]
    log = spark.createDataFrame(rows, LOG_SCHEMA)
    for f in (resolve.latest, resolve.latest_by_aggregate):
        assert [r.ts for r in f(log).orderBy("cell_key").collect()] == expected
    if len(expected) == 5:
        assert [r.cell_key for r in read(log, CellFilter("Col1", start="03", end="08")).orderBy("cell_key").collect()] == ["03", "05", "07"]


def test_resolution_ignores_order_and_settles_ties(spark):
    rng = random.Random(5)
    rows = [(f"r{rng.randrange(4)}", "Col1", f"c{rng.randrange(3)}", str(s), rng.randrange(6), rng.random() < 0.3, s) for s in range(200)]
    best = {}
    for r in rows:
        best[r[:3]] = max(best.get(r[:3], ((-1,),)), ((r[4], r[5], r[6]), r[3]))
    expected = {k: v for k, (o, v) in best.items() if not o[1]}
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        log = spark.createDataFrame(rows, LOG_SCHEMA).repartition(3)
        for f in (resolve.latest, resolve.latest_by_aggregate):
            assert {(r.row_key, r.column_name, r.cell_key): r.value for r in f(log).collect()} == expected
        assert {(r.row_key, r.column_name, r.cell_key): r.value for r in read(log, CellFilter("Col1")).collect()} == expected


def test_matcher_has_no_fallback(spark):
    log = spark.createDataFrame([("r", "Col1", "c", "good", 1, False, 1), ("r", "Col1", "c", "bad", 2, False, 2), ("r", "Col1", "d", "good", 1, False, 3)], LOG_SCHEMA)
    m = lambda v, ts: v.contains("good")
    assert [r.cell_key for r in read(log, CellFilter("Col1", matcher=m)).collect()] == ["d"]
    assert sorted(r.cell_key for r in read(log, CellFilter("Col1", versions=2, matcher=m)).collect()) == ["c", "d"]


@pytest.mark.parametrize("make", [lambda: CellFilter("c", versions=2, ts_range=(1, 2)), lambda: CellFilter("c", versions=2, page=CellPage(3)), lambda: CellFilter("c", matcher=lambda v, t: v, ts_range=(1, 2)), lambda: CellFilter("c", "k", start="a"), lambda: RowFilter(()), lambda: RowFilter.of("a", key="k", prefix="p"), lambda: CellPage(0), lambda: TableSchema("META", ("a",)), lambda: TableSchema("x", ("a",)), lambda: TableSchema("tt", ("a", "a"))])
def test_illegal_filters(make):
    with pytest.raises(ValueError):
        make()


def test_unknown_column(golden):
    with pytest.raises(ValueError, match="Invalid columnName"):
        read(golden, CellFilter("nope"))


@pytest.fixture
def store(spark, tmp_path):
    ticks = iter(range(1000, 10**6))
    return Store(spark, f"file://{tmp_path}/tables", clock=lambda: next(ticks))


def test_store_life(store):
    store.create("t_one", "a", "b", comment="first")
    store.put("t_one", "r1", {"a": [("k1", "v1"), ("k2", "v2")], "b": [("", "w")]})
    store.put("t_one", "r1", {"a": [("k1", "v1b")]})
    store.put("t_one", "r2", {"a": [("k1", None)]}, flush=False)
    assert store.get("t_one", "r2") is None
    store.flush("t_one")
    assert store.get_value("t_one", "r1", "a", "k1") == "v1b"
    assert store.get("t_one", "r2").a[0]["values"][0].value is None
    assert store.has_value("t_one", "a", "r1", "k2") and not store.has_value("t_one", "a", "r3")
    store.remove("t_one", "r1", "a", "k2")
    assert not store.has_value("t_one", "a", "r1", "k2") and store.has_value("t_one", "a", "r1")
    store.remove("t_one", "r1", "a")
    assert store.get("t_one", "r1").a is None and store.get("t_one", "r1").b is not None
    store.remove_row("t_one", "r1")
    store.remove_row("t_one", "absent")
    assert store.get("t_one", "r1") is None
    store.put("t_one", "r1", {"a": [("k1", "again", 5)]})  # older than the delete marker
    assert store.get("t_one", "r1") is None
    store.compact("t_one")
    assert store.get("t_one", "r1") is None and store.get("t_one", "r2") is not None
    store.compact("t_one", purge_deleted=True)
    assert {r.column_name: r.records for r in store.report("t_one").collect()}["a"] >= 1
    store.add_column("t_one", "c")
    store.put("t_one", "r9", {"c": [("x", "y")]})
    store.truncate_column("t_one", "c")
    assert store.get("t_one", "r9") is None
    assert [r.name for r in store.catalog.tables().collect()] == ["t_one"] and [r.column_name for r in store.catalog.columns("t_one").collect()] == ["a", "b", "c"]
    store.truncate("t_one")
    assert store.cells("t_one").count() == 0
    store.drop("t_one")
    store.drop("t_one")
    with pytest.raises(ValueError):
        store.schema("t_one")


def test_bulk_load(store, spark):
    rows = [(f"{i}_{j:010d}", c, k.format(j), f"test{c}_{j}", 1, False, i * 10 + j) for i in range(5) for j in range(10) for c, k in (("Col1", ""), ("Col2", "CK_{}"))]
    store.create("t_bulk", "Col1", "Col2", bounds=("3", "1"))
    random.Random(2).shuffle(rows)
    store.load("t_bulk", spark.createDataFrame(rows, LOG_SCHEMA))
    assert store.cells("t_bulk").count() == 100
    assert store.ranges("t_bulk") == [(None, "1"), ("1", "3"), ("3", None)] and store.range_of("t_bulk", "1") == (None, "1")
    store.load("t_bulk", spark.createDataFrame(sorted(rows), LOG_SCHEMA).coalesce(1), sorted_input=True)
    with pytest.raises(Exception, match="Not sorted"):
        store.load("t_bulk", spark.createDataFrame(sorted(rows, reverse=True), LOG_SCHEMA).coalesce(1), sorted_input=True)
    with pytest.raises(Exception, match="Invalid columnName"):
        store.load("t_bulk", spark.createDataFrame([("r", "Col3", "", "v", 1, False, 1)], LOG_SCHEMA))
    assert store.cells("t_bulk").count() == 100
    assert write.faults(store.log("t_bulk")).collect()[0].fault == "repeated version"
    rows, after = store.page_of_cells("t_bulk", "0_0000000001", "Col2", 5)
    assert len(rows) == 1 and after is None


def test_backup_round_trip(store, spark, tmp_path):
    rows = [("r1", "a", "", 'quo"te, comma', 1, False, 1), ("r1", "a", "k", None, 2, True, 2), ("r2", "a", "k", "", 3, False, 3), ("r3", "a", "k", "line\nbreak \\ back", 4, False, 4), ("#r", "a", "k", None, 5, False, 5)]
    log = spark.createDataFrame(rows, LOG_SCHEMA)
    files.backup_csv(log, f"file://{tmp_path}/csv")
    files.backup_parquet(log, f"file://{tmp_path}/parquet")
    for back in (files.restore_csv(spark, f"file://{tmp_path}/csv"), files.restore_parquet(spark, f"file://{tmp_path}/parquet")):
        assert sorted(map(tuple, back.select(*log.columns).collect()), key=str) == sorted(rows, key=str)
    lines = spark.createDataFrame([("r,c,k,v1,1,false,v2,2,true",), ("# note",), ("",)], "value string")
    assert [(r.value, r.ts, r.deleted) for r in files.restore_triples(lines).orderBy("ts").collect()] == [("v1", 1, False), ("v2", 2, True)]


def test_streams_refuse_unknown_columns(store, spark, tmp_path):
    store.create("t_s", "a")
    rows = [("r1", "a", "", "x", 1, False, 1), ("r2", "b", "", "y", 1, False, 2)]
    for name, own in (("good", rows[:1]), ("more", [("r3", "a", "", "z", 1, False, 3)]), ("bad", rows), ("null", [(*rows[0][:1], None, *rows[0][2:])])):
        spark.createDataFrame(own, LOG_SCHEMA).write.parquet(f"file://{tmp_path}/{name}")
        stream = spark.readStream.schema(LOG_SCHEMA).parquet(f"file://{tmp_path}/{name}")
        running = ingest(store, "t_s", stream, f"file://{tmp_path}/state-{name}")
        if name in ("good", "more"):
            running.awaitTermination()
            store.compact("t_s")
        else:
            with pytest.raises(Exception, match="Invalid columnName"):
                running.awaitTermination()
    assert sorted(r.row_key for r in store.cells("t_s").collect()) == ["r1", "r3"]


def test_a_definition_is_replaced_as_a_whole(store):
    store.create("t_d", "a")
    store.put("t_d", "r", {"a": [("", "v")]})
    before = store.schema("t_d").folder
    store.compact("t_d")
    assert store.schema("t_d").folder != before and store.get_value("t_d", "r", "a") == "v"
    assert store.catalog.names() == ["t_d"]


def test_upload(spark):
    lines = spark.createDataFrame([("r1|a|x|b",), ("",), ("|no row",), ("r2|c",)], "value string")
    out = files.delimited(lines, ["c1", "c2"], [0, 1, 3], "|", key_value=True)
    assert sorted((r.row_key, r.column_name, r.cell_key, r.value) for r in out.collect() if r.row_key == "r1") == [("r1", "c1", "a", "x"), ("r1", "c2", "b", None)]
    assert sorted((r.row_key, r.column_name, r.cell_key) for r in out.collect() if r.row_key == "r2") == [("r2", "c1", "c"), ("r2", "c2", "")]


def test_blobs_and_tree(spark, tmp_path):
    (tmp_path / "b1").write_bytes(b"0123456789")
    read_ = blobs.read_blobs(spark, f"file://{tmp_path}/b1")
    path = read_.first().path
    out = blobs.slices(spark.createDataFrame([(path, 2, 3), ("gone", 0, 1)], "path string, offset long, length long"), read_).collect()
    assert {r.path == path: r.content and bytes(r.content) for r in out} == {True: b"234", False: None}
    paths = spark.createDataFrame([(p,) for p in ("/", "/a", "/a/b", "/a/b/c", "/ab/x")], "p string").select(blobs.tree_key(F.col("p")).alias("row_key"))
    assert sorted(r.row_key for r in paths.collect()) == ["/0_/", "/1_/a", "/2_/a/b", "/2_/ab/x", "/3_/a/b/c"]
    assert [r.row_key for r in blobs.children(paths, "/a").collect()] == ["/2_/a/b"] and [r.row_key for r in blobs.children(paths, "/").collect()] == ["/1_/a"]
    assert sorted(r.row_key for r in blobs.moved(paths, "/a", "/z/y").collect()) == ["/2_/z/y", "/3_/z/y/b", "/4_/z/y/b/c"]


def test_views_as_text(golden):
    cells = read(golden, CellFilter("Col1"), key="0000000000")
    assert views.printed(cells, ("Col1",)).where("cell_idx = 1").first().Col1 == "0000000001:0000000000_0000000001_Cell1DataV1(2)"
    assert '"cell_key":"0000000002"' in views.to_json(views.row_view(cells, ("Col1",))).first().json
    assert views.to_xml(cells.withColumn("value", F.lit('<&"'))).first().xml.startswith('<row key="0000000000"><cell column="Col1" key="0000000000" timestamp="11">&lt;&amp;&quot;</cell>')


def test_typed_reads(spark):
    df = spark.createDataFrame([("12",), ("x",)], "v string")
    assert [r.n for r in df.select(cast_value("int", lenient=True)("v").alias("n")).collect()] == [12, None]
    with pytest.raises(Exception):
        df.select(cast_value("int")("v")).collect()
    assert [r[0] for r in df.select(cast_value("boolean")(F.lit("true"))).collect()] == [True, True]


def test_lookup_join(spark, golden):
    found = spark.createDataFrame([("0000000001", 0.5), ("none", 0.1)], "doc string, w double")
    rows = {r.doc: r.text for r in join.lookup(found, resolve.latest(golden), "doc", {"Col2": "text"}).collect()}
    assert rows == {"0000000001": "0000000001_Cell2Data", "none": None}


STATEMENTS = [
    "SELECT * FROM t_a",
    "SELECT c1, c2 FROM t_a WHERE rowkey = 'k'",
    "SELECT c1 FROM t_a WHERE rowkey LIKE 'pref' AND c1 = 'ck'",
    "SELECT c1 FROM t_a WHERE rowkey BETWEEN 'a' AND 'b' AND c1.timestamp BETWEEN '20240101' AND '20240102'",
    "SELECT c1 FROM t_a WHERE c1 >= 'it''s'",
    "INSERT INTO t_a (c1, c2) VALUES (('k', 'v'), ('', 'x')) WHERE rowkey = 'r'",
    "SELECT sum(c1), sum(c2.key) FROM t_a WHERE rowkey = 'k'",
    "SELECT c1, c2 FROM t_a INTO t_b (o1, o2) WHERE rowkey LIKE 'pref%'",
    "SELECT * FROM t_a INTO 'hdfs:///folder'",
    "SELECT c1 FROM t_a WHERE rowkey IN (SELECT top(c9, 5) FROM t_b WHERE rowkey = 'java') AND c1 = 'x'",
    "TRUNCATE TABLE t_a Y", "SET CHARSET utf-8", "SET CHARSET euc-kr",
    "DELETE c1 FROM t_a WHERE rowkey = 'r' AND c1 = 'k'",
    "DELETE * FROM t_a WHERE rowkey = 'r'",
    "CREATE TABLE t_a (c1, c2) VERSION = 5 COMMENT = 'note'",
    "DROP TABLE t_a", "SHOW TABLES", "DESC t_a", "TRUNCATE TABLE t_a", "TRUNCATE COLUMN c1 FROM t_a", "REPORT TABLE t_a", "ADD USER u1", "DELETE USER u1", "SHOW USERS", "HELP",
]


@pytest.mark.parametrize("text", STATEMENTS)
def test_statements_round_trip(text):
    parsed = cql.parse(text)
    assert str(parsed) == text and cql.parse(str(parsed) + ";") == parsed
    assert cql.parse(text.lower()).__class__ is parsed.__class__


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT * FROM a_b, c_d", "SELECT * FROM (SELECT * FROM t_a)", "SELECT * FROM t_a WHERE rowkey > 'a'", "SELECT * FROM t_a WHERE c1 LIKE 'x'", "SELECT * FROM t_a WHERE c1 BETWEEN 'a' AND 'b'", "SELECT * FROM t_a WHERE rowkey = 'a' OR rowkey = 'b'", "SELECT * FROM t_a WHERE rowkey = 'a' AND rowkey = 'b'", "SELECT * FROM t_a WHERE rowkey = 5", "INSERT INTO t_a VALUES (('a', 'b'))", "DELETE FROM t_a", "SELECT * FROM t_a extra", "UPDATE t_a"])
def test_refused_statements(text):
    with pytest.raises(cql.CqlError):
        cql.parse(text)


def test_query_language_end_to_end(store):
    run = store.sql
    assert run("CREATE TABLE t_q (c1, c2) VERSION = 0").message == "t_q table created."
    for i in range(3):
        run(f"INSERT INTO t_q (c1, c2) VALUES (('ck1_{i}', 'value1'), ('ck2_{i}', 'value''2')) WHERE rowkey = 'row{i}'")
    run("INSERT INTO t_q (c1) VALUES (('zz', '')) WHERE rowkey = 'row0'")
    rows = {(r.row_key, r.cell_idx): r for r in run("SELECT * FROM t_q").rows.collect()}
    assert len(rows) == 4 and rows["row0", 0].c2_value == "value'2" and rows["row0", 1].c1_key == "zz" and rows["row0", 1].c1_value is None and rows["row0", 1].c2_key is None
    assert run("SELECT c1 FROM t_q WHERE rowkey LIKE 'row1'").rows.count() == 1
    assert [r.c1_key for r in run("SELECT c1 FROM t_q WHERE c1 > 'ck1_0' AND rowkey = 'row0'").rows.collect()] == ["zz"]
    with pytest.raises(cql.CqlError):
        run("SELECT c1 FROM t_q WHERE rowkey LIKE 'ro'")
    with pytest.raises(ValueError):
        run("SELECT nope FROM t_q")
    run("DELETE c1 FROM t_q WHERE rowkey = 'row0' AND c1 = 'zz'")
    run("DELETE * FROM t_q WHERE rowkey = 'row1'")
    with pytest.raises(cql.CqlError):
        run("DELETE * FROM t_q WHERE rowkey LIKE 'row1'")
    assert {r.row_key for r in run("SELECT * FROM t_q").rows.collect()} == {"row0", "row2"}
    assert run("SHOW TABLES").rows.count() == 1 and run("DESC t_q").rows.count() == 2
    run("ADD USER someone")
    assert run("SHOW USERS").rows.count() == 1
    run("DELETE USER someone")
    assert run("SHOW USERS").rows.count() == 0
    found = run("SELECT c1 FROM t_q WHERE rowkey BETWEEN 'row0' AND 'row9'")
    assert found.message == "2 selected." and run("SELECT * FROM t_q").message == "selected."
    run("CREATE TABLE t_out (o1, o2)")
    run("INSERT INTO t_out (o2) VALUES (('row2', '1.5')) WHERE rowkey = 'links'")
    run("INSERT INTO t_out (o2) VALUES (('row0', '2')) WHERE rowkey = 'links'")
    assert {r.row_key for r in run("SELECT c1 FROM t_q WHERE rowkey IN (SELECT top(o2, 1) FROM t_out WHERE rowkey = 'links')").rows.collect()} == {"row0"}
    assert run("SELECT sum(o2), sum(o2.key) FROM t_out WHERE rowkey = 'links'").rows.collect() == [("links", 3.5, None)]
    run("SELECT c1, c2 FROM t_q INTO t_out (o1, o2) WHERE rowkey LIKE 'row2%'")
    assert {(r.row_key, r.o1_key, r.o2_key) for r in run("SELECT * FROM t_out WHERE rowkey = 'row2'").rows.collect()} == {("row2", "ck1_2", "ck2_2")}
    assert run("SET CHARSET euc-kr").message == "changed charset to euc-kr" and store.charset == "euc-kr"
    store.add_range("t_q", "m")
    run("TRUNCATE TABLE t_q N")
    assert len(store.ranges("t_q")) == 2
    run("TRUNCATE TABLE t_q Y")
    assert store.ranges("t_q") == [(None, None)]
    assert run("SELECT * FROM t_q").rows.count() == 0
    run("DROP TABLE t_q")
    assert not store.catalog.exists("t_q")


def test_dates():
    assert cql.millis("20240101", False) == 1704067200000 and cql.millis("20240101", True) == 1704153599000 and cql.millis("20240101123456", True) == 1704112496000
    with pytest.raises(cql.CqlError):
        cql.millis("2024", False)
