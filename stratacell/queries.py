"""One query for each operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import links, padded, terms
from .operators import join, resolve, scan, views, write
from .plans import cql, jobs
from .plans.model import CellFilter, CellPage, RowFilter
from .session import prepare, work_folder
from .sources import blobs, encoders, files
from .store import Store, cast_value
from .streaming.ingest import ingest, latest_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Logs as SQL sees them: one line for each version, repeated stamps settled by seq, numbered newest first.
_EVENTS = """ev AS (
  SELECT lpad(CAST(user_id AS VARCHAR), 10, '0') AS row_key, event_type AS cell_key, epoch_us(ts) AS ts, arg_max(value, event_id) AS value
  FROM events GROUP BY 1, 2, 3),
ver AS (SELECT *, row_number() OVER (PARTITION BY row_key, cell_key ORDER BY ts DESC) AS version FROM ev)"""
_RETAINED = _EVENTS + ", kept AS (SELECT *, count(*) OVER (PARTITION BY row_key, cell_key) AS num_of_values FROM ver WHERE version <= 3)"
_ACTIVITY = """act AS (
  SELECT lpad(CAST(user_id AS VARCHAR), 10, '0') AS row_key, 'h' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS cell_key, epoch_us(ts) AS ts,
         event_type = 'error' AS deleted, CASE WHEN event_type <> 'error' THEN value END AS value, event_id AS seq FROM events),
newest AS (SELECT *, row_number() OVER (PARTITION BY row_key, cell_key ORDER BY ts DESC, deleted DESC, seq DESC) AS version FROM act)"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return encoders.events(_t(spark, d, "events"))


def _flat(cells: DataFrame) -> DataFrame:
    return cells.select("row_key", "cell_key", "value", "ts")


@query(f"WITH {_EVENTS} SELECT row_key, cell_key, value, ts FROM ver WHERE version = 1 AND row_key BETWEEN '0000000010' AND '0000000020'")
def gets_between(spark, d):
    return _flat(scan.gets(_events(spark, d), encoders.EVENTS, RowFilter.of("ev", start="0000000010", end="0000000020")))


@query(f"WITH {_EVENTS} SELECT row_key, cell_key, value, ts FROM ver WHERE version = 1 AND row_key = '0000000012'")
def get_row(spark, d):
    return _flat(scan.get(_events(spark, d), encoders.EVENTS, "0000000012"))


@query(f"WITH {_EVENTS} SELECT value FROM ver WHERE version = 1 AND row_key = '0000000012' AND cell_key = 'click'")
def get_cell(spark, d):
    return scan.get_cell(_events(spark, d), encoders.EVENTS, "0000000012", "ev", "click")


@query(f"WITH {_EVENTS} SELECT row_key, cell_key, value, ts FROM ver WHERE version = 1 AND starts_with(row_key, '00000000')")
def gets_prefix(spark, d):
    return _flat(scan.gets(_events(spark, d), encoders.EVENTS, RowFilter.of("ev", prefix="00000000")))


@query(f"WITH {_EVENTS} SELECT row_key, cell_key, value, ts FROM ver WHERE version = 1")
def scan_latest(spark, d):
    return _flat(scan.scan(_events(spark, d), encoders.EVENTS))


@query(f"WITH {_EVENTS} SELECT row_key, cell_key, value, ts FROM ver WHERE version = 1")
def scan_latest_by_aggregate(spark, d):
    return _flat(resolve.latest_by_aggregate(_events(spark, d)))


@query(f"WITH {_EVENTS} SELECT row_key, cell_key, value, ts FROM ver WHERE version = 1 AND row_key > '0000000040' AND row_key <= '0000000080'")
def scan_key_range(spark, d):
    return _flat(scan.scan_range(_events(spark, d), encoders.EVENTS, "0000000040", "0000000080"))


@query(f"WITH {_EVENTS} SELECT row_key, cell_key, value, ts FROM ver WHERE version = 1 AND cell_key BETWEEN 'click' AND 'purchase'")
def cell_range(spark, d):
    return _flat(scan.scan(_events(spark, d), encoders.EVENTS, RowFilter((CellFilter("ev", start="click", end="purchase"),))))


@query(f"WITH {_EVENTS} SELECT row_key, cell_key, value, ts FROM ver WHERE version <= 2")
def versions_newest_two(spark, d):
    return _flat(scan.scan(_events(spark, d), encoders.EVENTS, RowFilter((CellFilter("ev", versions=2),))))


@query(f"WITH {_RETAINED} SELECT row_key, cell_key, value, ts FROM kept WHERE ts BETWEEN 1704844800000000 AND 1705881600000000")
def versions_in_time_range(spark, d):
    return _flat(scan.scan(_events(spark, d), encoders.EVENTS, RowFilter((CellFilter("ev", ts_range=(1704844800000000, 1705881600000000)),))))


@query(f"WITH {_RETAINED} SELECT row_key, cell_key, num_of_values FROM kept WHERE version = 1")
def version_counts(spark, d):
    return scan.scan(_events(spark, d), encoders.EVENTS).select("row_key", "cell_key", F.col("num_of_values").cast("long").alias("num_of_values"))


@query(f"WITH {_ACTIVITY} SELECT row_key, cell_key, value, ts FROM newest WHERE version = 1 AND NOT deleted")
def delete_markers(spark, d):
    return _flat(resolve.latest(encoders.activity(_t(spark, d, "events"))))


@query(f"""WITH {_ACTIVITY}, ded AS (SELECT row_key, cell_key, ts, deleted, arg_max(value, seq) AS value FROM act GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY row_key, cell_key ORDER BY ts DESC, deleted DESC) AS version FROM ded)
SELECT row_key, cell_key, value, ts, deleted FROM v WHERE version <= 2""")
def versions_show_delete_markers(spark, d):
    log = encoders.activity(_t(spark, d, "events"))
    return scan.scan(log, encoders.ACTIVITY, RowFilter((CellFilter("h", versions=2),))).select("row_key", "cell_key", "value", "ts", "deleted")


@query(f"WITH {_EVENTS} SELECT row_key, cell_key, value, ts FROM ver WHERE version = 1 AND row_key <> '0000000012'")
def remove_row(spark, d):
    log = _events(spark, d)
    marks = write.tombstones(log, F.lit(1 << 60), F.lit(1 << 60), row_key="0000000012")
    return _flat(resolve.latest(log.unionByName(marks)))


@query(f"WITH {_EVENTS} SELECT row_key, cell_key, value, ts FROM ver WHERE version = 1 AND NOT (row_key = '0000000012' AND cell_key = 'click')")
def remove_cell(spark, d):
    log = _events(spark, d)
    return _flat(resolve.latest(log.unionByName(write.mark_cell(log, F.lit(1 << 60), F.lit(1 << 60), "0000000012", "ev", "click"))))


@query(f"WITH {_EVENTS}, page AS (SELECT DISTINCT row_key FROM ver WHERE row_key > '0000000030' ORDER BY row_key LIMIT 25) SELECT row_key, cell_key, value, ts FROM ver JOIN page USING (row_key) WHERE version = 1")
def row_page(spark, d):
    return _flat(scan.gets(_events(spark, d), encoders.EVENTS, RowFilter.of("ev", page_size=25, after="0000000030")))


_ORDERS = """o AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS row_key, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS cell_key, o_totalprice AS value, epoch_us(o_orderdate) AS ts FROM orders)"""


@query(f"WITH {_ORDERS} SELECT row_key, cell_key, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY cell_key) AS n FROM o WHERE cell_key > '0000005000') WHERE n <= 3")
def cell_page(spark, d):
    log = encoders.orders(_t(spark, d, "orders"))
    return _flat(scan.scan(log, encoders.ORDERS, RowFilter((CellFilter("order", page=CellPage(3, "0000005000")),))))


@query(f"WITH {_ORDERS} SELECT row_key, max(cell_key) AS after FROM (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY cell_key) AS n FROM o) WHERE n <= 3 GROUP BY 1")
def next_cell_page(spark, d):
    log = encoders.orders(_t(spark, d, "orders"))
    return resolve.page_cursor(scan.scan(log, encoders.ORDERS, RowFilter((CellFilter("order", page=CellPage(3)),)))).select("row_key", "after")


@query(f"WITH {_EVENTS} SELECT row_key, cell_key, value, ts FROM ver WHERE version = 1 AND value > 50")
def value_matcher(spark, d):
    return _flat(scan.scan(_events(spark, d), encoders.EVENTS, RowFilter((CellFilter("ev", matcher=lambda v, ts: v > 50),))))


@query(f"WITH {_RETAINED} SELECT row_key, cell_key, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY row_key, cell_key ORDER BY version) AS n FROM kept WHERE value > 20) WHERE n <= 2")
def value_matcher_versions(spark, d):
    return _flat(scan.scan(_events(spark, d), encoders.EVENTS, RowFilter((CellFilter("ev", versions=2, matcher=lambda v, ts: v > 20),))))


_CUSTOMERS = """cells AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS row_key, 'attr' AS column_name, k AS cell_key, v AS value, CAST(0 AS BIGINT) AS ts
  FROM (SELECT c_custkey, unnest(['c_mktsegment', 'c_name', 'c_nationkey']) AS k, unnest([c_mktsegment, c_name, CAST(c_nationkey AS VARCHAR)]) AS v FROM customer)
  UNION ALL SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0'), 'order', lpad(CAST(o_orderkey AS VARCHAR), 10, '0'), o_orderstatus, epoch_us(o_orderdate) FROM orders)"""


def _customers(spark, d):
    return encoders.customers(_t(spark, d, "customer"), _t(spark, d, "orders"))


@query(f"""WITH {_CUSTOMERS}, n AS (SELECT *, row_number() OVER (PARTITION BY row_key, column_name ORDER BY cell_key) - 1 AS cell_idx FROM cells)
SELECT row_key, cell_idx, {", ".join(f"max(CASE WHEN column_name = '{c}' THEN {x} END) AS {c}_{y}" for c in ("attr", "order") for x, y in (("cell_key", "key"), ("value", "value"), ("ts", "ts")))} FROM n GROUP BY 1, 2""")
def grid_view(spark, d):
    schema = encoders.CUSTOMERS
    return views.grid_view(scan.scan(_customers(spark, d), schema), schema.columns).withColumn("cell_idx", F.col("cell_idx").cast("long"))


@query(f"""WITH {_CUSTOMERS} SELECT row_key, sum(CASE WHEN column_name = 'attr' THEN 1 ELSE 0 END) AS n_attr, sum(CASE WHEN column_name = 'order' THEN 1 ELSE 0 END) AS n_order,
  string_agg(cell_key || '=' || value, ',' ORDER BY cell_key) FILTER (column_name = 'order') AS orders FROM cells GROUP BY 1""")
def row_view(spark, d):
    rows = views.row_view(scan.scan(_customers(spark, d), encoders.CUSTOMERS), encoders.CUSTOMERS.columns)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    n = lambda c: F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(size(c))
    shown = F.array_join(F.transform("order", lambda x: F.concat(x["cell_key"], F.lit("="), x["values"][0]["value"])), ",")
    return rows.select("row_key", n("attr").alias("n_attr"), n("order").alias("n_order"), shown.alias("orders"))


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1),
s AS (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier WHERE s_nationkey % 3 = 0 GROUP BY 1)
SELECT lpad(CAST(coalesce(c.k, s.k) AS VARCHAR), 10, '0') AS row_key, n_customers, n_suppliers FROM c FULL JOIN s ON c.k = s.k""")
def merge_join(spark, d):
    c = _t(spark, d, "customer").where("c_nationkey % 2 = 0").groupBy(padded(F.col("c_nationkey")).alias("row_key")).agg(F.count("*").alias("n"))
    s = resolve.latest(encoders.suppliers(_t(spark, d, "supplier"))).where("cast(row_key as int) % 3 = 0").groupBy("row_key").agg(F.count("*").alias("n"))
    return join.merge_join([c, s], ["c", "s"]).select("row_key", F.col("c.n").alias("n_customers"), F.col("s.n").alias("n_suppliers"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_totalprice FROM orders), l AS (SELECT l_orderkey AS k, count(*) AS n_lines FROM lineitem GROUP BY 1)
SELECT lpad(CAST(coalesce(o.k, l.k) AS VARCHAR), 10, '0') AS row_key, o_totalprice, n_lines FROM o FULL JOIN l ON o.k = l.k""")
def merge_join_orders(spark, d):
    o = _t(spark, d, "orders").select(padded(F.col("o_orderkey")).alias("row_key"), "o_totalprice")
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).select(padded(F.col("l_orderkey")).alias("row_key"), "n")
    return join.merge_join([o, lines], ["o", "l"]).select("row_key", "o.o_totalprice", F.col("l.n").alias("n_lines"))


@query("""WITH o AS (SELECT o_custkey AS k, max(o_totalprice) AS top FROM orders GROUP BY 1)
SELECT lpad(CAST(coalesce(c_custkey, k) AS VARCHAR), 10, '0') AS row_key, c_mktsegment || '_' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS customer_key, top FROM customer FULL JOIN o ON c_custkey = k AND top > c_acctbal""")
def merge_join_mapped_keys(spark, d):
    c = _t(spark, d, "customer").select(F.concat_ws("_", "c_mktsegment", padded(F.col("c_custkey"))).alias("row_key"), "c_acctbal")
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top")).select(padded(F.col("o_custkey")).alias("row_key"), "top")
    out = join.merge_join([c, o], ["c", "o"], keys=[lambda k: F.substring_index(k, "_", -1), lambda k: k], condition=lambda x, y: y["top"] > x["c_acctbal"])
    return out.select("row_key", F.col("c.row_key").alias("customer_key"), "o.top")


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation), c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT lpad(CAST(n.k AS VARCHAR), 10, '0') AS row_key, c.n AS n_customers, s.n AS n_suppliers FROM n LEFT JOIN c ON n.k = c.k LEFT JOIN s ON n.k = s.k""")
def merge_join_three(spark, d):
    n = _t(spark, d, "nation").select(padded(F.col("n_nationkey")).alias("row_key"))
    count = lambda t, k: _t(spark, d, t).groupBy(padded(F.col(k)).alias("row_key")).agg(F.count("*").alias("n"))
    out = join.merge_join([n, count("customer", "c_nationkey"), count("supplier", "s_nationkey")], ["a", "c", "s"], "left")
    return out.select("row_key", F.col("c.n").alias("n_customers"), F.col("s.n").alias("n_suppliers"))


@query(f"""WITH {_EVENTS}, k AS (SELECT DISTINCT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS row_key FROM supplier)
SELECT k.row_key, cell_key, value, ts FROM k LEFT JOIN (SELECT * FROM ver WHERE version = 1) v ON k.row_key = v.row_key""")
def multi_get(spark, d):
    keys = _t(spark, d, "supplier").select(padded(F.col("s_suppkey")).alias("row_key"))
    return _flat(scan.multi_get(_events(spark, d), encoders.EVENTS, keys))


@query(f"""WITH {_ACTIVITY}, k AS (SELECT DISTINCT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS row_key FROM supplier)
SELECT row_key, row_key IN (SELECT row_key FROM newest WHERE version = 1 AND NOT deleted AND cell_key = 'h03') AS has_value FROM k""")
def has_value(spark, d):
    keys = _t(spark, d, "supplier").select(padded(F.col("s_suppkey")).alias("row_key"))
    return scan.exists(encoders.activity(_t(spark, d, "events")), encoders.ACTIVITY, keys, "h", "h03")


@query(f"WITH {_ORDERS} SELECT min(row_key) AS row_key FROM o WHERE row_key >= '0000000100'")
def nearest_key(spark, d):
    return scan.nearest_key(encoders.orders(_t(spark, d, "orders")), "0000000100")


@query(f"""WITH {_ORDERS}, k AS (SELECT DISTINCT row_key FROM o), p AS (SELECT DISTINCT lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS probe FROM part)
SELECT probe, row_key FROM p ASOF LEFT JOIN k ON probe <= row_key""")
def nearest_keys(spark, d):
    return scan.nearest_keys(encoders.orders(_t(spark, d, "orders")), _t(spark, d, "part").select(padded(F.col("p_partkey")).alias("probe")))


@query(f"WITH {_RETAINED} SELECT row_key, cell_key, value, ts FROM kept")
def compaction(spark, d):
    return _flat(write.compact(_events(spark, d), encoders.EVENTS))


@query(f"WITH {_EVENTS} SELECT row_key, cell_key, value, ts FROM ev")
def sorted_load(spark, d):
    return _flat(write.sorted_load(_events(spark, d))).distinct()


def _cql(spark, d, text: str, row_cap: int | None = None) -> DataFrame:
    store = Store(spark, "attached")
    store.attach(encoders.EVENTS, _events(spark, d))
    return cql.execute(store, text, ticks_per_ms=1000, row_cap=row_cap).rows.withColumn("cell_idx", F.col("cell_idx").cast("long"))


def _grid(where: str, source: str = "ver", base: str = _EVENTS) -> str:
    return f"WITH {base}, g AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY cell_key, ts DESC) - 1 AS cell_idx FROM {source} WHERE {where}) SELECT row_key, cell_idx, cell_key AS ev_key, value AS ev_value, ts AS ev_ts FROM g"


@query(_grid("version = 1"))
def cql_select_all(spark, d):
    return _cql(spark, d, "SELECT * FROM t_events")


@query(_grid("version = 1 AND row_key = '0000000012'"))
def cql_select_row(spark, d):
    return _cql(spark, d, "select ev from t_events where ROWKEY = '0000000012';")


@query(_grid("version = 1 AND starts_with(row_key, '000000001')"))
def cql_select_like(spark, d):
    return _cql(spark, d, "SELECT * FROM t_events WHERE rowkey LIKE '000000001'")


@query(_grid("version = 1 AND row_key BETWEEN '0000000010' AND '0000000090' AND cell_key = 'view'"))
def cql_select_between_and_cell(spark, d):
    return _cql(spark, d, "SELECT ev FROM t_events WHERE rowkey BETWEEN '0000000010' AND '0000000090' AND ev = 'view'")


@query(_grid("version = 1 AND cell_key > 'click' AND row_key IN (SELECT row_key FROM (SELECT DISTINCT row_key FROM ver WHERE cell_key > 'click' ORDER BY 1 LIMIT 5000))"))
def cql_select_compare(spark, d):
    return _cql(spark, d, "SELECT ev FROM t_events WHERE ev > 'click'", row_cap=5000)


@query(_grid("ts BETWEEN 1704844800000000 AND 1705795199000000 AND starts_with(row_key, '0000')", "kept", _RETAINED))
def cql_select_time_range(spark, d):
    return _cql(spark, d, "SELECT ev FROM t_events WHERE rowkey LIKE '0000' AND ev.timestamp BETWEEN '20240110' AND '20240120'")


_TERM = "[-~?<>=”“△/(),.·;’‘\\s\\[\\]\\n\\r]+"
_TERMS = f"""tok AS (SELECT doc_id, strlen(text) AS n, unnest(list_filter(list_transform(string_split_regex(text, '{_TERM}'), lambda x: trim(x)), lambda x: length(x) >= 2)) AS term FROM documents WHERE text <> ''),
tf AS (SELECT term, doc_id, n, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
tot AS (SELECT CAST(sum(strlen(text)) AS BIGINT) AS doc_length, count(*) AS doc_count FROM documents WHERE text <> ''),
w AS (SELECT term, doc_id, tf, df, round((tf * 0.9::DOUBLE / (tf + (0.75::DOUBLE + 0.25::DOUBLE * n / (doc_length // doc_count)) * 2.0::DOUBLE) + 0.1::DOUBLE)
  * (ln((doc_count - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) / ln((doc_count - 1 + 0.5::DOUBLE) / (1 + 0.5::DOUBLE))), 10) AS weight FROM tf JOIN df USING (term), tot)"""


def _weight_parts(spark, d):
    return [w.withColumn("weight", F.round("weight", 10)) for w in jobs.weight_parts(_t(spark, d, "documents"))]


def _weights(spark, d):
    common, others = _weight_parts(spark, d)
    return common.unionByName(others)


@query("SELECT CAST(sum(strlen(text)) AS BIGINT) AS doc_length, count(*) AS doc_count FROM documents WHERE text <> ''")
def corpus_totals(spark, d):
    return jobs.corpus_totals(_t(spark, d, "documents"))


@query(f"WITH {_TERMS} SELECT term, df FROM df")
def document_frequency(spark, d):
    return jobs.document_frequency(_t(spark, d, "documents"))


@query("SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: length(x) >= 2)) AS term FROM documents) GROUP BY 1")
def document_frequency_by_space(spark, d):
    return jobs.document_frequency(_t(spark, d, "documents"), lambda c: terms(c, r"\s+"))


@query(f"WITH {_TERMS} SELECT term, doc_id, tf, df, weight FROM w")
def term_weights(spark, d):
    return _weights(spark, d)


@query(f"WITH {_TERMS} SELECT term, row_number() OVER (PARTITION BY term ORDER BY weight DESC, doc_id) AS rank, doc_id, df, tf, weight FROM w")
def term_postings(spark, d):
    common, others = _weight_parts(spark, d)
    return jobs.postings(common, others=others).select("term", F.col("rank").cast("long").alias("rank"), "doc_id", "df", "tf", "weight")


@query(f"WITH {_TERMS} SELECT 'with' AS term, doc_id, df, weight, source FROM w JOIN documents USING (doc_id) WHERE term = 'with' ORDER BY weight DESC, doc_id LIMIT 10")
def index_search(spark, d):
    return jobs.search(_weights(spark, d), _t(spark, d, "documents"), "with")


_LINKS = """out AS (SELECT url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS target, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS anchor FROM pages)"""


@query("SELECT url AS row_key, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS target FROM pages")
def out_links(spark, d):
    return _t(spark, d, "pages").select(F.col("url").alias("row_key"), F.explode(links(F.col("html"))).alias("target"))


@query(f"WITH {_LINKS}, one AS (SELECT url, target, arg_max(anchor, nth) AS anchor FROM (SELECT *, row_number() OVER () AS nth FROM out) GROUP BY 1, 2) SELECT target AS row_key, anchor AS cell_key, url AS value, row_number() OVER (PARTITION BY target, anchor ORDER BY url) AS ts FROM one")
def in_links(spark, d):
    cells = scan.scan(encoders.pages(_t(spark, d, "pages")), encoders.PAGES, RowFilter.of("outlink"))
    return jobs.in_links(cells).select("row_key", "cell_key", "value", "ts")


@query(f"WITH {_LINKS} SELECT DISTINCT target AS row_key, url AS cell_key FROM out")
def inverted_cells(spark, d):
    return jobs.inverted(scan.scan(encoders.pages(_t(spark, d, "pages")), encoders.PAGES, RowFilter.of("outlink")))


_MATRIX = "m AS (SELECT vec_id, unnest(range(len(embedding))) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


@query(f"WITH {_MATRIX} SELECT CAST(a.c AS VARCHAR) AS row, CAST(b.c AS VARCHAR) AS col, round(sum(a.v * b.v), 6) AS value FROM m a JOIN m b USING (vec_id) GROUP BY 1, 2")
def matrix_product(spark, d):
    m = encoders.matrix(_t(spark, d, "embeddings"), "vec_id", "embedding")
    return jobs.multiply(jobs.transpose(m), m).withColumn("value", F.round("value", 6))


@query("SELECT round(corr(l_quantity, l_extendedprice), 9) AS pearson, round(sqrt(sum((l_discount - l_tax) * (l_discount - l_tax))), 6) AS euclidean FROM lineitem")
def correlations(spark, d):
    q = F.col
    return _t(spark, d, "lineitem").agg(F.round(jobs.pearson(q("l_quantity"), q("l_extendedprice")), 9).alias("pearson"), F.round(jobs.euclidean(q("l_discount"), q("l_tax")), 6).alias("euclidean"))


@query("SELECT count(DISTINCT user_id) AS n FROM events")
def row_count(spark, d):
    return jobs.row_count(_events(spark, d))


@query("SELECT CAST(part AS INTEGER) AS part, max(key) AS bound FROM (SELECT key, ntile(8) OVER (ORDER BY key) AS part FROM (SELECT DISTINCT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key FROM orders)) WHERE part < 8 GROUP BY 1")
def range_bounds(spark, d):
    return jobs.range_bounds(_t(spark, d, "orders").select(padded(F.col("o_orderkey")).alias("key")), 8)


@query("""SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS row_key, unnest(['segment', 'name']) AS column_name, unnest([c_mktsegment, c_name]) AS cell_key, unnest([c_name, CAST(c_nationkey AS VARCHAR)]) AS value FROM customer""")
def text_upload(spark, d):
    lines = _t(spark, d, "customer").select(F.concat_ws("|", padded(F.col("c_custkey")), "c_mktsegment", "c_name", F.col("c_nationkey").cast("string")).alias("value"))
    return files.delimited(lines, ["segment", "name"], [0, 1, 2], "|", key_value=True).select("row_key", "column_name", "cell_key", "value")


@query("""WITH r AS (SELECT '/2_/' || c_mktsegment || '/' || c_custkey AS row_key FROM customer) SELECT row_key FROM r WHERE starts_with(row_key, '/2_/BUILDING/')""")
def tree_children(spark, d):
    rows = _t(spark, d, "customer").select(blobs.tree_key(F.concat_ws("/", F.lit(""), "c_mktsegment", F.col("c_custkey").cast("string"))).alias("row_key"))
    return blobs.children(rows, "/BUILDING")


@query("""WITH b AS (SELECT p_brand AS path, sum(p_size) AS bytes, sum(CASE WHEN p_size > 25 THEN p_size ELSE 0 END) AS dead FROM part GROUP BY 1)
SELECT path, CAST(bytes AS BIGINT) AS bytes, CAST(dead AS BIGINT) AS dead_bytes, dead / CAST(bytes AS DOUBLE) AS dead_share FROM b WHERE dead / CAST(bytes AS DOUBLE) >= 0.3""")
def blob_garbage(spark, d):
    return blobs.garbage(_t(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_size").cast("long").alias("length"), (F.col("p_size") > 25).alias("deleted")))


@query(f"WITH {_EVENTS} SELECT row_key, round(sum(value), 6) AS total FROM ver WHERE version = 1 GROUP BY 1 HAVING sum(value) > 100")
def sum_of_cells_having(spark, d):
    return scan.scan(_events(spark, d), encoders.EVENTS).groupBy("row_key").agg(F.sum("value").alias("s")).where("s > 100").select("row_key", F.round("s", 6).alias("total"))


@query(f"""WITH {_ORDERS}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY cell_key) AS n FROM o) WHERE n <= 5)
SELECT t.row_key, t.cell_key, count(*) AS n_lines FROM t JOIN lineitem ON lpad(CAST(l_orderkey AS VARCHAR), 10, '0') = t.cell_key GROUP BY 1, 2""")
def join_on_top_cells(spark, d):
    top = scan.scan(encoders.orders(_t(spark, d, "orders")), encoders.ORDERS, RowFilter((CellFilter("order", page=CellPage(5)),)))
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines")).select(padded(F.col("l_orderkey")).alias("cell_key"), "n_lines")
    return top.join(lines, "cell_key").select("row_key", "cell_key", "n_lines")


@query("SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS row_key, 'order' AS source FROM orders UNION ALL SELECT lpad(CAST(s_nationkey AS VARCHAR), 10, '0'), 'supplier' FROM supplier")
def union_of_tables(spark, d):
    a, b = encoders.orders(_t(spark, d, "orders")), encoders.suppliers(_t(spark, d, "supplier"))
    return a.unionByName(b.withColumn("value", F.lit(None).cast("double"))).select("row_key", F.col("column_name").alias("source"))


def _stream(spark, d) -> DataFrame:
    kinds = spark.read.parquet(f"{d}/events.parquet").schema
    return encoders.events(prepare(spark).readStream.schema(kinds).parquet(f"{d}/events.parquet*"))


@query(f"WITH {_EVENTS} SELECT row_key, cell_key, value, ts FROM ver WHERE version = 1")
def streaming_ingest(spark, d):
    """A stream of records appended to a table, then read like any other."""
    root = work_folder(spark, "stream")
    store = Store(spark, f"{root}/tables")
    store.create("t_stream", "ev")
    ingest(store, "t_stream", _stream(spark, d).withColumn("value", F.col("value").cast("string")), f"{root}/state").awaitTermination()
    return _flat(store.cells("t_stream")).withColumn("value", F.col("value").cast("double"))


@query(f"WITH {_EVENTS} SELECT row_key, cell_key, value, ts FROM ver WHERE version = 1")
def streaming_latest(spark, d):
    """A stateful stream that keeps each cell's newest version; a batch writes the cells that it changed."""
    root = work_folder(spark, "latest")

    def write_batch(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/view/batch={number}")

    latest_view(_stream(spark, d)).writeStream.outputMode("update").foreachBatch(write_batch).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.parquet(f"{root}/view")
    last = changes.groupBy(*resolve.CELL).agg(F.max_by(F.struct("value", "ts", "deleted"), "batch").alias("v")).select(*resolve.CELL, "v.*")
    return _flat(last.where(~F.col("deleted")))


@query(f"WITH {_EVENTS} SELECT row_key, cell_key, value, ts FROM ev")
def backup_and_restore(spark, d):
    """A backup as text and the records restored from it."""
    path = work_folder(spark, "backup") + "/files"
    files.backup_csv(_events(spark, d).withColumn("value", F.col("value").cast("string")), path)
    return _flat(files.restore_csv(spark, path)).withColumn("value", F.col("value").cast("double"))


# Reads of chosen columns and rows, in pages and in order


_CELLS = f"WITH {_CUSTOMERS} SELECT row_key, column_name, cell_key, value FROM cells WHERE "


def _cells(cells: DataFrame) -> DataFrame:
    return cells.select("row_key", "column_name", "cell_key", "value")


@query(_CELLS + "row_key = '0000000007' AND column_name = 'attr'")
def get_columns(spark, d):
    return _cells(scan.get(_customers(spark, d), encoders.CUSTOMERS, "0000000007", "attr"))


@query(_CELLS + "row_key = '0000000007' AND (column_name = 'attr' AND cell_key BETWEEN 'c_m' AND 'c_nb' OR column_name = 'order' AND cell_key > '0000005000')")
def get_row_filter(spark, d):
    """One row by a filter with a rule for each of two families, through a store."""
    store = Store(spark, "attached")
    store.attach(encoders.CUSTOMERS, _customers(spark, d))
    rows = store.get_row("t_customers", RowFilter((CellFilter("attr", start="c_m", end="c_nb"), CellFilter("order", page=CellPage(1000, "0000005000"))), key="0000000007"))
    each = [rows.select("row_key", F.lit(c).alias("column_name"), F.explode(c).alias("x")) for c in ("attr", "order")]
    return each[0].unionByName(each[1]).select("row_key", "column_name", F.col("x.cell_key").alias("cell_key"), F.element_at("x.values", 1)["value"].alias("value"))


@query(f"WITH {_EVENTS} SELECT row_key, row_number() OVER (ORDER BY row_key) - 1 AS place, count(*) AS n_cells FROM ver WHERE version = 1 GROUP BY 1")
def row_iterator(spark, d):
    """All rows from an iterator, in key order."""
    rows = scan.iterate(_events(spark, d), encoders.EVENTS, RowFilter.of("ev", page_size=20))
    found = [(r.row_key, i, len(r.ev)) for i, r in enumerate(rows)]
    return spark.createDataFrame(found, "row_key string, place long, n_cells long")


@query(f"WITH {_ORDERS}, p AS (SELECT *, row_number() OVER (ORDER BY cell_key) - 1 AS n FROM o WHERE row_key = '0000000007') SELECT n // 4 AS page, cell_key, value FROM p")
def cell_page_cursor(spark, d):
    """One row's cells, a page of four at a time, each from the cursor of the page before."""
    store = Store(spark, "attached")
    store.attach(encoders.ORDERS, encoders.orders(_t(spark, d, "orders")))
    found, after, page = [], None, 0
    while True:
        rows, after = store.page_of_cells("t_orders", "0000000007", "order", 4, after)
        found += [(page, r.cell_key, r.value) for r in rows]
        if after is None:
            return spark.createDataFrame(found, "page long, cell_key string, value double")
        page += 1


@query(f"WITH {_CUSTOMERS} SELECT row_number() OVER (ORDER BY row_key, column_name = 'attr', cell_key) - 1 AS place, row_key, column_name, cell_key FROM cells ORDER BY 1 LIMIT 500")
def ordered_scan(spark, d):
    """The first 500 cells in scan order: by row, then by the columns as asked for, then by cell key."""
    cells = scan.scan(_customers(spark, d), encoders.CUSTOMERS, RowFilter.of("order", "attr"))
    first = scan.ordered_cells(cells, ("order", "attr")).limit(500)
    return first.withColumn("place", F.monotonically_increasing_id()).select("place", "row_key", "column_name", "cell_key")


@query(f"WITH {_CUSTOMERS} SELECT row_key, count(*) AS n_cells, row_number() OVER (ORDER BY row_key) - 1 AS place FROM cells GROUP BY 1 ORDER BY 1 LIMIT 100")
def ordered_row_view(spark, d):
    rows = scan.ordered_rows(scan.scan(_customers(spark, d), encoders.CUSTOMERS), encoders.CUSTOMERS.columns).limit(100)
    n = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    return rows.withColumn("place", F.monotonically_increasing_id()).select("row_key", (n("attr") + n("order")).cast("long").alias("n_cells"), "place")


@query(f"WITH {_EVENTS}, few AS (SELECT DISTINCT row_key FROM ver WHERE starts_with(row_key, '00000000') ORDER BY 1 LIMIT 17) SELECT row_key, cell_key, value, ts FROM ver JOIN few USING (row_key) WHERE version = 1")
def row_cap(spark, d):
    """A prefix read with a cap on rows that binds."""
    return _flat(scan.gets(_events(spark, d), encoders.EVENTS, RowFilter.of("ev", prefix="00000000", page_size=17)))


@query(f"WITH {_TERMS}, r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY weight DESC, doc_id) AS rank FROM w) SELECT term, rank, doc_id, weight FROM r WHERE rank <= 7")
def capped_postings(spark, d):
    """Postings with a cap that binds."""
    common, others = _weight_parts(spark, d)
    return jobs.postings(common, cap=7, others=others).select("term", F.col("rank").cast("long").alias("rank"), "doc_id", "weight")


# Tables that are written, changed and read


def _store(spark, what: str) -> Store:
    """A store in a folder of its own whose clock ticks by one."""
    ticks = iter(range(1000, 10**9))
    return Store(spark, f"{work_folder(prepare(spark), what)}/tables", clock=lambda: next(ticks))


def _as_text(log: DataFrame) -> DataFrame:
    return log.withColumn("value", F.col("value").cast("string"))


@query("SELECT lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS row_key, k AS column_name, CASE k WHEN 'name' THEN '' ELSE lpad(CAST(n_regionkey AS VARCHAR), 10, '0') END AS cell_key, CASE k WHEN 'name' THEN n_name END AS value FROM nation, (SELECT unnest(['name', 'region']) AS k) WHERE n_nationkey <> 3 AND NOT (n_nationkey = 5 AND k = 'region')")
def put_flush_remove(spark, d):
    """Rows put into a buffer and flushed at once; then a row and a cell are removed."""
    store = _store(spark, "put")
    store.create("t_nation", "name", "region")
    for r in _t(spark, d, "nation").orderBy("n_nationkey").limit(1000).collect():
        store.put("t_nation", f"{r.n_nationkey:010d}", {"name": [("", r.n_name)], "region": [(f"{r.n_regionkey:010d}", None)]}, flush=False)
    store.flush("t_nation")
    store.remove_row("t_nation", "0000000003")
    store.remove("t_nation", "0000000005", "region")
    return _cells(store.cells("t_nation"))


@query(f"WITH {_EVENTS} SELECT row_key, cell_key, value, ts FROM ver WHERE version = 1")
def out_of_order_load(spark, d):
    """The later half of the records is loaded before the earlier half."""
    store, log = _store(spark, "late"), _as_text(_events(spark, d))
    store.create("t_events", "ev")
    for half in ("ts >= 1705276800000000", "ts < 1705276800000000"):
        store.load("t_events", log.where(half))
    return _flat(store.cells("t_events")).withColumn("value", F.col("value").cast("double"))


@query(f"WITH {_RETAINED} SELECT row_key, cell_key, value, ts FROM kept WHERE version <= 2")
def compacted_table(spark, d):
    """A stored table after its log was rewritten with the retained versions."""
    store = _store(spark, "compact")
    store.create("t_events", "ev")
    store.load("t_events", _as_text(_events(spark, d)))
    store.compact("t_events")
    return _flat(store.cells("t_events", RowFilter((CellFilter("ev", versions=2),)))).withColumn("value", F.col("value").cast("double"))


@query("SELECT lpad(CAST(r_regionkey AS VARCHAR), 10, '0') AS row_key, CAST(0 AS BIGINT) AS cell_idx, 'name' AS name_key, CASE r_regionkey WHEN 1 THEN 'changed' ELSE r_name END AS name_value, CASE WHEN r_regionkey <> 2 THEN 'k' END AS kind_key, CASE WHEN r_regionkey <> 2 THEN 'region' END AS kind_value FROM region WHERE r_regionkey <> 4")
def cql_table_life(spark, d):
    """CREATE, INSERT, DELETE of a cell and of a row, and SELECT, all as statements."""
    store = _store(spark, "cql")
    store.sql("CREATE TABLE t_region (name, kind) VERSION = 2 COMMENT = 'regions'")
    for r in _t(spark, d, "region").limit(100).collect():
        store.sql(f"INSERT INTO t_region (name, kind) VALUES (('name', '{r.r_name}'), ('k', 'region')) WHERE rowkey = '{r.r_regionkey:010d}'")
    store.sql("INSERT INTO t_region (name) VALUES (('name', 'changed')) WHERE rowkey = '0000000001'")
    store.sql("DELETE kind FROM t_region WHERE rowkey = '0000000002' AND kind = 'k'")
    store.sql("DELETE * FROM t_region WHERE rowkey = '0000000004'")
    return store.sql("SELECT * FROM t_region").rows.drop("name_ts", "kind_ts").withColumn("cell_idx", F.col("cell_idx").cast("long"))


def _loaded(spark, d, what: str) -> Store:
    store = _store(spark, what)
    store.create("t_customers", "attr", "order", num_versions=0, bounds=("0000000500", "0000001000"))
    store.load("t_customers", _customers(spark, d))
    return store


@query(f"WITH {_CUSTOMERS} SELECT column_name, cell_key, value, row_key FROM cells WHERE column_name = 'attr' AND row_key <= '0000000100' UNION ALL SELECT 'note', 'n', 'new', '0000000001'")
def changed_columns(spark, d):
    """One family is emptied, another is added and written to."""
    store = _loaded(spark, d, "columns")
    store.sql("TRUNCATE COLUMN order FROM t_customers")
    store.add_column("t_customers", "note")
    store.put("t_customers", "0000000001", {"note": [("n", "new")]})
    return _cells(store.cells("t_customers", RowFilter.of("attr", "order", "note", end="0000000100")))


@query("SELECT 't_customers' AS name, CAST(0 AS INTEGER) AS version, 'attr' AS column_name UNION ALL SELECT 't_customers', 0, 'order' UNION ALL SELECT 't_other', 5, 'x1'")
def show_and_describe(spark, d):
    """SHOW TABLES and DESC of what is left after a DROP."""
    store = _store(spark, "show")
    store.create("t_customers", "attr", "order", num_versions=0)
    store.sql("CREATE TABLE t_other (x1) VERSION = 5")
    store.sql("CREATE TABLE t_gone (x1)")
    store.sql("DROP TABLE t_gone")
    tables = store.sql("SHOW TABLES").rows.select("name", "version")
    columns = [store.sql(f"DESC {r.name}").rows.select(F.col("table_name").alias("name"), "column_name") for r in tables.collect()]
    return tables.join(columns[0].unionByName(columns[1]), "name")


@query(f"WITH {_CUSTOMERS} SELECT column_name, count(*) AS records, CAST(sum(strlen(value)) AS BIGINT) AS value_bytes FROM cells GROUP BY 1")
def report_table(spark, d):
    return _loaded(spark, d, "report").sql("REPORT TABLE t_customers").rows.select("column_name", "records", "value_bytes")


@query("""WITH p AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS row_key FROM customer)
SELECT row_key, CASE WHEN row_key > '0000001000' THEN '0000001000' WHEN row_key > '0000000500' THEN '0000000500' END AS low, CASE WHEN row_key <= '0000000500' THEN '0000000500' WHEN row_key <= '0000001000' THEN '0000001000' END AS high FROM p""")
def range_of_key(spark, d):
    """Each key with the range of the table that holds it."""
    store = _store(spark, "ranges")
    store.create("t_customers", "attr", bounds=("0000000500",))
    store.add_range("t_customers", "0000001000")
    ranges = spark.createDataFrame(store.ranges("t_customers"), "low string, high string")
    keys = _t(spark, d, "customer").select(padded(F.col("c_custkey")).alias("row_key"))
    inside = (F.col("low").isNull() | (F.col("row_key") > F.col("low"))) & (F.col("high").isNull() | (F.col("row_key") <= F.col("high")))
    return keys.join(F.broadcast(ranges), inside)


@query("SELECT 'repeated version' AS fault, count(*) AS n FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'null key', count(*) FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'value of a delete marker', count(*) FROM region")
def faults_of_a_log(spark, d):
    """What a check of a log finds where versions were stored twice, keys are null and markers have values."""
    good = _as_text(encoders.customers(_t(spark, d, "customer"), _t(spark, d, "orders").limit(0)))
    twice = good.where("cell_key = 'c_name' and cast(row_key as long) % 10 = 0")
    null = _as_text(encoders.suppliers(_t(spark, d, "supplier").where("s_suppkey % 4 = 0"))).withColumn("row_key", F.lit(None).cast("string"))
    null = null.withColumn("ts", F.monotonically_increasing_id())
    region = _t(spark, d, "region")
    marks = write.records(region, F.col("r_name"), "name", F.lit(""), F.col("r_name"), F.lit(0), F.lit(0), F.lit(True))
    return write.faults(good.unionByName(twice).unionByName(null).unionByName(marks))


@query("SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS row_key, 'o_name' AS column_name, 'c_name' AS cell_key, c_name AS value FROM customer WHERE c_custkey BETWEEN 100 AND 199")
def cql_select_into(spark, d):
    """A SELECT whose cells go into another table, under another column's name."""
    store = _loaded(spark, d, "into")
    store.sql("CREATE TABLE t_names (o_name)")
    store.sql("SELECT BATCH attr FROM t_customers INTO t_names (o_name) WHERE rowkey LIKE '00000001%' AND attr = 'c_name'")
    return _cells(store.cells("t_names"))


@query(f"""WITH {_CUSTOMERS}, top AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS k FROM supplier WHERE s_nationkey = (SELECT min(s_nationkey) FROM supplier) ORDER BY 1 LIMIT 2)
SELECT row_key, cell_key AS attr_key, value AS attr_value FROM cells WHERE column_name = 'attr' AND row_key IN (SELECT k FROM top)""")
def cql_select_in_top(spark, d):
    """Rows whose keys are the first cell keys of a row of another table."""
    store = Store(spark, "attached")
    store.attach(encoders.CUSTOMERS, _customers(spark, d))
    suppliers = encoders.suppliers(_t(spark, d, "supplier"))
    store.attach(encoders.SUPPLIERS, suppliers)
    key = suppliers.agg(F.min("row_key")).first()[0]
    return store.sql(f"SELECT attr FROM t_customers WHERE rowkey IN (SELECT top(supplier, 2) FROM t_suppliers WHERE rowkey = '{key}')").rows.select("row_key", "attr_key", "attr_value")


@query(f"WITH {_EVENTS} SELECT row_key, round(sum(value), 6) AS total FROM ver WHERE version = 1 AND row_key BETWEEN '0000000010' AND '0000000020' GROUP BY 1")
def cql_select_sum(spark, d):
    store = Store(spark, "attached")
    store.attach(encoders.EVENTS, _events(spark, d))
    return store.sql("SELECT sum(ev) FROM t_events WHERE rowkey BETWEEN '0000000010' AND '0000000020'").rows.select("row_key", F.round("sum_ev", 6).alias("total"))


# Values, files and matrices


@query("SELECT url AS row_key, html AS value FROM pages")
def blob_write_and_slice(spark, d):
    """Large values packed into files, and read again by their pointers."""
    folder = work_folder(prepare(spark), "blobs")
    pages = _t(spark, d, "pages").select(F.col("url").alias("row_key"), "html")
    pointers, packed = blobs.packed(pages, "row_key", "html", 40)
    pointers.write.parquet(f"{folder}/pointers")
    packed.write.parquet(f"{folder}/files")
    found = blobs.slices(spark.read.parquet(f"{folder}/pointers"), spark.read.parquet(f"{folder}/files"))
    return found.select("row_key", F.decode("content", "UTF-8").alias("value"))


@query("SELECT '/' || CASE WHEN c_mktsegment = 'BUILDING' THEN '4_/old/b' ELSE '3_/' || c_mktsegment END || '/' || c_nationkey || '/' || c_custkey AS row_key FROM customer WHERE c_mktsegment = 'BUILDING'")
def tree_moved(spark, d):
    """The entries of a folder and of all below it, under their new keys."""
    path = F.concat_ws("/", F.lit(""), "c_mktsegment", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    rows = _t(spark, d, "customer").select(blobs.tree_key(path).alias("row_key"))
    return blobs.moved(rows, "/BUILDING", "/old/b")


@query("SELECT '/2_/' || c_mktsegment || '/' || c_custkey AS row_key FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT '/1_/MACHINERY'")
def tree_subtree(spark, d):
    rows = _t(spark, d, "customer").select(blobs.tree_key(F.concat_ws("/", F.lit(""), "c_mktsegment", F.col("c_custkey").cast("string"))).alias("row_key"))
    folders = _t(spark, d, "customer").select(blobs.tree_key(F.concat(F.lit("/"), "c_mktsegment")).alias("row_key")).distinct()
    return blobs.subtree(rows.unionByName(folders), "/MACHINERY")


@query(f"WITH {_MATRIX} SELECT CAST(vec_id AS VARCHAR) || ',' || CAST(c AS VARCHAR) AS row_key, v AS value FROM m")
def dense_matrix(spark, d):
    return jobs.dense_cells(encoders.matrix(_t(spark, d, "embeddings"), "vec_id", "embedding"))


@query("""WITH r AS (SELECT DISTINCT lpad(CAST(user_id AS VARCHAR), 10, '0') AS row_key, event_type AS item FROM events),
c AS (SELECT a.event_type AS item, b.event_type AS other, round(abs(avg(a.value) - avg(b.value)), 6) AS similarity FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type <> b.event_type WHERE a.user_id < 5 GROUP BY 1, 2)
SELECT row_key, other AS item, round(sum(similarity), 6) AS score FROM r JOIN c USING (item) GROUP BY 1, 2""")
def similar_items(spark, d):
    """For each user the summed similarity of further event types to those they have."""
    e = _t(spark, d, "events").where("user_id < 5").select("user_id", "event_type", "value")
    other = e.select("user_id", F.col("event_type").alias("col"), F.col("value").alias("v"))
    both = e.join(other, "user_id").where("event_type != col").groupBy(F.col("event_type").alias("row"), "col")
    similarity = both.agg(F.round(F.abs(F.avg("value") - F.avg("v")), 6).alias("similarity"))
    ratings = scan.scan(_events(spark, d), encoders.EVENTS).select("row_key", "cell_key")
    return jobs.similar_items(ratings, similarity).withColumn("score", F.round("score", 6))


@query("SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS row_key, CAST(CASE WHEN k = 'c_nationkey' THEN c_nationkey END AS INTEGER) AS number, CASE WHEN k = 'c_mktsegment' THEN c_mktsegment END AS segment FROM customer, (SELECT unnest(['c_nationkey', 'c_mktsegment']) AS k)")
def typed_values(spark, d):
    """Values read as numbers, and as text from the bytes of another character set."""
    cells = scan.scan(_customers(spark, d), encoders.CUSTOMERS, RowFilter((CellFilter("attr"),))).where("cell_key in ('c_nationkey', 'c_mktsegment')")
    coded = Store.decoded(cells.withColumn("value", F.encode("value", "UTF-16")), "UTF-16")
    number = cast_value("int", lenient=True)("value")
    return coded.select("row_key", number.alias("number"), F.when(F.col("cell_key") == "c_mktsegment", F.col("value")).alias("segment"))


@query("SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS row_key, c_name AS value, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def scalar_lookup(spark, d):
    """Each customer's name with that of the nation whose row key a cell holds."""
    customers = _t(spark, d, "customer").select(padded(F.col("c_custkey")).alias("customer"), F.col("c_name").alias("value"), padded(F.col("c_nationkey")).alias("nation_key"))
    nations = write.records(_t(spark, d, "nation"), padded(F.col("n_nationkey")), "name", F.lit(""), F.col("n_name"), F.lit(0), F.lit(0))
    return join.lookup(customers, resolve.latest(nations), "nation_key", {"name": "nation"}).select(F.col("customer").alias("row_key"), "value", "nation")
