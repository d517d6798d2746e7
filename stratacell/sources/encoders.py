"""Logs of cells made from ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import anchors, micros, padded, title
from ..operators.write import records
from ..plans.model import TableSchema

EVENTS = TableSchema("t_events", ("ev",))
ACTIVITY = TableSchema("t_activity", ("h",))
ORDERS = TableSchema("t_orders", ("order",))
CUSTOMERS = TableSchema("t_customers", ("attr", "order"))
SUPPLIERS = TableSchema("t_suppliers", ("supplier",), num_versions=0)
PAGES = TableSchema("t_pages", ("url", "title", "page", "outlink"))


def events(df: DataFrame) -> DataFrame:
    """Row: user; cell: event type; each event a version."""
    return records(df, padded(F.col("user_id")), "ev", F.col("event_type"), F.col("value"), micros(F.col("ts")), F.col("event_id"))


def activity(df: DataFrame) -> DataFrame:
    """Row: user; cell: hour of day. An error deletes its hour's cell."""
    gone = F.col("event_type") == "error"
    value = F.when(~gone, F.col("value"))
    hour = F.concat(F.lit("h"), F.lpad(F.hour(F.col("ts").cast("timestamp_ntz")).cast("string"), 2, "0"))
    return records(df, padded(F.col("user_id")), "h", hour, value, micros(F.col("ts")), F.col("event_id"), gone)


def orders(df: DataFrame) -> DataFrame:
    """Row: customer; cell: order; value: its price."""
    return records(df, padded(F.col("o_custkey")), "order", padded(F.col("o_orderkey")), F.col("o_totalprice"), micros(F.col("o_orderdate")), F.col("o_orderkey"))


def customers(customer: DataFrame, order: DataFrame) -> DataFrame:
    """Two families: attributes of a customer, and the orders."""
    names = ("c_mktsegment", "c_name", "c_nationkey")
    attr = customer.select("c_custkey", F.explode(F.array(*(F.struct(F.lit(n).alias("k"), F.col(n).cast("string").alias("v")) for n in names))).alias("x"))
    key = F.col("c_custkey")
    own = records(attr, padded(key), "attr", F.col("x.k"), F.col("x.v"), F.lit(0), key)
    return own.unionByName(records(order, padded(F.col("o_custkey")), "order", padded(F.col("o_orderkey")), F.col("o_orderstatus"), micros(F.col("o_orderdate")), F.col("o_orderkey")))


def suppliers(df: DataFrame) -> DataFrame:
    """Row: nation; cell: supplier."""
    return records(df, padded(F.col("s_nationkey")), "supplier", padded(F.col("s_suppkey")), F.col("s_name"), F.lit(0), F.col("s_suppkey"))


def pages(df: DataFrame) -> DataFrame:
    """Row: URL; families url, title, page and outlink, whose cells are link targets with anchor texts."""
    base = df.select("page_id", "url", "html")
    key, seq = F.col("url"), F.col("page_id")
    whole = [records(base, key, c, F.lit(""), v, F.lit(0), seq) for c, v in (("url", F.col("url")), ("title", title(F.col("html"))), ("page", F.col("html")))]
    out = base.select("page_id", "url", F.posexplode(anchors(F.col("html"))).alias("at", "x"))
    linked = records(out, key, "outlink", F.col("x.target"), F.col("x.anchor"), F.col("at"), seq)
    return whole[0].unionByName(whole[1]).unionByName(whole[2]).unionByName(linked)


def matrix(df: DataFrame, row: str, vector: str) -> DataFrame:
    """(row, col, value) of a column of vectors."""
    return df.select(F.col(row).cast("string").alias("row"), F.posexplode(vector).alias("c", "v")).select("row", F.col("c").cast("string").alias("col"), F.col("v").cast("double").alias("value"))
