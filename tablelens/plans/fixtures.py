"""Derived inputs shared by the registered queries and their oracle SQL.

The driver tables hold no NULL, no duplicate lineitem rows and no text
numbers, so missing/duplicate/coercion logic is exercised on frames derived
from them by the same expression in Spark and in SQL (see FIXTURES.md).
Every derivation keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

# -- lineitem with gaps: l_discount missing where 0, l_returnflag missing where 'R'
SQL_LINEITEM_GAPS = """(SELECT * REPLACE (
    CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS l_discount,
    CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS l_returnflag)
  FROM lineitem)"""


def lineitem_gaps(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    return (li.withColumn("l_discount", F.when(F.col("l_discount") != 0, F.col("l_discount")))
            .withColumn("l_returnflag", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag"))))


# -- orders with gaps: o_totalprice missing for status 'P', o_orderpriority missing for '5-LOW'
ORDERS_GAPS_COLS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
SQL_ORDERS_GAPS = """(SELECT o_custkey, o_orderstatus,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice,
    o_orderdate,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)"""


def orders_gaps(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    return o.select(
        "o_custkey", "o_orderstatus",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority"))


# -- documents text columns, source missing for 'src0'
SQL_DOCS_GAPS = """(SELECT text, lang, CASE WHEN source = 'src0' THEN NULL ELSE source END AS source
  FROM documents)"""


def docs_gaps(spark: SparkSession, d: str) -> DataFrame:
    doc = read_table(spark, d, "documents")
    return doc.select("text", "lang", F.when(F.col("source") != "src0", F.col("source")).alias("source"))


# -- events with its JSON field as text (numbers held as text) and a date held as text
SQL_EVENTS_TEXT = """(SELECT event_id, ts, user_id, event_type, value, props,
    json_extract_string(props, '$.k') AS k_text,
    strftime(ts, '%Y-%m-%d') AS day_text
  FROM events)"""


def events_text(spark: SparkSession, d: str) -> DataFrame:
    ev = read_table(spark, d, "events")
    return ev.select("*", F.get_json_object("props", "$.k").alias("k_text"),
                     F.date_format("ts", "yyyy-MM-dd").alias("day_text"))


# -- lineitem projection with many duplicate rows
DUP_COLS = ["l_returnflag", "l_linestatus", "l_linenumber"]
SQL_DUP = "(SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem)"


def lineitem_dup(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select(*DUP_COLS)
