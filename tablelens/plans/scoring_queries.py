"""Registered queries for projections and scoring inputs, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import scoring as sc
from ..sources.tables import read_table

DOMAIN_FEATURES = ["c_nationkey", "c_acctbal", "c_mktsegment", "c_name"]


def customer_new_rows(spark: SparkSession, d: str) -> DataFrame:
    """New rows derived from customer: the balance typed as text (empty, junk or out of
    range for three segments) and one segment renamed to a level never seen in training."""
    c = read_table(spark, d, "customer")
    seg = F.col("c_mktsegment")
    bal = (F.when(seg == "BUILDING", F.lit(""))
           .when(seg == "MACHINERY", F.lit("x"))
           .when(seg == "AUTOMOBILE", (F.col("c_acctbal") + 20000).cast("string"))
           .otherwise(F.col("c_acctbal").cast("string")))
    return c.select("c_custkey", "c_nationkey", bal.alias("c_acctbal"),
                    F.when(seg == "HOUSEHOLD", F.lit("UNKNOWN")).otherwise(seg).alias("c_mktsegment"))


SQL_NEW_ROWS = """(SELECT c_custkey, c_nationkey,
    CASE c_mktsegment WHEN 'BUILDING' THEN '' WHEN 'MACHINERY' THEN 'x'
         WHEN 'AUTOMOBILE' THEN CAST(c_acctbal + 20000 AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END AS c_acctbal,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'UNKNOWN' ELSE c_mktsegment END AS c_mktsegment FROM customer)"""


def project_features(spark, d):
    li = read_table(spark, d, "lineitem")
    return fe.project_features(li, ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"], "l_returnflag")


def input_domains(spark, d):
    return sc.input_domains(read_table(spark, d, "customer"), DOMAIN_FEATURES)


def score_validate(spark, d):
    train = read_table(spark, d, "customer")
    doms = sc.fit_domains(train, ["c_nationkey", "c_acctbal", "c_mktsegment"])
    values = sc.domain_values(train, doms)
    return sc.validate_rows(customer_new_rows(spark, d), doms, values).select("c_custkey", "issue", "warning")


def _customer_spec(spark, d) -> fe.FeatureSpec:
    train = read_table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal")
    return fe.fit_features(train, "c_acctbal")


def score_align_columns(spark, d):
    spec = _customer_spec(spark, d)
    new = customer_new_rows(spark, d).drop("c_acctbal")
    return sc.align(new, spec, keep=["c_custkey"])


def append_rows(spark, d):
    train = read_table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    new = customer_new_rows(spark, d).drop("c_acctbal")
    return sc.append_rows(train, new)


QUERIES = {
    "project_features": project_features,
    "input_domains": input_domains,
    "score_validate": score_validate,
    "score_align_columns": score_align_columns,
    "append_rows": append_rows,
}


def oracles() -> dict[str, str]:
    segs = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    dummies = ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS \"c_mktsegment_{s}\"" for s in segs)
    num = "TRY_CAST(trim(n.c_acctbal) AS DOUBLE)"
    return {
        "project_features": "SELECT l_quantity, l_extendedprice, l_discount, l_returnflag FROM lineitem",
        "input_domains": """
WITH h AS (
SELECT 'c_nationkey' AS feature, 0 AS position, CASE WHEN count(DISTINCT c_nationkey) <= 20 THEN 'list' ELSE 'range' END AS kind,
       CAST(min(c_nationkey) AS DOUBLE) AS min_num, CAST(max(c_nationkey) AS DOUBLE) AS max_num,
       count(DISTINCT c_nationkey) AS n_unique FROM customer
UNION ALL
SELECT 'c_acctbal', 1, CASE WHEN count(DISTINCT c_acctbal) <= 20 THEN 'list' ELSE 'range' END,
       min(c_acctbal), max(c_acctbal), count(DISTINCT c_acctbal) FROM customer
UNION ALL SELECT 'c_mktsegment', 2, 'list', NULL, NULL, count(DISTINCT c_mktsegment) FROM customer
UNION ALL SELECT 'c_name', 3, 'list', NULL, NULL, count(DISTINCT c_name) FROM customer),
v AS (SELECT 'c_nationkey' AS feature, CAST(c_nationkey AS VARCHAR) AS value FROM customer
UNION SELECT 'c_acctbal', CAST(c_acctbal AS VARCHAR) FROM customer
UNION SELECT 'c_mktsegment', c_mktsegment FROM customer UNION SELECT 'c_name', c_name FROM customer)
SELECT h.*, v.value FROM h LEFT JOIN v ON h.feature = v.feature AND h.kind = 'list' AND v.value IS NOT NULL""",
        "score_validate": f"""
WITH d AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_nationkey) AS nlo, max(c_nationkey) AS nhi
           FROM customer),
n AS {SQL_NEW_ROWS}
SELECT n.c_custkey,
  CASE WHEN n.c_nationkey IS NULL THEN 'empty: c_nationkey'
       WHEN n.c_nationkey < d.nlo OR n.c_nationkey > d.nhi THEN 'out of range: c_nationkey'
       WHEN n.c_acctbal IS NULL OR trim(n.c_acctbal) = '' THEN 'empty: c_acctbal'
       WHEN {num} IS NULL THEN 'not a number: c_acctbal'
       WHEN {num} < d.lo OR {num} > d.hi THEN 'out of range: c_acctbal' END AS issue,
  CASE WHEN n.c_mktsegment NOT IN (SELECT DISTINCT c_mktsegment FROM customer)
       THEN 'unseen category: c_mktsegment' END AS warning
FROM n, d""",
        "score_align_columns": f"SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey, {dummies} FROM {SQL_NEW_ROWS} n",
        "append_rows": f"""
SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer
UNION ALL
SELECT c_custkey, c_nationkey, c_mktsegment, CAST(NULL AS DOUBLE) FROM {SQL_NEW_ROWS} n""",
    }
