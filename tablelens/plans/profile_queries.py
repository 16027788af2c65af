"""Registered profiling queries (Spark) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import column_stats as cs
from ..operators import outliers, profile
from ..sources.tables import read_table
from . import fixtures as fx
from .sqlgen import SCHEMAS, fence_cte, q, to_number_sql, union_per_column

# First whole number that a double does not hold.
BIG_KEY = 2 ** 53 + 1


def _r(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """Round the named double columns (engines differ in the last bits)."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- Spark side

def table_overview(spark: SparkSession, d: str) -> DataFrame:
    return profile.table_overview(fx.orders_gaps(spark, d))


def preview_rows(spark: SparkSession, d: str) -> DataFrame:
    return profile.preview_rows(read_table(spark, d, "customer"), 10, ["c_custkey"])


def missing_total(spark: SparkSession, d: str) -> DataFrame:
    return profile.missing_total(fx.lineitem_gaps(spark, d))


def missing_by_column(spark: SparkSession, d: str) -> DataFrame:
    return profile.missing_by_column(fx.lineitem_gaps(spark, d))


def duplicate_rows_total(spark: SparkSession, d: str) -> DataFrame:
    return profile.duplicate_rows_total(fx.lineitem_dup(spark, d))


def duplicate_rows_listing(spark: SparkSession, d: str) -> DataFrame:
    return profile.duplicate_rows_listing(fx.lineitem_dup(spark, d))


def duplicate_texts_total(spark: SparkSession, d: str) -> DataFrame:
    """Exact duplicates among documents without moving texts that occur once."""
    return profile.duplicate_rows_total(read_table(spark, d, "documents").select("lang", "text"), method="candidates")


def duplicate_texts_listing(spark: SparkSession, d: str) -> DataFrame:
    found = profile.duplicate_rows_listing(read_table(spark, d, "documents").select("lang", "text"), method="candidates")
    return found.select("lang", F.md5("text").alias("text_md5"))


def unique_by_column(spark: SparkSession, d: str) -> DataFrame:
    return profile.unique_by_column(fx.docs_gaps(spark, d))


def unique_by_column_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return profile.unique_by_column(fx.docs_gaps(spark, d), method="fingerprint")


def duplicate_values_by_column(spark: SparkSession, d: str) -> DataFrame:
    return profile.duplicate_values_by_column(fx.docs_gaps(spark, d))


def min_max_by_column(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their keys moved above 2^53, where a double no longer tells neighbours apart."""
    o = read_table(spark, d, "orders")
    moved = o.withColumn("o_orderkey", F.col("o_orderkey") + F.lit(BIG_KEY))
    return _r(profile.min_max_by_column(moved), ["min_num", "max_num"])


def iqr_outliers(spark: SparkSession, d: str) -> DataFrame:
    res = outliers.iqr_outliers(fx.events_text(spark, d))
    return _r(res, ["q1", "q3", "lower_bound", "upper_bound"])


def outlier_rows(spark: SparkSession, d: str) -> DataFrame:
    return outliers.outlier_rows(read_table(spark, d, "events"), "value")


def column_stats(spark: SparkSession, d: str) -> DataFrame:
    return _r(cs.column_stats(read_table(spark, d, "lineitem")), ["min_num", "max_num"])


def numeric_coercible(spark: SparkSession, d: str) -> DataFrame:
    return profile.numeric_coercible(fx.events_text(spark, d))


def size_estimate(spark: SparkSession, d: str) -> DataFrame:
    return profile.size_estimate(read_table(spark, d, "customer"))


def size_estimate_nested(spark: SparkSession, d: str) -> DataFrame:
    return profile.size_estimate(read_table(spark, d, "embeddings"))


QUERIES = {
    "size_estimate_nested": size_estimate_nested,
    "table_overview": table_overview,
    "preview_rows": preview_rows,
    "missing_total": missing_total,
    "missing_by_column": missing_by_column,
    "duplicate_rows_total": duplicate_rows_total,
    "duplicate_rows_listing": duplicate_rows_listing,
    "duplicate_texts_total": duplicate_texts_total,
    "duplicate_texts_listing": duplicate_texts_listing,
    "unique_by_column": unique_by_column,
    "unique_by_column_fingerprint": unique_by_column_fingerprint,
    "duplicate_values_by_column": duplicate_values_by_column,
    "min_max_by_column": min_max_by_column,
    "iqr_outliers": iqr_outliers,
    "outlier_rows": outlier_rows,
    "column_stats": column_stats,
    "numeric_coercible": numeric_coercible,
    "size_estimate": size_estimate,
}


# ---------------------------------------------------------------- oracle SQL

def _width(t: str) -> int | None:
    return {"bigint": 8, "int": 4, "double": 8, "timestamp_ntz": 8, "boolean": 1}.get(t)


def _bytes_sql(n: str, t: str) -> str:
    if t == "string":
        return f"coalesce(strlen({q(n)}), 0)"
    return f"(CASE WHEN {q(n)} IS NULL THEN 0 ELSE {_width(t)} END)"


def _sql_table_overview() -> str:
    src = fx.SQL_ORDERS_GAPS
    types = {"o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
             "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
    nulls = " + ".join(f"CAST({q(c)} IS NULL AS INTEGER)" for c in fx.ORDERS_GAPS_COLS)
    size = " + ".join(_bytes_sql(c, types[c]) for c in fx.ORDERS_GAPS_COLS)
    return f"""
WITH t AS {src}
SELECT CAST(count(*) AS BIGINT) AS n_rows, 5 AS n_columns, 2 AS n_numeric, 2 AS n_categorical,
       1 AS n_datetime, 0 AS n_boolean,
       CAST(coalesce(sum({nulls}), 0) AS BIGINT) AS missing_total,
       round(coalesce(CAST(sum({nulls}) AS DOUBLE) * 100.0 / nullif(count(*) * 5, 0), 0.0), 4) AS missing_pct,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS BIGINT) AS duplicate_rows,
       CAST(coalesce(sum({size}), 0) AS BIGINT) AS size_bytes
FROM t"""


def _sql_missing_total() -> str:
    cols = [n for n, _, _ in SCHEMAS["lineitem"]]
    nulls = " + ".join(f"CAST({q(c)} IS NULL AS INTEGER)" for c in cols)
    k = len(cols)
    return f"""
SELECT CAST(coalesce(sum({nulls}), 0) AS BIGINT) AS missing_total,
       CAST(count(*) * {k} AS BIGINT) AS n_cells,
       round(coalesce(CAST(sum({nulls}) AS DOUBLE) * 100.0 / nullif(count(*) * {k}, 0), 0.0), 4) AS missing_pct
FROM {fx.SQL_LINEITEM_GAPS} t"""


def _sql_missing_by_column() -> str:
    return union_per_column(SCHEMAS["lineitem"], lambda i, n, t, c: (
        f"SELECT '{n}' AS column_name, {i} AS position, count(*) - count({q(n)}) AS missing, "
        f"round(coalesce(CAST(count(*) - count({q(n)}) AS DOUBLE) * 100.0 / nullif(count(*), 0), 0.0), 4) AS missing_pct "
        f"FROM {fx.SQL_LINEITEM_GAPS} t"))


def _sql_distinct(metric: str) -> str:
    def sel(i, n, t, c):
        if metric == "unique":
            expr = f"count(DISTINCT {q(n)}) AS \"unique\""
        else:
            expr = (f"count(*) - count(DISTINCT {q(n)}) - CAST(count(*) > count({q(n)}) AS BIGINT) "
                    f"AS duplicate_values")
        return f"SELECT '{n}' AS column_name, {i} AS position, {expr} FROM {fx.SQL_DOCS_GAPS} t"
    return union_per_column(SCHEMAS["docs_gaps"], sel)


SQL_BIG_KEYS = f"(SELECT * REPLACE (o_orderkey + {BIG_KEY} AS o_orderkey) FROM orders)"


def _exact_text(n: str, t: str) -> tuple[str, str]:
    """Minimum and maximum digit by digit, for 64-bit whole numbers only."""
    if t != "bigint":
        return "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"
    return f"CAST(min({q(n)}) AS VARCHAR)", f"CAST(max({q(n)}) AS VARCHAR)"


def _sql_min_max() -> str:
    def sel(i, n, t, c):
        if c == "numeric":
            lo, hi = _exact_text(n, t)
            return (f"SELECT '{n}' AS column_name, {i} AS position, round(CAST(min({q(n)}) AS DOUBLE), 6) AS min_num, "
                    f"round(CAST(max({q(n)}) AS DOUBLE), 6) AS max_num, {lo} AS min_str, {hi} AS max_str "
                    f"FROM {SQL_BIG_KEYS} t")
        if c == "datetime":
            return (f"SELECT '{n}', {i}, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), "
                    f"strftime(min({q(n)}), '%Y-%m-%d %H:%M:%S'), strftime(max({q(n)}), '%Y-%m-%d %H:%M:%S') "
                    f"FROM {SQL_BIG_KEYS} t")
        return (f"SELECT '{n}', {i}, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), "
                f"min({q(n)}), max({q(n)}) FROM {SQL_BIG_KEYS} t")
    return union_per_column(SCHEMAS["orders"], sel)


def _sql_iqr_outliers() -> str:
    schema = SCHEMAS["events_text"]
    src = fx.SQL_EVENTS_TEXT

    def sel(i, n, t, c):
        if c not in ("numeric", "categorical"):
            return (f"SELECT '{n}' AS column_name, {i} AS position, CAST(0 AS BIGINT) AS n_numeric, "
                    f"CAST(NULL AS DOUBLE) AS q1, CAST(NULL AS DOUBLE) AS q3, CAST(NULL AS DOUBLE) AS lower_bound, "
                    f"CAST(NULL AS DOUBLE) AS upper_bound, CAST(NULL AS BIGINT) AS outliers")
        x = to_number_sql(n, c)
        lo = f"(f.q1_{i} - 1.5 * (f.q3_{i} - f.q1_{i}))"
        hi = f"(f.q3_{i} + 1.5 * (f.q3_{i} - f.q1_{i}))"
        return (f"SELECT '{n}' AS column_name, {i} AS position, count({x}) AS n_numeric, "
                f"round(any_value(f.q1_{i}), 6) AS q1, round(any_value(f.q3_{i}), 6) AS q3, "
                f"round(any_value({lo}), 6) AS lower_bound, round(any_value({hi}), 6) AS upper_bound, "
                f"CASE WHEN count({x}) = 0 THEN NULL ELSE count(*) FILTER (WHERE {x} < {lo} OR {x} > {hi}) END "
                f"AS outliers FROM {src} t, fences f")
    return f"WITH {fence_cte(src, schema)}\n" + union_per_column(schema, sel)


def _sql_outlier_rows() -> str:
    return """
WITH f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT e.* FROM events e, f
WHERE e.value < f.q1 - 1.5 * (f.q3 - f.q1) OR e.value > f.q3 + 1.5 * (f.q3 - f.q1)"""


def _sql_column_stats() -> str:
    schema = SCHEMAS["lineitem"]

    def sel(i, n, t, c):
        base = (f"SELECT '{n}' AS column_name, {i} AS position, '{t}' AS data_type, "
                f"count(*) - count({q(n)}) AS missing, "
                f"count(*) - count(DISTINCT {q(n)}) - CAST(count(*) > count({q(n)}) AS BIGINT) AS duplicate_values, "
                f"count(DISTINCT {q(n)}) AS \"unique\", ")
        if c == "numeric":
            x = to_number_sql(n, c)
            lo = f"(f.q1_{i} - 1.5 * (f.q3_{i} - f.q1_{i}))"
            hi = f"(f.q3_{i} + 1.5 * (f.q3_{i} - f.q1_{i}))"
            return (base + f"round(CAST(min({q(n)}) AS DOUBLE), 6) AS min_num, round(CAST(max({q(n)}) AS DOUBLE), 6) AS max_num, "
                    f"{_exact_text(n, t)[0]} AS min_str, {_exact_text(n, t)[1]} AS max_str, "
                    f"count(*) FILTER (WHERE {x} < {lo} OR {x} > {hi}) AS outliers FROM lineitem, fences f")
        if c == "datetime":
            return (base + "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), "
                    f"strftime(min({q(n)}), '%Y-%m-%d %H:%M:%S'), strftime(max({q(n)}), '%Y-%m-%d %H:%M:%S'), "
                    f"CAST(NULL AS BIGINT) FROM lineitem")
        return (base + f"CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), min({q(n)}), max({q(n)}), "
                f"CAST(NULL AS BIGINT) FROM lineitem")
    numeric_schema = [(n, t, c) if c == "numeric" else (n, t, "skip") for n, t, c in schema]
    return f"WITH {fence_cte('lineitem', numeric_schema)}\n" + union_per_column(schema, sel)


def _sql_numeric_coercible() -> str:
    def sel(i, n, t, c):
        x = to_number_sql(n, c) if c in ("numeric", "categorical") else "CAST(NULL AS DOUBLE)"
        return (f"SELECT '{n}' AS column_name, {i} AS position, count({x}) AS n_numeric, "
                f"count({x}) > 0 AS is_numeric FROM {fx.SQL_EVENTS_TEXT} t")
    return union_per_column(SCHEMAS["events_text"], sel)


def _sql_size_estimate() -> str:
    return union_per_column(SCHEMAS["customer"], lambda i, n, t, c: (
        f"SELECT '{n}' AS column_name, {i} AS position, CAST(coalesce(sum({_bytes_sql(n, t)}), 0) AS BIGINT) "
        f"AS size_bytes FROM customer"))


def oracles() -> dict[str, str]:
    return {
        "table_overview": _sql_table_overview(),
        "preview_rows": "SELECT * FROM customer ORDER BY c_custkey LIMIT 10",
        "missing_total": _sql_missing_total(),
        "missing_by_column": _sql_missing_by_column(),
        "duplicate_rows_total": f"""
SELECT CAST(sum(k) AS BIGINT) AS n_rows, count(*) AS distinct_rows, CAST(sum(k - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS k FROM {fx.SQL_DUP} t GROUP BY ALL_COLUMNS)""".replace(
            "GROUP BY ALL_COLUMNS", "GROUP BY l_returnflag, l_linestatus, l_linenumber"),
        "duplicate_rows_listing": f"""
SELECT l_returnflag, l_linestatus, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_linenumber) AS rn FROM {fx.SQL_DUP} t)
WHERE rn > 1""",
        "duplicate_texts_total": """
SELECT CAST(sum(k) AS BIGINT) AS n_rows, count(*) AS distinct_rows, CAST(sum(k - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS k FROM documents GROUP BY lang, text)""",
        "duplicate_texts_listing": """
SELECT lang, md5(text) AS text_md5 FROM (
  SELECT lang, text, row_number() OVER (PARTITION BY lang, text) AS rn FROM documents) WHERE rn > 1""",
        "unique_by_column": _sql_distinct("unique"),
        "unique_by_column_fingerprint": _sql_distinct("unique"),
        "duplicate_values_by_column": _sql_distinct("duplicates"),
        "min_max_by_column": _sql_min_max(),
        "iqr_outliers": _sql_iqr_outliers(),
        "outlier_rows": _sql_outlier_rows(),
        "column_stats": _sql_column_stats(),
        "numeric_coercible": _sql_numeric_coercible(),
        "size_estimate": _sql_size_estimate(),
        "size_estimate_nested": """
SELECT 'vec_id' AS column_name, 0 AS position, CAST(8 * count(vec_id) AS BIGINT) AS size_bytes FROM embeddings
UNION ALL SELECT 'embedding', 1, CAST(coalesce(sum(4 * len(list_filter(embedding, lambda x: x IS NOT NULL))), 0) AS BIGINT)
FROM embeddings
UNION ALL SELECT 'label', 2, CAST(4 * count(label) AS BIGINT) FROM embeddings""",
    }
