"""Small helpers that write the DuckDB oracle SQL for per-column results.

The oracle is independent of the Spark code: it is plain SQL over the
same parquet tables, one SELECT per column glued with UNION ALL.
"""

from __future__ import annotations

# Column lists (name, Spark type, class) of the driver tables used by oracles.
SCHEMAS = {
    "lineitem": [
        ("l_orderkey", "bigint", "numeric"), ("l_partkey", "bigint", "numeric"),
        ("l_suppkey", "bigint", "numeric"), ("l_linenumber", "int", "numeric"),
        ("l_quantity", "double", "numeric"), ("l_extendedprice", "double", "numeric"),
        ("l_discount", "double", "numeric"), ("l_tax", "double", "numeric"),
        ("l_returnflag", "string", "categorical"), ("l_linestatus", "string", "categorical"),
        ("l_shipdate", "timestamp_ntz", "datetime"),
    ],
    "orders": [
        ("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"),
        ("o_orderstatus", "string", "categorical"), ("o_totalprice", "double", "numeric"),
        ("o_orderdate", "timestamp_ntz", "datetime"), ("o_orderpriority", "string", "categorical"),
    ],
    "customer": [
        ("c_custkey", "bigint", "numeric"), ("c_name", "string", "categorical"),
        ("c_nationkey", "int", "numeric"), ("c_acctbal", "double", "numeric"),
        ("c_mktsegment", "string", "categorical"),
    ],
    "events": [
        ("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "datetime"),
        ("user_id", "bigint", "numeric"), ("event_type", "string", "categorical"),
        ("value", "double", "numeric"), ("props", "string", "categorical"),
    ],
    "events_text": [
        ("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "datetime"),
        ("user_id", "bigint", "numeric"), ("event_type", "string", "categorical"),
        ("value", "double", "numeric"), ("props", "string", "categorical"),
        ("k_text", "string", "categorical"), ("day_text", "string", "categorical"),
    ],
    "docs_gaps": [("text", "string", "categorical"), ("lang", "string", "categorical"),
                  ("source", "string", "categorical")],
}

NUM_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INF_RE = r"^[+-]?([iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])$"


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def to_number_sql(col: str, cls: str) -> str:
    """SQL twin of the outlier-context numeric coercion."""
    c = q(col)
    if cls == "numeric":
        return f"CAST({c} AS DOUBLE)"
    if cls == "boolean":
        return f"CAST(CAST({c} AS INTEGER) AS DOUBLE)"
    if cls == "categorical":
        t = f"trim({c})"
        return (f"(CASE WHEN regexp_matches({t}, '{NUM_RE}') THEN "
                f"(CASE WHEN abs(TRY_CAST({t} AS DOUBLE)) = 'inf'::DOUBLE THEN NULL ELSE TRY_CAST({t} AS DOUBLE) END) "
                f"WHEN regexp_matches({t}, '{INF_RE}') THEN "
                f"(CASE WHEN left({t}, 1) = '-' THEN '-inf'::DOUBLE ELSE 'inf'::DOUBLE END) END)")
    return "CAST(NULL AS DOUBLE)"


def union_per_column(schema, select_for) -> str:
    """UNION ALL of ``select_for(position, name, spark_type, cls)`` over columns."""
    return "\nUNION ALL\n".join(select_for(i, n, t, c) for i, (n, t, c) in enumerate(schema))


def fence_cte(src: str, schema, alias: str = "fences") -> str:
    """One-row CTE with q1_<i>/q3_<i> (quantile_cont) of every coercible column."""
    parts = []
    for i, (n, t, c) in enumerate(schema):
        if c in ("numeric", "boolean", "categorical"):
            x = to_number_sql(n, c)
            parts.append(f"quantile_cont({x}, 0.25) AS q1_{i}, quantile_cont({x}, 0.75) AS q3_{i}")
    return f"{alias} AS (SELECT {', '.join(parts)} FROM {src})"
