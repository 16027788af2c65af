"""Table and column profiles.

Each operator returns a DataFrame.  Per-column results are long tables with
one row per profiled column (``column_name``, ``position``, metrics...), built
from ONE wide aggregate whose single result row is unpivoted with ``inline``
- the table itself is scanned once per operator, never once per column.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.layout import materialize
from ..functions.typing_rules import (
    is_atomic, nan_to_null, qcol, to_number, type_class,
)

_K = "__tl_copies"


def fixed_width(dtype: T.DataType) -> int | None:
    """Bytes per non-missing value for fixed-width types (None for text/nested)."""
    if isinstance(dtype, (T.ByteType, T.BooleanType)):
        return 1
    if isinstance(dtype, T.ShortType):
        return 2
    if isinstance(dtype, (T.IntegerType, T.FloatType, T.DateType)):
        return 4
    if isinstance(dtype, (T.LongType, T.DoubleType, T.TimestampType, T.TimestampNTZType)):
        return 8
    if isinstance(dtype, T.DecimalType):
        return 8 if dtype.precision <= 18 else 16
    return None


def value_bytes(name: str, dtype: T.DataType) -> Column:
    """Estimated bytes of one value (0 when missing)."""
    c = qcol(name)
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c).cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    if isinstance(dtype, T.ArrayType):
        each = fixed_width(dtype.elementType)
        if each is not None:
            return F.when(c.isNull(), zero).otherwise(F.size(F.filter(c, lambda x: x.isNotNull())).cast("long") * each)
    w = fixed_width(dtype)
    if w is None:       # nested values by the bytes of their JSON text
        return F.coalesce(F.octet_length(F.to_json(c)).cast("long"), zero)
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(F.lit(w).cast("long"))


def _groupable(df: DataFrame) -> DataFrame:
    """Maps cannot be grouped on; compare them by their JSON text instead."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.MapType):
            cols.append(F.to_json(qcol(f.name)).alias(f.name))
        else:
            cols.append(qcol(f.name))
    return df.select(*cols)


# Columns per aggregate: a global aggregate with hundreds of functions exceeds
# whole-stage codegen's field limit; chunks keep every aggregate compiled, and
# with a columnar source the chunks together still read each column once.
COLUMNS_PER_AGGREGATE = 24


def per_column_table(df: DataFrame, specs: list[tuple[list[Column], list[Column]]], names: list[str],
                     shared: list[Column] | None = None) -> DataFrame:
    """One row per column from aggregates: ``specs[i] = (aggregates, values)``.

    ``values`` are expressions over the aggregate aliases (and ``shared``
    ones such as a row count); each chunk of columns is one aggregate whose
    single row is unpivoted with ``inline``; chunks are unioned (lazy).
    """
    if not specs:
        raise ValueError("no columns to profile")
    parts = []
    for k in range(0, len(specs), COLUMNS_PER_AGGREGATE):
        chunk = specs[k:k + COLUMNS_PER_AGGREGATE]
        aggs = list(shared or []) + [a for s in chunk for a in s[0]]
        if not aggs:
            aggs = [F.count(F.lit(1)).alias("__rows")]
        structs = [F.struct(*[v.alias(n) for v, n in zip(s[1], names)]) for s in chunk]
        parts.append(df.agg(*aggs).select(F.inline(F.array(*structs))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def preview_rows(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows; with ``order_by`` the preview is deterministic (top-n sort)."""
    if order_by:
        return df.orderBy(*[qcol(c) for c in order_by]).limit(n)
    return df.limit(n)


def census(df: DataFrame) -> dict[str, int]:
    """Number of numeric / categorical / datetime / boolean columns (schema only)."""
    counts = Counter(type_class(f.dataType) for f in df.schema.fields)
    return {k: counts.get(k, 0) for k in ("numeric", "categorical", "datetime", "boolean", "other")}


def columns_of_class(df: DataFrame, include: list[str] | None = None,
                     exclude: list[str] | None = None) -> list[str]:
    """Column names whose type class (numeric, categorical, datetime, boolean, other)
    is in ``include`` and not in ``exclude`` - the schema-only column selection."""
    out = []
    for f in df.schema.fields:
        cls = type_class(f.dataType)
        if include is not None and cls not in include:
            continue
        if exclude is not None and cls in exclude:
            continue
        out.append(f.name)
    return out


def select_by_class(df: DataFrame, include: list[str] | None = None,
                    exclude: list[str] | None = None) -> DataFrame:
    """Project the columns of the given type classes (pruned down to the scan)."""
    return df.select(*[qcol(c) for c in columns_of_class(df, include, exclude)])


def dtypes_text(df: DataFrame) -> str:
    """'column: type, ...' as one line (schema only)."""
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in df.schema.fields)


def column_types(df: DataFrame) -> DataFrame:
    """(column_name, position, data_type, type_class) from the schema alone."""
    spark = df.sparkSession
    rows = [(f.name, i, f.dataType.simpleString(), type_class(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    schema = "column_name string, position int, data_type string, type_class string"
    return spark.createDataFrame(rows, schema)


def row_keys(df: DataFrame, method: str = "exact") -> list[Column]:
    """Grouping keys that make equal rows (missing equals missing) one group.

    ``exact`` groups by every column.  ``fingerprint`` groups by a 128-bit
    fingerprint of the row - two independently seeded 64-bit hashes over
    every value and its missing flag (so a value cannot shift into another
    column), with -0.0 folded into 0.0 as grouping does.  The shuffle then
    carries 16 bytes per distinct row instead of the row; the chance that two
    different rows share a fingerprint is about n^2 / 2^129 (1e-15 at 10^12
    rows).
    """
    if method == "exact":
        return [qcol(f.name) for f in df.schema.fields]
    if method != "fingerprint":
        raise ValueError("method must be 'exact' or 'fingerprint'")
    parts = []
    for f in df.schema.fields:
        c = qcol(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = c + F.lit(0.0)
        parts += [c, c.isNull()]
    return [F.xxhash64(F.lit(17), *parts).alias("__fp1"), F.xxhash64(F.lit(91), *parts).alias("__fp2")]


def table_overview(df: DataFrame, method: str = "exact") -> DataFrame:
    """One row: shape, type census, missing cells, duplicate rows and data size.

    All data-dependent figures come out of one group-by over the rows
    (needed anyway for duplicate rows): each group carries its number of
    copies, missing cells and bytes, partially aggregated map-side, so a row
    repeated a billion times costs one shuffle record per map task.
    ``method="fingerprint"`` groups by a 128-bit row fingerprint instead of
    the full row (see ``row_keys``).
    """
    df = nan_to_null(df)
    fields = df.schema.fields
    n_cols = len(fields)
    cen = census(df)
    nulls = F.lit(0).cast("long")
    size = F.lit(0).cast("long")
    for f in fields:
        nulls = nulls + qcol(f.name).isNull().cast("long")
        size = size + value_bytes(f.name, f.dataType)
    g = (_groupable(df).groupBy(*row_keys(df, method))
         .agg(F.count(F.lit(1)).alias(_K), F.sum(nulls).alias("__m"), F.sum(size).alias("__b")))
    k = F.col(_K)
    rows = F.coalesce(F.sum(k), F.lit(0).cast("long"))
    missing = F.coalesce(F.sum("__m"), F.lit(0).cast("long"))
    return g.agg(
        rows.alias("n_rows"),
        F.lit(n_cols).alias("n_columns"),
        F.lit(cen["numeric"]).alias("n_numeric"),
        F.lit(cen["categorical"]).alias("n_categorical"),
        F.lit(cen["datetime"]).alias("n_datetime"),
        F.lit(cen["boolean"]).alias("n_boolean"),
        missing.alias("missing_total"),
        F.round(F.coalesce(F.try_divide(missing * 100.0, rows * n_cols), F.lit(0.0)), 4).alias("missing_pct"),
        F.coalesce(F.sum(k - 1), F.lit(0).cast("long")).alias("duplicate_rows"),
        F.coalesce(F.sum("__b"), F.lit(0).cast("long")).alias("size_bytes"),
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column_name, position, missing, missing_pct): NULL (and NaN) per column."""
    df = nan_to_null(df)
    specs = []
    for i, f in enumerate(df.schema.fields):
        m = F.col(f"m{i}")
        specs.append(([(F.count(F.lit(1)) - F.count(qcol(f.name))).alias(f"m{i}")],
                      [F.lit(f.name), F.lit(i), m,
                       F.round(F.coalesce(F.try_divide(m * 100.0, F.col("n")), F.lit(0.0)), 4)]))
    return per_column_table(df, specs, ["column_name", "position", "missing", "missing_pct"],
                            shared=[F.count(F.lit(1)).alias("n")])

def missing_total(df: DataFrame) -> DataFrame:
    """One row: missing cells, cells, and their percentage (0 for no rows/columns)."""
    df = nan_to_null(df)
    n_cols = len(df.columns)
    nulls = F.lit(0).cast("long")
    for f in df.schema.fields:
        nulls = nulls + qcol(f.name).isNull().cast("long")
    rows = F.count(F.lit(1))
    missing = F.coalesce(F.sum(nulls), F.lit(0).cast("long"))
    return df.agg(
        missing.alias("missing_total"),
        (rows * n_cols).alias("n_cells"),
        F.round(F.coalesce(F.try_divide(missing * 100.0, rows * n_cols), F.lit(0.0)), 4).alias("missing_pct"),
    )


#: Fingerprints met twice that are sent to every task: 16 bytes each.
MAX_BROADCAST_PRINTS = 1_000_000


def repeated_rows(df: DataFrame, max_broadcast: int = MAX_BROADCAST_PRINTS) -> DataFrame:
    """Every row that occurs more than once, once, with its number of copies in ``__k``.

    Exact, but rows that occur once are not moved.  A first pass shuffles
    128-bit fingerprints only and keeps those met twice; rows with one of them are
    candidates, and only candidates are grouped by all their columns.  Up to
    ``max_broadcast`` fingerprints are sent to all tasks; more are joined by shuffle.
    """
    df = nan_to_null(df)
    cols = [qcol(c) for c in df.columns]
    prints = row_keys(df, "fingerprint")
    names = [f"__print{i}" for i in range(len(prints))]
    printed = df.select(*cols, *[p.alias(n) for p, n in zip(prints, names)])
    twice = materialize(printed.groupBy(*names).agg(F.count(F.lit(1)).alias(_K)).where(F.col(_K) > 1).select(*names))
    few = twice.limit(max_broadcast + 1).count() <= max_broadcast
    found = printed.join(F.broadcast(twice) if few else twice, names, "left_semi")
    return found.groupBy(*cols).agg(F.count(F.lit(1)).alias(_K)).where(F.col(_K) > 1)


def duplicate_rows_total(df: DataFrame, method: str = "exact") -> DataFrame:
    """One row: rows, distinct rows, duplicate rows (copies after the first).

    Missing equals missing, as in pandas ``duplicated``.  ``method`` as in
    ``row_keys``, or ``candidates``: exact, but only rows whose fingerprint is met
    twice are shuffled.
    """
    df = _groupable(nan_to_null(df))
    k = F.col(_K)
    if method == "candidates":
        copies = repeated_rows(df).agg(F.coalesce(F.sum(k - 1), F.lit(0).cast("long")).alias("duplicate_rows"))
        n = df.agg(F.count(F.lit(1)).alias("n_rows")).first()["n_rows"]
        return copies.select(F.lit(n).cast("long").alias("n_rows"),
                             (F.lit(n) - F.col("duplicate_rows")).cast("long").alias("distinct_rows"), "duplicate_rows")
    g = df.groupBy(*row_keys(df, method)).agg(F.count(F.lit(1)).alias(_K))
    return g.agg(
        F.coalesce(F.sum(k), F.lit(0).cast("long")).alias("n_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(k - 1), F.lit(0).cast("long")).alias("duplicate_rows"),
    )


def duplicate_rows_listing(df: DataFrame, chunk: int = 100_000, spread: int | None = None,
                           method: str = "exact") -> DataFrame:
    """All copies of each row except the first (pandas ``df[df.duplicated()]``).

    Order-free: rows are grouped, and a row with k copies is re-emitted k - 1
    times.  A row duplicated a billion times must not be re-emitted by one
    task, so the k - 1 copies are cut into chunks of ``chunk`` rows, the
    chunk descriptors are spread over ``spread`` partitions (round robin), and
    each chunk is expanded where it lands.  ``method="candidates"`` moves only rows
    whose fingerprint is met twice (see ``repeated_rows``).
    """
    if method not in ("exact", "candidates"):
        raise ValueError("method must be 'exact' or 'candidates'")
    df = nan_to_null(df)
    cols = [qcol(c) for c in df.columns]
    spark = df.sparkSession
    if spread is None:
        spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = (repeated_rows(df) if method == "candidates"
         else df.groupBy(*cols).agg(F.count(F.lit(1)).alias(_K)).where(F.col(_K) > 1))
    extra = F.col(_K) - 1
    n_chunks = F.floor((extra - 1) / chunk).cast("long") + 1
    chunks = (
        g.select(*cols, extra.alias("__extra"),
                 F.explode(F.sequence(F.lit(0).cast("long"), n_chunks - 1)).alias("__chunk"))
        .repartition(spread)
    )
    size = F.least(F.lit(chunk).cast("long"), F.col("__extra") - F.col("__chunk") * chunk)
    return (
        chunks.select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), size)).alias("__i"))
        .select(*cols)
    )


def _distinct_key(name: str, dtype: T.DataType) -> Column:
    c = qcol(name)
    if not is_atomic(dtype) and not isinstance(dtype, T.ArrayType):
        return F.to_json(c)
    return c


def distinct_only(df: DataFrame, exact: bool = True, method: str = "values") -> DataFrame:
    """(column_name, position, unique): distinct non-missing values per column.

    The aggregate holds nothing but the distinct counts, so Spark plans it as
    hash aggregation on (column, value) after one expansion; values are
    de-duplicated map-side before the shuffle, which also absorbs hot values.
    ``exact=False`` uses HyperLogLog++ sketches instead (no expansion).
    ``method="fingerprint"`` shuffles 128 bits in place of text and nested
    values: exact but for a collision of both hashes.
    """
    if method not in ("values", "fingerprint"):
        raise ValueError(f"unknown method {method!r}")
    specs = []
    for i, f in enumerate(df.schema.fields):
        key = _distinct_key(f.name, f.dataType)
        if method == "fingerprint" and fixed_width(f.dataType) is None:
            key = F.when(key.isNotNull(), F.struct(F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)))
        d = F.count_distinct(key) if exact else F.approx_count_distinct(key)
        specs.append(([d.alias(f"d{i}")], [F.lit(f.name), F.lit(i), F.col(f"d{i}")]))
    return per_column_table(df, specs, ["column_name", "position", "unique"])

def present_counts(df: DataFrame) -> DataFrame:
    """(column_name, position, n_rows, non_missing) from plain aggregates (NaN is missing)."""
    df = nan_to_null(df)
    specs = [([F.count(qcol(f.name)).alias(f"c{i}")], [F.lit(f.name), F.lit(i), F.col("n"), F.col(f"c{i}")])
             for i, f in enumerate(df.schema.fields)]
    return per_column_table(df, specs, ["column_name", "position", "n_rows", "non_missing"],
                            shared=[F.count(F.lit(1)).alias("n")])

def distinct_counts(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column_name, position, n_rows, unique, has_missing, duplicate_values).

    ``unique`` excludes missing (pandas ``nunique``); ``duplicate_values``
    counts missing as one value (pandas ``Series.duplicated().sum()``).
    Distinct counts and plain counts are two aggregates (mixing them makes
    Spark carry every column through the expansion); their per-column rows
    are merged by a group-by over 2 x columns rows.
    """
    df = nan_to_null(df)
    a = present_counts(df).withColumn("unique", F.lit(None).cast("long"))
    b = (distinct_only(df, exact)
         .withColumn("n_rows", F.lit(None).cast("long"))
         .withColumn("non_missing", F.lit(None).cast("long")))
    m = a.unionByName(b).groupBy("position").agg(
        F.max("column_name").alias("column_name"), F.max("n_rows").alias("n_rows"),
        F.max("non_missing").alias("non_missing"), F.max("unique").alias("unique"))
    has = F.col("non_missing") < F.col("n_rows")
    return m.select(
        "column_name", "position", "n_rows", "unique", has.alias("has_missing"),
        (F.col("n_rows") - F.col("unique") - has.cast("long")).alias("duplicate_values"))


def unique_by_column(df: DataFrame, exact: bool = True, method: str = "values") -> DataFrame:
    """(column_name, position, unique), from one scan."""
    return distinct_only(nan_to_null(df), exact, method)


def duplicate_values_by_column(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column_name, position, duplicate_values)."""
    return distinct_counts(df, exact).select("column_name", "position", "duplicate_values")


def _text_of(name: str, dtype: T.DataType) -> Column | None:
    c = qcol(name)
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(dtype, T.DateType):
        return c
    return None


def exact_text(dtype: T.DataType) -> bool:
    """Whether minimum and maximum are also given as text, because a double may round them."""
    return isinstance(dtype, (T.LongType, T.DecimalType))


def min_max_by_column(df: DataFrame) -> DataFrame:
    """(column_name, position, min_num, max_num, min_str, max_str).

    Numbers (and booleans as 0/1) fill the numeric pair, whole numbers and
    decimals the text pair as well, digit by digit, since a double rounds them
    above 2^53; text fills the text pair; dates and timestamps are given as ``yyyy-MM-dd HH:mm:ss`` text.
    Missing values are skipped, so a text column with gaps still has a
    minimum.  Nested columns get NULLs.
    """
    df = nan_to_null(df)
    null_d = F.lit(None).cast("double")
    null_s = F.lit(None).cast("string")
    fmt = "yyyy-MM-dd HH:mm:ss"
    specs = []
    for i, f in enumerate(df.schema.fields):
        c = qcol(f.name)
        cls = type_class(f.dataType)
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        head = [F.lit(f.name), F.lit(i)]
        if cls in ("numeric", "boolean"):
            x = c.cast("int") if cls == "boolean" else c
            text = [a.cast("string"), b.cast("string")] if exact_text(f.dataType) else [null_s, null_s]
            specs.append(([F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")],
                          head + [a.cast("double"), b.cast("double"), *text]))
        elif cls == "categorical":
            specs.append(([F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")], head + [null_d, null_d, a, b]))
        elif cls == "datetime":
            specs.append(([F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")],
                          head + [null_d, null_d, F.date_format(a, fmt), F.date_format(b, fmt)]))
        else:
            specs.append(([], head + [null_d, null_d, null_s, null_s]))
    return per_column_table(df, specs, ["column_name", "position", "min_num", "max_num", "min_str", "max_str"])

def numeric_coercible(df: DataFrame) -> DataFrame:
    """(column_name, position, n_numeric, is_numeric) under the plotting rule.

    Every column is coerced to a number (text through ``to_number``);
    columns with at least one number qualify.  Booleans, dates and nested
    columns never qualify.
    """
    df = nan_to_null(df)
    specs = [([F.count(to_number(qcol(f.name), f.dataType, "plot")).alias(f"c{i}")],
              [F.lit(f.name), F.lit(i), F.col(f"c{i}"), F.col(f"c{i}") > 0])
             for i, f in enumerate(df.schema.fields)]
    return per_column_table(df, specs, ["column_name", "position", "n_numeric", "is_numeric"])

def size_estimate(df: DataFrame) -> DataFrame:
    """(column_name, position, size_bytes): UTF-8 bytes of text, fixed widths otherwise.

    Replaces pandas' in-memory object size, which has no meaning on Spark.
    """
    specs = [([F.coalesce(F.sum(value_bytes(f.name, f.dataType)), F.lit(0).cast("long")).alias(f"s{i}")],
              [F.lit(f.name), F.lit(i), F.col(f"s{i}")])
             for i, f in enumerate(df.schema.fields)]
    return per_column_table(df, specs, ["column_name", "position", "size_bytes"])