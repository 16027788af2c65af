"""The per-column statistics table: missing, duplicates, unique, min, max, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layout import spread
from ..functions.typing_rules import nan_to_null, qcol, to_number, type_class
from .outliers import fit_fences, outlier_flag
from .profile import distinct_only, exact_text, per_column_table

_NAMES = ["column_name", "position", "data_type", "missing", "duplicate_values", "unique",
          "min_num", "max_num", "min_str", "max_str", "outliers"]


def _single_pass(df: DataFrame, fences) -> DataFrame:
    """Missing, min, max and outlier counts of every column (plain aggregates, no keys)."""
    null_d = F.lit(None).cast("double")
    null_s = F.lit(None).cast("string")
    fmt = "yyyy-MM-dd HH:mm:ss"
    specs = []
    for i, f in enumerate(df.schema.fields):
        c = qcol(f.name)
        cls = type_class(f.dataType)
        aggs = [(F.count(F.lit(1)) - F.count(c)).alias(f"m{i}")]
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        if cls in ("numeric", "boolean"):
            x = c.cast("int") if cls == "boolean" else c
            aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
            text = [a.cast("string"), b.cast("string")] if exact_text(f.dataType) else [null_s, null_s]
            mins = [a.cast("double"), b.cast("double"), *text]
        elif cls == "categorical":
            aggs += [F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")]
            mins = [null_d, null_d, a, b]
        elif cls == "datetime":
            aggs += [F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")]
            mins = [null_d, null_d, F.date_format(a, fmt), F.date_format(b, fmt)]
        else:
            mins = [null_d, null_d, null_s, null_s]
        fence = fences.get(f.name)
        if fence is not None and fence.q1 is not None:
            x = to_number(c, f.dataType, "outliers")
            aggs.append(F.count(F.when(outlier_flag(x, fence), 1)).alias(f"o{i}"))
            out = F.col(f"o{i}")
        else:
            out = F.lit(None).cast("long")
        vals = [F.lit(f.name), F.lit(i), F.lit(f.dataType.simpleString()), F.col(f"m{i}"),
                F.col("n"), F.lit(None).cast("long")] + mins + [out]
        specs.append((aggs, vals))
    return per_column_table(df, specs, _NAMES, shared=[F.count(F.lit(1)).alias("n")])


def column_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column_name, position, data_type, missing, duplicate_values, unique,
    min_num, max_num, min_str, max_str, outliers) - one row per column.

    Quartiles are fitted first (a few bounded passes shared by all columns).
    Then two lazy aggregates: distinct counts (hash aggregation over the
    per-column expansion) and one plain pass for everything else.  Keeping
    them apart matters: a text ``min`` next to ``count(DISTINCT)`` turns the
    whole expanded aggregate into a sort-based one.  Their per-column rows are
    merged by a group-by over at most 2 x columns rows.
    """
    df = spread(nan_to_null(df))
    fences = fit_fences(df, None, exact)
    plain = _single_pass(df, fences)
    dist = distinct_only(df, exact).select(
        "column_name", "position", F.lit(None).cast("string").alias("data_type"),
        F.lit(None).cast("long").alias("missing"), F.lit(None).cast("long").alias("duplicate_values"), "unique",
        F.lit(None).cast("double").alias("min_num"), F.lit(None).cast("double").alias("max_num"),
        F.lit(None).cast("string").alias("min_str"), F.lit(None).cast("string").alias("max_str"),
        F.lit(None).cast("long").alias("outliers"))
    # in the plain rows "duplicate_values" temporarily carries the row count
    merged = plain.unionByName(dist).groupBy("position").agg(
        *[F.max(n).alias(n) for n in _NAMES if n != "position"])
    dup = (F.col("duplicate_values") - F.col("unique")
           - (F.col("missing") > 0).cast("long")).alias("duplicate_values")
    return merged.select(*[dup if n == "duplicate_values" else F.col(n) for n in _NAMES])
