"""Target column checks, problem type, and label encoding / decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.layout import beside_if_small
from ..functions.typing_rules import is_numeric_for, nan_to_null, qcol
from .ordered import running_totals
from .profile import distinct_counts

# Fixed values of the reference's rules.
MAX_TEXT_CLASSES = 20          # a text target with more distinct values is refused
MIN_CLASSES = 2                # fewer distinct values than this are refused

REASONS = {
    "ok": "The column can be predicted.",
    "not_found": "There is no such column in the table.",
    "identifier": "Every row has its own value, so there is nothing to learn.",
    "too_many_categories": "The text values are too many to be classes.",
    "too_few_classes": "At least two different values are needed.",
}


def problem_type(dtype: T.DataType) -> str:
    """Numbers (booleans included) are regression targets; everything else classification."""
    return "regression" if is_numeric_for(dtype, "problem_type") else "classification"


def validate_targets(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, position, n_rows, unique, ok, reason, problem_type) for every column.

    Rules in order: text with every row distinct is an identifier; text with
    more than 20 values has too many categories; fewer than 2 distinct values
    cannot be learned.  One distinct-count aggregate covers all columns.
    """
    df = nan_to_null(df)
    if columns is not None:
        df = df.select(*[qcol(c) for c in columns])
    fields = df.schema.fields
    text_pos = [i for i, f in enumerate(fields) if isinstance(f.dataType, T.StringType)]
    reg_pos = [i for i, f in enumerate(fields) if problem_type(f.dataType) == "regression"]
    d = distinct_counts(df)
    is_text = F.col("position").isin(text_pos) if text_pos else F.lit(False)
    reason = (F.when(is_text & (F.col("unique") == F.col("n_rows")), F.lit("identifier"))
              .when(is_text & (F.col("unique") > MAX_TEXT_CLASSES), F.lit("too_many_categories"))
              .when(F.col("unique") < MIN_CLASSES, F.lit("too_few_classes"))
              .otherwise(F.lit("ok")))
    ptype = F.when(F.col("position").isin(reg_pos) if reg_pos else F.lit(False),
                   F.lit("regression")).otherwise(F.lit("classification"))
    return d.select("column_name", "position", "n_rows", "unique", (reason == "ok").alias("ok"),
                    reason.alias("reason"), ptype.alias("problem_type"))


def target_reason(is_text: bool, n_rows: int, unique: int) -> str:
    """The validation rule on one column's counts (same order as ``validate_targets``)."""
    if is_text and unique == n_rows:
        return "identifier"
    if is_text and unique > MAX_TEXT_CLASSES:
        return "too_many_categories"
    if unique < MIN_CLASSES:
        return "too_few_classes"
    return "ok"


def validate_target(df: DataFrame, target: str) -> tuple[bool, str]:
    """(ok, reason code) for one column from ONE aggregate (rows, distinct values);
    a missing column is refused without a scan."""
    if target not in df.columns:
        return False, "not_found"
    df = nan_to_null(df.select(qcol(target)))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(qcol(target)).alias("d")).first()
    dtype = df.schema.fields[0].dataType
    reason = target_reason(isinstance(dtype, T.StringType), row["n"], row["d"])
    return reason == "ok", reason


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is present (NaN counts as missing).

    The test is written on the raw column so ``IS NOT NULL`` reaches the scan.
    """
    c = qcol(target)
    dtype = {f.name: f.dataType for f in df.schema.fields}[target]
    present = c.isNotNull()
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        present = present & ~F.isnan(c)
    return nan_to_null(df.where(present))


def fit_labels(df: DataFrame, target: str) -> DataFrame:
    """(value, class_index): the distinct target values in sorted order, any number of them.

    Classes are numbered within ranges of values, to which the counts of the
    ranges before are added, so no task sees all of them.
    """
    values = df.where(qcol(target).isNotNull()).select(qcol(target).alias("value")).distinct()
    numbered = running_totals(values.withColumn("__n", F.lit(1)), "value", ["__n"], descending=False)
    return numbered.select("value", (F.col("cum___n") - 1).cast("int").alias("class_index"))


def label_encode(df: DataFrame, target: str, labels: DataFrame | None = None,
                 output: str = "label") -> tuple[DataFrame, DataFrame]:
    """Drop rows without a target, add ``output`` = class index in sorted order (NULL when unseen).

    A class table of usual size goes to the rows, as a class may hold most of them.
    Returns the frame and the class table (which decodes predictions).
    """
    df = drop_missing_target(df, target)
    if labels is None:
        labels = fit_labels(df, target)
    known = labels.select(F.col("value").alias("__value"), F.col("class_index").alias(output))
    joined = df.join(beside_if_small(known), qcol(target) == F.col("__value"), "left")
    return joined.select(*[qcol(c) for c in df.columns if c != output], qcol(output)), labels


def label_decode(df: DataFrame, labels: DataFrame, column: str = "prediction",
                 output: str = "prediction_label") -> DataFrame:
    """Add ``output`` = class text of the index in ``column``; an index without a class keeps its own text."""
    known = labels.select(F.col("class_index").cast("double").alias("__index"),
                          F.col("value").cast("string").alias("__class"))
    joined = df.join(beside_if_small(known), qcol(column).cast("double") == F.col("__index"), "left")
    text = F.coalesce(F.col("__class"), qcol(column).cast("long").cast("string"))
    return joined.select(*[qcol(c) for c in df.columns if c != output], text.alias(output))
