"""Quartile (IQR) fences and outliers.

Values are coerced the way the outlier rule wants them: numbers as they
are, booleans as 0/1, text through ``to_number``; anything else has no
numeric value.  Fences are Q1 - 1.5 IQR and Q3 + 1.5 IQR; a value is an
outlier when strictly outside them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.layout import spread
from ..functions.typing_rules import nan_to_null, qcol, to_number, type_class
from .profile import per_column_table
from .quantiles import quantiles


@dataclass(frozen=True)
class Fence:
    column: str
    q1: float | None
    q3: float | None

    @property
    def iqr(self) -> float | None:
        return None if self.q1 is None else self.q3 - self.q1

    @property
    def lower(self) -> float | None:
        return None if self.q1 is None else self.q1 - 1.5 * self.iqr

    @property
    def upper(self) -> float | None:
        return None if self.q1 is None else self.q3 + 1.5 * self.iqr


def eligible(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Columns that can hold numbers under the outlier rule."""
    names = set(columns) if columns is not None else None
    return [f.name for f in df.schema.fields
            if (names is None or f.name in names)
            and type_class(f.dataType) in ("numeric", "boolean", "categorical")]


def numeric_view(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns coerced to double (NULL = no numeric value), same names."""
    df = nan_to_null(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[to_number(qcol(c), types[c], "outliers").alias(c) for c in columns])


def fit_fences(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> dict[str, Fence]:
    """Q1 / Q3 of every eligible column (all columns share each pass)."""
    cols = eligible(df, columns)
    qs = quantiles(spread(numeric_view(df, cols)), cols, [0.25, 0.75], exact=exact)
    return {c: Fence(c, qs[c][0], qs[c][1]) for c in cols}


def outlier_flag(x, fence: Fence | None):
    """Column expression: strict comparison with the fences (NULL when none)."""
    if fence is None or fence.q1 is None:
        return F.lit(None).cast("boolean")
    return (x < F.lit(fence.lower)) | (x > F.lit(fence.upper))


def iqr_outliers(df: DataFrame, columns: list[str] | None = None, exact: bool = True,
                 fences: dict[str, Fence] | None = None) -> DataFrame:
    """(column_name, position, n_numeric, q1, q3, lower_bound, upper_bound, outliers).

    One row per column of ``df`` (or of ``columns``); columns without any
    numeric value have NULL fences and NULL outliers (the reference's "N/A").
    Fences are fitted first (bounded driver result), the counting pass is a
    lazy one-row aggregate.
    """
    df = nan_to_null(df)
    if fences is None:
        fences = fit_fences(df, columns, exact)
    wanted = [f.name for f in df.schema.fields if columns is None or f.name in columns]
    positions = {f.name: i for i, f in enumerate(df.schema.fields)}
    cols = eligible(df, wanted)
    # the coerced view the fences were fitted on (same plan, so a spread copy is shared)
    view = spread(numeric_view(df, cols))
    null_d = F.lit(None).cast("double")
    specs = []
    for j, c in enumerate(wanted):
        fence = fences.get(c)
        has = fence is not None and fence.q1 is not None
        if c in cols:
            x = qcol(c)
            aggs = [F.count(x).alias(f"n{j}")]
            n_num = F.col(f"n{j}")
            if has:
                aggs.append(F.count(F.when(outlier_flag(x, fence), 1)).alias(f"o{j}"))
        else:
            aggs, n_num = [], F.lit(0).cast("long")
        lit = (lambda v: F.lit(v).cast("double")) if has else (lambda v: null_d)
        specs.append((aggs, [
            F.lit(c), F.lit(positions[c]), n_num,
            lit(fence.q1 if has else None), lit(fence.q3 if has else None),
            lit(fence.lower if has else None), lit(fence.upper if has else None),
            F.col(f"o{j}") if has else F.lit(None).cast("long")]))
    return per_column_table(view, specs, ["column_name", "position", "n_numeric", "q1", "q3",
                                        "lower_bound", "upper_bound", "outliers"])


def outlier_rows(df: DataFrame, column: str, exact: bool = True, fence: Fence | None = None) -> DataFrame:
    """Rows of ``df`` whose coerced ``column`` lies strictly outside the fences.

    For number columns the range test is written on the raw column (NaN is
    excluded by a separate conjunct), so the parquet scan receives it as a
    pushed filter and skips row groups whose statistics lie inside the fences.
    """
    if fence is None:
        fence = fit_fences(nan_to_null(df), [column], exact).get(column)
    if fence is None or fence.q1 is None:
        return nan_to_null(df).limit(0)
    dtype = {f.name: f.dataType for f in df.schema.fields}[column]
    c = qcol(column)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        pred = ((c < F.lit(fence.lower)) | (c > F.lit(fence.upper))) & ~F.isnan(c)
    else:
        pred = outlier_flag(to_number(c, dtype, "outliers"), fence)
    return nan_to_null(df.where(pred))
