"""The profiling flow of one table as a set of DataFrames (the exploration page, re-aimed)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import column_stats as cs
from ..operators import distributions as dist
from ..operators import profile


def profile_report(df: DataFrame, bins: int = 30, exact: bool = True,
                   histograms: bool = True) -> dict[str, DataFrame]:
    """overview, column_stats, missing, correlation, and a histogram per numeric column.

    All histograms share their bounds and their counts.  Each entry is a
    DataFrame; fitting steps (quartiles, bounds) run when the
    report is built, the rest when an entry is read.
    """
    out = {
        "overview": profile.table_overview(df),
        "preview": profile.preview_rows(df, 5),
        "column_stats": cs.column_stats(df, exact),
        "missing": profile.missing_by_column(df),
    }
    numeric = dist.plot_numeric_columns(df)
    if len(numeric) >= 2:
        out["correlation"] = dist.correlation_matrix(df, numeric)
        out["scatter_grid"] = dist.scatter_grid(df, numeric[0], numeric[1])
    if histograms:
        every = dist.histograms(df, numeric, bins)
        for c in numeric:
            out[f"histogram:{c}"] = every.where(F.col("column_name") == c).drop("column_name")
    return out
