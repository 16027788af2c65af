"""Running missing-value profile of a stream (one-row state per query)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.typing_rules import nan_to_null, qcol


def running_missing(stream: DataFrame) -> DataFrame:
    """(n_rows, missing_<column>...) over everything seen so far.

    A global streaming aggregate of counts: its state is one row whatever
    the volume; run it with output mode "complete" or "update".
    """
    df = nan_to_null(stream)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [(F.count(F.lit(1)) - F.count(qcol(c))).alias(f"missing_{c}") for c in df.columns]
    return df.agg(*aggs)
