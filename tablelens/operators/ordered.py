"""Running totals over a global order without a single-partition window.

A window ``ORDER BY x`` with no ``PARTITION BY`` moves every row into one
task.  Here Spark range-partitions the rows by the ordering column, the window
runs per range, and each range's offset comes from a table with one row per
range.  The number of ranges is that of the shuffle, so it follows the session
and the size of the data, not a constant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import materialize


def running_totals(df: DataFrame, order: str, sums: list[str], descending: bool = True,
                   ranges: int | None = None, lead: list[str] | None = None) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum of ``c`` in the order of ``order``) and
    ``next_<c>`` (value of ``c`` in the following row, NULL for the last row).

    ``order`` must be unique per row (group by it first).  The ranged rows are
    checkpointed, which fixes the range a row is in; ``ranges`` overrides
    their number.
    """
    lead = lead or []
    x = F.col(order)
    by = x.desc() if descending else x.asc()
    ranged = df.repartitionByRange(ranges, by) if ranges else df.repartitionByRange(by)
    tagged = materialize(ranged).withColumn("__range", F.spark_partition_id())
    first = F.max_by if descending else F.min_by
    per = tagged.groupBy("__range").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums],
                                        *[first(F.col(c), x).alias(f"__f_{c}") for c in lead])
    along = Window.orderBy("__range")          # one row per range, not per row
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("__range", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}")
                                      for c in sums],
                         *[F.lead(f"__f_{c}").over(along).alias(f"__n_{c}") for c in lead])
    w = Window.partitionBy("__range").orderBy(by)
    frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = [F.col(c) for c in df.columns]
    return (tagged.join(offsets, "__range")
            .select(*own, *[(F.sum(c).over(frame) + F.col(f"__o_{c}")).alias(f"cum_{c}") for c in sums],
                    *[F.coalesce(F.lead(c).over(w), F.col(f"__n_{c}")).alias(f"next_{c}") for c in lead]))
