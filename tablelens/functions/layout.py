"""Partition layout helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


#: Session setting: number of partitions that multi-pass operators deal their
#: (already projected) input to.  Unset: the input is read as it is laid out.
SPREAD = "tablelens.spread"


def spread(df: DataFrame) -> DataFrame:
    """Deal the input of a multi-pass operator to ``tablelens.spread`` partitions, if the session sets it.

    Worth it where an input is one unsplittable file; nothing runs here, and
    the size of the input plays no part.
    """
    n = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(n)) if n else df


#: Rows that a task of many passes may hold before they are dealt to more tasks.
DEAL_ROWS = 1 << 16


def deal(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (of ``rows`` rows) for many passes, by as many tasks as there are cores.

    A session that sets ``tablelens.spread`` has its number; otherwise the rows
    are dealt out where fewer tasks than cores would hold over ``DEAL_ROWS`` each.
    """
    if df.sparkSession.conf.get(SPREAD, None):
        return spread(df)
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, rows // DEAL_ROWS)
    return df.repartition(wanted) if wanted > 1 and df.rdd.getNumPartitions() < wanted else df


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once for several later passes: a reliable checkpoint.

    The rows are written to the session's checkpoint folder, so a lost
    executor never forces the upstream scan and shuffle to run again; Spark
    removes them with the frame where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows up to which a table that names a few groups is sent to every executor.
SMALL_TABLE = 100_000


def beside(table: DataFrame, rows: int) -> DataFrame:
    """``table`` (of at most ``rows`` rows) as the small side of a join.

    A join on few keys through a shuffle brings all rows of a key to one task;
    a table of at most ``SMALL_TABLE`` rows goes to the rows instead, which stay
    where they are.  Larger tables have keys enough to deal rows out by.
    """
    return F.broadcast(table) if rows <= SMALL_TABLE else table


def beside_if_small(table: DataFrame) -> DataFrame:
    """``beside`` for a table whose size is not known; its first rows are counted."""
    return beside(table, table.limit(SMALL_TABLE + 1).count())


# Aggregate functions per pass for collected (scalar) aggregates: wider global
# aggregates exceed whole-stage codegen's field limit and run interpreted.
AGGS_PER_PASS = 80


def aggregate_in_passes(df: DataFrame, named: list[tuple[str, Column]]) -> dict:
    """Run many named scalar aggregates, at most ``AGGS_PER_PASS`` per pass.

    Returns {name: value}.  With a columnar source each pass reads only the
    columns its aggregates use.
    """
    out: dict = {}
    for k in range(0, len(named), AGGS_PER_PASS):
        part = named[k:k + AGGS_PER_PASS]
        row = df.agg(*[e.alias(n) for n, e in part]).first()
        out.update({n: row[n] for n, _ in part})
    return out
