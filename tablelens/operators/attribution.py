"""Which features a model leans on, for any model: permutation importance by a keyed cyclic shift.

Shuffling a feature needs a random order of all rows.  Here rows are put in the
order of a seeded md5 of their key and numbered without a one-task window
(ranges, and the counts of the ranges before); every row then gets the values of
the row a fixed number of places later, counted in a circle, by a join on
that number.  The same rows, key and seed give the same shift whatever the
layout of the table.  A feature's importance is what the model's score loses
when that feature alone comes from the shifted row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.layout import materialize
from ..functions.typing_rules import qcol
from .ordered import running_totals

SEED = 42


def key_hash(key: list[str], seed: int = SEED) -> Column:
    """32 hexadecimal digits from the seed and the key; missing values and borders between values count."""
    parts = [F.coalesce(F.concat(F.lit("="), qcol(c).cast("string")), F.lit("-")) for c in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def with_shifted(df: DataFrame, columns: list[str], key: list[str], shift: int = 1, seed: int = SEED) -> DataFrame:
    """``df`` with ``__s0``, ``__s1``, ...: the values of ``columns`` in the row ``shift`` places later in hash order.

    ``key`` must tell rows apart: two rows with one key are an error.  A shift is
    counted in a circle; an empty table stays empty.
    """
    rows = materialize(df.withColumn("__h", key_hash(key, seed)).withColumn("__one", F.lit(1)))
    n, apart = rows.agg(F.count(F.lit(1)), F.count_distinct("__h")).first()
    if n != apart:
        raise ValueError("the key does not tell rows apart")
    placed = materialize(running_totals(rows.select("__h", "__one"), "__h", ["__one"], descending=False)
                         .select("__h", (F.col("cum___one") - 1).alias("__at")))
    ordered = rows.drop("__one").join(placed, "__h").drop("__h")
    ordered = materialize(ordered)
    later = ordered.select(F.pmod(F.col("__at") - shift, F.lit(max(n, 1))).alias("__at"),
                           *[qcol(c).alias(f"__s{i}") for i, c in enumerate(columns)])
    return ordered.join(later, "__at").drop("__at")


def permutation_importance(df: DataFrame, features: list[str], key: list[str],
                           score: Callable[[DataFrame], float], shift: int = 1, seed: int = SEED) -> DataFrame:
    """(feature, score, score_without, importance), a row per feature.

    ``score`` gives the model's score of a frame with the columns of ``df``, larger
    meaning better; it is called once as it is and once per feature.
    """
    if not features:
        raise ValueError("select at least one feature")
    both = materialize(with_shifted(df, features, key, shift, seed))
    names = [qcol(c) for c in df.columns]
    whole = score(both.select(*names))
    rows = []
    for i, f in enumerate(features):  # a row per feature of the model, not of the table
        without = score(both.select(*[F.col(f"__s{i}").alias(c) if c == f else qcol(c) for c in df.columns]))
        rows.append((f, float(whole), float(without), float(whole - without)))
    return df.sparkSession.createDataFrame(rows, "feature string, score double, score_without double, importance double")
