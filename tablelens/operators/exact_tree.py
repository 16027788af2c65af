"""Decision trees with exact thresholds and no limit on their depth.

MLlib's trees put values into bins and stop at depth 30.  Here every cut
between two different values of a feature is looked at, and a tree grows until
its nodes are pure or hold equal rows only.

A level is one pass.  Rows with equal features and label are one row with a
weight.  Each open node's rows are counted by (node, feature, value); those
counts are range-sorted, running label sums are taken within ranges, and the
sums of earlier ranges of the same node and feature are added (a small table
with a row per range and group), so neither a frequent node nor a feature with
many values is one task's work.  A cut lies half way between neighbouring
values; the best one per node comes from an aggregate.  Rows go to the children
by a join with the cuts, and rows of finished nodes leave the table.  What is
known of the nodes of a level goes to the rows while it is small (a shuffle by
node would bring all rows of a node to one task).

The impurity is Gini's for classes and the variance for numbers.  Of equally
good cuts the first feature, then the lowest threshold wins.  Class sums are
whole numbers, so scores do not depend on the order of rows; label sums of
regression trees are added as doubles.

Edge cases: rows with a missing feature or label are left out (NaN counts as
missing); an empty table gives a tree without nodes; a node whose rows agree in
all features is a leaf even if their labels differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import SMALL_TABLE, beside, materialize
from ..functions.typing_rules import qcol

#: Classes are columns of the running sums.
MAX_CLASSES = 100

#: Levels that rows walk down before they are checkpointed.
WALK = 4

NODE_COLUMNS = ["node", "parent", "side", "depth", "n", "impurity", "prediction", "feature", "threshold"]


def _score(sums: list[Column], n: Column, classes: int | None) -> Column:
    """Of one side of a cut: what its impurity takes off the worst case, times its weight."""
    if classes is None:
        return sums[0] * sums[0] / n
    return sum((s * s for s in sums[1:]), sums[0] * sums[0]).cast("double") / n


def _impurity(sums: list[Column], n: Column, square: Column | None) -> Column:
    """Gini impurity, or variance if sums of squares are given."""
    if square is None:
        return 1 - sum((s * s for s in sums[1:]), sums[0] * sums[0]).cast("double") / (n.cast("double") * n)
    mean = sums[0] / n
    return F.greatest(square / n - mean * mean, F.lit(0.0))


@dataclass
class ExactTree:
    """A grown tree: one row per node, and for every level its cuts as a table of their own."""

    features: list[str]
    classes: int | None               # None: a regression tree
    levels: list[DataFrame]           # NODE_COLUMNS by depth
    sizes: list[int]                  # nodes by depth

    def nodes(self) -> DataFrame:
        """depth, node, parent, side, n, impurity, prediction, feature and threshold (NULL in leaves).

        Numbers of nodes are unique within a depth; ``parent`` is one of the depth before.
        """
        out = self.levels[0]
        for level in self.levels[1:]:
            out = out.unionByName(level)
        return out

    def importances(self) -> DataFrame:
        """(feature, importance): the impurity that cuts on a feature take away, weighed by rows, as shares of one."""
        nodes = self.nodes()
        weighed = nodes.select("depth", "node", "parent", "feature", (F.col("n") * F.col("impurity")).alias("w"))
        below = (weighed.where("parent is not null")
                 .groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.sum("w").alias("below")))
        gains = (weighed.where("feature is not null").join(below, ["depth", "node"])
                 .groupBy("feature").agg(F.sum(F.col("w") - F.col("below")).alias("gain")))
        total = gains.agg(F.sum("gain")).first()[0] or 0.0
        return gains.select("feature", (F.col("gain") / F.lit(total) if total else F.lit(0.0)).alias("importance"))

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """``df`` with the prediction of the leaf each row falls into; NULL for a missing feature.

        Rows walk down level by level: a join with the cuts of the level.  Those
        that have reached a leaf keep its prediction and meet no further cut.
        Small levels go to the rows, ``WALK`` of them in one pass.
        """
        values = F.array(*[qcol(f).cast("double") for f in self.features])
        gap = F.exists(values, lambda v: v.isNull() | F.isnan(v))
        at = df.select(F.struct(*[qcol(c) for c in df.columns]).alias("__row"), values.alias("__x"), gap.alias("__gap"),
                       F.lit(None).cast("double").alias(output))
        done = at.where("__gap").select("__row", output)
        at = materialize(at.where("not __gap").select("__row", "__x", F.lit(0).cast("long").alias("node"), output))
        index = F.create_map(*[x for i, f in enumerate(self.features) for x in (F.lit(f), F.lit(i + 1))])
        for depth, (level, size) in enumerate(zip(self.levels, self.sizes)):
            cuts = level.select("node", F.col("prediction").alias("__p"), index[F.col("feature")].alias("__f"),
                                "threshold", "__left")
            if size > SMALL_TABLE or depth and depth % WALK == 0:
                at = materialize(at)
            if size > SMALL_TABLE:  # rows without a node are not dealt out
                done = done.unionByName(at.where("node is null").select("__row", output))
                at = at.where("node is not null")
            left = F.element_at("__x", F.col("__f")) <= F.col("threshold")
            at = at.join(beside(cuts, size), "node", "left").select(
                "__row", "__x", F.when(F.col("__f").isNotNull(), F.col("__left") + F.when(left, 0).otherwise(1)).alias("node"),
                F.when(F.col("node").isNotNull() & F.col("__f").isNull(), F.col("__p")).otherwise(qcol(output)).alias(output))
        done = done.unionByName(at.select("__row", output))
        names = [F.col("__row").getField(c).alias(c) for c in df.columns if c != output]
        return done.select(*names, output)


def fit(df: DataFrame, features: list[str], label: str = "label", classes: int | None = None,
        max_depth: int | None = None, min_rows: int = 2) -> ExactTree:
    """Grow a tree on ``df``: for class numbers 0 to ``classes`` - 1, or for numbers if ``classes`` is None.

    ``max_depth`` None grows it to the end; a node of fewer than ``min_rows`` rows is a leaf.
    """
    if not features:
        raise ValueError("select at least one feature")
    if classes is not None and not 1 <= classes <= MAX_CLASSES:
        raise ValueError(f"the number of classes must be from 1 to {MAX_CLASSES}")
    names = [f"s{i}" for i in range(classes or 1)] + ([] if classes else ["q"])
    rows = _weighted(df, features, label, classes)
    rows = materialize(rows.withColumn("node", F.lit(0).cast("long")))
    frontier = rows.select("node").distinct().select("node", F.lit(None).cast("long").alias("parent"),
                                                     F.lit(None).cast("string").alias("side"))
    levels: list[DataFrame] = []
    sizes = [1]
    depth = 0
    while True:
        level = _level(rows, frontier, features, names, classes, depth, max_depth is None or depth < max_depth, min_rows,
                       sizes[-1])
        levels.append(level)
        cut = level.where("feature is not null")
        n_cuts = cut.count()
        if not n_cuts:
            return ExactTree(list(features), classes, levels, sizes)
        children = F.inline(F.array(*[F.struct((F.col("__left") + k).alias("node"), F.col("node").alias("parent"),
                                               F.lit(side).alias("side")) for k, side in enumerate(("left", "right"))]))
        frontier = cut.select(children)
        index = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i + 1))])
        cuts = cut.select("node", index[F.col("feature")].alias("__f"), "threshold", "__left")
        left = F.element_at("x", F.col("__f")) <= F.col("threshold")
        rows = materialize(rows.join(beside(cuts, n_cuts), "node").select(
            "x", "w", *names, (F.col("__left") + F.when(left, 0).otherwise(1)).alias("node")))
        sizes.append(2 * n_cuts)
        depth += 1


def _weighted(df: DataFrame, features: list[str], label: str, classes: int | None) -> DataFrame:
    """x (array of features), w (rows) and label sums of every set of equal rows."""
    values = [qcol(f).cast("double") for f in features]
    y = qcol(label).cast("double")
    whole = y.isNotNull() & ~F.isnan(y)
    for v in values:
        whole = whole & v.isNotNull() & ~F.isnan(v)
    own = df.where(whole).select(F.array(*[v + 0.0 for v in values]).alias("x"), y.alias("y"))
    grouped = own.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    if classes is None:
        return grouped.groupBy("x").agg(F.sum("w").alias("w"), F.sum(F.col("y") * F.col("w")).alias("s0"),
                                        F.sum(F.col("y") * F.col("y") * F.col("w")).alias("q"))
    known = F.when((F.col("y") >= 0) & (F.col("y") < classes) & (F.col("y") == F.floor("y")), F.col("y").cast("int"))
    coded = grouped.withColumn("k", F.coalesce(known, F.raise_error(F.concat(F.lit("not a class number: "),
                                                                             F.col("y"))).cast("int")))
    return coded.groupBy("x").agg(F.sum("w").alias("w"), *[
        F.sum(F.when(F.col("k") == i, F.col("w")).otherwise(0)).alias(f"s{i}") for i in range(classes)])


def _level(rows: DataFrame, frontier: DataFrame, features: list[str], names: list[str], classes: int | None, depth: int,
           may_cut: bool, min_rows: int, size: int) -> DataFrame:
    """The ``size`` nodes of a level: NODE_COLUMNS and ``__left``, the number of the left child (the right one follows)."""
    square = None if classes else F.col("q")
    sums = [F.col(f"s{i}") for i in range(classes or 1)]
    totals = materialize(rows.groupBy("node").agg(F.sum("w").alias("w"), *[F.sum(c).alias(c) for c in names]))
    if classes is None:
        prediction = F.col("s0") / F.col("w")
    else:  # the most frequent class, the smallest number of equals
        prediction = F.array_position(F.array(*sums), F.array_max(F.array(*sums))).cast("double") - 1
    known = frontier.join(totals, "node").select(
        "node", "parent", "side", F.lit(depth).alias("depth"), F.col("w").alias("n"),
        _impurity(sums, F.col("w"), square).alias("impurity"), prediction.alias("prediction"))
    if may_cut:
        best = _best_cuts(rows, totals, features, names, classes, min_rows, size)
        known = known.join(best, "node", "left")
    else:
        known = known.select("*", F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("threshold"))
    return materialize(known.select(*NODE_COLUMNS, (2 * F.monotonically_increasing_id()).alias("__left")))


def _best_cuts(rows: DataFrame, totals: DataFrame, features: list[str], names: list[str], classes: int | None,
               min_rows: int, size: int) -> DataFrame:
    """(node, feature, threshold) of the best cut of every node that is not pure and has one."""
    pure = (F.greatest(*[F.col(f"s{i}") for i in range(classes)]) == F.col("w")) if classes and classes > 1 else (
        F.lit(True) if classes else F.col("q") * F.col("w") <= F.col("s0") * F.col("s0"))
    open_nodes = totals.where(~pure & (F.col("w") >= min_rows)).select(
        "node", F.col("w").alias("__w"), *[F.col(c).alias(f"__{c}") for c in names])
    sums = ["w", *names]
    counted = (rows.join(beside(open_nodes.select("node"), size), "node", "left_semi")
               .select("node", F.posexplode("x").alias("f", "v"), *sums)
               .groupBy("node", "f", "v").agg(*[F.sum(c).alias(c) for c in sums]))
    order = ["node", "f", "v"]
    ranged = materialize(counted.repartitionByRange(*order)).withColumn("__range", F.spark_partition_id())
    per = ranged.groupBy("node", "f", "__range").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums],
                                                     F.min("v").alias("__first"))
    along = Window.partitionBy("node", "f").orderBy("__range")  # a row per range that the group reaches into
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("node", "f", "__range", F.lead("__first").over(along).alias("__n"),
                         *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums])
    own = Window.partitionBy("node", "f", "__range").orderBy("v")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ranged.select(*order, "__range", F.lead("v").over(own).alias("__v"),
                            *[F.sum(c).over(upto).alias(c) for c in sums])
    cuts = (running.join(offsets, ["node", "f", "__range"]).join(beside(open_nodes, size), "node")
            .select("node", "f", "v", F.coalesce("__v", "__n").alias("next"),
                    *[(F.col(c) + F.col(f"__o_{c}")).alias(c) for c in sums], "__w", *[f"__{c}" for c in names])
            .where("next is not null"))
    k = classes or 1
    left = _score([F.col(f"s{i}") for i in range(k)], F.col("w"), classes)
    right = _score([F.col(f"__s{i}") - F.col(f"s{i}") for i in range(k)], F.col("__w") - F.col("w"), classes)
    middle = (F.col("v") + F.col("next")) / 2
    # between neighbouring doubles the middle may round up to the next one
    threshold = F.when(middle < F.col("next"), middle).otherwise(F.col("v"))
    best = F.min_by(F.struct("f", threshold.alias("threshold")),
                    F.struct((-(left + right)).alias("score"), F.col("f"), F.col("v")))
    names_of = F.array(*[F.lit(f) for f in features])
    return cuts.groupBy("node").agg(best.alias("b")).select(
        "node", F.element_at(names_of, F.col("b.f") + 1).alias("feature"), F.col("b.threshold").alias("threshold"))
