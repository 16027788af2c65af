"""Forests with bags that can be looked up: every row's weight in every tree is a column expression.

A bootstrap sample of n rows holds each row a number of times that is Poisson
with mean one when n is large.  Here that number comes from a seeded hash of
the row's key and the tree, so it does not depend on partitions or on the order
of rows and a lost task computes the same bag again.  Rows of weight zero are
out of the tree's bag; each row is judged by exactly the
trees that never saw it, which estimates the error on new rows without a test
set.

Trees are single-tree MLlib forests without a bootstrap of their own (weights
stand in for it), so each node still looks at a random subset of features.
They are fitted ``parallelism`` at a time.  Fitting a tree takes several passes,
so the weights of a row, a byte a tree, are drawn once and stored beside its
features.  A row's votes come from one pass over the rows, all trees in one
expression.

Edge cases: keys that repeat share their weights, so a key should name a row;
a NULL in a key is a value of its own; a row that is in every bag has no votes
and is left out of the estimate; tied classes go to the smaller; an empty table
cannot be fitted (ValueError).
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.layout import materialize
from ..functions.typing_rules import qcol
from . import metrics as mt
from .models import DEFAULT_MAX_DEPTH, FOREST_TREES, SEED, TREE_MEMORY_MB, assemble

#: Hexadecimal digits of the hash that are read as a number, and how many numbers there are.
DIGITS, RANGE = 8, 1 << 32


def poisson_limits() -> list[int]:
    """Of ``RANGE`` equally likely numbers, how many stand for a weight of at most k, for k = 0, 1, ..."""
    limits, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(k)
        limit = round(total * RANGE)
        if limit >= RANGE:
            return limits
        limits.append(limit)
        k += 1


def bag_weight(key: list[str], tree: int, seed: int = SEED) -> Column:
    """How often the row with this key is in the bag of a tree: Poisson with mean one."""
    parts = [F.coalesce(F.concat(F.lit("="), qcol(c).cast("string")), F.lit("-")) for c in key]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(tree)), *parts))
    # digits of one width are in the order of their numbers; hashed once, then held against each limit
    drawn = F.transform(F.array(F.substring(digest, 1, DIGITS)), lambda x: sum(
        (x >= F.lit(f"{limit:0{DIGITS}x}")).cast("int") for limit in poisson_limits()))
    return drawn.getItem(0)


def bags(df: DataFrame, key: list[str], num_trees: int, seed: int = SEED) -> DataFrame:
    """(tree, n_in, n_out, weight): rows in and out of each tree's bag and the sum of weights, from one scan."""
    weights = [bag_weight(key, t, seed).alias(f"w{t}") for t in range(num_trees)]
    sums = [F.struct(F.lit(t).alias("tree"), F.count_if(F.col(f"w{t}") > 0).alias("n_in"),
                     F.count_if(F.col(f"w{t}") == 0).alias("n_out"),
                     F.coalesce(F.sum(f"w{t}"), F.lit(0)).alias("weight")).alias(f"s{t}") for t in range(num_trees)]
    return df.select(*weights).agg(*sums).select(F.inline(F.array(*[F.col(f"s{t}") for t in range(num_trees)])))


def _times(k: int) -> Column:
    """How many of the votes heard are for class ``k``."""
    return F.size(F.filter("__heard", lambda x: x == F.lit(float(k))))


def _with_vector(df: DataFrame, features: list[str], columns: list[Column]) -> DataFrame:
    """The given columns and ``__features``; feature names may be any."""
    numbered = [f"__f{i}" for i in range(len(features))]
    out = assemble(df.select(*columns, *[qcol(f).alias(n) for f, n in zip(features, numbered)]), numbered, "__features")
    return out.drop(*numbered)


@dataclass
class Forest:
    """Trees in order, what they were fitted on, and how their bags are found."""

    trees: list
    features: list[str]
    label: str
    key: list[str]
    num_classes: int | None
    seed: int

    def _voted(self, df: DataFrame, mask: bool) -> DataFrame:
        """``df`` with ``__said``: what each tree says of the row, NULL (``mask``) where the row is in its bag."""
        out = _with_vector(df, self.features, [qcol(c) for c in df.columns])
        for t, tree in enumerate(self.trees):
            out = tree.setFeaturesCol("__features").setPredictionCol(f"__p{t}").transform(out)
            out = out.select(*[qcol(c) for c in df.columns], "__features", *[f"__p{i}" for i in range(t + 1)])
        said = [F.when(bag_weight(self.key, t, self.seed) == 0, F.col(f"__p{t}")) if mask else F.col(f"__p{t}")
                for t in range(len(self.trees))]
        return out.select(*[qcol(c) for c in df.columns], F.array(*said).alias("__said"))

    def _decided(self, voted: DataFrame) -> DataFrame:
        """n_votes and the prediction: the class with most votes, or the mean."""
        heard = F.filter("__said", lambda x: x.isNotNull())
        voted = voted.withColumn("__heard", heard).withColumn("n_votes", F.size("__heard"))
        if self.num_classes:
            voted = voted.withColumn("__tally", F.array(*map(_times, range(self.num_classes))))
            decided = (F.array_position("__tally", F.array_max("__tally")) - 1).cast("double")
        else:
            decided = F.aggregate("__heard", F.lit(0.0), lambda s, x: s + x) / F.col("n_votes")
        own = [c for c in voted.columns if not c.startswith("__") and c != "n_votes"]
        return voted.select(*[qcol(c) for c in own], "n_votes", F.when(F.col("n_votes") > 0, decided).alias("prediction"))

    def out_of_bag(self, df: DataFrame) -> DataFrame:
        """The rows fitted on, with n_votes (trees that never saw the row) and what these predict (NULL: none)."""
        return self._decided(self._voted(df, True))

    def predict(self, df: DataFrame) -> DataFrame:
        """New rows with n_votes (all trees) and the prediction."""
        return self._decided(self._voted(df, False))

    def estimate(self, df: DataFrame) -> DataFrame:
        """(n_rows, n_judged, n_votes, score): accuracy or R^2 of the out-of-bag predictions, one row."""
        told = materialize(self.out_of_bag(df).select(F.col(self.label).cast("double").alias("label"), "n_votes",
                                                      "prediction"))
        sums = [F.count(F.lit(1)).alias("n_rows"), F.count("prediction").alias("n_judged"),
                F.coalesce(F.sum("n_votes"), F.lit(0)).alias("n_votes")]
        if self.num_classes:
            return told.agg(*sums, F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("score"))
        summary = mt.regression_summary(told.where(F.col("prediction").isNotNull()), "label", "prediction").first()
        return told.agg(*sums, F.lit(summary["r2"]).cast("double").alias("score"))


def fit(df: DataFrame, features: list[str], label: str, key: list[str], num_classes: int | None = None,
        num_trees: int = FOREST_TREES, max_depth: int = DEFAULT_MAX_DEPTH, seed: int = SEED,
        parallelism: int = 3) -> Forest:
    """Fit a classification (``num_classes``; labels 0, 1, ...) or regression forest on complete rows.

    Features, label and the weights in all bags are checkpointed once; every tree reads its own weights.
    """
    weights = F.array(*[bag_weight(key, t, seed).cast("byte") for t in range(num_trees)])
    rows = materialize(_with_vector(df, features, [qcol(label).cast("double").alias("__label"),
                                                   weights.alias("__weights")]))
    if rows.isEmpty():
        raise ValueError("no rows to fit")
    settings = dict(featuresCol="__features", labelCol="__label", weightCol="__weight", numTrees=1, bootstrap=False,
                    maxDepth=max_depth, maxMemoryInMB=TREE_MEMORY_MB, cacheNodeIds=True, checkpointInterval=10)

    def one(tree: int):
        weighted = (rows.withColumn("__weight", F.col("__weights").getItem(tree).cast("double")).drop("__weights")
                    .where(F.col("__weight") > 0))
        make = (RandomForestClassifier(featureSubsetStrategy="sqrt", seed=seed + tree, **settings) if num_classes
                else RandomForestRegressor(featureSubsetStrategy="all", seed=seed + tree, **settings))
        return make.fit(weighted).trees[0]

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        trees = list(pool.map(one, range(num_trees)))
    return Forest(trees, list(features), label, list(key), num_classes, seed)
