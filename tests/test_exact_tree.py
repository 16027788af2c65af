import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.functions import layout
from tablelens.operators import exact_tree


def plain_tree(x, y, classes, max_depth=None):
    """(depth, n, impurity, prediction, feature, threshold) of every node, by trying every cut."""
    out = []

    def impurity(v):
        if classes is None:
            return max(float(np.mean(v * v) - np.mean(v) ** 2), 0.0)
        return 1 - sum((np.bincount(v.astype(int), minlength=classes) / len(v)) ** 2)

    def gain(v):
        return float(sum(np.bincount(v.astype(int), minlength=classes) ** 2) / len(v) if classes else v.sum() ** 2 / len(v))

    def grow(rows, depth):
        v = y[rows]
        best = None
        if (len(set(v)) > 1) and (max_depth is None or depth < max_depth):
            for f in range(x.shape[1]):
                values = sorted(set(x[rows, f]))
                for a, b in zip(values, values[1:]):
                    left = rows[x[rows, f] <= a]
                    right = rows[x[rows, f] > a]
                    s = gain(y[left]) + gain(y[right])
                    if best is None or s > best[0]:
                        best = (s, f, (a + b) / 2, left, right)
        value = float(np.bincount(v.astype(int), minlength=classes).argmax()) if classes else float(v.mean())
        out.append((depth, len(rows), round(impurity(v), 8), round(value, 8), None if best is None else best[1],
                    None if best is None else best[2]))
        if best:
            grow(best[3], depth + 1)
            grow(best[4], depth + 1)

    grow(np.arange(len(y)), 0)
    return sorted(out, key=repr)


def rows_of(tree, features):
    return sorted(((r["depth"], r["n"], round(r["impurity"], 8), round(r["prediction"], 8),
                    None if r["feature"] is None else features.index(r["feature"]), r["threshold"])
                   for r in tree.nodes().collect()), key=repr)


@pytest.mark.parametrize("classes,depth", [(3, None), (None, 3)])
def test_against_plain_search(spark, classes, depth):
    rng = np.random.default_rng(5)
    n = 120
    x = np.column_stack([rng.integers(0, 12, n), np.round(rng.normal(size=n), 1), rng.integers(0, 2, n)]).astype(float)
    y = (rng.integers(0, 3, n) if classes else rng.integers(0, 50, n)).astype(float)
    features = ["a", "b b", "c"]
    df = spark.createDataFrame([(*map(float, r), float(v), "x") for r, v in zip(x, y)],
                               "a double, `b b` double, c double, y double, node string")
    tree = exact_tree.fit(df.repartition(5), features, "y", classes, depth)
    assert rows_of(tree, features) == plain_tree(x, y, classes, depth)
    importances = {r["feature"]: r["importance"] for r in tree.importances().collect()}
    assert math.isclose(sum(importances.values()), 1, abs_tol=1e-9)
    if classes:  # grown to the end, it knows every row that no other contradicts
        told = tree.predict(df).groupBy("a", "b b", "c").agg(F.countDistinct("y").alias("k"), F.min("y").alias("y"),
                                                             F.min("prediction").alias("p")).where("k = 1").collect()
        assert told and all(r["y"] == r["p"] for r in told)


def test_deep_chain(spark):
    """Alternating labels on one line: a leaf for every row."""
    n = 10
    df = spark.createDataFrame([(float(2 ** i), float(i % 2)) for i in range(n)], "x double, y double")
    tree = exact_tree.fit(df, ["x"], "y", 2)
    assert tree.nodes().where("feature is null").count() == n
    assert tree.predict(df).where("prediction <> y").count() == 0


def test_awkward_rows(spark):
    rows = [(1.0, 0.0), (1.0, 1.0), (1.0, 1.0), (None, 1.0), (float("nan"), 0.0), (2.0, None)]
    df = spark.createDataFrame(rows, "x double, y double")
    only = exact_tree.fit(df, ["x"], "y", 2).nodes().collect()
    assert len(only) == 1 and only[0]["n"] == 3 and only[0]["feature"] is None and only[0]["prediction"] == 1.0
    told = exact_tree.fit(df, ["x"], "y", 2).predict(df).collect()
    assert sum(r["prediction"] is None for r in told) == 2 and len(told) == 6
    assert exact_tree.fit(df.limit(0), ["x"], "y", 2).nodes().count() == 0
    with pytest.raises(ValueError):
        exact_tree.fit(df, [], "y", 2)
    with pytest.raises(Exception, match="not a class number"):
        exact_tree.fit(spark.createDataFrame([(1.0, 5.0)], "x double, y double"), ["x"], "y", 2)


def test_neighbouring_doubles(spark):
    a = 1.0
    b = math.nextafter(a, 2)
    df = spark.createDataFrame([(a, 0.0), (b, 1.0)], "x double, y double")
    tree = exact_tree.fit(df, ["x"], "y", 2)
    assert tree.predict(df).where("prediction <> y").count() == 0


def test_rows_of_a_node_are_not_gathered(spark, monkeypatch):
    """Small levels go to the rows; beyond the limit rows are dealt out by node, with the same result."""
    rng = np.random.default_rng(9)
    rows = [(i, float(a), float(b), float(rng.integers(0, 3))) for i, (a, b) in enumerate(rng.integers(0, 9, (80, 2)))]
    df = spark.createDataFrame([*rows, (900, None, 1.0, 2.0)], "id long, a double, b double, y double")

    def told():
        tree = exact_tree.fit(df, ["a", "b"], "y", 3, 4)
        found = tree.predict(df)
        plan = found._jdf.queryExecution().executedPlan().toString()
        return rows_of(tree, ["a", "b"]), sorted(map(tuple, found.collect())), plan

    nodes, said, plan = told()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(exact_tree, "WALK", 2)
    monkeypatch.setattr(exact_tree, "SMALL_TABLE", 3)
    monkeypatch.setattr(layout, "SMALL_TABLE", 3)
    assert told()[:2] == (nodes, said) and len(said) == 81 and sum(r[-1] is None for r in said) == 1
