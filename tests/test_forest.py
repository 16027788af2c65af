"""Forests: bags by hash, out-of-bag votes and estimates against plain computation."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.operators import forest


def weight(key, tree, seed):
    text = "|".join([str(seed), str(tree), *("-" if k is None else f"={k}" for k in key)])
    number = int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    return sum(number >= x for x in forest.poisson_limits())


def test_bags_are_poisson(spark):
    limits = forest.poisson_limits()
    assert limits == sorted(limits) and abs(limits[0] / forest.RANGE - np.exp(-1)) < 1e-9
    rows = [(i, None if i % 7 == 0 else f"k{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, `b.c` string")
    got = {r["a"]: (r["x"], r["y"]) for r in df.select(
        "a", forest.bag_weight(["a", "b.c"], 0).alias("x"), forest.bag_weight(["a", "b.c"], 5, 1).alias("y")).collect()}
    assert got == {a: (weight((a, b), 0, 42), weight((a, b), 5, 1)) for a, b in rows}
    drawn = np.array([x for x, _ in got.values()])
    assert abs(drawn.mean() - 1) < 0.06 and abs(drawn.var() - 1) < 0.1
    found = forest.bags(df.repartition(5), ["a", "b.c"], 3).collect()
    assert [(r["tree"], r["n_in"], r["n_out"], r["weight"]) for r in found] == [
        (t, sum(w > 0 for w in ws), sum(w == 0 for w in ws), sum(ws))
        for t in range(3) for ws in [[weight(r, t, 42) for r in rows]]]
    assert forest.bags(df.limit(0), ["a"], 2).agg(F.sum("n_in"), F.sum("weight")).first() == (0, 0)


def test_regression_out_of_bag(spark):
    rng = random.Random(3)
    rows = [(i, float(i % 2), rng.random() + i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    grown = forest.fit(df, ["x"], "y", ["id"], None, 4, 1)
    w = np.array([[weight((i,), t, 42) for t in range(4)] for i in range(200)])
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    means = np.array([[np.average(y[x == s], weights=w[x == s, t]) for t in range(4)] for s in (0, 1)])
    told = {r["id"]: (r["n_votes"], r["prediction"]) for r in grown.out_of_bag(df).collect()}
    judged = []
    for i in range(200):
        unseen = w[i] == 0
        assert told[i][0] == unseen.sum()
        if unseen.any():
            assert told[i][1] == pytest.approx(means[int(x[i]), unseen].mean())
            judged.append((y[i], told[i][1]))
        else:
            assert told[i][1] is None
    a, p = np.array(judged).T
    r = grown.estimate(df).first()
    assert (r["n_rows"], r["n_judged"], r["n_votes"]) == (200, len(judged), (w == 0).sum())
    assert r["score"] == pytest.approx(1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum())
    new = grown.predict(spark.createDataFrame([(900, 1.0)], "id long, x double")).first()
    assert new["n_votes"] == 4 and new["prediction"] == pytest.approx(means[1].mean())


def test_estimate_is_near_the_error_on_new_rows(spark):
    """Deep classification trees know their own rows by heart; rows out of the bag tell the truth."""
    rng = np.random.default_rng(1)

    def made(first, n):
        x = rng.random((n, 3))
        y = ((x[:, 0] > 0.5).astype(int) + (x[:, 1] > 0.5)) * (rng.random(n) > 0.2)
        return spark.createDataFrame([(first + i, *map(float, v), float(c)) for i, (v, c) in enumerate(zip(x, y))],
                                     "id long, a double, `b.c` double, c double, y double")

    seen, new = made(0, 500), made(10_000, 500)
    grown = forest.fit(seen, ["a", "b.c", "c"], "y", ["id"], 3, 10, 8)

    def accuracy(df):
        return df.agg(F.avg((F.col("y") == F.col("prediction")).cast("double"))).first()[0]

    inside, outside = accuracy(grown.predict(seen)), accuracy(grown.predict(new))
    guess = grown.estimate(seen).first()["score"]
    assert abs(guess - outside) < 0.08 and inside > guess + 0.05
    again = forest.fit(seen.repartition(3), ["a", "b.c", "c"], "y", ["id"], 3, 1, 8)
    assert again.trees[0].numNodes > 10 and set(grown.out_of_bag(seen).columns) == {*seen.columns, "n_votes", "prediction"}
    with pytest.raises(ValueError):
        forest.fit(seen.limit(0), ["a"], "y", ["id"], 3, 1)


def test_a_key_is_hashed_once_a_tree(spark):
    """Limits are held against one hash, however many there are, and the passes of a fit hash nothing again."""
    assert str(forest.bag_weight(["a"], 0)).lower().count("md5") == 1
    df = spark.createDataFrame([(i, float(i % 2), float(i % 3)) for i in range(60)], "id long, x double, y double")
    before = forest.bag_weight
    asked = []
    try:
        forest.bag_weight = lambda key, tree, seed=forest.SEED: asked.append(tree) or before(key, tree, seed)
        forest.fit(df, ["x"], "y", ["id"], None, 3, 1)
    finally:
        forest.bag_weight = before
    # all trees' weights in one table that the trees read, its byte a tree enough for the largest weight
    assert asked == [0, 1, 2] and len(forest.poisson_limits()) < 128
