import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.operators import least_squares, logistic


def frame(spark, x, y, partitions=40):
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    df = spark.createDataFrame(rows, ", ".join(f"`f {i}` double" for i in range(x.shape[1])) + ", y double")
    return df.repartition(partitions), [f"f {i}" for i in range(x.shape[1])]


def test_least_norm_of_collinear_features(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=300), 1000 * rng.normal(size=300) + 5e6
    dummies = np.eye(3)[rng.integers(0, 3, 300)]
    x = np.column_stack([a, 2 * a, b, dummies, a * 3 + 1e-3 * b, np.full(300, 7.0)])
    y = 3 * a + 0.01 * b + dummies @ [1, 2, 4] + rng.normal(size=300)
    df, features = frame(spark, x, y)
    got = least_squares.fit(df, features, "y")
    xc, yc = x - x.mean(0), y - y.mean()
    xc[:, -1] = 0
    expected = np.linalg.pinv(xc, rcond=1e-11) @ yc
    assert got.rank == 4 and got.n == 300
    assert np.allclose(got.coefficients, expected, rtol=1e-6, atol=1e-8) and got.coefficients[-1] == 0
    assert math.isclose(got.residual, float(((yc - xc @ expected) ** 2).sum()), rel_tol=1e-8)
    told = got.predict(df).agg(F.sum((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    assert math.isclose(told, got.residual, rel_tol=1e-6)


def test_least_squares_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3)) * [1, 1e6, 1e-6]
    df, features = frame(spark, x, x @ [1, 2e-6, 3e6] + 5)
    for n in (1, 7, 70):
        got = least_squares.fit(df.repartition(n), features, "y")
        assert np.allclose(got.coefficients, [1, 2e-6, 3e6], rtol=1e-8) and math.isclose(got.intercept, 5, rel_tol=1e-8)
        assert got.rank == 3


def test_least_squares_awkward(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (float("nan"), 1.0), (4.0, None)], "x double, y double")
    got = least_squares.fit(df, ["x"], "y")
    assert (got.coefficients, got.intercept, got.rank, got.n) == ([0.0], 2.0, 0, 1)
    assert [r["prediction"] for r in got.predict(df).orderBy("y").collect()].count(None) == 2
    with pytest.raises(ValueError):
        least_squares.fit(df.limit(0), ["x"], "y")
    with pytest.raises(ValueError):
        least_squares.fit(df, [], "y")


@pytest.mark.parametrize("classes", [2, 3])
def test_certificate_and_optimum(spark, classes):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 2)) * [1, 3]
    y = (x @ rng.normal(size=(2, classes)) + rng.gumbel(size=(400, classes))).argmax(axis=1)
    df, features = frame(spark, x, y, 5)
    best, end = logistic.optimum(df, features, "y", classes=classes)
    assert end.distance <= 1e-9 and end.largest_gradient < 1e-9
    off = best + 1e-4 * rng.normal(size=best.shape)
    near = logistic.certify(df, features, "y", off, classes)
    gap = off - best
    if classes > 2:
        gap[:, -1] -= gap[:, -1].mean()
    assert np.linalg.norm(gap) <= near.distance < 0.1 and near.objective > end.objective
    # the gradient by differences of the objective
    for place in np.ndindex(best.shape):
        step = np.zeros(best.shape)
        step[place] = 1e-5
        up, down = (logistic.certify(df, features, "y", off + s * step, classes).objective for s in (1, -1))
        assert math.isclose((up - down) / 2e-5, near.gradient[place], abs_tol=1e-8)
        if place[1]:
            break


def test_certificate_of_the_library_model(spark):
    from tablelens.operators import models as md
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 2))
    y = (x @ [1, -2] + rng.logistic(size=500) > 0.3).astype(int)
    df, features = frame(spark, x, y, 4)
    est = dict(md.candidates("classification", 500, "y"))["Logistic Regression"]
    model = est.fit(md.assemble(df, features))
    weights = np.append(model.coefficients.toArray(), model.intercept)
    found = logistic.certify(df, features, "y", weights)
    best, _ = logistic.optimum(df, features, "y", weights)
    assert np.linalg.norm(best[0] - weights) <= found.distance < 0.1


def test_logistic_awkward(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (None, 1.0), (1.0, None)], "x double, y double")
    assert logistic.certify(df, ["x"], "y", [0, 0]).n == 2
    with pytest.raises(ValueError):
        logistic.certify(df.limit(0), ["x"], "y", [0, 0])
    with pytest.raises(ValueError):
        logistic.certify(df, ["x"], "y", [0, 0, 0])
    with pytest.raises(Exception, match="not a class number"):
        logistic.certify(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), ["x"], "y", [0, 0])
