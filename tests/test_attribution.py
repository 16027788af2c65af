import hashlib

import pytest
from pyspark.sql import functions as F

from tablelens.operators import attribution, least_squares
from tablelens.operators import metrics as mt


def plain_shift(rows, shift):
    order = sorted(rows, key=lambda r: hashlib.md5(f"42|={r[0]}".encode()).hexdigest())
    return {r[0]: order[(i + shift) % len(order)] for i, r in enumerate(order)}


@pytest.mark.parametrize("shift", [1, 7, -3, 1000])
def test_shift_against_plain_order(spark, shift):
    rows = [(i, float(i * i), f"v{i}") for i in range(211)]
    df = spark.createDataFrame(rows, "k long, `x y` double, t string").repartition(9)
    expected = plain_shift(rows, shift)
    got = attribution.with_shifted(df, ["x y", "t"], ["k"], shift).collect()
    assert len(got) == 211
    assert all((r["__s0"], r["__s1"]) == expected[r["k"]][1:] for r in got)


def test_importance_of_a_linear_model(spark):
    df = spark.range(400).select("id", F.rand(3).alias("a"), F.rand(4).alias("b"), F.rand(5).alias("c"))
    df = df.withColumn("y", 3 * F.col("a") + F.col("b")).cache()
    model = least_squares.fit(df, ["a", "b", "c"], "y")

    def r2(frame):
        return mt.regression_summary(model.predict(frame), "y", "prediction").first()["r2"]

    found = {r["feature"]: r["importance"] for r in
             attribution.permutation_importance(df, ["a", "b", "c"], ["id"], r2).collect()}
    assert found["a"] > found["b"] > 0.05 and abs(found["c"]) < 1e-9
    again = {r["feature"]: r["importance"] for r in
             attribution.permutation_importance(df.repartition(13), ["a", "b", "c"], ["id"], r2).collect()}
    assert found == pytest.approx(again)


def test_awkward(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k long, x double")
    with pytest.raises(ValueError):
        attribution.with_shifted(df, ["x"], ["k"])
    assert attribution.with_shifted(df.limit(0), ["x"], ["k"]).count() == 0
    one = attribution.with_shifted(df.limit(1), ["x"], ["k"]).collect()
    assert len(one) == 1 and one[0]["__s0"] == one[0]["x"]
    nulls = spark.createDataFrame([(None, 1.0), (2, None)], "k long, x double")
    assert {(r["k"], r["__s0"]) for r in attribution.with_shifted(nulls, ["x"], ["k"]).collect()} == {(None, None), (2, 1.0)}
