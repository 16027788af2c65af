import numpy as np
import pytest

from tablelens.operators.quantiles import approx_quantiles, exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _check(spark, values, **kw):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    got = exact_quantiles(df, ["v"], PROBS, **kw)["v"]
    arr = np.array([v for v in values if v is not None], dtype=float)
    want = np.quantile(arr, PROBS, method="linear")
    assert np.allclose(got, want, rtol=1e-12, atol=1e-12, equal_nan=True), (got, want)


@pytest.mark.parametrize("limit", [65536, 5])
def test_exact_random(spark, limit):
    rng = np.random.default_rng(1)
    _check(spark, rng.normal(size=2000).round(3).tolist(), collect_limit=limit, buckets=16)


def test_exact_hot_value_and_tail(spark):
    vals = [7.0] * 700 + list(range(300)) + [1e12, -1e12]
    _check(spark, vals, collect_limit=3, buckets=4)


def test_exact_with_missing_and_infinity(spark):
    vals = [1.0, 2.0, None, float("inf"), 3.0, float("-inf"), 4.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = exact_quantiles(df, ["v"], [0.0, 0.5, 1.0], collect_limit=1, buckets=2)["v"]
    assert got == [float("-inf"), 2.5, float("inf")]


def test_empty_and_constant(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 5.0)], "a double, b double")
    got = exact_quantiles(df, ["a", "b"], [0.25, 0.75])
    assert got == {"a": [None, None], "b": [5.0, 5.0]}


def test_approx_close(spark):
    df = spark.range(10000).selectExpr("cast(id as double) as v")
    got = approx_quantiles(df, ["v"], [0.5])["v"][0]
    assert abs(got - 4999.5) <= 10


def test_pass_budget_respected(spark, monkeypatch):
    from tablelens.operators import quantiles as qm
    monkeypatch.setattr(qm, "PASS_BUDGET", 64)
    rng = np.random.default_rng(2)
    cols = {f"c{i}": rng.normal(size=500).round(4) for i in range(6)}
    rows = list(zip(*[cols[c].tolist() for c in cols]))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    got = qm.exact_quantiles(df, list(cols), [0.25, 0.5, 0.75])
    for c in cols:
        assert np.allclose(got[c], np.quantile(cols[c], [0.25, 0.5, 0.75]), rtol=1e-12, atol=1e-12)
