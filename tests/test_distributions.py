import pytest
from pyspark.sql import functions as F

from tablelens.operators import distributions as dist


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,)], "x double")
    h = dist.histogram(df, "x", 3).orderBy("bin").collect()
    assert [r["count"] for r in h] == [1, 1, 2]
    assert [r["lower"] for r in h] + [h[-1]["upper"]] == [0.0, 1.0, 2.0, 3.0]


def test_histogram_constant_and_empty(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "x double")
    h = dist.histogram(df, "x", 3).orderBy("bin").collect()
    assert [r["count"] for r in h] == [0, 3, 0]
    assert h[0]["lower"] == 4.5 and h[-1]["upper"] == 5.5
    empty = spark.createDataFrame([(None,)], "x double")
    assert dist.histogram(empty, "x", 3).count() == 0


def test_histogram_matches_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    vals = rng.exponential(size=3000).round(2)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = [r["count"] for r in dist.histogram(df, "x", 30).orderBy("bin").collect()]
    want, _ = np.histogram(vals, bins=30)
    assert got == want.tolist()


def test_correlation_pairwise(spark):
    rows = [(1.0, 5.0, 2.0), (2.0, 5.0, None), (3.0, 5.0, 7.0), (None, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    m = {(r["column_a"], r["column_b"]): r["corr"] for r in dist.correlation_matrix(df).collect()}
    assert abs(m[("a", "c")] - 1.0) < 1e-12 and m[("c", "a")] == m[("a", "c")]
    assert m[("a", "b")] is None and m[("b", "b")] is None and m[("a", "a")] == 1.0


def test_correlation_matches_pandas(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(
        "l_quantity", "l_extendedprice", "l_discount")
    pdf = df.toPandas().corr()
    m = {(r["column_a"], r["column_b"]): r["corr"] for r in dist.correlation_matrix(df).collect()}
    for a in pdf.columns:
        for b in pdf.columns:
            assert abs(m[(a, b)] - pdf.loc[a, b]) < 1e-9


def test_scatter_refuses_same_column(spark, edge_profile):
    import pytest
    with pytest.raises(ValueError):
        dist.scatter_pairs(edge_profile, "x", "x")
    assert dist.scatter_pairs(edge_profile, "id", "x").count() == 6
    g = dist.scatter_grid(edge_profile, "id", "x", 4)
    assert sum(r["count"] for r in g.collect()) == 6


def test_correlation_wide_long_form_matches_pandas(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(7)
    k = 16
    data = rng.normal(size=(400, k)).round(3)
    data[rng.random(size=data.shape) < 0.1] = np.nan
    cols = [f"v{i}" for i in range(k)]
    pdf = pd.DataFrame(data, columns=cols)
    df = spark.createDataFrame([tuple(None if np.isnan(x) else float(x) for x in row) for row in data],
                               ", ".join(f"{c} double" for c in cols))
    m = {(r["column_a"], r["column_b"]): r["corr"] for r in dist.correlation_matrix(df).collect()}
    want = pdf.corr()
    for a in cols:
        for b in cols:
            assert abs(m[(a, b)] - want.loc[a, b]) < 1e-9


def test_scatter_sample_does_not_depend_on_layout(spark):
    df = spark.range(5000).select("id", (F.col("id") % 97).cast("double").alias("x"),
                                  F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.col("id") % 13).alias("y"))
    df = df.unionByName(spark.createDataFrame([(9999, 1e6, 500), (9998, float("inf"), 1)], "id long, x double, y long"))
    a = dist.scatter_sample(df, "x", "y", ["id"], per_cell=2, bins=10)
    b = dist.scatter_sample(df.repartition(17), "x", "y", ["id"], per_cell=2, bins=10)
    assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count()
    assert a.groupBy("x_bin", "y_bin").count().where("count > 2").count() == 0
    assert a.where("id = 9999").count() == 1 and a.where("id = 9998 or y is null").count() == 0
    assert "WindowGroupLimit" in a._jdf.queryExecution().executedPlan().toString()
    assert dist.scatter_sample(df.limit(0), "x", "y", ["id"]).count() == 0
    with pytest.raises(ValueError):
        dist.scatter_sample(df, "x", "x", ["id"])
