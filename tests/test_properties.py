"""Property checks from the test strategy: sums, symmetry, partition independence."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tablelens.operators import column_stats, distributions, metrics, profile


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=60),
       st.integers(1, 12))
def test_histogram_counts_sum_to_present_values(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    h = distributions.histogram(df, "x", bins).collect()
    present = [v for v in values if v is not None]
    assert sum(r["count"] for r in h) == len(present)
    if present:
        assert len(h) == bins
        want, _ = np.histogram(np.array(present), bins=bins)
        assert [r["count"] for r in sorted(h, key=lambda r: r["bin"])] == want.tolist()


def test_missing_plus_present_is_rows(spark, edge_profile):
    miss = {r["column_name"]: r["missing"] for r in profile.missing_by_column(edge_profile).collect()}
    d = profile.present_counts(edge_profile).collect()
    assert all(r["non_missing"] + miss[r["column_name"]] == r["n_rows"] for r in d)


def test_confusion_matrix_sums_to_rows(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 4, 500), rng.integers(0, 5, 500)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, p)], "label int, prediction int")
    cm = metrics.confusion_matrix(df).collect()
    assert sum(r["count"] for r in cm) == 500 and len(cm) == 25


def test_correlation_symmetric(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    m = {(r["column_a"], r["column_b"]): r["corr"] for r in distributions.correlation_matrix(df).collect()}
    for (a, b), v in m.items():
        assert m[(b, a)] == v


def test_results_do_not_depend_on_partitioning(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    a = sorted(tuple(r) for r in column_stats.column_stats(df).collect())
    b = sorted(tuple(r) for r in column_stats.column_stats(df.repartition(7)).collect())
    assert a == b
    assert (profile.table_overview(df).first().asDict()
            == profile.table_overview(df.repartition(3)).first().asDict())
