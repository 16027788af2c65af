import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 11 and "outliers" in df.columns


def test_registry_consistent():
    qs, orc = entry.queries(), entry.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 50


def test_cheap_queries_run_small(spark):
    qs = entry.queries()
    for name in ["table_overview", "missing_by_column", "histogram_30", "confusion_matrix", "roc_auc",
                 "feature_frame", "score_validate"]:
        assert qs[name](spark, "/root/testdata/sf0.001").count() >= 1, name


def test_profile_report(spark):
    from tablelens.plans.report import profile_report
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    rep = profile_report(df)
    assert rep["overview"].first()["n_rows"] == 1500
    assert "histogram:o_totalprice" in rep and rep["histogram:o_totalprice"].count() == 30
    assert rep["correlation"].count() == 9
