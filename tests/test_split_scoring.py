import math

import pytest
from pyspark.sql import functions as F

from tablelens.operators import features as fe
from tablelens.operators import scoring as sc
from tablelens.operators import split as sp


def test_split_is_deterministic_and_partition_free(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    a = sp.flag_test_rows(df, ["k"]).where("is_test").select("k")
    b = sp.flag_test_rows(df.repartition(13), ["k"]).where("is_test").select("k")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.count() == 4000
    tr, te = sp.train_test_split(df, ["k"])
    assert tr.count() == 16000 and te.count() == 4000 and tr.exceptAll(te).count() == 16000


def test_split_of_equal_rows(spark):
    df = spark.range(10003).select((F.col("id") % 3).alias("x"))
    tr, te = sp.train_test_split(df)
    assert te.count() == math.ceil(0.2 * 10003) and tr.count() + te.count() == 10003
    whole = tr.unionByName(te).groupBy("x").count()
    assert {r["x"]: r["count"] for r in whole.collect()} == {0: 3335, 1: 3334, 2: 3334}


def test_clean_rows(spark):
    rows = [(1.0, 1.0), (float("inf"), 1.0), (None, 1.0), (2.0, None), (float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert sp.clean_rows(df, ["x"], "y").count() == 1
    with pytest.raises(ValueError):
        sp.check_all_numeric(spark.createDataFrame([("a",)], "s string"), ["s"])


@pytest.fixture()
def city_train(spark):
    rows = [("P", 1.0, 0.0), ("Q", 2.0, 1.0), ("R", 4.0, 2.0), ("P", 3.0, 1.0)]
    return spark.createDataFrame(rows, "city string, size double, y double")


def test_scoring_rows(spark, city_train):
    spec = fe.fit_features(city_train, "y")
    assert spec.feature_columns == ["size", "city_Q", "city_R"]
    doms = sc.fit_domains(city_train, ["city", "size"])
    new = spark.createDataFrame(
        [(1, "Q", "2"), (2, "Z", "2"), (3, "P", "1"), (4, "P", "4"), (5, "P", "5"), (6, "P", ""), (7, "P", "x")],
        "id int, city string, size string")
    res = {r["id"]: (r["issue"], r["warning"]) for r in sc.validate_rows(new, doms, sc.domain_values(city_train, doms)).collect()}
    assert res[1] == (None, None) and res[2] == (None, "unseen category: city")
    assert res[3] == (None, None) and res[4] == (None, None)
    assert res[5][0] == "out of range: size" and res[6][0] == "empty: size" and res[7][0] == "not a number: size"
    aligned = {r["id"]: tuple(r[1:]) for r in sc.align(new.where("id <= 2"), spec, keep=["id"]).collect()}
    assert aligned == {1: (2.0, 1, 0), 2: (2.0, 0, 0)}


def test_score_batch_one_row_per_input(spark):
    from tablelens.plans import training
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    tm = training.train(orders, "o_orderstatus", ["o_totalprice", "o_orderpriority"], num_trees=5, max_depth=4)
    new = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.lit(None))
                        .otherwise(F.col("o_totalprice")).alias("o_totalprice"), "o_orderpriority")
    out = training.score_batch(tm, new, keep=["o_orderkey"])
    rows = out.collect()
    assert len(rows) == orders.count()
    bad = [r for r in rows if r["issue"] is not None]
    assert bad and all(r["prediction"] is None and r["predicted_label"] is None for r in bad)
    good = [r for r in rows if r["issue"] is None]
    names = {r["value"] for r in tm.labels.collect()}
    assert all(r["predicted_label"] in names for r in good)


def test_unseen_categories(spark, city_train):
    doms = sc.fit_domains(city_train, ["city"])
    new = spark.createDataFrame([(1, "Q"), (2, "Z"), (3, None), (4, "Z")], "id int, city string")
    checked = sc.validate_rows(new, doms, sc.domain_values(city_train, doms))
    assert {r["id"]: r["warning"] for r in checked.collect()} == {
        1: None, 2: "unseen category: city", 3: None, 4: "unseen category: city"}


def test_typed_booleans_and_missing_dates(spark):
    train = spark.sql("SELECT true AS flag, DATE'2020-01-01' AS day, 1.0D AS y UNION ALL "
                      "SELECT false, DATE'2020-02-01', 2.0D")
    doms = sc.fit_domains(train, ["flag", "day"])
    new = spark.createDataFrame([(1, "True", "2020-01-05"), (2, "maybe", "2020-01-05"), (3, "false", None)],
                                "id int, flag string, day string").withColumn("day", F.col("day").cast("date"))
    res = {r["id"]: (r["issue"], r["warning"])
           for r in sc.validate_rows(new, doms, sc.domain_values(train, doms)).collect()}
    assert res == {1: (None, None), 2: (None, "unseen category: flag"), 3: ("empty: day", None)}
    spec = fe.fit_features(train, "y")
    aligned = sc.align(new, spec, keep=["id"])
    assert {r[0]: r[1] for r in aligned.select("id", sc.unusable(aligned, spec)).collect()}[3] == "not a date: day"


def test_evaluation_agrees_with_selection(spark):
    from tablelens.plans import training
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    tm = training.train(orders, "o_orderstatus", ["o_totalprice", "o_orderpriority"], num_trees=3, max_depth=3)
    found = tm.evaluation()
    accuracy = found["metrics"].where("metric = 'accuracy'").first()["value"]
    assert accuracy == pytest.approx(max(s for _, s in tm.selection.scores)) and accuracy > 0.2
    classes = {r["value"] for r in tm.labels.collect()}
    assert {r["actual"] for r in found["confusion_matrix"].collect()} <= classes
    assert found["confusion_matrix"].agg(F.sum("count")).first()[0] == tm.test.count() == 300


def test_number_text_of_predictions(spark):
    from tablelens.plans import training
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    tm = training.train(orders, "o_totalprice", ["o_custkey"], num_trees=2, max_depth=2)
    row = training.score_batch(tm, orders.limit(1)).first()
    assert row["predicted_label"] == f"{row['prediction']:.4f}"


def test_evaluation_of_multiclass_logistic_regression(spark):
    """Three classes, the linear model chosen: one coefficient per class and feature."""
    from tablelens.plans import training
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumn(
        "size", F.when(F.col("o_totalprice") < 100000, "a").when(F.col("o_totalprice") < 250000, "b").otherwise("c"))
    tm = training.train(orders, "size", ["o_totalprice", "o_custkey"], only=["Logistic Regression"])
    found = tm.evaluation()
    rows = found["coefficients"].collect()
    assert {(r["class_index"], r["feature"]) for r in rows} == {
        (k, f) for k in range(3) for f in tm.feature_columns}
    assert "feature_importance" not in found
    assert found["confusion_matrix"].agg(F.sum("count")).first()[0] == tm.test.count()


def test_labels_numbered_without_one_task(spark):
    from tablelens.operators import target as tg
    df = spark.createDataFrame([(f"v{i % 500:03d}" if i % 7 else None,) for i in range(4000)], "t string")
    labels = tg.fit_labels(df.repartition(7), "t")
    assert [(r["value"], r["class_index"]) for r in labels.orderBy("value").collect()] == [
        (f"v{i:03d}", i) for i in range(500)]


def test_split_where_many_rows_share_a_hash(spark):
    df = spark.range(3000).select(F.lit("same").alias("g"), (F.col("id") % 1500).alias("x"))
    flagged = sp.flag_test_rows(df, ["g"])
    assert flagged.groupBy("is_test").count().where("is_test").first()["count"] == 600 and flagged.count() == 3000
    again = sp.flag_test_rows(df.repartition(11), ["g"])
    assert flagged.exceptAll(again).count() == 0


def test_short_and_long_category_lists_agree(spark, city_train, monkeypatch):
    doms = sc.fit_domains(city_train, ["city"])
    new = spark.createDataFrame([(1, "Q"), (2, "Z"), (3, None), (4, "Z"), (5, "")], "id int, city string")

    def told():
        checked = sc.validate_rows(new, doms, sc.domain_values(city_train, doms))
        return checked, sorted(map(tuple, checked.collect()))

    short, rows = told()
    assert "Join" not in short._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(sc, "SHORT_LIST", 2)
    long, same = told()
    assert "Join" in long._jdf.queryExecution().executedPlan().toString() and rows == same


def test_training_rows_are_dealt_to_the_cores(spark, monkeypatch):
    """Rows of one file come as one task, which all levels of all trees would wait for."""
    from tablelens.functions import layout
    from tablelens.operators import models as md

    monkeypatch.setattr(layout, "DEAL_ROWS", 50)
    set_before = spark.conf.get(layout.SPREAD, None)
    spark.conf.unset(layout.SPREAD)
    try:
        rows = spark.range(0, 200, 1, 1).selectExpr("cast(id % 7 as double) x", "cast(id % 7 > 2 as double) label")
        fitted = []
        monkeypatch.setattr(md, "candidates", lambda *a, **k: [("Decision Tree", Fit(fitted))])
        md.train_select(rows, rows, "classification", ["x"])
        assert fitted == [(min(4, spark.sparkContext.defaultParallelism), 200)]
        assert layout.deal(rows, 49).rdd.getNumPartitions() == 1
    finally:
        if set_before:
            spark.conf.set(layout.SPREAD, set_before)


class Fit:
    """An estimator that notes the tasks and rows it gets."""

    def __init__(self, seen):
        self.seen = seen

    def fit(self, df):
        self.seen.append((df.rdd.getNumPartitions(), df.count()))
        return self

    def transform(self, df):
        return df.selectExpr("*", "label as prediction")
