import pytest

from tablelens.operators import metrics as mt
from tablelens.operators.ordered import running_totals


def _m(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_classification(spark):
    y = [0, 1, 2, 0, 1, 2]
    p = [0, 2, 1, 0, 0, 1]
    df = spark.createDataFrame(list(zip(y, p)), "label int, prediction int")
    m = _m(mt.classification_metrics(df))
    assert m["accuracy"] == pytest.approx(1 / 3)
    assert m["precision"] == pytest.approx(0.2222222222)
    assert m["recall"] == pytest.approx(1 / 3)
    assert m["f1_score"] == pytest.approx(0.2666666667)
    cm = {(r["actual"], r["predicted"]): r["count"] for r in mt.confusion_matrix(df).collect()}
    assert [[cm[(str(a), str(b))] for b in range(3)] for a in range(3)] == [[2, 0, 0], [1, 0, 1], [0, 2, 0]]
    rep = {r["class_label"]: r for r in mt.classification_report(df).collect()}
    assert rep["accuracy"]["f1_score"] == pytest.approx(1 / 3) and rep["weighted avg"]["support"] == 6


def test_roc(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, score double")
    assert mt.roc_auc(df).first()["auc"] == pytest.approx(0.75)
    pts = [(r["fpr"], r["tpr"]) for r in mt.roc_curve(df).collect()]
    assert pts == [(0.0, 0.0), (0.0, 0.5), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)]


def test_roc_ties_and_ranges(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 3000)
    s = (rng.random(3000) + y * 0.3).round(2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    # brute force AUC with ties counted half
    pos, neg = s[y == 1], s[y == 0]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert mt.roc_auc(df).first()["auc"] == pytest.approx(brute, abs=1e-12)


def test_running_totals_cross_ranges(spark):
    import pandas as pd
    df = spark.createDataFrame([(float(i), i % 3, 1) for i in range(500)], "s double, a long, b long")
    out = running_totals(df, "s", ["a", "b"], descending=True, ranges=7, lead=["a"]).toPandas()
    out = out.sort_values("s", ascending=False)
    assert out["cum_a"].tolist() == out["a"].cumsum().tolist()
    assert out["next_a"].tolist()[:-1] == out["a"].tolist()[1:]
    assert pd.isna(out["next_a"].tolist()[-1])


def test_regression(spark):
    df = spark.createDataFrame([(3.0, 2.5), (-0.5, 0.0), (2.0, 2.0), (7.0, 8.0)], "label double, prediction double")
    m = _m(mt.regression_metrics(df))
    assert m["MAE"] == pytest.approx(0.5) and m["MSE"] == pytest.approx(0.375)
    assert m["RMSE"] == pytest.approx(0.6123724357) and m["R2"] == pytest.approx(0.9486081370)
    c1 = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "label double, prediction double")
    c2 = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "label double, prediction double")
    assert _m(mt.regression_metrics(c1))["R2"] == 1.0 and _m(mt.regression_metrics(c2))["R2"] == 0.0


def test_confusion_matrix_of_many_classes(spark):
    from tablelens.operators import metrics
    df = spark.createDataFrame([(f"c{i}", f"c{i + i % 2}") for i in range(30)], "label string, prediction string")
    grid = metrics.confusion_matrix(df)
    assert grid.count() == 31 * 31 and grid.where("count > 0").count() == 30
    sparse = metrics.confusion_matrix(df, max_grid_classes=30)
    assert sorted(map(tuple, sparse.collect())) == sorted(map(tuple, grid.where("count > 0").collect()))
    assert metrics.confusion_matrix(df.limit(0)).count() == 0
