"""Evaluation of any (label, prediction[, score]) frame with plain aggregates.

Nothing here needs a fitted model: the metrics are DataFrame aggregates, so
they can be checked against SQL with rule-made predictions.  The group-by
on (label, prediction) is partially aggregated map-side, so a task sends each
pair of classes once whatever the row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.layout import materialize
from ..functions.typing_rules import INTEGRAL, NUMERIC, qcol, text_to_number
from .ordered import running_totals

_INF = float("inf")

#: A confusion matrix shows pairs that do not occur up to so many classes.
MAX_GRID_CLASSES = 1000


def _zero_div(num: Column, den: Column) -> Column:
    """num / den, and 0 when den is 0 (an empty class scores 0)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _class_text(c: Column, dtype: T.DataType) -> Column:
    """Text of a class where numbers are compared by value: 1, 1.0 and '1' are one class."""
    if isinstance(dtype, T.BooleanType):
        number = c.cast("int").cast("double")
    elif isinstance(dtype, NUMERIC):
        number = c.cast("double")
    else:
        number = text_to_number(c.cast("string"))
    whole = (number == F.rint(number)) & (F.abs(number) < 2.0 ** 53)
    return F.coalesce(F.when(whole, number.try_cast("long").cast("string")).otherwise(number.cast("string")),
                      c.cast("string"))


def pair_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(actual, predicted, n) over the observed pairs.

    Two texts, or two whole-number columns, are compared as they are.  Where
    types differ and one side holds numbers, classes are compared by value.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    sides = [types[label], types[prediction]]
    plain = (all(isinstance(t, T.StringType) for t in sides) or all(isinstance(t, INTEGRAL) for t in sides)
             or not any(isinstance(t, (T.BooleanType, *NUMERIC)) for t in sides))
    text = [qcol(n).cast("string") if plain else _class_text(qcol(n), t) for n, t in zip((label, prediction), sides)]
    return (df.select(text[0].alias("actual"), text[1].alias("predicted"))
            .groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n")))


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class_label, support, predicted, tp, precision, recall, f1_score) per class in
    the union of actual and predicted classes."""
    pc = pair_counts(df, label, prediction)
    zero = F.lit(0).cast("long")
    parts = pc.select(F.explode(F.array(
        F.struct(F.col("actual").alias("class_label"), F.col("n").alias("support"), zero.alias("predicted"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(zero).alias("tp")),
        F.struct(F.col("predicted").alias("class_label"), zero.alias("support"), F.col("n").alias("predicted"),
                 zero.alias("tp")))).alias("p")).select("p.*")
    g = parts.groupBy("class_label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                                         F.sum("tp").alias("tp"))
    p = _zero_div(F.col("tp"), F.col("predicted"))
    r = _zero_div(F.col("tp"), F.col("support"))
    return g.select("class_label", "support", "predicted", "tp", p.alias("precision"), r.alias("recall")).withColumn(
        "f1_score", _zero_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _summary(pcl: DataFrame) -> DataFrame:
    s = F.col("support")
    return pcl.agg(
        F.sum(s).alias("total"),
        _zero_div(F.sum("tp"), F.sum(s)).alias("accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1_score").alias("macro_f1"),
        _zero_div(F.sum(s * F.col("precision")), F.sum(s)).alias("weighted_precision"),
        _zero_div(F.sum(s * F.col("recall")), F.sum(s)).alias("weighted_recall"),
        _zero_div(F.sum(s * F.col("f1_score")), F.sum(s)).alias("weighted_f1"),
    )


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(metric, value): accuracy and support-weighted precision, recall and F1."""
    sm = _summary(per_class(df, label, prediction))
    rows = [("accuracy", "accuracy"), ("precision", "weighted_precision"),
            ("recall", "weighted_recall"), ("f1_score", "weighted_f1")]
    return sm.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value"))
                                        for m, c in rows])))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class_label, precision, recall, f1_score, support): one row per class, then
    'accuracy' (f1_score holds the accuracy), 'macro avg' and 'weighted avg'."""
    full = per_class(df, label, prediction)  # read twice; both reads share its exchange
    pcl = full.select("class_label", "precision", "recall", "f1_score", "support")
    sm = _summary(full)
    null_d = F.lit(None).cast("double")
    names = ["class_label", "precision", "recall", "f1_score", "support"]

    def row(*vals):
        return F.struct(*[v.alias(n) for v, n in zip(vals, names)])
    tail = sm.select(F.inline(F.array(
        row(F.lit("accuracy"), null_d, null_d, F.col("accuracy"), F.col("total")),
        row(F.lit("macro avg"), F.col("macro_precision"), F.col("macro_recall"), F.col("macro_f1"), F.col("total")),
        row(F.lit("weighted avg"), F.col("weighted_precision"), F.col("weighted_recall"),
            F.col("weighted_f1"), F.col("total")))))
    return pcl.unionByName(tail)


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     max_grid_classes: int = MAX_GRID_CLASSES) -> DataFrame:
    """(actual, predicted, count) for every pair over the class union, zeros included.

    Zeros are classes^2 rows by definition.  With over ``max_grid_classes`` classes
    only the pairs that occur are returned.
    """
    pc = pair_counts(df, label, prediction)
    classes = materialize(pc.select(F.explode(F.array("actual", "predicted")).alias("actual")).distinct().where("actual is not null"))
    counts = pc.where("actual is not null and predicted is not null").select("actual", "predicted", F.col("n").alias("count"))
    known = [r["actual"] for r in classes.limit(max_grid_classes + 1).collect()]
    if not known or len(known) > max_grid_classes:
        return counts
    dtype = classes.schema["actual"].dataType
    grid = classes.select("actual", F.explode(F.array(*[F.lit(c).cast(dtype) for c in known])).alias("predicted"))
    return (grid.join(counts, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce(F.col("count"), F.lit(0).cast("long")).alias("count")))


def score_groups(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """(score, pos, neg) per distinct score: partial aggregation absorbs repeated scores."""
    is_pos = F.col(label) == F.lit(positive)
    return (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(F.col(score).cast("double").alias("score"))
            .agg(F.count(F.when(is_pos, 1)).alias("pos"), F.count(F.when(~is_pos, 1)).alias("neg")))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", positive=1,
              drop_intermediate: bool = True) -> DataFrame:
    """(threshold, fpr, tpr): one point per distinct score (descending) after a
    starting point (inf, 0, 0); collinear interior points are dropped."""
    g = materialize(score_groups(df, label, score, positive))     # read by four passes below
    tot = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    P, N = tot["P"] or 0, tot["N"] or 0
    rt = running_totals(g, "score", ["pos", "neg"], descending=True, lead=["pos", "neg"])
    keep = F.lit(True)
    if drop_intermediate:
        last = F.col("next_pos").isNull()
        first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
        keep = first | last | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    pts = rt.where(keep).select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_neg").cast("double"), F.lit(float(N))).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), F.lit(float(P))).alias("tpr"))
    start = df.sparkSession.createDataFrame([(_INF, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(pts)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """One row (auc, n_pos, n_neg): area under the ROC curve, ties counted half.

    AUC = sum over score groups of neg * (positives above + pos / 2) / (P * N);
    NULL when only one class is present.
    """
    g = materialize(score_groups(df, label, score, positive))     # read by three passes below
    rt = running_totals(g, "score", ["pos"], descending=True)
    above = F.col("cum_pos") - F.col("pos")
    return rt.agg(
        F.try_divide(F.sum(F.col("neg") * (above + F.col("pos") / 2.0)),
                     F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"),
        F.coalesce(F.sum("pos"), F.lit(0).cast("long")).alias("n_pos"),
        F.coalesce(F.sum("neg"), F.lit(0).cast("long")).alias("n_neg"))


def regression_summary(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row (n, mae, mse, rmse, r2).  R^2 of a constant target is 1 without error, else 0."""
    y = F.col(label).cast("double")
    p = F.col(prediction).cast("double")
    e = y - p
    n = F.count(F.lit(1))
    sse = F.sum(e * e)
    sst = F.var_pop(y) * n
    r2 = (F.when(sst > 0, 1.0 - sse / sst)
          .when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return df.where(y.isNotNull() & p.isNotNull()).agg(
        n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(metric, value): MAE, MSE, RMSE, R^2."""
    s = regression_summary(df, label, prediction)
    return s.select(F.inline(F.array(*[F.struct(F.lit(m.upper() if m != "r2" else "R2").alias("metric"),
                                                F.col(m).alias("value"))
                                       for m in ("mae", "mse", "rmse", "r2")])))
