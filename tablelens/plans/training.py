"""Train-and-select flow and batch scoring built from the operators.

validate target -> project -> encode target -> fit features -> transform ->
clean -> split -> fit candidates -> select -> evaluate; then score new rows
with the same fitted state (no re-fit, no row appended to the training data).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layout import materialize, spread
from ..functions.typing_rules import qcol
from ..operators import distributions as dist
from ..operators import features as fe
from ..operators import metrics as mt
from ..operators import models as md
from ..operators import scoring as sc
from ..operators import split as sp
from ..operators import target as tg


@dataclass
class TrainedModel:
    target: str
    features: list[str]               # original input columns
    problem_type: str
    labels: DataFrame | None          # (value, class_index) for classification
    spec: fe.FeatureSpec
    selection: md.Selection
    domains: list[sc.Domain]
    test: DataFrame                   # engineered test rows (label column "label")
    values: DataFrame                 # (feature, value) of the features picked from a list

    @property
    def model(self):
        return self.selection.best_model

    @property
    def feature_columns(self) -> list[str]:
        return self.spec.feature_columns

    def test_predictions(self) -> DataFrame:
        """(label, prediction[, probability]) of the best model on the test rows."""
        return md.predict(self.model, self.test, self.feature_columns, keep=["label"])

    def evaluation(self) -> dict[str, DataFrame]:
        """Metric frames of the best model on the test rows."""
        pred = self.test_predictions()
        spark = self.test.sparkSession
        out = {"scores": self.selection.scores_frame(spark)}
        if self.problem_type == "classification":
            # classes by name: the label and the predicted index are decoded alike
            pred = tg.label_decode(tg.label_decode(pred, self.labels, "label", "label"), self.labels, "prediction",
                                   "prediction")
            out["metrics"] = mt.classification_metrics(pred)
            out["confusion_matrix"] = mt.confusion_matrix(pred)
            out["classification_report"] = mt.classification_report(pred)
        else:
            out["metrics"] = mt.regression_metrics(pred)
            out["predicted_vs_actual"] = dist.predicted_vs_actual(pred)
            out["residuals"] = dist.residuals(pred)
        m = self.model
        if md.is_linear(m):
            out["coefficients"] = md.coefficients_top(m, self.feature_columns, spark)
        else:
            out["feature_importance"] = md.feature_importance(m, self.feature_columns, spark)
        return out


@dataclass
class Prepared:
    frame: DataFrame                  # engineered, cleaned rows; target renamed to "label"
    spec: fe.FeatureSpec
    problem_type: str
    labels: DataFrame | None
    domains: list[sc.Domain]
    values: DataFrame
    features: list[str]


def prepare(df: DataFrame, target: str, features: list[str] | None = None,
            problem_type: str | None = None) -> Prepared:
    """Validate the target, encode it, fit and apply the feature spec, clean rows."""
    ok, reason = tg.validate_target(df, target)
    if not ok:
        raise ValueError(tg.REASONS[reason])
    if features is None:
        features = [c for c in df.columns if c != target]
    features = [c for c in features if c != target]
    if not features:
        raise ValueError("select at least one feature")
    data = spread(df.select(*[qcol(c) for c in features + [target]]))
    dtype = {f.name: f.dataType for f in data.schema.fields}[target]
    ptype = problem_type or tg.problem_type(dtype)
    domains = sc.fit_domains(data, features)
    values = materialize(sc.domain_values(data, domains))   # read by every later scoring call
    labels = None
    if ptype == "classification":
        labels = materialize(tg.fit_labels(tg.drop_missing_target(data, target), target))
        data, _ = tg.label_encode(data, target, labels, output="__label")
        data = data.drop(target).withColumnRenamed("__label", target)
    else:
        data = tg.drop_missing_target(data, target)
    spec = fe.fit_features(data, target)
    frame = sp.clean_rows(spec.transform(data), spec.feature_columns, target)
    sp.check_all_numeric(frame, spec.feature_columns)
    if target != "label":
        frame = frame.withColumnRenamed(target, "label")
    return Prepared(frame, spec, ptype, labels, domains, values, features)


def train(df: DataFrame, target: str, features: list[str] | None = None, problem_type: str | None = None,
          test_fraction: float = sp.TEST_FRACTION, seed: int = sp.SEED, split_key: list[str] | None = None,
          max_depth: int = md.DEFAULT_MAX_DEPTH, num_trees: int = md.FOREST_TREES,
          only: list[str] | None = None) -> TrainedModel:
    """Fit and select a model for ``target`` from ``features`` (default: all other columns).

    ``split_key`` names engineered columns that decide the side of a row;
    ``only`` narrows the candidate models by name.
    """
    p = prepare(df, target, features, problem_type)
    tr, te = sp.train_test_split(p.frame, split_key, test_fraction, seed)
    sel = md.train_select(tr, te, p.problem_type, p.spec.feature_columns, "label", max_depth, num_trees, seed,
                         only=only)
    return TrainedModel(target, p.features, p.problem_type, p.labels, p.spec, sel, p.domains, te, p.values)


def score_batch(tm: TrainedModel, new: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Validate, align and predict new rows in ONE pass over them: keep columns,
    issue, warning, prediction, predicted_label and (classifiers) probabilities.

    Every row is aligned and sent through the model; rows with a blocking
    issue carry NaN in the feature vector and get NULL outputs, so the
    result has exactly one row per input row without splitting the input.
    """
    # kept columns travel in one struct, so they may share names with features
    kept = F.struct(*[qcol(c) for c in keep]) if keep else F.struct(F.lit(1).alias("__none"))
    checked = sc.validate_rows(new.withColumn("__keep", kept), tm.domains, tm.values)
    carried = ["__keep", "issue", "warning"]
    aligned = sc.align(checked, tm.spec, keep=carried)
    aligned = aligned.withColumn("issue", F.coalesce("issue", sc.unusable(aligned, tm.spec)))
    pred = md.predict(tm.model, aligned, tm.feature_columns, keep=carried, keep_invalid=True)
    ok = F.col("issue").isNull()
    if tm.problem_type == "classification":
        pred = tg.label_decode(pred, tm.labels, "prediction", "predicted_label")
    else:
        pred = pred.withColumn("predicted_label", F.format_string("%.4f", F.col("prediction")))
    cols = [F.col("__keep").getField(c).alias(c) for c in keep or []]
    cols += [F.col("issue"), F.col("warning"), F.when(ok, F.col("prediction")).alias("prediction")]
    if "probability" in pred.columns:
        cols.append(F.when(ok, F.col("probability")).alias("probability"))
    cols.append(F.when(ok, F.col("predicted_label")).alias("predicted_label"))
    return pred.select(*cols)
