"""Model candidates, fitting and selection with MLlib; importances and coefficients.

The three candidates per problem type mirror the reference's choice
(linear model, decision tree, random forest), re-expressed as MLlib
estimators.  Differences that cannot be removed are settings: trees are
depth-limited (MLlib's maximum is 30; default here 10) and seeded.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.classification import (
    DecisionTreeClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.layout import deal, spread
from . import metrics as mt

# Fixed values of the reference's estimators.
LOGISTIC_MAX_ITER = 1000
FOREST_TREES = 100
SEED = 42
TOP_FEATURES = 15
DEFAULT_MAX_DEPTH = 10
# Tree training setting that changes speed, not the model: a larger budget for
# node statistics per pass (fewer passes over the data).  Node ids are not cached
# between levels: that holds a number per row and tree, several times over, in
# memory, on disk and in the checkpoint folder; a row finds its node from the root.
TREE_MEMORY_MB = 1024

CLASSIFIER_NAMES = ["Logistic Regression", "Decision Tree", "Random Forest"]
REGRESSOR_NAMES = ["Linear Regression", "Decision Tree Regressor", "Random Forest Regressor"]


def assemble(df: DataFrame, features: list[str], output: str = "features", keep_invalid: bool = False) -> DataFrame:
    """Feature columns -> one vector column.

    Training input must be clean (missing values raise); scoring may pass
    ``keep_invalid=True`` so rows with missing values get NaN entries and are
    blanked afterwards instead of being split off.
    """
    return VectorAssembler(inputCols=list(features), outputCol=output,
                           handleInvalid="keep" if keep_invalid else "error").transform(df)


def candidates(problem_type: str, n_train: int, label: str = "label", max_depth: int = DEFAULT_MAX_DEPTH,
               num_trees: int = FOREST_TREES, seed: int = SEED) -> list[tuple[str, object]]:
    """(name, estimator) in the reference's order."""
    common = dict(featuresCol="features", labelCol=label)
    trees = dict(maxMemoryInMB=TREE_MEMORY_MB, cacheNodeIds=False)
    if problem_type == "classification":
        return [
            # L2 with C = 1 over n rows is regParam = 1 / n in MLlib's averaged objective.
            ("Logistic Regression", LogisticRegression(maxIter=LOGISTIC_MAX_ITER, regParam=1.0 / max(n_train, 1),
                                                       elasticNetParam=0.0, standardization=False, **common)),
            ("Decision Tree", DecisionTreeClassifier(maxDepth=max_depth, seed=seed, **trees, **common)),
            ("Random Forest", RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth,
                                                     featureSubsetStrategy="sqrt", seed=seed, **trees, **common)),
        ]
    return [
        ("Linear Regression", LinearRegression(regParam=0.0, solver="normal", standardization=False, **common)),
        ("Decision Tree Regressor", DecisionTreeRegressor(maxDepth=max_depth, seed=seed, **trees, **common)),
        ("Random Forest Regressor", RandomForestRegressor(numTrees=num_trees, maxDepth=max_depth,
                                                          featureSubsetStrategy="all", seed=seed, **trees,
                                                          **common)),
    ]


def score_predictions(pred: DataFrame, problem_type: str, label: str = "label") -> float:
    """Accuracy (classification) or R^2 (regression) of a prediction frame."""
    if problem_type == "classification":
        r = pred.agg(F.avg((F.col(label).cast("double") == F.col("prediction")).cast("double")).alias("a")).first()
        return float(r["a"] or 0.0)
    r = mt.regression_summary(pred, label, "prediction").first()
    return float(r["r2"])


@dataclass
class Selection:
    best_name: str
    best_model: object
    scores: list[tuple[str, float]]
    problem_type: str
    max_depth: int

    def scores_frame(self, spark: SparkSession) -> DataFrame:
        """(model, position, score, is_best, max_depth): one row per candidate (a handful of rows);
        ``max_depth`` is the depth trees were allowed, NULL for other models."""
        rows = [(n, i, float(s), n == self.best_name, self.max_depth if "Tree" in n or "Forest" in n else None)
                for i, (n, s) in enumerate(self.scores)]
        return spark.createDataFrame(rows, "model string, position int, score double, is_best boolean, max_depth int")


def train_select(train: DataFrame, test: DataFrame, problem_type: str, features: list[str],
                 label: str = "label", max_depth: int = DEFAULT_MAX_DEPTH, num_trees: int = FOREST_TREES,
                 seed: int = SEED, parallelism: int = 3, only: list[str] | None = None) -> Selection:
    """Fit every candidate on ``train``, score it on ``test``, keep the first best (strict >).

    ``only`` narrows the candidates by name.

    Candidates are fitted concurrently from ``parallelism`` driver threads
    (as MLlib's tuning estimators do), so light models run alongside the
    forest; the choice is made afterwards in candidate order, so ties still
    go to the first.  Both frames are persisted (memory, spilling to disk)
    for the duration of the fits; lost blocks are recomputed from the scan.
    """
    n_train = train.count()
    tr = deal(assemble(train, features).select("features", F.col(label).cast("double").alias(label)), n_train)
    te = spread(assemble(test, features).select("features", F.col(label).cast("double").alias(label)))
    tr.persist(StorageLevel.MEMORY_AND_DISK)
    te.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tr.count()
        te.count()
        cands = [c for c in candidates(problem_type, n_train, label, max_depth, num_trees, seed)
                 if only is None or c[0] in only]

        def fit_score(est):
            model = est.fit(tr)
            return model, score_predictions(model.transform(te), problem_type, label)

        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            results = list(pool.map(fit_score, [est for _, est in cands]))
        best_name, best_model, best_score = None, None, float("-inf")
        scores = []
        for (name, _), (model, s) in zip(cands, results):
            scores.append((name, s))
            if s > best_score:
                best_name, best_model, best_score = name, model, s
    finally:
        tr.unpersist()
        te.unpersist()
    return Selection(best_name, best_model, scores, problem_type, max_depth)


def _ranked(rows: list[tuple], key, top: int | None) -> list[tuple]:
    """Sort model-attribute rows (bounded by the feature count) by key desc, name asc."""
    rows = sorted(rows, key=lambda r: (-key(r), r[1]))
    return [(i + 1,) + r for i, r in enumerate(rows[:top] if top else rows)]


def feature_importance(model, features: list[str], spark: SparkSession, top: int = TOP_FEATURES) -> DataFrame:
    """(rank, class_index, feature, importance): impurity importances, the ``top`` largest.

    The importances are a model attribute with one value per feature, so
    the result is built from that vector (its size never grows with rows).
    """
    imp = model.featureImportances.toArray().tolist()
    rows = _ranked([(0, f, float(v)) for f, v in zip(features, imp)], lambda r: r[2], top)
    return spark.createDataFrame(rows, "rank int, class_index int, feature string, importance double")


def is_linear(model) -> bool:
    """Whether the model has coefficients (the others have importances)."""
    return isinstance(model, (LogisticRegressionModel, LinearRegressionModel))


def coefficients(model, features: list[str]) -> list[tuple[int, str, float]]:
    """(class_index, feature, coefficient): one entry per (class, feature).

    Multiclass logistic regression has one coefficient row per class; binary
    and linear models have class_index 0.
    """
    rows = []
    if isinstance(model, LogisticRegressionModel) and model.numClasses > 2:
        mat = model.coefficientMatrix.toArray()
        for k in range(mat.shape[0]):
            for j, f in enumerate(features):
                rows.append((k, f, float(mat[k, j])))
    else:
        for f, v in zip(features, model.coefficients.toArray().tolist()):
            rows.append((0, f, float(v)))
    return rows


def coefficients_top(model, features: list[str], spark: SparkSession, top: int = TOP_FEATURES) -> DataFrame:
    """(rank, class_index, feature, coefficient, sign): the ``top`` by absolute value."""
    rows = _ranked(coefficients(model, features), lambda r: abs(r[2]), top)
    rows = [r + ("positive" if r[3] > 0 else "negative" if r[3] < 0 else "zero",) for r in rows]
    return spark.createDataFrame(rows, "rank int, class_index int, feature string, coefficient double, sign string")


def predict(model, df: DataFrame, features: list[str], keep: list[str] | None = None,
            keep_invalid: bool = False) -> DataFrame:
    """Model output on any feature frame: prediction and, for classifiers, class probabilities."""
    out = model.transform(assemble(df, features, keep_invalid=keep_invalid))
    cols = [F.col(c) for c in (keep or [])] + [F.col("prediction")]
    if "probability" in out.columns:
        cols.append(vector_to_array("probability").alias("probability"))
    return out.select(*cols)
