"""Registered queries over models whose results SQL can compute in full: exact trees,
least squares of least norm, and logistic regression at its optimum.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import attribution, exact_tree, least_squares, logistic
from ..operators import metrics as mt
from ..operators import models as md
from ..sources.tables import read_table

CLASS_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
NUMBER_FEATURES = ["l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
TREE_DEPTH = 3
FLAGS = ["A", "N", "R"]


def _class_tree(spark: SparkSession, d: str) -> exact_tree.ExactTree:
    rows = read_table(spark, d, "lineitem").select(
        *CLASS_FEATURES, (F.array_position(F.array(*map(F.lit, FLAGS)), F.col("l_returnflag")) - 1).alias("label"))
    return exact_tree.fit(rows, CLASS_FEATURES, "label", len(FLAGS), TREE_DEPTH)


def _number_tree(spark: SparkSession, d: str) -> exact_tree.ExactTree:
    return exact_tree.fit(read_table(spark, d, "lineitem").select(*NUMBER_FEATURES, "l_quantity"), NUMBER_FEATURES,
                          "l_quantity", None, TREE_DEPTH)


def _nodes(tree: exact_tree.ExactTree):
    return tree.nodes().select("depth", "n", F.round("impurity", 6).alias("impurity"),
                               F.round("prediction", 6).alias("prediction"), "feature",
                               F.round("threshold", 9).alias("threshold"))


def exact_tree_classes(spark, d):
    """Every node of a Gini tree for the return flag: its cut is the best of all cuts between two values."""
    return _nodes(_class_tree(spark, d))


def exact_tree_numbers(spark, d):
    """Every node of a variance tree for the quantity."""
    return _nodes(_number_tree(spark, d))


def exact_tree_importance(spark, d):
    """What share of the impurity taken away each feature has in the Gini tree."""
    return _class_tree(spark, d).importances().select("feature", F.round("importance", 8).alias("importance"))


def exact_tree_predictions(spark, d):
    """How often each flag is predicted as each by the Gini tree, over all lines."""
    lines = read_table(spark, d, "lineitem").select(*CLASS_FEATURES, "l_returnflag")
    told = _class_tree(spark, d).predict(lines)
    flag = F.element_at(F.array(*map(F.lit, FLAGS)), F.col("prediction").cast("int") + 1)
    return told.groupBy(F.col("l_returnflag").alias("actual"), flag.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def least_squares_min_norm(spark, d):
    """Order total on a dummy for every priority, one of them twice: collinear, so the shortest solution is asked for."""
    orders = read_table(spark, d, "orders").select("o_totalprice", *[
        (F.col("o_orderpriority") == p).cast("double").alias(p) for p in PRIORITIES])
    rows = orders.withColumn("again", F.col(f"`{PRIORITIES[0]}`"))
    fitted = least_squares.fit(rows, [*PRIORITIES, "again"], "o_totalprice")
    found = [(f, float(w), fitted.rank, fitted.residual) for f, w in
             zip([*fitted.features, "(intercept)"], [*fitted.coefficients, fitted.intercept])]
    return (spark.createDataFrame(found, "feature string, coefficient double, rank int, residual double")
            .select("feature", F.round("coefficient", 4).alias("coefficient"), "rank",
                    F.round(F.col("residual") / 1e9, 4).alias("residual_1e9")))


def logistic_optimum(spark, d):
    """Whether a line is dear, from its quantity and discount: the optimum that Newton's method
    reaches from the library's fit, the gradient there, and whether the certificate of the library's fit holds."""
    rows = read_table(spark, d, "lineitem").select(
        (F.col("l_quantity") / 10).alias("quantity"), (F.col("l_discount") * 10).alias("discount"),
        (F.col("l_extendedprice") > 35000).cast("double").alias("label"))
    features = ["quantity", "discount"]
    n = rows.count()
    estimator: LogisticRegression = dict(md.candidates("classification", n))["Logistic Regression"]
    model = estimator.fit(md.assemble(rows, features))
    start = np.append(model.coefficients.toArray(), model.intercept)
    first = logistic.certify(rows, features, "label", start)
    best, last = logistic.optimum(rows, features, "label", start)
    off = float(np.linalg.norm(best[0] - start))
    found = [(f, float(w), abs(float(g)) < 1e-9, off <= first.distance + last.distance, last.distance < 1e-6, last.objective)
             for f, w, g in zip([*features, "(intercept)"], best[0], last.gradient[0])]
    return (spark.createDataFrame(found, "feature string, coefficient double, gradient_is_zero boolean, "
                                         "start_within_bound boolean, certified boolean, objective double")
            .withColumn("coefficient", F.round("coefficient", 6)).withColumn("objective", F.round("objective", 9)))


def permutation_importance(spark, d):
    """What R^2 of a linear model of the price loses when quantity or discount comes from another line."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]  # no fewer tell lines apart
    lines = read_table(spark, d, "lineitem").select(*key, "l_discount", "l_extendedprice")
    features = ["l_quantity", "l_discount"]
    model = least_squares.fit(lines, features, "l_extendedprice")

    def r2(frame) -> float:
        return mt.regression_summary(model.predict(frame), "l_extendedprice", "prediction").first()["r2"]

    found = attribution.permutation_importance(lines, features, key, r2)
    return found.select("feature", *[F.round(c, 7).alias(c) for c in ("score", "score_without", "importance")])


def _cuts(source: str, n_features: int, classes: int | None) -> str:
    """SQL of the best cut (f, threshold) per path of ``source`` (path, id), among rows of ``base`` (id, x, y)."""
    if classes:
        sums = [f"sum((y = {k})::BIGINT)::BIGINT AS s{k}" for k in range(classes)]
        names = [f"s{k}" for k in range(classes)]
        left = "(" + " + ".join(f"{s} * {s}" for s in names) + ")::DOUBLE / w"
        right = "(" + " + ".join(f"(t{s} - {s}) * (t{s} - {s})" for s in names) + ")::DOUBLE / (tw - w)"
        mixed = f"greatest({', '.join('t' + s for s in names)}) < tw"
    else:
        sums, names = ["sum(y) AS s0", "sum(y * y) AS q"], ["s0", "q"]
        left, right = "s0 * s0 / w", "(ts0 - s0) * (ts0 - s0) / (tw - w)"
        mixed = "tq * tw > ts0 * ts0"
    whole = ["w", *names]
    return f"""(
  SELECT path, f, threshold FROM (
    SELECT path, f, (v + nv) / 2 AS threshold,
           row_number() OVER (PARTITION BY path ORDER BY {left} + {right} DESC, f, v) AS place
    FROM (
      SELECT path, f, v, lead(v) OVER (PARTITION BY path, f ORDER BY v) AS nv,
             {', '.join(f"(sum({c}) OVER (PARTITION BY path, f ORDER BY v))::{'BIGINT' if classes or c == 'w' else 'DOUBLE'} AS {c}" for c in whole)},
             {', '.join(f"(sum({c}) OVER (PARTITION BY path, f))::{'BIGINT' if classes or c == 'w' else 'DOUBLE'} AS t{c}" for c in whole)}
      FROM (SELECT path, f, x[f] AS v, count(*) AS w, {', '.join(sums)}
            FROM {source} JOIN base USING (id), (SELECT unnest(range(1, {n_features + 1})) AS f)
            GROUP BY path, f, v))
    WHERE nv IS NOT NULL AND {mixed})
  WHERE place = 1)"""


def _tree_sql(table: str, features: list[str], label: str, classes: int | None, result: str) -> str:
    """A tree in recursive SQL; ``result`` selects from ``nodes`` (and ``grown``: path, id)."""
    n = len(features)
    if classes:
        impurity = "1 - (" + " + ".join(f"sum((y = {k})::BIGINT) ^ 2" for k in range(classes)) + ") / count(*) ^ 2"
        counts = ", ".join(f"sum((y = {k})::BIGINT)" for k in range(classes))
        value = f"list_position([{counts}], greatest({counts}))::DOUBLE - 1"
    else:
        impurity, value = "greatest(sum(y * y) / count(*) - (sum(y) / count(*)) ^ 2, 0)", "sum(y) / count(*)"
    return f"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS id, [{', '.join(f + '::DOUBLE' for f in features)}] AS x, {label} AS y FROM {table}),
grown AS (
  SELECT 0 AS depth, 'o' AS path, id FROM base
  UNION ALL
  SELECT depth + 1, path || CASE WHEN x[f] <= threshold THEN 'l' ELSE 'r' END, id
  FROM grown JOIN base USING (id) JOIN {_cuts('grown', n, classes)} AS cut USING (path)
  WHERE depth < {TREE_DEPTH}),
cuts AS (SELECT * FROM {_cuts(f'(SELECT path, id FROM grown WHERE depth < {TREE_DEPTH})', n, classes)}),
nodes AS (
  SELECT depth, path, n, impurity, prediction, [{', '.join(f"'{f}'" for f in features)}][f] AS feature, threshold
  FROM (SELECT depth, path, count(*) AS n, {impurity} AS impurity, {value} AS prediction
        FROM grown JOIN base USING (id) GROUP BY depth, path) LEFT JOIN cuts USING (path))
{result}"""


_NODES = """SELECT depth, n, round(impurity, 6) AS impurity, round(prediction, 6) AS prediction, feature,
       round(threshold, 9) AS threshold FROM nodes"""
_LABEL = f"list_position({FLAGS}, l_returnflag) - 1"

QUERIES = {
    "exact_tree_classes": exact_tree_classes,
    "exact_tree_numbers": exact_tree_numbers,
    "exact_tree_importance": exact_tree_importance,
    "exact_tree_predictions": exact_tree_predictions,
    "least_squares_min_norm": least_squares_min_norm,
    "logistic_optimum": logistic_optimum,
    "permutation_importance": permutation_importance,
}

_PERMUTATION = """
WITH d AS (
  SELECT l_quantity::DOUBLE AS q, l_discount::DOUBLE AS c, l_extendedprice::DOUBLE AS y,
         md5('42|=' || l_orderkey || '|=' || l_linenumber || '|=' || l_partkey || '|=' || l_suppkey
             || '|=' || l_quantity) AS h FROM lineitem),
m AS (SELECT var_pop(q) AS qq, var_pop(c) AS cc, covar_pop(q, c) AS qc, covar_pop(q, y) AS qy, covar_pop(c, y) AS cy,
             avg(q) AS mq, avg(c) AS mc, avg(y) AS my FROM d),
w AS (SELECT (qy * cc - cy * qc) / (qq * cc - qc * qc) AS a, (cy * qq - qy * qc) / (qq * cc - qc * qc) AS b, * FROM m),
s AS (SELECT q, c, y, coalesce(lead(q) OVER (ORDER BY h), first_value(q) OVER (ORDER BY h)) AS sq,
             coalesce(lead(c) OVER (ORDER BY h), first_value(c) OVER (ORDER BY h)) AS sc FROM d),
p AS (SELECT y, my, my + a * (q - mq) + b * (c - mc) AS whole, my + a * (sq - mq) + b * (c - mc) AS no_q,
             my + a * (q - mq) + b * (sc - mc) AS no_c FROM s, w),
r AS (SELECT 1 - sum((y - whole) ^ 2) / sum((y - my) ^ 2) AS whole, 1 - sum((y - no_q) ^ 2) / sum((y - my) ^ 2) AS no_q,
             1 - sum((y - no_c) ^ 2) / sum((y - my) ^ 2) AS no_c FROM p)
SELECT 'l_quantity' AS feature, round(whole, 7) AS score, round(no_q, 7) AS score_without, round(whole - no_q, 7) AS importance
FROM r UNION ALL SELECT 'l_discount', round(whole, 7), round(no_c, 7), round(whole - no_c, 7) FROM r"""

#: With a dummy for every level, fitted values are the means m of the levels, and w = m + c fits for any c.  The level
#: that is there twice shares its w between two columns, so it counts half in the c of the shortest w.
_LEAST_NORM = f"""
WITH m AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT -sum(m * CASE WHEN p = '{PRIORITIES[0]}' THEN 0.5 ELSE 1 END)
             / sum(CASE WHEN p = '{PRIORITIES[0]}' THEN 0.5 ELSE 1 END) AS c FROM m),
w AS (SELECT p AS feature, (m + c) * CASE WHEN p = '{PRIORITIES[0]}' THEN 0.5 ELSE 1 END AS w FROM m, c
      UNION ALL SELECT 'again', (m + c) / 2 FROM m, c WHERE p = '{PRIORITIES[0]}'
      UNION ALL SELECT '(intercept)', -c FROM c),
r AS (SELECT sum((o_totalprice - m) ^ 2) / 1e9 AS r FROM orders JOIN m ON o_orderpriority = p)
SELECT feature, round(w, 4) AS coefficient, 4 AS rank, round(r, 4) AS residual_1e9 FROM w, r"""

_LOGISTIC = """
WITH RECURSIVE d AS (
  SELECT l_quantity / 10 AS x, l_discount * 10 AS z, (l_extendedprice > 35000)::INT AS y FROM lineitem),
it AS (
  SELECT 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c
  UNION ALL
  SELECT k + 1,
    a - (ga * (hbb * hcc - hbc * hbc) - hab * (gb * hcc - hbc * gc) + hac * (gb * hbc - hbb * gc)) / det,
    b - (haa * (gb * hcc - hbc * gc) - ga * (hab * hcc - hbc * hac) + hac * (hab * gc - gb * hac)) / det,
    c - (haa * (hbb * gc - gb * hbc) - hab * (hab * gc - gb * hac) + ga * (hab * hbc - hbb * hac)) / det
  FROM (
    SELECT *, haa * (hbb * hcc - hbc * hbc) - hab * (hab * hcc - hbc * hac) + hac * (hab * hbc - hbb * hac) AS det
    FROM (
      SELECT k, a, b, c, sum((p - y) * x) + a AS ga, sum((p - y) * z) + b AS gb, sum(p - y) AS gc,
             sum(p * (1 - p) * x * x) + 1 AS haa, sum(p * (1 - p) * x * z) AS hab, sum(p * (1 - p) * x) AS hac,
             sum(p * (1 - p) * z * z) + 1 AS hbb, sum(p * (1 - p) * z) AS hbc, sum(p * (1 - p)) AS hcc
      FROM (SELECT *, 1 / (1 + exp(-(a * x + b * z + c))) AS p FROM it, d)
      GROUP BY k, a, b, c))
  WHERE k < 25),
w AS (SELECT * FROM it WHERE k = 25),
o AS (SELECT (sum(ln(1 + exp(a * x + b * z + c)) - y * (a * x + b * z + c)) + any_value(a * a + b * b) / 2) / count(*) AS f
      FROM w, d)
SELECT feature, round(v, 6) AS coefficient, true AS gradient_is_zero, true AS start_within_bound, true AS certified,
       round(f, 9) AS objective
FROM (SELECT unnest(['quantity', 'discount', '(intercept)']) AS feature, unnest([a, b, c]) AS v FROM w), o"""


def oracles() -> dict[str, str]:
    return {
        "exact_tree_classes": _tree_sql("lineitem", CLASS_FEATURES, _LABEL, len(FLAGS), _NODES),
        "exact_tree_numbers": _tree_sql("lineitem", NUMBER_FEATURES, "l_quantity::DOUBLE", None, _NODES),
        "exact_tree_importance": _tree_sql("lineitem", CLASS_FEATURES, _LABEL, len(FLAGS), """,
gains AS (
  SELECT a.feature, a.n * a.impurity - (SELECT sum(b.n * b.impurity) FROM nodes b
                                        WHERE b.depth = a.depth + 1 AND b.path[:-2] = a.path) AS gain
  FROM nodes a WHERE a.feature IS NOT NULL)
SELECT feature, round(sum(gain) / (SELECT sum(gain) FROM gains), 8) AS importance FROM gains GROUP BY feature"""),
        "exact_tree_predictions": _tree_sql("lineitem", CLASS_FEATURES, _LABEL, len(FLAGS), f"""
SELECT {FLAGS}[y + 1] AS actual, {FLAGS}[prediction::INT + 1] AS predicted, count(*) AS n
FROM grown JOIN nodes USING (depth, path) JOIN base USING (id) WHERE feature IS NULL GROUP BY ALL"""),
        "least_squares_min_norm": _LEAST_NORM,
        "logistic_optimum": _LOGISTIC,
        "permutation_importance": _PERMUTATION,
    }
