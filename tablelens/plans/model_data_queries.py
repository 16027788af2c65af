"""Registered queries for plots, targets, features, split and metrics, with oracles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distributions as dist
from ..operators import features as fe
from ..operators import metrics as mt
from ..operators import models as md
from ..operators import split as sp
from ..operators import target as tg
from ..sources.tables import read_table
from . import fixtures as fx
from .sqlgen import q

LI_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax"]


def _r(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ derived frames

def lineitem_rule_prediction(spark: SparkSession, d: str) -> DataFrame:
    """l_returnflag against a rule-made prediction from l_quantity."""
    li = read_table(spark, d, "lineitem")
    pred = (F.when(F.col("l_quantity") > 34, "R").when(F.col("l_quantity") > 17, "N").otherwise("A"))
    return li.select(F.col("l_returnflag").alias("label"), pred.alias("prediction"))


SQL_RULE_PRED = """(SELECT l_returnflag AS label,
    CASE WHEN l_quantity > 34 THEN 'R' WHEN l_quantity > 17 THEN 'N' ELSE 'A' END AS prediction FROM lineitem)"""


def lineitem_linear_rule(spark: SparkSession, d: str) -> DataFrame:
    """A fixed linear rule: predict 100 * l_tax by 80 * l_discount + 1."""
    li = read_table(spark, d, "lineitem")
    return li.select((F.col("l_tax") * 100).alias("label"), (F.col("l_discount") * 80 + 1).alias("prediction"))


SQL_LINEAR_RULE = "(SELECT l_tax * 100 AS label, l_discount * 80 + 1 AS prediction FROM lineitem)"


def doc_scores(spark: SparkSession, d: str) -> DataFrame:
    """n_chars as a score for the quality label (documents joined to labels)."""
    doc = read_table(spark, d, "documents").select("doc_id", "n_chars")
    lab = read_table(spark, d, "labels").select("doc_id", "quality")
    return doc.join(lab, "doc_id").select(F.col("quality").alias("label"), F.col("n_chars").alias("score"))


SQL_DOC_SCORES = """(SELECT quality AS label, CAST(n_chars AS DOUBLE) AS score
  FROM documents JOIN labels USING (doc_id))"""


def lineitem_inf(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.col("l_discount")).alias("l_discount"),
                     F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("l_returnflag"))


SQL_LINEITEM_INF = """(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
    CASE WHEN l_tax = 0 THEN 'inf'::DOUBLE ELSE l_discount END AS l_discount,
    CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS l_returnflag FROM lineitem)"""


def orders_date_text(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    txt = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select("o_orderkey", "o_orderstatus", txt.alias("o_date_text"),
                    F.when(F.col("o_orderstatus") == "F", txt).otherwise(F.lit("unknown")).alias("o_mixed_text"),
                    "o_orderpriority")


SQL_ORDERS_DATE_TEXT = """(SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_date_text,
    CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'unknown' END AS o_mixed_text,
    o_orderpriority FROM orders)"""


# ------------------------------------------------------------------ Spark queries

def histogram_30(spark, d):
    return _r(dist.histogram(read_table(spark, d, "lineitem"), "l_extendedprice", 30), ["lower", "upper"])


def correlation_matrix(spark, d):
    li = read_table(spark, d, "lineitem").select(*LI_NUMERIC, F.lit(5.0).alias("const_col"))
    return _r(dist.correlation_matrix(li), ["corr"])


def scatter_pairs(spark, d):
    return dist.scatter_pairs(read_table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


def scatter_grid(spark, d):
    return _r(dist.scatter_grid(read_table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 50),
              ["x_lower", "y_lower"])


def scatter_sample(spark, d):
    """Four lines of every cell of the scatter's grid, the same ones however the table is laid out."""
    return _r(dist.scatter_sample(read_table(spark, d, "lineitem"), "l_quantity", "l_extendedprice",
                                  ["l_orderkey", "l_linenumber"]), ["x", "y"])


def predicted_vs_actual(spark, d):
    return _r(dist.predicted_vs_actual(lineitem_linear_rule(spark, d)), ["actual", "predicted", "line_min", "line_max"])


def residuals(spark, d):
    return _r(dist.residuals(lineitem_linear_rule(spark, d)), ["predicted", "residual"])


def validate_targets(spark, d):
    return tg.validate_targets(read_table(spark, d, "customer"))


def label_encode(spark, d):
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    enc, _ = tg.label_encode(li, "l_returnflag")
    return enc


def label_decode(spark, d):
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    enc, labels = tg.label_encode(li, "l_returnflag")
    return tg.label_decode(enc.drop("l_returnflag"), labels, "label", "decoded")


def drop_missing_target(spark, d):
    return tg.drop_missing_target(fx.lineitem_gaps(spark, d), "l_discount")


def clean_rows(spark, d):
    df = lineitem_inf(spark, d)
    return sp.clean_rows(df, ["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag")


def date_like_columns(spark, d):
    res = fe.date_like_columns(orders_date_text(spark, d))
    return _r(res.drop("best_format"), ["share"])


def date_parts(spark, d):
    return fe.date_parts(read_table(spark, d, "orders"), "o_orderdate", keep=["o_orderkey"])


def cardinality_split(spark, d):
    return fe.cardinality_split(read_table(spark, d, "customer"))


def one_hot(spark, d):
    o = read_table(spark, d, "orders")
    return fe.one_hot(o, "o_orderpriority", keep=["o_orderkey"])


def interactions(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = fe.interactions(read_table(spark, d, "lineitem"), cols, keep=["l_orderkey", "l_linenumber"])
    return _r(out, [c for c in out.columns if "_x_" in c])


def feature_frame(spark, d):
    o = read_table(spark, d, "orders")
    frame, spec = fe.feature_frame(o, "o_totalprice")
    inter = [c for c in spec.output_columns if "_x_" in c]
    return _r(frame, inter + ["o_orderkey", "o_custkey", "o_totalprice"])


def train_test_split(spark, d):
    """Both sides of the split that training uses."""
    train, test = sp.train_test_split(read_table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])
    return (train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
            .select("o_orderkey", "is_test"))


def train_test_split_exact(spark, d):
    """Exactly ceil(0.2 n) test rows among rows that are mostly copies of each other."""
    li = read_table(spark, d, "lineitem").select("l_returnflag", "l_linestatus")
    return sp.flag_test_rows(li).groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


def lineitem_index_prediction(spark: SparkSession, d: str) -> DataFrame:
    """The rule prediction as a model gives it: whole-number labels, double predictions."""
    names = F.array(F.lit("A"), F.lit("N"), F.lit("R"))
    return lineitem_rule_prediction(spark, d).select(
        (F.array_position(names, F.col("label")) - 1).cast("int").alias("label"),
        (F.array_position(names, F.col("prediction")) - 1).cast("double").alias("prediction"))


def classification_metrics_indexed(spark, d):
    return _r(mt.classification_metrics(lineitem_index_prediction(spark, d)), ["value"])


def confusion_matrix_indexed(spark, d):
    return mt.confusion_matrix(lineitem_index_prediction(spark, d))


def classification_report_indexed(spark, d):
    return _r(mt.classification_report(lineitem_index_prediction(spark, d)), ["precision", "recall", "f1_score"])


def label_encode_many(spark, d):
    """As many classes as there are customers."""
    enc, _ = tg.label_encode(read_table(spark, d, "customer").select("c_custkey", "c_name"), "c_name")
    return enc


def confusion_matrix_many(spark, d):
    """The supplier of a line against the one its part number points at."""
    li = read_table(spark, d, "lineitem")
    return mt.confusion_matrix(li.select(F.col("l_suppkey").alias("label"),
                                         (F.col("l_partkey") % 50).alias("prediction"))).where("count > 0")


def correlation_with_gaps(spark, d):
    """Columns with missing values and one with an infinity."""
    li = read_table(spark, d, "lineitem")
    gap = F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("gap")
    inf = F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.col("l_tax")).alias("inf")
    return _r(dist.correlation_matrix(li.select("l_quantity", gap, inf, "l_extendedprice")), ["corr"])


_DATE_TEXTS = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy/MM/dd", "dd-MMM-yyyy",
               "yyyy-MM-dd HH:mm", "MMM d, yyyy"]


def date_texts(spark, d):
    """The order date written in many ways, each parsed back by the format found for it."""
    o = read_table(spark, d, "orders")
    ways = [F.date_format("o_orderdate", f).alias(f"way{i}") for i, f in enumerate(_DATE_TEXTS)]
    offset = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'23:30:00"), F.lit("+02:00")).alias("way_offset")
    texts = o.select("o_orderkey", *ways, offset)
    found = {n: s for n, s in fe.date_shares(texts, texts.columns[1:]).items()}
    out = texts.select("o_orderkey", *[F.dayofyear(fe.parse_date(F.col(c), found[c][0])).alias(c)
                                       for c in texts.columns[1:]])
    return out


def classification_metrics(spark, d):
    return _r(mt.classification_metrics(lineitem_rule_prediction(spark, d)), ["value"])


def confusion_matrix(spark, d):
    return mt.confusion_matrix(lineitem_rule_prediction(spark, d))


def classification_report(spark, d):
    return _r(mt.classification_report(lineitem_rule_prediction(spark, d)), ["precision", "recall", "f1_score"])


def roc_curve(spark, d):
    return _r(mt.roc_curve(doc_scores(spark, d)), ["fpr", "tpr"])


def roc_auc(spark, d):
    return _r(mt.roc_auc(doc_scores(spark, d)), ["auc"])


def regression_metrics(spark, d):
    return _r(mt.regression_metrics(lineitem_linear_rule(spark, d)), ["value"])


def ols_single_feature(spark, d):
    """Least squares with one feature, by the estimator and assembly of model selection."""
    li = read_table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    lr = dict(md.candidates("regression", 1, "l_extendedprice"))["Linear Regression"]
    m = lr.fit(md.assemble(li, ["l_quantity"]))
    # one row derived from the fitted model (its size does not grow with the data)
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept), m.summary.numInstances)],
                                 "slope double, intercept double, n long").select(
        F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


QUERIES = {
    "histogram_30": histogram_30,
    "correlation_matrix": correlation_matrix,
    "scatter_pairs": scatter_pairs,
    "scatter_grid": scatter_grid,
    "scatter_sample": scatter_sample,
    "predicted_vs_actual": predicted_vs_actual,
    "residuals": residuals,
    "validate_targets": validate_targets,
    "label_encode": label_encode,
    "label_decode": label_decode,
    "drop_missing_target": drop_missing_target,
    "clean_rows": clean_rows,
    "date_like_columns": date_like_columns,
    "date_parts": date_parts,
    "cardinality_split": cardinality_split,
    "one_hot": one_hot,
    "interactions": interactions,
    "feature_frame": feature_frame,
    "train_test_split": train_test_split,
    "train_test_split_exact": train_test_split_exact,
    "classification_metrics_indexed": classification_metrics_indexed,
    "confusion_matrix_indexed": confusion_matrix_indexed,
    "classification_report_indexed": classification_report_indexed,
    "label_encode_many": label_encode_many,
    "confusion_matrix_many": confusion_matrix_many,
    "correlation_with_gaps": correlation_with_gaps,
    "date_texts": date_texts,
    "classification_metrics": classification_metrics,
    "confusion_matrix": confusion_matrix,
    "classification_report": classification_report,
    "roc_curve": roc_curve,
    "roc_auc": roc_auc,
    "regression_metrics": regression_metrics,
    "ols_single_feature": ols_single_feature,
}


# ------------------------------------------------------------------ oracle SQL

def _sql_histogram(col: str, table: str, bins: int) -> str:
    return f"""
WITH v AS (SELECT CAST({q(col)} AS DOUBLE) AS x FROM {table} WHERE {q(col)} IS NOT NULL AND isfinite({q(col)})),
r AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM v),
e AS (SELECT CAST(i AS INTEGER) AS bin, lo + i * ((hi - lo) / {bins}) AS lower,
             CASE WHEN i = {bins - 1} THEN hi ELSE lo + (i + 1) * ((hi - lo) / {bins}) END AS upper
      FROM r, range({bins}) t(i))
SELECT e.bin, round(e.lower, 6) AS lower, round(e.upper, 6) AS upper, count(v.x) AS count
FROM e LEFT JOIN v ON v.x >= e.lower AND (v.x < e.upper OR (e.bin = {bins - 1} AND v.x <= e.upper))
GROUP BY e.bin, e.lower, e.upper"""


def _sql_correlation() -> str:
    cols = LI_NUMERIC + ["const_col"]
    src = f"(SELECT {', '.join(LI_NUMERIC)}, 5.0::DOUBLE AS const_col FROM lineitem)"
    parts = []
    for c in cols:
        parts.append(f"SELECT '{c}' AS column_a, '{c}' AS column_b, "
                     f"CASE WHEN var_pop({c}) > 0 THEN 1.0::DOUBLE END AS corr FROM {src} t")
    for a, b in combinations(cols, 2):
        r = f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
        v = f"CASE WHEN {r} IS NULL OR isnan({r}) THEN NULL ELSE round({r}, 6) END"
        parts.append(f"SELECT '{a}', '{b}', {v} FROM {src} t")
        parts.append(f"SELECT '{b}', '{a}', {v} FROM {src} t")
    return "\nUNION ALL\n".join(parts)


def _sql_correlation_gaps() -> str:
    """Pairs with the infinite column have no value; a gap takes its row out of its own pairs only."""
    src = """(SELECT l_quantity, CASE WHEN l_discount <> 0 THEN l_discount END AS gap,
             CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS finite, l_extendedprice FROM lineitem)"""
    cols = ["l_quantity", "gap", "inf", "l_extendedprice"]
    parts = []
    for a in cols:
        for b in cols:
            v = "max(CAST(NULL AS DOUBLE))" if "inf" in (a, b) else "max(1.0::DOUBLE)" if a == b else f"round(corr({a}, {b}), 6)"
            parts.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {v} AS corr FROM {src} t")
    return "\nUNION ALL\n".join(parts)


_SQL_INDEX = "CAST(strpos('ANR', {}) - 1 AS VARCHAR)"


def _sql_scatter_cells(bins: int) -> str:
    return f"""
WITH v AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y, l_orderkey, l_linenumber
           FROM lineitem
           WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
r AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS x0,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS x1,
             CASE WHEN min(y) = max(y) THEN min(y) - 0.5 ELSE min(y) END AS y0,
             CASE WHEN min(y) = max(y) THEN max(y) + 0.5 ELSE max(y) END AS y1 FROM v),
ex AS (SELECT CAST(i AS INTEGER) AS b, x0 + i * ((x1 - x0) / {bins}) AS lo,
              CASE WHEN i = {bins - 1} THEN x1 ELSE x0 + (i + 1) * ((x1 - x0) / {bins}) END AS hi
       FROM r, range({bins}) t(i)),
ey AS (SELECT CAST(i AS INTEGER) AS b, y0 + i * ((y1 - y0) / {bins}) AS lo,
              CASE WHEN i = {bins - 1} THEN y1 ELSE y0 + (i + 1) * ((y1 - y0) / {bins}) END AS hi
       FROM r, range({bins}) t(i)),
c AS (SELECT v.*, ex.b AS x_bin, ey.b AS y_bin, ex.lo AS x_lower, ey.lo AS y_lower
      FROM v JOIN ex ON v.x >= ex.lo AND (v.x < ex.hi OR (ex.b = {bins - 1} AND v.x <= ex.hi))
             JOIN ey ON v.y >= ey.lo AND (v.y < ey.hi OR (ey.b = {bins - 1} AND v.y <= ey.hi)))"""


def _sql_scatter_grid(bins: int = 50) -> str:
    return f"""{_sql_scatter_cells(bins)}
SELECT x_bin, y_bin, round(any_value(x_lower), 6) AS x_lower, round(any_value(y_lower), 6) AS y_lower, count(*) AS count
FROM c GROUP BY x_bin, y_bin"""


def _sql_scatter_sample(bins: int, per_cell: int) -> str:
    return f"""{_sql_scatter_cells(bins)}
SELECT x_bin, y_bin, round(x, 6) AS x, round(y, 6) AS y, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY x_bin, y_bin
                               ORDER BY md5('42|=' || l_orderkey || '|=' || l_linenumber), x, y) AS place FROM c)
WHERE place <= {per_cell}"""


def _sql_validate_targets() -> str:
    cols = [("c_custkey", False, "regression"), ("c_name", True, "classification"),
            ("c_nationkey", False, "regression"), ("c_acctbal", False, "regression"),
            ("c_mktsegment", True, "classification")]
    parts = []
    for i, (c, is_text, pt) in enumerate(cols):
        t = "TRUE" if is_text else "FALSE"
        reason = (f"CASE WHEN {t} AND count(DISTINCT {c}) = count(*) THEN 'identifier' "
                  f"WHEN {t} AND count(DISTINCT {c}) > 20 THEN 'too_many_categories' "
                  f"WHEN count(DISTINCT {c}) < 2 THEN 'too_few_classes' ELSE 'ok' END")
        parts.append(f"SELECT '{c}' AS column_name, {i} AS position, count(*) AS n_rows, "
                     f"count(DISTINCT {c}) AS \"unique\", ({reason}) = 'ok' AS ok, {reason} AS reason, "
                     f"'{pt}' AS problem_type FROM customer")
    return "\nUNION ALL\n".join(parts)


def _sql_cardinality_split() -> str:
    return """
SELECT 'c_name' AS column_name, 1 AS position, count(DISTINCT c_name) AS "unique",
       CASE WHEN count(DISTINCT c_name) <= 20 THEN 'low' ELSE 'high' END AS kind FROM customer
UNION ALL
SELECT 'c_mktsegment', 4, count(DISTINCT c_mktsegment),
       CASE WHEN count(DISTINCT c_mktsegment) <= 20 THEN 'low' ELSE 'high' END FROM customer"""


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


def _sql_feature_frame() -> str:
    parts = ["year", "month", "day", "weekday"]
    date_expr = {
        "year": "CAST(year(o_orderdate) AS INTEGER)", "month": "CAST(month(o_orderdate) AS INTEGER)",
        "day": "CAST(day(o_orderdate) AS INTEGER)", "weekday": "CAST(isodow(o_orderdate) - 1 AS INTEGER)"}
    numeric = {"o_orderkey": "CAST(o_orderkey AS DOUBLE)", "o_custkey": "CAST(o_custkey AS DOUBLE)"}
    numeric.update({f"o_orderdate_{p}": date_expr[p] for p in parts})
    sel = [f"round({e}, 6) AS {q(n)}" if n in ("o_orderkey", "o_custkey") else f"{e} AS {q(n)}"
           for n, e in numeric.items()]
    for v in STATUSES[1:]:
        sel.append(f"CASE WHEN o_orderstatus = '{v}' THEN 1 ELSE 0 END AS {q('o_orderstatus_' + v)}")
    for v in PRIORITIES[1:]:
        sel.append(f"CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END AS {q('o_orderpriority_' + v)}")
    names = list(numeric)
    for a, b in combinations(names, 2):
        sel.append(f"round(CAST({numeric[a]} AS DOUBLE) * CAST({numeric[b]} AS DOUBLE), 6) AS {q(a + '_x_' + b)}")
    sel.append("round(o_totalprice, 6) AS o_totalprice")
    return "SELECT " + ",\n  ".join(sel) + "\nFROM orders"


def _sql_confusion() -> str:
    return f"""
WITH p AS {SQL_RULE_PRED},
c AS (SELECT DISTINCT x FROM (SELECT label AS x FROM p UNION SELECT prediction FROM p) WHERE x IS NOT NULL),
n AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY ALL)
SELECT a.x AS actual, b.x AS predicted, coalesce(n.n, 0) AS count
FROM c a CROSS JOIN c b LEFT JOIN n ON n.label = a.x AND n.prediction = b.x"""


def _sql_per_class() -> str:
    return f"""
WITH p AS {SQL_RULE_PRED},
c AS (SELECT DISTINCT x FROM (SELECT label AS x FROM p UNION SELECT prediction FROM p)),
k AS (SELECT c.x AS class_label,
        (SELECT count(*) FROM p WHERE p.label = c.x) AS support,
        (SELECT count(*) FROM p WHERE p.prediction = c.x) AS predicted,
        (SELECT count(*) FROM p WHERE p.label = c.x AND p.prediction = c.x) AS tp FROM c),
m AS (SELECT class_label, support, predicted, tp,
        CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
        CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM k),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                     ELSE 2 * precision * recall / (precision + recall) END AS f1_score FROM m)"""


def _sql_classification_metrics() -> str:
    return _sql_per_class() + """
SELECT 'accuracy' AS metric, round(sum(tp) / sum(support), 6) AS value FROM f
UNION ALL SELECT 'precision', round(sum(support * precision) / sum(support), 6) FROM f
UNION ALL SELECT 'recall', round(sum(support * recall) / sum(support), 6) FROM f
UNION ALL SELECT 'f1_score', round(sum(support * f1_score) / sum(support), 6) FROM f"""


def _sql_classification_report() -> str:
    return _sql_per_class() + """
SELECT class_label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
       support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6),
       CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(support * precision) / sum(support), 6),
       round(sum(support * recall) / sum(support), 6), round(sum(support * f1_score) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM f"""


def _sql_roc_curve() -> str:
    return f"""
WITH d AS {SQL_DOC_SCORES},
g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
      FROM d GROUP BY score),
c AS (SELECT score, pos, neg,
        sum(pos) OVER (ORDER BY score DESC) AS tps, sum(neg) OVER (ORDER BY score DESC) AS fps,
        lead(pos) OVER (ORDER BY score DESC) AS np, lead(neg) OVER (ORDER BY score DESC) AS nn,
        row_number() OVER (ORDER BY score DESC) AS rn FROM g),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM g)
SELECT 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL
SELECT score, round(fps / N, 6), round(tps / P, 6) FROM c, t
WHERE rn = 1 OR np IS NULL OR np <> pos OR nn <> neg"""


def _sql_roc_auc() -> str:
    return f"""
WITH d AS {SQL_DOC_SCORES},
g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
      FROM d GROUP BY score),
c AS (SELECT pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tps FROM g)
SELECT round(sum(neg * (tps - pos + pos / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c"""


def _sql_regression_metrics() -> str:
    return f"""
WITH p AS {SQL_LINEAR_RULE},
s AS (SELECT avg(abs(label - prediction)) AS mae, avg((label - prediction) ^ 2) AS mse,
        sum((label - prediction) ^ 2) AS sse, var_pop(label) * count(*) AS sst FROM p)
SELECT 'MAE' AS metric, round(mae, 6) AS value FROM s
UNION ALL SELECT 'MSE', round(mse, 6) FROM s
UNION ALL SELECT 'RMSE', round(sqrt(mse), 6) FROM s
UNION ALL SELECT 'R2', round(CASE WHEN sst > 0 THEN 1 - sse / sst WHEN sse = 0 THEN 1.0 ELSE 0.0 END, 6) FROM s"""


def oracles() -> dict[str, str]:
    li_inter = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    inter_sel = ", ".join(f"round(CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE), 6) AS {q(a + '_x_' + b)}"
                          for a, b in combinations(li_inter, 2))
    onehot_sel = ", ".join(f"CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END AS {q('o_orderpriority_' + v)}"
                           for v in PRIORITIES[1:])
    text_cols = [("o_orderstatus", 1, "0"), ("o_date_text", 2, "1"), ("o_orderpriority", 4, "0"),
                 ("o_mixed_text", 3, "avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END)")]
    # the share follows from how each column was made
    date_like = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, {i} AS position, round(CAST({share} AS DOUBLE), 6) AS share, "
        f"any_value({share if 'avg' not in share else '0'}) > 0.8 AS is_date FROM {SQL_ORDERS_DATE_TEXT} t"
        for c, i, share in text_cols)
    return {
        "histogram_30": _sql_histogram("l_extendedprice", "lineitem", 30),
        "correlation_matrix": _sql_correlation(),
        "scatter_pairs": """SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y
FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""",
        "scatter_grid": _sql_scatter_grid(50),
        "scatter_sample": _sql_scatter_sample(50, 4),
        "predicted_vs_actual": f"""
WITH p AS {SQL_LINEAR_RULE}
SELECT round(label, 6) AS actual, round(prediction, 6) AS predicted,
       round(min(least(label, prediction)) OVER (), 6) AS line_min,
       round(max(greatest(label, prediction)) OVER (), 6) AS line_max FROM p""",
        "residuals": f"""WITH p AS {SQL_LINEAR_RULE}
SELECT round(prediction, 6) AS predicted, round(label - prediction, 6) AS residual FROM p""",
        "validate_targets": _sql_validate_targets(),
        "label_encode": """SELECT l_orderkey, l_linenumber, l_returnflag,
       CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS label
FROM lineitem WHERE l_returnflag IS NOT NULL""",
        "label_decode": """SELECT l_orderkey, l_linenumber,
       CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS label, l_returnflag AS decoded
FROM lineitem WHERE l_returnflag IS NOT NULL""",
        "drop_missing_target": f"SELECT * FROM {fx.SQL_LINEITEM_GAPS} t WHERE l_discount IS NOT NULL",
        "clean_rows": f"""SELECT * FROM {SQL_LINEITEM_INF} t
WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL
  AND isfinite(l_quantity) AND isfinite(l_extendedprice) AND isfinite(l_discount) AND l_returnflag IS NOT NULL""",
        "date_like_columns": date_like,
        "date_parts": """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year,
       CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day,
       CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_weekday FROM orders""",
        "cardinality_split": _sql_cardinality_split(),
        "one_hot": f"SELECT o_orderkey, {onehot_sel} FROM orders",
        "interactions": f"SELECT l_orderkey, l_linenumber, {inter_sel} FROM lineitem",
        "feature_frame": _sql_feature_frame(),
        "train_test_split": """
WITH h AS (SELECT o_orderkey, CAST('0x' || substr(md5('42|=' || o_orderkey), 1, 13) AS BIGINT) AS h FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY h) AS nth, count(*) OVER () AS n FROM h)
SELECT o_orderkey, nth <= ceil(0.2 * n) AS is_test FROM r""",
        "train_test_split_exact": """
WITH n AS (SELECT count(*) AS n FROM lineitem)
SELECT true AS is_test, CAST(ceil(0.2 * n) AS BIGINT) AS n FROM n
UNION ALL SELECT false, CAST(n - ceil(0.2 * n) AS BIGINT) FROM n""",
        "classification_metrics_indexed": _sql_classification_metrics(),
        "confusion_matrix_indexed": f"SELECT {_SQL_INDEX.format('actual')} AS actual, {_SQL_INDEX.format('predicted')} "
                                    f"AS predicted, count FROM ({_sql_confusion()}) t",
        "classification_report_indexed": f"SELECT CASE WHEN class_label IN ('A', 'N', 'R') THEN "
                                         f"{_SQL_INDEX.format('class_label')} ELSE class_label END AS class_label, "
                                         f"precision, recall, f1_score, support FROM ({_sql_classification_report()}) t",
        "label_encode_many": """SELECT c_custkey, c_name,
       CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS label FROM customer WHERE c_name IS NOT NULL""",
        "confusion_matrix_many": """SELECT CAST(l_suppkey AS VARCHAR) AS actual,
       CAST(l_partkey % 50 AS VARCHAR) AS predicted, count(*) AS count FROM lineitem GROUP BY ALL""",
        "correlation_with_gaps": _sql_correlation_gaps(),
        "date_texts": "SELECT o_orderkey, " + ", ".join(f"CAST(dayofyear(o_orderdate) AS INTEGER) AS way{i}" for i in
                                                        range(len(_DATE_TEXTS)))
                      + ", CAST(dayofyear(o_orderdate) AS INTEGER) AS way_offset FROM orders",
        "classification_metrics": _sql_classification_metrics(),
        "confusion_matrix": _sql_confusion(),
        "classification_report": _sql_classification_report(),
        "roc_curve": _sql_roc_curve(),
        "roc_auc": _sql_roc_auc(),
        "regression_metrics": _sql_regression_metrics(),
        "ols_single_feature": """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, count(*) AS n FROM lineitem""",
    }
