"""The data behind the plots: histogram, correlation matrix, scatter, model plots."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import aggregate_in_passes, spread
from ..functions.typing_rules import nan_to_null, qcol, to_number, type_class
from .dense import fold

_INF = float("inf")
SAMPLE_SEED = 42


def _coerced(df: DataFrame, column: str, context: str = "plot") -> Column:
    dtype = {f.name: f.dataType for f in df.schema.fields}[column]
    return to_number(qcol(column), dtype, context)


def with_bin(df: DataFrame, x: str, lo: float, hi: float, bins: int, out: str) -> DataFrame:
    """Add ``out`` = index i with edge_i <= x < edge_(i+1), the last bin closed on the right.

    edge_i = lo + i * (hi - lo) / bins and edge_bins = hi exactly (numpy
    ``linspace``).  A first guess from the scaled offset is corrected by one
    step against the true edges, which is how numpy assigns values that sit
    on an edge.  Each step is its own projection over the previous column, so
    the expression stays linear in size (nesting the guess inside both
    corrections would grow it exponentially).
    """
    step = (hi - lo) / bins
    xc = F.col(x)

    def edge(i: Column) -> Column:
        return F.when(i >= bins, F.lit(hi)).otherwise(i.cast("double") * F.lit(step) + F.lit(lo))

    g = "__bin_guess"
    df = df.withColumn(g, F.least(((xc - F.lit(lo)) / F.lit(hi - lo) * bins).cast("int"), F.lit(bins - 1)))
    df = df.withColumn(g, F.when(xc < edge(F.col(g)), F.col(g) - 1).otherwise(F.col(g)))
    df = df.withColumn(out, F.when((xc >= edge(F.col(g) + 1)) & (F.col(g) != bins - 1), F.col(g) + 1)
                       .otherwise(F.col(g)))
    return df.drop(g)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, lower, upper, count): equal-width bins over [min, max] of the finite values.

    Missing and infinite values are left out; a constant column gets the
    range value +- 0.5; a column without values gives an empty result.
    Every bin appears, empty ones with count 0.
    """
    return histograms(df, [column], bins).drop("column_name")


def histograms(df: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """(column_name, bin, lower, upper, count) of several columns: one pass for all bounds, one for all counts."""
    spark = df.sparkSession
    values = df.select(*[_coerced(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    named = []
    for i in range(len(columns)):
        fin = F.when(F.abs(F.col(f"x{i}")) != F.lit(_INF), F.col(f"x{i}"))
        named += [(f"lo{i}", F.min(fin)), (f"hi{i}", F.max(fin))]
    row = aggregate_in_passes(values, named)
    edges = []
    for i, c in enumerate(columns):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is not None:
            edges.append((i, c, *((lo - 0.5, hi + 0.5) if lo == hi else (lo, hi))))
    schema = "column_name string, bin int, lower double, upper double, count long"
    if not edges:
        return spark.createDataFrame([], schema)
    for i, _, lo, hi in edges:
        fin = F.when(F.abs(F.col(f"x{i}")) != F.lit(_INF), F.col(f"x{i}"))
        values = with_bin(values.withColumn("__x", fin), "__x", lo, hi, bins, "__bin")
        values = values.withColumn(f"bin{i}", F.when(F.col("__x").isNotNull(), F.col("__bin"))).drop("__x", "__bin")
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"bin{i}").alias("bin")) for i, *_ in edges]))
    counts = (values.select(cells).where(F.col("bin").isNotNull()).groupBy("i", "bin")
              .agg(F.count(F.lit(1)).alias("count")))          # at most columns x bins rows
    heads = spark.createDataFrame(edges, "i int, column_name string, lo double, hi double")
    grid = heads.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / bins
    lower = F.col("bin").cast("double") * step + F.col("lo")
    upper = F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise((F.col("bin") + 1).cast("double") * step
                                                                    + F.col("lo"))
    return (grid.join(counts, ["i", "bin"], "left")
            .select("column_name", "bin", lower.alias("lower"), upper.alias("upper"),
                    F.coalesce("count", F.lit(0).cast("long")).alias("count")))


def plot_numeric_columns(df: DataFrame) -> list[str]:
    """Columns with at least one value coercible to a number (plotting rule), one aggregate."""
    df = nan_to_null(df)
    cand = [f for f in df.schema.fields if type_class(f.dataType) in ("numeric", "categorical")]
    if not cand:
        return []
    row = df.agg(*[F.count(to_number(qcol(f.name), f.dataType, "plot")).alias(f"c{i}")
                   for i, f in enumerate(cand)]).first()
    return [f.name for i, f in enumerate(cand) if row[f"c{i}"] > 0]


def _product_sums(df: DataFrame, columns: list[str], means: list[float]) -> np.ndarray:
    """Sums of products of all pairs among (shifted values, presence, squares) of the columns, in one scan.

    Every task adds its rows up to one matrix of (3 x columns)^2 numbers, whatever
    its rows, and hands it on as one row; matrices meet in small groups, level by
    level.  What rounding takes from a sum is carried along and added at the end.
    """
    shift = np.array(means)
    width = 3 * len(columns)

    def add(state, x):
        with np.errstate(invalid="ignore"):       # an infinity only spoils the pairs of its own column
            there = ~np.isnan(x)
            y = np.where(there, x - shift, 0.0)
            z = np.concatenate([y, there, y * y], axis=1)
            own = np.concatenate([(z.T @ z).ravel(), np.zeros(width * width)])
        return own if state is None else merge(state, own)

    def merge(a, b):
        (sa, ra), (sb, rb) = np.split(a, 2), np.split(b, 2)
        with np.errstate(invalid="ignore"):
            s = sa + sb
            back = s - sa
            rest = (sa - (s - back)) + (sb - back)   # exactly what s lacks
            return np.concatenate([s, ra + rb + np.where(np.isfinite(rest), rest, 0.0)])

    total = fold(df.select(*[qcol(c).cast("double") for c in columns]), add, merge)
    if total is None:
        return np.zeros((width, width))
    s, r = np.split(total, 2)
    return (s + r).reshape(width, width)


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_a, column_b, corr): Pearson correlation on pairwise complete rows.

    Two passes at any width: the first finds every column's mean and bounds,
    the second all sums of products of the mean-shifted values, their squares
    and their presence, from which each pair takes those of its own complete
    rows.  Constant columns, columns with an infinity, or pairs with fewer
    than two complete rows give NULL (pandas NaN); the diagonal is 1 else.
    """
    df = nan_to_null(df)
    if columns is None:
        columns = plot_numeric_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    df = spread(df.select(*[to_number(qcol(c), types[c], "plot").alias(c) for c in columns]))
    schema = "column_a string, column_b string, corr double"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    first = []
    for i, c in enumerate(columns):
        first += [(f"m{i}", F.avg(qcol(c))), (f"a{i}", F.min(qcol(c))), (f"b{i}", F.max(qcol(c)))]
    p1 = aggregate_in_passes(df, first)
    k = len(columns)
    flat = [p1[f"a{i}"] is None or p1[f"a{i}"] == p1[f"b{i}"] or not math.isfinite(p1[f"b{i}"] - p1[f"a{i}"])
            for i in range(k)]
    g = _product_sums(df, columns, [0.0 if flat[i] else p1[f"m{i}"] for i in range(k)])
    y, there, square = (slice(j * k, (j + 1) * k) for j in range(3))
    n, s, q, p = g[there, there], g[y, there], g[square, there], g[y, y]   # rows: the column that is summed

    def corr(i: int, j: int) -> float | None:
        if flat[i] or flat[j] or n[i, j] < 2:
            return None
        if i == j:
            return 1.0
        ma, mb = s[i, j] / n[i, j], s[j, i] / n[i, j]
        va, vb = q[i, j] / n[i, j] - ma * ma, q[j, i] / n[i, j] - mb * mb
        if not (va > 0 and vb > 0):
            return None
        return float(max(-1.0, min(1.0, (p[i, j] / n[i, j] - ma * mb) / (va * vb) ** 0.5)))

    # k x k summary numbers computed from the aggregates above (bounded by the column count)
    rows = [(columns[i], columns[j], corr(i, j)) for i in range(k) for j in range(k)]
    return df.sparkSession.createDataFrame(rows, schema)


def scatter_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y) of every row where both are numbers; x and y must differ."""
    if x == y:
        raise ValueError("scatter needs two different columns")
    df = nan_to_null(df)
    return (df.select(_coerced(df, x).alias("x"), _coerced(df, y).alias("y"))
            .where(F.col("x").isNotNull() & F.col("y").isNotNull()))


def scatter_sample(df: DataFrame, x: str, y: str, key: list[str], per_cell: int = 4, bins: int = 50,
                   seed: int = SAMPLE_SEED) -> DataFrame:
    """(x_bin, y_bin, x, y, and the key columns): a sample of the scatter in which sparse regions show.

    Of every cell of the grid the ``per_cell`` rows with the smallest md5 of seed and
    ``key`` (ties: by their values).  Which rows those are depends on the rows
    only, not on how they are laid out.  Spark limits each cell within every task
    before it shuffles (up to ``spark.sql.optimizer.windowGroupLimitThreshold`` rows a
    cell), so at most bins^2 * per_cell rows a task move.  The key should tell rows
    apart.  Rows without a number, and infinities, are left out.
    """
    if x == y:
        raise ValueError("scatter needs two different columns")
    if not key:
        raise ValueError("name the columns that tell rows apart")
    df = nan_to_null(df)
    parts = [F.coalesce(F.concat(F.lit("="), qcol(c).cast("string")), F.lit("-")) for c in key]
    points = (df.select(_coerced(df, x).alias("x"), _coerced(df, y).alias("y"),
                        F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)).alias("__h"),
                        F.struct(*[qcol(c).alias(f"k{i}") for i, c in enumerate(key)]).alias("__key"))
              .where((F.abs("x") < F.lit(_INF)) & (F.abs("y") < F.lit(_INF))))
    r = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    low, high = [], []
    for lo, hi in ((r["x0"], r["x1"]), (r["y0"], r["y1"])):
        lo, hi = (0.0, 1.0) if lo is None else (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
        low.append(lo)
        high.append(hi)
    for name, lo, hi in (("x", low[0], high[0]), ("y", low[1], high[1])):
        points = with_bin(points, name, lo, hi, bins, f"{name}_bin")
    order = [F.col("__h"), F.col("x"), F.col("y"), F.col("__key")]
    place = F.row_number().over(Window.partitionBy("x_bin", "y_bin").orderBy(*order))
    points = points.withColumn("__place", place).where(F.col("__place") <= per_cell)
    return points.select("x_bin", "y_bin", "x", "y", *[F.col("__key")[f"k{i}"].alias(c) for i, c in enumerate(key)])


def scatter_grid(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """(x_bin, y_bin, x_lower, y_lower, count): a 2-D histogram of the scatter.

    The scalable form of a scatter plot: its size is bounded by bins^2
    whatever the number of rows.
    """
    pts = scatter_pairs(df, x, y).where((F.abs("x") != F.lit(_INF)) & (F.abs("y") != F.lit(_INF)))
    r = pts.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
                F.max("y").alias("y1")).first()
    if r["x0"] is None:
        return df.sparkSession.createDataFrame(
            [], "x_bin int, y_bin int, x_lower double, y_lower double, count long")
    x0, x1, y0, y1 = r["x0"], r["x1"], r["y0"], r["y1"]
    if x0 == x1:
        x0, x1 = x0 - 0.5, x1 + 0.5
    if y0 == y1:
        y0, y1 = y0 - 0.5, y1 + 0.5
    binned = with_bin(with_bin(pts, "x", x0, x1, bins, "x_bin"), "y", y0, y1, bins, "y_bin")
    g = binned.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count"))
    return g.select("x_bin", "y_bin",
                    (F.col("x_bin").cast("double") * F.lit((x1 - x0) / bins) + F.lit(x0)).alias("x_lower"),
                    (F.col("y_bin").cast("double") * F.lit((y1 - y0) / bins) + F.lit(y0)).alias("y_lower"),
                    "count")


def predicted_vs_actual(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(actual, predicted, line_min, line_max): the pairs plus the identity line's common range."""
    r = pred.agg(F.least(F.min(label), F.min(prediction)).alias("lo"),
                 F.greatest(F.max(label), F.max(prediction)).alias("hi")).first()
    return pred.select(F.col(label).cast("double").alias("actual"), F.col(prediction).cast("double").alias("predicted"),
                       F.lit(r["lo"]).cast("double").alias("line_min"), F.lit(r["hi"]).cast("double").alias("line_max"))


def residuals(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(predicted, residual = actual - predicted)."""
    return pred.select(F.col(prediction).cast("double").alias("predicted"),
                       (F.col(label).cast("double") - F.col(prediction).cast("double")).alias("residual"))
