"""Feature engineering with a fitted, reusable specification.

``fit_features(df, target)`` reads the data in a few aggregates (date
detection, cardinality, level lists) and returns a ``FeatureSpec``;
``FeatureSpec.transform(df)`` is then ONE narrow ``select`` - no shuffle,
no join - that applies to the training table and to any new rows alike.
Unseen categories give all-zero dummies and a missing trained column is
filled with 0, so new rows always get the training columns in training order.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.layout import aggregate_in_passes
from ..functions.typing_rules import DATE_FORMATS, formats_of, nan_to_null, parse_date, qcol, type_class

# Fixed values of the reference's rules.
MAX_LEVELS = 20                 # <= this many distinct values: one-hot; more: dropped
# An estimated distinct count this many times too large rules a column out; the estimate is good to a few percent.
RULED_OUT = 3
DATE_SHARE = 0.8                # a text column is a date column when MORE than this share parses
MAX_INTERACTION_COLUMNS = 6     # pairwise products only for 2..6 numeric columns
DATE_PARTS = ["year", "month", "day", "weekday"]


def level_text(v) -> str:
    """Text of a category level as it appears in a dummy column name."""
    if isinstance(v, bool):
        return "True" if v else "False"
    return str(v)


@dataclass
class FeatureSpec:
    target: str | None
    numeric: list[str] = field(default_factory=list)
    dates: list[list] = field(default_factory=list)        # [column, format or None]
    dummies: list[list] = field(default_factory=list)      # [column, level, output name]
    dropped: list[str] = field(default_factory=list)
    interactions: list[list[str]] = field(default_factory=list)
    output_columns: list[str] = field(default_factory=list)
    source_types: dict[str, str] = field(default_factory=dict)

    # ------------------------------------------------------------ persistence
    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "FeatureSpec":
        return cls(**json.loads(text))

    @property
    def feature_columns(self) -> list[str]:
        return [c for c in self.output_columns if c != self.target]

    # ------------------------------------------------------------ expressions
    def _source(self, df: DataFrame, name: str) -> Column | None:
        return qcol(name) if name in df.columns else None

    def _date_value(self, df: DataFrame, name: str, fmt: str | None) -> Column | None:
        c = self._source(df, name)
        if c is None:
            return None
        dtype = {f.name: f.dataType for f in df.schema.fields}[name]
        if isinstance(dtype, T.StringType):
            return parse_date(c, fmt or DATE_FORMATS[0])
        return c

    def expressions(self, df: DataFrame) -> dict[str, Column]:
        """Output column name -> expression over ``df`` (missing sources give 0)."""
        out: dict[str, Column] = {}
        for c in self.numeric:
            src = self._source(df, c)
            out[c] = src.cast("double") if src is not None else F.lit(0.0)
        for name, fmt in self.dates:
            d = self._date_value(df, name, fmt)
            for part in DATE_PARTS:
                col_name = f"{name}_{part}"
                if d is None:
                    out[col_name] = F.lit(0)
                elif part == "year":
                    out[col_name] = F.year(d)
                elif part == "month":
                    out[col_name] = F.month(d)
                elif part == "day":
                    out[col_name] = F.dayofmonth(d)
                else:
                    out[col_name] = F.weekday(d)          # Monday = 0
        types = {f.name: f.dataType for f in df.schema.fields}
        for name, level, col_name in self.dummies:
            src = self._source(df, name)
            if src is None:
                out[col_name] = F.lit(0)
                continue
            if isinstance(types[name], T.BooleanType):
                lv = F.lit(level == "True")
            else:
                lv = F.lit(level)
            out[col_name] = F.when(src == lv, F.lit(1)).otherwise(F.lit(0))
        for a, b in self.interactions:
            out[f"{a}_x_{b}"] = out[a].cast("double") * out[b].cast("double")
        return out

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """The feature frame: training columns in training order, then the target if present.

        ``keep`` lists extra pass-through columns (ids) placed first.
        """
        df = nan_to_null(df)
        ex = self.expressions(df)
        cols = [qcol(k) for k in (keep or [])]
        cols += [ex[c].alias(c) for c in self.feature_columns]
        if self.target is not None and self.target in df.columns:
            cols.append(qcol(self.target))
        return df.select(*cols)


def date_shares(df: DataFrame, columns: list[str], formats: list[str] = DATE_FORMATS) -> dict[str, tuple[str, float]]:
    """Best format and its parse share (all rows in the denominator) per text column.

    One scan at any number of columns.  A value's class (its runs of digits and
    of letters, each as one sign) names the few formats it can have; only those
    are tried, and formats are counted per column.  Which of day and month comes
    first follows from the values that parse either way; ties go to the earlier
    format.
    """
    if not columns:
        return {}
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("i"), qcol(c).alias("v")) for i, c in enumerate(columns)]))
    # every value counts once as itself (-1) and once for each format it has
    had = F.array_append(F.coalesce(formats_of(F.col("v"), formats), F.array().cast("array<int>")), F.lit(-1))
    counts = {(r["i"], r["j"]): r["count"] for r in
              df.select(cells).select("i", F.explode(had).alias("j")).groupBy("i", "j").count().collect()}
    out = {}
    for i, c in enumerate(columns):
        n = counts.get((i, -1), 0)
        shares = [counts.get((i, j), 0) / n if n else 0.0 for j in range(len(formats))]
        best = max(range(len(formats)), key=lambda j: (shares[j], -j))
        out[c] = (formats[best], shares[best])
    return out


def date_like_columns(df: DataFrame, threshold: float = DATE_SHARE) -> DataFrame:
    """(column_name, position, best_format, share, is_date) for every text column."""
    df = nan_to_null(df)
    text = [(i, f.name) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.StringType)]
    shares = date_shares(df, [n for _, n in text])
    rows = [(n, i, shares[n][0], float(shares[n][1]), shares[n][1] > threshold) for i, n in text]
    # The result is a per-column summary (bounded by the schema), built from the aggregate above.
    return df.sparkSession.createDataFrame(
        rows, "column_name string, position int, best_format string, share double, is_date boolean")


def cardinality(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact distinct counts (missing excluded) of several columns, one aggregate."""
    if not columns:
        return {}
    row = df.agg(*[F.count_distinct(qcol(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    return {c: int(row[f"d{i}"]) for i, c in enumerate(columns)}


def few_values(df: DataFrame, columns: list[str], limit: int) -> dict[str, list | None]:
    """Sorted distinct values of text or boolean columns with at most ``limit`` of them, None for others.

    An estimate of the distinct counts rules out columns with several times as
    many; the values of the rest are gathered, a few dozen each.
    """
    if not columns:
        return {}
    about = aggregate_in_passes(df, [(f"c{i}", F.approx_count_distinct(qcol(c))) for i, c in enumerate(columns)])
    left = [(i, c) for i, c in enumerate(columns) if about[f"c{i}"] <= RULED_OUT * (limit + 1)]
    met = aggregate_in_passes(df, [(f"c{i}", F.slice(F.sort_array(F.collect_set(qcol(c))), 1, limit + 1))
                                   for i, c in left]) if left else {}
    out: dict[str, list | None] = dict.fromkeys(columns)
    for i, c in left:
        out[c] = met[f"c{i}"] if len(met[f"c{i}"]) <= limit else None
    return out


def cardinality_split(df: DataFrame, target: str | None = None, max_levels: int = MAX_LEVELS) -> DataFrame:
    """(column_name, position, unique, kind): low (one-hot) or high (dropped) for every
    non-numeric, non-date column other than the target."""
    df = nan_to_null(df)
    cats = [(i, f.name) for i, f in enumerate(df.schema.fields)
            if f.name != target and type_class(f.dataType) in ("categorical", "boolean")]
    card = cardinality(df, [n for _, n in cats])
    rows = [(n, i, card[n], "low" if card[n] <= max_levels else "high") for i, n in cats]
    return df.sparkSession.createDataFrame(rows, "column_name string, position int, unique long, kind string")


def fit_features(df: DataFrame, target: str | None, max_levels: int = MAX_LEVELS,
                 date_share: float = DATE_SHARE, max_interactions: int = MAX_INTERACTION_COLUMNS,
                 detect_text_dates: bool = True) -> FeatureSpec:
    """Learn the feature specification of a table in two passes.

    One finds the date format of every text column, the other the levels of
    the text and boolean columns that have few.
    """
    df = nan_to_null(df)
    fields = [f for f in df.schema.fields if f.name != target]
    spec = FeatureSpec(target=target)
    spec.source_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    # 1) dates: native date/timestamp columns, and text columns that mostly parse
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)] if detect_text_dates else []
    shares = date_shares(df, text)
    date_cols = set()
    for f in fields:
        cls = type_class(f.dataType)
        if cls == "datetime":
            spec.dates.append([f.name, None])
            date_cols.add(f.name)
        elif f.name in shares and shares[f.name][1] > date_share:
            spec.dates.append([f.name, shares[f.name][0]])
            date_cols.add(f.name)

    # 2) categorical split by cardinality, with the levels of the low side
    cats = [f.name for f in fields if type_class(f.dataType) in ("categorical", "boolean") and f.name not in date_cols]
    levels = few_values(df, cats, max_levels)
    spec.dropped = sorted(date_cols, key=[f.name for f in fields].index) + [c for c in cats if levels[c] is None]
    spec.dropped += [f.name for f in fields if type_class(f.dataType) == "other"]

    # 3) dummies, without the first sorted level
    for c in cats:
        for v in (levels[c] or [])[1:]:
            spec.dummies.append([c, level_text(v), f"{c}_{level_text(v)}"])

    # 4) numeric columns (originals, then date parts) and their pairwise products
    spec.numeric = [f.name for f in fields if type_class(f.dataType) == "numeric"]
    numeric_all = spec.numeric + [f"{d}_{p}" for d, _ in spec.dates for p in DATE_PARTS]
    if 1 < len(numeric_all) <= max_interactions:
        spec.interactions = [[a, b] for a, b in combinations(numeric_all, 2)]

    spec.output_columns = (numeric_all + [n for _, _, n in spec.dummies]
                           + [f"{a}_x_{b}" for a, b in spec.interactions])
    if target is not None:
        spec.output_columns.append(target)
    if len(set(spec.output_columns)) != len(spec.output_columns):
        seen, dup = set(), []
        for c in spec.output_columns:
            if c in seen:
                dup.append(c)
            seen.add(c)
        raise ValueError(f"engineered column names clash: {dup}")
    return spec


def feature_frame(df: DataFrame, target: str | None, **kw) -> tuple[DataFrame, FeatureSpec]:
    """Fit on ``df`` and transform it: the engineered frame with the target last."""
    spec = fit_features(df, target, **kw)
    return spec.transform(df), spec


def one_hot(df: DataFrame, column: str, levels: list | None = None, keep: list[str] | None = None,
            max_levels: int = MAX_LEVELS) -> DataFrame:
    """Dummy columns ``column_level`` for every sorted level but the first.

    Missing and unseen values are all-zero rows.  Levels are collected only
    if there are at most ``max_levels``; each is a column of the result.
    """
    if levels is None:
        levels = few_values(nan_to_null(df), [column], max_levels)[column]
        if levels is None:
            raise ValueError(f"{column!r} has more than {max_levels} levels; pass levels or a larger max_levels")
    spec = FeatureSpec(target=None, dummies=[[column, level_text(v), f"{column}_{level_text(v)}"]
                                             for v in levels[1:]])
    spec.output_columns = [n for _, _, n in spec.dummies]
    return spec.transform(df, keep=keep)


def date_parts(df: DataFrame, column: str, fmt: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``column_year/_month/_day/_weekday`` (Monday = 0) of a date, timestamp or date text."""
    spec = FeatureSpec(target=None, dates=[[column, fmt]])
    spec.output_columns = [f"{column}_{p}" for p in DATE_PARTS]
    return spec.transform(df, keep=keep)


def interactions(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Pairwise products ``a_x_b`` (as double, so big integers cannot overflow)."""
    spec = FeatureSpec(target=None, numeric=list(columns),
                       interactions=[[a, b] for a, b in combinations(columns, 2)])
    spec.output_columns = [f"{a}_x_{b}" for a, b in spec.interactions]
    return spec.transform(df, keep=keep)


def project_features(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Selected features then the target; the target is never also a feature."""
    feats = [c for c in features if c != target]
    if not feats:
        raise ValueError("select at least one feature")
    missing = [c for c in feats + [target] if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    return df.select(*[qcol(c) for c in feats + [target]])
