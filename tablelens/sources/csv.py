"""CSV scan with pandas-compatible missing tokens, header names and type inference.

The file is read as all-text columns (no Spark inference pass), the pandas
missing tokens become NULL, and the type of every column is decided by ONE
aggregate over the data that counts, per column, how many values look like
integers, decimals or booleans.  A second, narrow ``select`` casts.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.layout import aggregate_in_passes
from ..functions.typing_rules import (
    FALSE_TOKENS, INFINITY_PATTERN, INTEGER_PATTERN, NA_TOKENS, NUMBER_PATTERN, TRUE_TOKENS,
    qcol, text_to_boolean, text_to_number,
)
from .csv_records import records


def dedupe_header(names: list[str]) -> list[str]:
    """Blank names become ``_c<i>``; repeated names get ``_1``, ``_2``... suffixes."""
    out: list[str] = []
    seen: set[str] = set()
    for i, raw in enumerate(names):
        name = raw.strip() if raw is not None else ""
        if not name:
            name = f"_c{i}"
        base, k = name, 0
        while name in seen:
            k += 1
            name = f"{base}_{k}"
        seen.add(name)
        out.append(name)
    return out


def _headers(spark: SparkSession, path: str, options: dict) -> list[str]:
    """Header of the files below ``path``, as Spark's CSV reader splits it.

    Each file's first record is its header; all of them must agree.  Read from
    the records themselves, so blank lines before it and line breaks within
    quotes are treated as everywhere else.
    """
    raw = spark.read.options(**options).option("header", False).csv(path)
    if not raw.columns:
        return []
    record = F.struct(*[qcol(c) for c in raw.columns])
    position = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    firsts = (raw.select(F.col("_metadata.file_path").alias("file"), record.alias("r"), position.alias("p"))
              .groupBy("file").agg(F.min_by("r", "p").alias("r")).select("r").distinct().limit(2).collect())
    if len(firsts) > 1:
        raise ValueError(f"the files below {path} have different headers: {[list(f['r']) for f in firsts]}")
    return list(firsts[0]["r"]) if firsts else []


def infer_types(df: DataFrame) -> dict[str, T.DataType]:
    """Spark type per all-text column, from one aggregate pass (split when very wide)."""
    aggs = []
    for i, name in enumerate(df.columns):
        c = qcol(name)
        t = F.trim(c)
        aggs += [
            (f"n{i}", F.count(c)),
            (f"i{i}", F.count(F.when(t.rlike(INTEGER_PATTERN) & t.try_cast("long").isNotNull(), 1))),
            (f"f{i}", F.count(F.when(t.rlike(NUMBER_PATTERN) | t.rlike(INFINITY_PATTERN), 1))),
            (f"b{i}", F.count(F.when(c.isin(TRUE_TOKENS + FALSE_TOKENS), 1))),
        ]
    if not aggs:
        return {}
    row = aggregate_in_passes(df, aggs)
    types: dict[str, T.DataType] = {}
    for i, name in enumerate(df.columns):
        n = row[f"n{i}"]
        if n == 0:
            types[name] = T.DoubleType()          # an all-missing column reads as float in pandas
        elif row[f"i{i}"] == n:
            types[name] = T.LongType()
        elif row[f"f{i}"] == n:
            types[name] = T.DoubleType()
        elif row[f"b{i}"] == n:
            types[name] = T.BooleanType()
        else:
            types[name] = T.StringType()
    return types


def _split_records(spark: SparkSession, path: str, sep: str) -> tuple[list[str], DataFrame] | None:
    """Header and records of files in which some quoted field holds a line break; None if there is none."""
    found = records(spark, path, sep)
    if found is None:
        return None
    headers = [next(csv.reader([r["text"]], delimiter=sep)) if "\n" not in r["text"] else
               next(csv.reader(io.StringIO(r["text"], newline=""), delimiter=sep))
               for r in found.where("first").select("text").distinct().limit(2).collect()]
    if len(headers) > 1 and headers[0] != headers[1]:
        raise ValueError(f"the files below {path} have different headers: {headers}")
    return headers[0], found.where("not first").select("text")


def read_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False,
             na_tokens: list[str] | None = None, infer: bool = True) -> DataFrame:
    """Read a headed CSV file (or directory of files) the way pandas.read_csv does.

    Line breaks inside quotes are kept, and files are split all the same (see
    ``csv_records``): a pass over the lines with quotes finds out whether there are
    any, and files without are left to Spark's reader.  ``multi_line=True`` leaves
    such files to Spark's reader too, one task a file.  Rows with more fields than the header, and files
    with another header than the rest, are errors; short rows are filled up
    with missing values.  A missing header name at the end is a column too.
    """
    options = {"sep": sep, "multiLine": str(multi_line).lower(), "escape": '"', "mode": "PERMISSIVE",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    apart = None if multi_line else _split_records(spark, path, sep)
    names = dedupe_header(apart[0] if apart else _headers(spark, path, options))
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    # one column more than the header takes up what overlong rows have in excess
    extra = "__beyond"
    while extra in names:
        extra += "_"
    schema = T.StructType([T.StructField(n, T.StringType(), True) for n in [*names, extra]])
    if apart:
        fields = F.from_csv(F.col("text"), ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, extra]), {**options, "multiLine": "true"})
        read = apart[1].select(fields.alias("r")).select("r.*")
    else:
        read = (spark.read.schema(schema).options(**options).option("header", True).option("enforceSchema", True)
                .csv(path))
    overlong = F.raise_error(F.concat(F.lit(f"a row of {path} has more than {len(names)} fields, near: "),
                                      F.coalesce(*[qcol(n) for n in names], F.lit(""))))
    raw = read.select(*[F.when(qcol(extra).isNotNull(), overlong).otherwise(qcol(n)).alias(n) if i == 0 else qcol(n)
                        for i, n in enumerate(names)])
    tokens = NA_TOKENS if na_tokens is None else na_tokens
    text = raw.select(*[F.when(qcol(n).isin(tokens), F.lit(None).cast("string"))
                        .otherwise(qcol(n)).alias(n) for n in names])
    if not infer:
        return text
    types = infer_types(text)
    cols = []
    for n in names:
        c, t = qcol(n), types[n]
        if isinstance(t, T.LongType):
            cols.append(F.trim(c).try_cast("long").alias(n))
        elif isinstance(t, T.DoubleType):
            cols.append(text_to_number(c).alias(n))
        elif isinstance(t, T.BooleanType):
            cols.append(text_to_boolean(c).alias(n))
        else:
            cols.append(c.alias(n))
    return text.select(*cols)
