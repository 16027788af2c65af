"""Type classes, missing-value normalisation and value coercion.

Every rule here is a Column expression (JVM side, inside whole-stage
codegen); nothing in this module runs Python per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference behaviour (pandas defaults).
# ---------------------------------------------------------------------------

# Text tokens pandas.read_csv reads as missing (its default na_values).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Text tokens pandas.read_csv reads as booleans.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

# A decimal or scientific number, as pandas.to_numeric accepts it.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER_PATTERN = r"^[+-]?[0-9]+$"
INFINITY_PATTERN = r"^[+-]?([iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])$"

# Dates tried when a text column may hold them, in order of preference, each
# with the shape a value must have before it is parsed.  The shape test is a
# cheap regular expression; a failed parse is expensive (the parser raises and
# catches internally), and most values of a non-date column fail.
_DAYS = {
    "yyyy-M-d": "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}",
    "M/d/yyyy": "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}",
    "d/M/yyyy": "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}",
    "yyyy/M/d": "[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}",
    "yyyy.M.d": r"[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}",
    "M-d-yyyy": "[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}",
    "d-M-yyyy": "[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}",
    "M.d.yyyy": r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}",
    "d.M.yyyy": r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}",
    "d MMM yyyy": "[0-9]{1,2} [A-Za-z]{3} [0-9]{4}",
    "d-MMM-yyyy": "[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}",
    "MMM d, yyyy": "[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}",
    "d MMMM yyyy": "[0-9]{1,2} [A-Za-z]{3,} [0-9]{4}",
    "MMMM d, yyyy": "[A-Za-z]{3,} [0-9]{1,2}, [0-9]{4}",
}
# Time of day after a date: hours and minutes, then seconds and a fraction if there are any.  A "T" may stand for the
# blank, and an offset may follow; it is left out, so the parts of the date are the local ones.
_TIME = " H:m[:s[.SSSSSSSSS]]"
_TIME_SHAPE = r"[ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?"
_OFFSET_SHAPE = r" ?(Z|[+-][0-9]{2}(:?[0-9]{2})?)"
DATE_SHAPES = ({f: f"^{shape}$" for f, shape in _DAYS.items()}
               | {f + _TIME: f"^{shape}{_TIME_SHAPE}({_OFFSET_SHAPE})?$" for f, shape in _DAYS.items()})
DATE_FORMATS = list(DATE_SHAPES)

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
NUMERIC = INTEGRAL + FRACTIONAL
DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
ATOMIC = NUMERIC + DATETIME + (T.StringType, T.BooleanType, T.BinaryType)


def qcol(name: str) -> Column:
    """Column reference that survives dots, spaces and backticks in names."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_class(dtype: T.DataType) -> str:
    """Census class of a Spark type: numeric, categorical, datetime, boolean or other."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, NUMERIC):
        return "numeric"
    if isinstance(dtype, DATETIME):
        return "datetime"
    if isinstance(dtype, T.StringType):
        return "categorical"
    return "other"


def is_numeric_for(dtype: T.DataType, context: str) -> bool:
    """Whether a type counts as numeric in a given context.

    Booleans are the irregular case: they are numbers for outlier detection
    (as 0/1) and for choosing the problem type, but not for plotting and not
    for feature engineering, where they are one-hot encoded.
    """
    cls = type_class(dtype)
    if cls == "numeric":
        return True
    if cls == "boolean":
        return context in ("outliers", "problem_type")
    return False


def is_atomic(dtype: T.DataType) -> bool:
    return isinstance(dtype, ATOMIC)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Map NaN to NULL in every float/double column (pandas has one 'missing')."""
    cols = []
    changed = False
    for f in df.schema.fields:
        c = qcol(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            cols.append(F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name))
            changed = True
        else:
            cols.append(c)
    return df.select(*cols) if changed else df


def text_to_number(c: Column) -> Column:
    """pandas.to_numeric(errors='coerce') for a text column, as a double.

    Plain and scientific decimals parse; 'inf'/'infinity' (any case, signed)
    give infinities; overflow such as '1e400', suffixes such as '1d', and
    anything else give NULL.
    """
    t = F.trim(c)
    parsed = t.try_cast("double")
    return (
        F.when(t.rlike(NUMBER_PATTERN),
               F.when(F.abs(parsed) == F.lit(float("inf")), F.lit(None).cast("double"))
               .otherwise(parsed))
        .when(t.rlike(INFINITY_PATTERN),
              F.when(F.substring(t, 1, 1) == "-", F.lit(float("-inf")))
              .otherwise(F.lit(float("inf"))))
    )


def to_number(c: Column, dtype: T.DataType, context: str = "plot") -> Column:
    """Coerce a column of any type to double following the context's rule.

    Returns a NULL literal for types that never hold numbers in ``context``.
    """
    if isinstance(dtype, NUMERIC):
        return c.cast("double")
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double") if is_numeric_for(dtype, context) else F.lit(None).cast("double")
    if isinstance(dtype, T.StringType):
        return text_to_number(c)
    return F.lit(None).cast("double")


def parse_date(c: Column, fmt: str) -> Column:
    """Text to timestamp with one explicit format; NULL unless the text has the
    format's shape and parses (so 31 February and trailing text are NULL).

    With a time of day, the offset is cut off: the result holds the local parts.
    """
    shape = DATE_SHAPES.get(fmt)
    if shape is None:
        return F.try_to_timestamp(c, F.lit(fmt))
    text = c
    if fmt.endswith(_TIME):
        text = F.regexp_replace(c, f"(:[0-9.]+){_OFFSET_SHAPE}$", "$1")
        text = F.regexp_replace(text, "([0-9])T([0-9])", "$1 $2")
    return F.when(c.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)))


def _date_class(fmt: str) -> str:
    """The class of the dates of a format: a 9 for a run of digits, an a for a run of letters, other signs as they are."""
    return re.sub("[A-Za-z]+", lambda m: "a" if m[0].startswith("MMM") else "9", fmt.removesuffix(_TIME))


def formats_of(c: Column, formats: list[str] = DATE_FORMATS) -> Column:
    """Positions in ``formats`` (of DATE_FORMATS) of those in which a text is a date; NULL or empty without any."""
    signs = F.regexp_replace(F.regexp_replace(c, "[0-9]+", "9"), "[A-Za-z]+", "a")
    timed = c.contains(":")
    classes: dict[tuple[str, bool], list[int]] = {}
    for j, fmt in enumerate(formats):
        classes.setdefault((_date_class(fmt), fmt.endswith(_TIME)), []).append(j)
    found = None
    for (cls, with_time), members in classes.items():
        tried = F.array_compact(F.array(*[F.when(parse_date(c, formats[j]).isNotNull(), F.lit(j)) for j in members]))
        fits = timed & F.startswith(signs, F.lit(cls)) if with_time else ~timed & (signs == cls)
        found = F.when(fits, tried) if found is None else found.when(fits, tried)
    # the shortest date has eight signs, the longest a long month, a fraction of a second and an offset
    return F.when(F.length(c).between(8, 64), found)


def text_to_boolean(c: Column) -> Column:
    """'True'/'False' tokens (three spellings each) to boolean, else NULL."""
    return (F.when(c.isin(TRUE_TOKENS), F.lit(True))
            .when(c.isin(FALSE_TOKENS), F.lit(False)))
