"""Column-level rules: type classes, missing values, numeric and date coercion."""

from .typing_rules import (  # noqa: F401
    DATE_FORMATS, NA_TOKENS, is_atomic, is_numeric_for, nan_to_null, parse_date,
    qcol, text_to_boolean, text_to_number, to_number, type_class,
)
