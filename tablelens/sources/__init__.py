"""Sources: parquet tables and a pandas-compatible CSV reader."""

from .csv import dedupe_header, infer_types, read_csv  # noqa: F401
from .tables import TABLES, read_table, register_views  # noqa: F401
