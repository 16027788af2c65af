"""Registered queries over data read back from CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import read_csv
from ..sources.tables import read_table


def csv_quoted_breaks(spark: SparkSession, d: str):
    """All documents written as CSV, their line breaks inside quotes, and read again in splits."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    read_table(spark, d, "documents").select("doc_id", "lang", "text").write.csv(
        path, header=True, quoteAll=True, escape='"')
    back = read_csv(spark, path, na_tokens=[], infer=False)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.md5("text").alias("text_md5"),
                       (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("n_breaks"))


QUERIES = {"csv_quoted_breaks": csv_quoted_breaks}


def oracles() -> dict[str, str]:
    return {"csv_quoted_breaks": """
SELECT doc_id, lang, md5(text) AS text_md5, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS n_breaks
FROM documents"""}
