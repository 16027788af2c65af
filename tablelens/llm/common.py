"""Helpers shared by the text operators.

Python code of the operators runs inside Spark tasks.  ``ship`` makes the
package importable there whatever folder the driver was started from; on a
cluster where the package is installed on every node it changes nothing.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKAGE = __name__.split(".")[0]

_shipped: dict[str, bool] = {}

#: Rows handed to Python at once.  Texts are long: Spark's default of 10,000
#: would hold hundreds of megabytes on both sides.
BATCH_SETTING, SPARK_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers, once per application.

    Also lowers the rows per Arrow batch of the session, unless it was set.
    """
    if spark.conf.get(BATCH_SETTING, SPARK_DEFAULT) == SPARK_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(), f"{PACKAGE}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join(PACKAGE, os.path.relpath(full, top)))
    sc.addPyFile(target)
    _shipped[sc.applicationId] = True


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor and the driver can read: ``spark.checkpoint.dir``.

    Only a session on a local master (tests) may go without the setting; it
    then gets a scratch folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="llm-shared-")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are computed once and survive lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers, which give memory back after each task."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return Arrow's unused memory: workers outlive their tasks and would keep it."""
    pa.default_memory_pool().release_unused()


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns only; whatever else the input carries cannot clash later."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def column_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, one value at a time; NULL as empty."""
    for v in column.cast(pa.large_binary()):
        yield v.as_py() or b""


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and go on from the files.

    Takes less room than ``cut`` for tables of many narrow rows; lineage ends
    here just the same.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
