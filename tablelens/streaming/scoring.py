"""Score rows as they arrive with a model trained in batch.

The streaming plan is the batch plan: validation against the training
domains (literals, or a stream-static join for large category domains),
alignment by the fitted ``FeatureSpec`` and the MLlib model's transform.
Nothing is stateful, so every micro-batch is independent and a restarted
query resumes from its checkpoint without re-scoring committed batches.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans import training


def score_stream(tm: "training.TrainedModel", stream: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A streaming DataFrame of scored rows (same columns as ``training.score_batch``)."""
    if not stream.isStreaming:
        raise ValueError("score_stream expects a streaming DataFrame (spark.readStream...)")
    return training.score_batch(tm, stream, keep)


def start_scoring(tm: "training.TrainedModel", stream: DataFrame, path: str, keep: list[str] | None = None,
                  checkpoint: str | None = None, trigger_available_now: bool = False) -> StreamingQuery:
    """Append scored rows to parquet at ``path``.

    The checkpoint defaults to a folder under the session's reliable
    ``spark.checkpoint.dir`` so a restarted driver picks up where it stopped.
    """
    spark = stream.sparkSession
    if checkpoint is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            raise ValueError("set spark.checkpoint.dir or pass checkpoint=")
        # one folder per target path, so a restarted driver finds its own place again
        name = hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:16]
        checkpoint = os.path.join(base, "tablelens-scoring", f"{os.path.basename(path.rstrip('/'))}-{name}")
    w = (score_stream(tm, stream, keep).writeStream.format("parquet").outputMode("append")
         .option("path", path).option("checkpointLocation", checkpoint))
    if trigger_available_now:
        w = w.trigger(availableNow=True)
    return w.start()
