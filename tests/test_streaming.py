import os
import tempfile

from pyspark.sql import functions as F

from tablelens.plans import training
from tablelens.streaming import running_missing, score_stream

SF = "/root/testdata/sf0.001"


def _stream_dir(spark, df):
    d = tempfile.mkdtemp(prefix="tl-stream-", dir="/tmp")
    df.write.mode("overwrite").parquet(os.path.join(d, "in"))
    return d


def test_stream_scoring_matches_batch(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    tm = training.train(orders, "o_orderstatus", ["o_totalprice", "o_orderpriority", "o_orderdate"],
                        num_trees=5, max_depth=4)
    batch = training.score_batch(tm, orders, keep=["o_orderkey"]).select("o_orderkey", "prediction")
    d = _stream_dir(spark, orders)
    stream = spark.readStream.schema(orders.schema).parquet(os.path.join(d, "in"))
    q = (score_stream(tm, stream, keep=["o_orderkey"]).writeStream.format("memory").queryName("scored")
         .option("checkpointLocation", os.path.join(d, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("scored").select("o_orderkey", "prediction")
    assert got.count() == orders.count()
    assert got.exceptAll(batch).count() == 0


def test_running_missing(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select(
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("d"), "l_returnflag")
    want = li.where(F.col("d").isNull()).count()
    d = _stream_dir(spark, li)
    stream = spark.readStream.schema(li.schema).parquet(os.path.join(d, "in"))
    q = (running_missing(stream).writeStream.format("memory").queryName("missing").outputMode("complete")
         .option("checkpointLocation", os.path.join(d, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    r = spark.table("missing").first()
    assert r["n_rows"] == li.count() and r["missing_d"] == want and r["missing_l_returnflag"] == 0


def test_start_scoring_writes_parquet(spark):
    from tablelens.streaming import start_scoring
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    tm = training.train(orders, "o_orderstatus", ["o_totalprice", "o_orderpriority"], num_trees=5, max_depth=4)
    d = _stream_dir(spark, orders)
    stream = spark.readStream.schema(orders.schema).parquet(os.path.join(d, "in"))
    out = os.path.join(d, "out")
    q = start_scoring(tm, stream, out, keep=["o_orderkey"], checkpoint=os.path.join(d, "ckpt-out"),
                      trigger_available_now=True)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.count() == orders.count()
    assert set(got.columns) >= {"o_orderkey", "prediction", "predicted_label", "issue", "warning"}
