"""Streaming intake over micro-batches, and the streaming run-state fold."""

import os
import tempfile

from pyspark.sql import functions as F

from quarry.streaming.intake_stream import start_intake_stream
from quarry.streaming.ledger_stream import run_state_stream

SCHEMA = ("seq long, tenant_id string, source_id string, filename string, mime_type string, "
          "content string, idempotency_key string")


def test_intake_stream_sees_earlier_batches(spark):
    root = tempfile.mkdtemp(prefix="quarry-stream-")
    landing = os.path.join(root, "landing")
    src = spark.createDataFrame([("t", "s")], "tenant_id string, id string")
    b1 = [(1, "t", "s", "a.csv", "text/csv", "x,y\n1,2", "k1")]
    b2 = [(2, "t", "s", "b.csv", "text/csv", "x,y\n1,2", None), (3, "t", "s", "c.csv", "text/csv", "other", "k1")]
    spark.createDataFrame(b1, SCHEMA).write.parquet(os.path.join(landing, "b1"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(landing + "/*")
    q = start_intake_stream(stream, src, os.path.join(root, "out"), os.path.join(root, "ckpt"))
    q.processAllAvailable()
    spark.createDataFrame(b2, SCHEMA).write.parquet(os.path.join(landing, "b2"))
    q.processAllAvailable()
    q.stop()
    res = {r.seq: r.status for r in spark.read.parquet(os.path.join(root, "out", "results")).collect()}
    assert res == {1: "NEW", 2: "DUPLICATE", 3: "REPLAY"}
    assert spark.read.parquet(os.path.join(root, "out", "source_files")).count() == 1


def test_run_state_stream(spark):
    root = tempfile.mkdtemp(prefix="quarry-ledger-")
    schema = "run_id string, seq long, status string, ts timestamp, progress int"
    rows = spark.createDataFrame([("r", 1, "RUNNING", None, None), ("r", 2, "BOGUS", None, None),
                                  ("r", 3, "COMPLETED", None, 100)], schema).withColumn("ts", F.current_timestamp())
    rows.write.parquet(os.path.join(root, "in"))
    stream = spark.readStream.schema(schema).parquet(os.path.join(root, "in"))
    q = (run_state_stream(stream).writeStream.outputMode("update").format("memory")
         .queryName("run_state_test").option("checkpointLocation", os.path.join(root, "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    r = spark.sql("SELECT * FROM run_state_test").first()
    assert (r.status, r.progress, r.transitions) == ("COMPLETED", 100, 2)


def test_run_state_stream_bounded(spark):
    from quarry.streaming.ledger_stream import run_state_stream_bounded

    root = tempfile.mkdtemp(prefix="quarry-ledger-b-")
    schema = "run_id string, seq long, status string, ts timestamp, progress int"
    first = spark.createDataFrame([("r", 1, "RUNNING", "2024-01-01 00:00:00", None),
                                   ("r", 2, "BOGUS", "2024-01-01 00:01:00", None),
                                   ("q", 1, "RUNNING", "2024-01-01 00:02:00", 5)], "run_id string, seq long, status string, ts string, progress int")
    first.withColumn("ts", F.to_timestamp("ts")).write.parquet(os.path.join(root, "in", "b1"))
    stream = spark.readStream.schema(schema).parquet(os.path.join(root, "in", "*"))
    q = (run_state_stream_bounded(stream).writeStream.outputMode("update").format("memory")
         .queryName("run_state_bounded").option("checkpointLocation", os.path.join(root, "ckpt")).start())
    q.processAllAvailable()
    second = spark.createDataFrame([("r", 4, "COMPLETED", "2024-01-01 00:05:00", 100),
                                    ("r", 3, "RUNNING", "2024-01-01 00:04:00", None)],
                                   "run_id string, seq long, status string, ts string, progress int")
    second.withColumn("ts", F.to_timestamp("ts")).write.parquet(os.path.join(root, "in", "b2"))
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT * FROM run_state_bounded WHERE run_id = 'r' ORDER BY transitions DESC").collect()
    r = rows[0]
    assert (r.status, str(r.started_at), str(r.finished_at), r.progress, r.transitions) == (
        "COMPLETED", "2024-01-01 00:04:00", "2024-01-01 00:05:00", 100, 3)
