"""Streaming intake (I5 delivered by Structured Streaming).

Uploads arrive as a stream of rows (e.g. ``readStream`` over a landing table
of ``seq, tenant_id, source_id, filename, mime_type, content,
idempotency_key``). Each micro-batch is resolved with the files and keys
stored by earlier batches (``resolve_uploads`` with ``prior_files`` /
``prior_keys``) and appended to the output tables.

Exactly-once: a micro-batch may be replayed after a failure, so every output
is written under ``batch_id=<id>`` with dynamic partition overwrite; a replay
replaces its own partition instead of appending twice, and earlier batches
are read back excluding the batch being written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import intake

TABLES = ("results", "source_files", "artifacts", "keys")


def _read_prior(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What earlier batches stored, None before the first. The path's own file
    system is asked; an unreadable history is an error, never "no history"."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    earlier = [s for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith("batch_id=")]
    if not any(int(s.getPath().getName().removeprefix("batch_id=")) < batch_id for s in earlier):
        return None
    return spark.read.parquet(path).filter(F.col("batch_id") < batch_id).drop("batch_id")


def process_batch(uploads: DataFrame, batch_id: int, sources: DataFrame, out_dir: str,
                  max_bytes: int | None = None) -> None:
    """Resolve one micro-batch against everything stored before it."""
    spark = uploads.sparkSession
    prior_files = _read_prior(spark, f"{out_dir}/source_files", batch_id)
    prior_keys = _read_prior(spark, f"{out_dir}/keys", batch_id)
    pf = prior_files.select("tenant_id", "checksum_sha256", F.col("id").alias("file_id")) if prior_files is not None else None
    resolved = intake.resolve_uploads(uploads, sources, pf, prior_keys, max_bytes)
    files, artifacts = intake.ingest_manifest(resolved)
    outputs = {"results": resolved, "source_files": files, "artifacts": artifacts,
               "keys": intake.registered_keys(resolved)}
    for name, df in outputs.items():
        (df.withColumn("batch_id", F.lit(batch_id).cast("long"))
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("batch_id").parquet(f"{out_dir}/{name}"))


def start_intake_stream(uploads_stream: DataFrame, sources: DataFrame, out_dir: str,
                        checkpoint_location: str, trigger: dict | None = None,
                        max_bytes: int | None = None) -> StreamingQuery:
    """Start the intake stream; ``checkpoint_location`` must be a shared,
    durable folder (it records which batches were committed)."""
    writer = (uploads_stream.writeStream
              .foreachBatch(lambda df, bid: process_batch(df, bid, sources, out_dir, max_bytes))
              .option("checkpointLocation", checkpoint_location))
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
