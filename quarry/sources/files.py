"""Landing folders and tables: where uploads come from and results go.

* ``read_landing``: a folder of uploaded files -> upload rows via Spark's
  ``binaryFile`` source (one row per file, splittable across tasks).
  Tenant and source come from the folder layout
  ``<root>/<tenant_id>/<source_id>/<file name>``.
* ``append_table`` / ``read_table``: parquet tables partitioned by
  ``tenant_id`` (tenant-scoped reads prune partitions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACCEPTED_GLOB = "*.{csv,tsv,json,xlsx,xlsm,pdf,CSV,TSV,JSON,XLSX,XLSM,PDF}"


def read_landing(spark: SparkSession, root: str, glob: str | None = None,
                 mime_type: str = "application/octet-stream") -> DataFrame:
    """Upload rows from ``<root>/<tenant>/<source>/<name>``.

    Columns: seq (by time of change, then by a hash of the path), tenant_id, source_id, filename,
    mime_type, size_bytes, content, idempotency_key (null), path.
    ``glob`` restricts the files read (default: every file).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(root)
    # 64 low bits tell files of one microsecond apart
    seq = F.expr("cast(cast(unix_micros(modificationTime) AS decimal(17,0)) * 18446744073709551616BD "
                 "+ xxhash64(path) + 9223372036854775808BD AS decimal(38,0))")
    parts = F.split(F.col("path"), "/")
    n = F.size(parts)
    return df.select(
        seq.alias("seq"),
        F.element_at(parts, n - 2).alias("tenant_id"),
        F.element_at(parts, n - 1).alias("source_id"),
        F.element_at(parts, n).alias("filename"),
        F.lit(mime_type).alias("mime_type"),
        F.col("length").alias("size_bytes"),
        F.col("content"),
        F.lit(None).cast("string").alias("idempotency_key"),
        "path")


def append_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("tenant_id",)) -> None:
    """Append rows to a parquet table partitioned by tenant."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, tenant_id: str | None = None) -> DataFrame:
    """Read a table; with ``tenant_id`` only that tenant's partition is scanned."""
    df = spark.read.parquet(path)
    return df if tenant_id is None else df.filter(F.col("tenant_id") == tenant_id)
