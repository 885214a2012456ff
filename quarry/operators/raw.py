"""RAW snapshots.

Records are ``(tenant_id, snapshot_id, record_number, payload)`` with the
payload as JSON text (keys in JavaScript object order). Record numbers come
from the parser; nothing here imposes a global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.grouping import first_by, number_within

# Default parser label on snapshot headers (a caller's parameter); fixed
# value: the record cap that a caller may ask for.
PARSER_VERSION = "parser-1"
MAX_RECORDS = 10_000


def snapshot_versions(batch: DataFrame, prior: DataFrame | None = None,
                      file_col: str = "source_file_id", seq: str = "seq") -> DataFrame:
    """version = snapshots already stored for the file + rank in the batch.

    The rank is numbered in two levels (``number_within``), so a file with a
    huge number of snapshots is spread over many tasks, whatever ``seq`` is.
    """
    out = number_within(batch, [file_col], [seq], "__rank")
    if prior is not None:
        counts = prior.groupBy(file_col).agg(F.count(F.lit(1)).alias("__prior"))
        out = out.join(counts, file_col, "left")
    else:
        out = out.withColumn("__prior", F.lit(0))
    return (out.withColumn("snapshot_version", (F.coalesce(F.col("__prior"), F.lit(0)) + F.col("__rank")).cast("long"))
            .drop("__rank", "__prior"))


def snapshot_id(file_col: str = "source_file_id", version: str = "snapshot_version"):
    return F.sha2(F.concat_ws("|", F.lit("snapshot"), F.col(file_col), F.col(version).cast("string")), 256)


def column_union(records: DataFrame, snapshot: str = "snapshot_id") -> DataFrame:
    """R2: sorted distinct keys per snapshot and ``sha256(JSON(columns))``.

    ``collect_set`` combines map-side, so a snapshot's partial sets are
    bounded by its number of distinct columns, not its number of records.
    """
    keys = records.select(snapshot, F.explode(F.json_object_keys("payload")).alias("k"))
    cols = F.array_sort(F.collect_set("k"))
    return (keys.groupBy(snapshot).agg(cols.alias("columns"))
            .withColumn("columns_json", F.to_json("columns"))
            .withColumn("schema_hash", F.sha2(F.col("columns_json"), 256)))


def build_snapshots(records: DataFrame, parser_version: str = PARSER_VERSION,
                    snapshot: str = "snapshot_id") -> DataFrame:
    """One header row per snapshot (record_count, schema_hash, COMPLETE)."""
    counts = records.groupBy(snapshot).agg(F.count(F.lit(1)).alias("record_count"))
    union = column_union(records, snapshot).select(snapshot, "schema_hash")
    empty_hash = F.sha2(F.lit("[]"), 256)
    return (counts.join(union, snapshot, "left")
            .select(snapshot, F.col("record_count").cast("long"),
                    F.coalesce("schema_hash", empty_hash).alias("schema_hash"),
                    F.lit(parser_version).alias("parser_version"), F.lit("COMPLETE").alias("status")))


def record_limit(records: DataFrame, limit: int | None = None,
                 snapshot: str = "snapshot_id") -> tuple[DataFrame, DataFrame]:
    """Snapshots over ``limit`` records are refused whole.

    Returns (kept records, per-snapshot verdicts). Without a limit none is refused.
    """
    counts = records.groupBy(snapshot).agg(F.count(F.lit(1)).cast("long").alias("record_count"))
    over = F.lit(False) if limit is None else F.col("record_count") > F.lit(limit)
    verdicts = counts.select(
        snapshot, "record_count",
        F.when(over, F.lit("REJECTED")).otherwise(F.lit("ACCEPTED")).alias("status"),
        F.when(over, F.lit("RAW record limit exceeded")).alias("reason"),
        F.when(over, F.lit("INGESTION_ERROR")).alias("error_code"))
    refused = verdicts.filter(F.col("status") == "REJECTED").select(snapshot)
    return records.join(refused, snapshot, "left_anti"), verdicts


def latest_snapshot(snapshots: DataFrame, keys=("tenant_id", "source_file_id"),
                    version: str = "snapshot_version") -> DataFrame:
    """The highest version per file in its tenant (an aggregate, no sort)."""
    return first_by(snapshots, list(keys), version, descending=True)


def ordered_records(records: DataFrame, tenant_id: str, snapshot_id_value: str) -> DataFrame:
    """One snapshot's records in a tenant, ordered by record number."""
    return (records.filter((F.col("tenant_id") == tenant_id) & (F.col("snapshot_id") == snapshot_id_value))
            .orderBy("record_number"))
