"""Entities and lineage.

Ids are derived (sha256 of natural keys) so a retried or recomputed job
produces the same rows; ``insert_if_absent`` makes appends idempotent.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.rules import normalize_payload, payload_map, raw_map, rebuild_payload

REQUIRED = ["source_id", "source_file_id", "source_record_id", "run_id", "entity_type"]


def record_id(snapshot: Column, number: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("record"), snapshot, number.cast("string")), 256)


def entity_id(run: Column, record: Column, version: Column | int = 1) -> Column:
    v = F.lit(version) if isinstance(version, int) else version
    return F.sha2(F.concat_ws("|", F.lit("entity"), run, record, v.cast("string")), 256)


def identity_projection(records: DataFrame, fields: Sequence[str], payload: str = "payload",
                        out: str = "identity_payload") -> DataFrame:
    """The listed fields of the *raw* payload; absent keys are skipped,
    explicit nulls kept, payload key order kept."""
    wanted = F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")
    kept = rebuild_payload(payload_map(payload), raw_map(payload), keep=lambda k: F.array_contains(wanted, k))
    return records.withColumn(out, kept)


def build_entities(records: DataFrame, configuration: Mapping) -> DataFrame:
    """One ACTIVE version-1 entity per record.

    ``records`` carries tenant_id, source_id, source_file_id, source_record_id,
    run_id, payload and ``domain`` (the profiled domain of its snapshot).
    entity_type = configuration["entity_type"] if set, else the domain.
    All joins that produced those columns are many-to-one on unique ids;
    this step itself is narrow (no shuffle).
    """
    rules = configuration.get("field_rules") or {}
    fields = configuration.get("identity_fields") or []
    etype = configuration.get("entity_type")
    df = normalize_payload(records, rules)
    df = identity_projection(df, fields)
    return df.select(
        entity_id(F.col("run_id"), F.col("source_record_id")).alias("entity_id"),
        "tenant_id",
        (F.lit(etype) if etype else F.col("domain")).alias("entity_type"),
        "source_id", "source_file_id", "source_record_id", "run_id",
        "normalized_payload", "identity_payload",
        F.lit(1).alias("version"), F.lit("ACTIVE").alias("status"))


def insert_if_absent(new: DataFrame, existing: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Entities whose (tenant, run, record, version) is not stored yet.

    Stored entities can only collide with new ones of the same runs: with
    ``runs`` (tenant_id, run_id of the batch, known without the entities) the
    stored side is first cut down to those.
    """
    keys = ["tenant_id", "run_id", "source_record_id", "version"]
    relevant = existing.select(*keys)
    if runs is not None:
        relevant = relevant.join(runs.select("tenant_id", "run_id"), ["tenant_id", "run_id"], "left_semi")
    return new.join(relevant, keys, "left_anti")


def create_checked(inputs: DataFrame, raw_records: DataFrame, runs: DataFrame) -> DataFrame:
    """Required fields, then provenance (record and run exist in the
    caller's tenant). Adds ``status`` (ACCEPTED/REJECTED) and ``reason``.

    The caller's tenant (column ``tenant_id``) always wins over any tenant in
    the input (deliberate). Only rows that pass the field checks take part in
    the existence joins, so null ids never meet in one reducer.
    """
    missing = None
    for k in reversed(REQUIRED):
        c = F.col(k)
        cond = c.isNull() | (c.cast("string") == "")
        missing = F.when(cond, F.lit(f"{k} required")) if missing is None else F.when(cond, F.lit(f"{k} required")).otherwise(missing)
    checked = inputs.withColumn("reason", missing)
    bad_fields = checked.filter(F.col("reason").isNotNull())
    ok_fields = checked.filter(F.col("reason").isNull())
    rec = raw_records.select(F.col("id").alias("source_record_id"), F.col("tenant_id").alias("__rt"))
    run = runs.select(F.col("id").alias("run_id"), F.col("tenant_id").alias("__ut"))
    joined = ok_fields.join(rec, "source_record_id", "left").join(run, "run_id", "left")
    valid = (F.col("__rt") == F.col("tenant_id")) & (F.col("__ut") == F.col("tenant_id"))
    joined = joined.withColumn("reason", F.when(~F.coalesce(valid, F.lit(False)),
                                                F.lit("Entity provenance context invalid"))).drop("__rt", "__ut")
    out = joined.unionByName(bad_fields)
    return out.withColumn("status", F.when(F.col("reason").isNull(), F.lit("ACCEPTED")).otherwise(F.lit("REJECTED")))


def lineage(entities: DataFrame, records: DataFrame, snapshots: DataFrame,
            files: DataFrame, sources: DataFrame) -> DataFrame:
    """E5: entity -> record -> snapshot -> file -> source, tenant in every key.

    Returns per (tenant, source): entities, records, snapshots, files reached.
    """
    e = entities.select("tenant_id", F.col("source_record_id").alias("record_id"), "entity_id")
    r = records.select("tenant_id", F.col("id").alias("record_id"), "snapshot_id")
    s = snapshots.select("tenant_id", F.col("id").alias("snapshot_id"), "source_file_id")
    f = files.select("tenant_id", F.col("id").alias("source_file_id"), "source_id")
    src = sources.select("tenant_id", F.col("id").alias("source_id"))
    walk = (e.join(r, ["tenant_id", "record_id"]).join(s, ["tenant_id", "snapshot_id"])
            .join(f, ["tenant_id", "source_file_id"]).join(src, ["tenant_id", "source_id"]))
    # records sit in one snapshot, snapshots in one file: roll up level by level
    # (one distinct per stage instead of an Expand over three distinct counts)
    per_snap = walk.groupBy("tenant_id", "source_id", "source_file_id", "snapshot_id").agg(
        F.count(F.lit(1)).alias("entities"), F.count_distinct("record_id").alias("records"))
    per_file = per_snap.groupBy("tenant_id", "source_id", "source_file_id").agg(
        F.sum("entities").alias("entities"), F.sum("records").alias("records"),
        F.count(F.lit(1)).alias("snapshots"))
    return per_file.groupBy("tenant_id", "source_id").agg(
        F.sum("entities").cast("long").alias("entities"), F.sum("records").cast("long").alias("records"),
        F.sum("snapshots").cast("long").alias("snapshots"), F.count(F.lit(1)).cast("long").alias("files"))
