"""End-to-end pipeline (E6, L5): latest RAW snapshot per file -> profile ->
normalization -> entities -> run statistics, for many files in one job.

Plan shape: the snapshot choice and the profile are aggregations keyed by
snapshot; both results are small (one row per file / snapshot) and are
materialized once, since several branches use them. Everything attached back
to the records is a many-to-one join on a unique snapshot id (AQE broadcasts
the small side at run time); the normalization and entity projection are
narrow.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.grouping import first_by, materialize
from quarry.operators import entity, ledger, profile


def run_id_col(config_hash: str):
    return F.sha2(F.concat_ws("|", F.lit("run"), F.col("tenant_id"), F.col("source_file_id"),
                              F.col("snapshot_id"), F.lit(config_hash)), 256)


def run_pipeline(records: DataFrame, configuration: Mapping,
                 profile_version_id: str | None = None, rule_version_id: str | None = None,
                 existing_entities: DataFrame | None = None,
                 snapshots: DataFrame | None = None) -> dict[str, DataFrame]:
    """``records``: tenant_id, source_id, source_file_id, snapshot_id,
    record_number, payload, and optionally snapshot_version (default 1).

    Returns ``entities`` (inserted), ``runs`` (one per file, with statistics),
    ``profiles`` (summary report per snapshot) and ``records`` (the chosen
    snapshots' records); ``profiling_results(out)`` gives the full rows.
    """
    cfg = ledger.config_snapshot(configuration, profile_version_id, rule_version_id)
    if "snapshot_version" not in records.columns:
        records = records.withColumn("snapshot_version", F.lit(1).cast("long"))

    # Latest snapshot per file (aggregate over the snapshot list; with
    # ``snapshots`` given, snapshots without any record take part too)
    cols5 = ["tenant_id", "source_id", "source_file_id", "snapshot_id", "snapshot_version"]
    snaps = records.select(*cols5).distinct() if snapshots is None else snapshots.select(*cols5)
    latest = first_by(snaps, ["tenant_id", "source_file_id"], "snapshot_version", descending=True)
    # one row per file, used by four branches below: computed once
    latest = materialize(latest.withColumn("run_id", run_id_col(cfg["configuration_hash"])), small=True)
    recs = records.join(latest.select("tenant_id", "source_file_id", "snapshot_id", "run_id"),
                        ["tenant_id", "source_file_id", "snapshot_id"], "left_semi")

    # P1-P5 over the chosen snapshots
    # one row per snapshot, used three times: computed once. The full result
    # JSON (statistics, examples) is only built for ``profiling_results``.
    report = materialize(profile.profile_report(recs), small=True)

    # N8 + E1-E3
    enriched = (recs.join(latest.select("snapshot_id", "run_id"), "snapshot_id")
                .join(report.select("snapshot_id", "domain"), "snapshot_id")
                .withColumn("source_record_id", entity.record_id(F.col("snapshot_id"), F.col("record_number"))))
    ents = entity.build_entities(enriched, configuration)
    if existing_entities is not None:
        ents = entity.insert_if_absent(ents, existing_entities, latest)

    # Statistics per run
    n_raw = report.select("snapshot_id", F.col("row_count").alias("raw_records"))
    n_ent = ents.groupBy("run_id").agg(F.count(F.lit(1)).cast("long").alias("entities"))
    runs = (latest.join(n_raw, "snapshot_id", "left")
            .join(report.select("snapshot_id", "domain", "confidence"), "snapshot_id", "left")
            .join(n_ent, "run_id", "left")
            .select("run_id", "tenant_id", "source_file_id", "snapshot_id",
                    F.coalesce("raw_records", F.lit(0)).cast("long").alias("raw_records"),
                    F.coalesce("entities", F.lit(0)).cast("long").alias("entities"),
                    F.coalesce("domain", F.lit("UNKNOWN")).alias("profiling_domain"),
                    F.coalesce("confidence", F.lit("LOW")).alias("confidence"),
                    F.lit(cfg["configuration_version"]).alias("configuration_version"),
                    F.lit(cfg["configuration_hash"]).alias("configuration_hash"),
                    F.lit("COMPLETED").alias("status"), F.lit(100).alias("progress"),
                    F.lit("local").alias("worker")))
    return {"entities": ents, "runs": runs, "profiles": report, "records": recs}


def profiling_results(out: dict[str, DataFrame]) -> DataFrame:
    """One ``profiling_results`` row per run of a ``run_pipeline`` result,
    with the full result JSON (statistics and examples). Kept separate
    because the full-result plan is large: it is only built when asked for."""
    full = profile.profile_report(out["records"], with_result=True)
    return (out["runs"].select("snapshot_id", "run_id", "tenant_id").join(full, "snapshot_id")
            .select(F.sha2(F.concat_ws("|", F.lit("profile"), F.col("run_id")), 256).alias("id"),
                    "tenant_id", "run_id", F.col("snapshot_id").alias("raw_snapshot_id"), "domain",
                    "confidence", "row_count", "column_count", "result"))


def pipeline_steps(runs: DataFrame) -> DataFrame:
    """The three steps of each run (RAW, PROFILING, NORMALIZATION) with the
    outputs the reference records on them, all COMPLETED at 100."""
    def step(kind: str, seq: int, output):
        return runs.select("run_id", F.lit(kind).alias("step_type"), F.lit(seq).cast("long").alias("sequence"),
                           F.lit("COMPLETED").alias("status"), F.lit(100).alias("progress"), output.alias("output"))
    raw = step("RAW", 1, F.to_json(F.struct(F.col("snapshot_id"), F.col("raw_records").alias("record_count"))))
    result_id = F.sha2(F.concat_ws("|", F.lit("profile"), F.col("run_id")), 256)
    prof = step("PROFILING", 2, F.to_json(F.struct(result_id.alias("profiling_result_id"),
                                                   F.col("profiling_domain").alias("domain"), "confidence")))
    norm = step("NORMALIZATION", 3, F.to_json(F.struct(F.col("entities").alias("entity_count"))))
    return raw.unionByName(prof).unionByName(norm)


def snapshot_files(files: DataFrame, prior_snapshots: DataFrame | None = None,
                   max_records: int | None = None,
                   parser_version: str | None = None,
                   contents: DataFrame | None = None,
                   registered: DataFrame | None = None) -> dict[str, DataFrame]:
    """RAW snapshots (R1-R4) of already registered files.

    ``files``: seq (arrival order), source_file_id, tenant_id, source_id,
    filename, and content unless ``contents`` (seq, filename, content) gives
    the bytes separately. The same file may be snapshotted again: versions
    continue after ``prior_snapshots`` (source_file_id) and after earlier rows
    of this batch. Versions are computed on the narrow file list. With ``registered`` (source files: id, tenant_id) a file not
    registered in its tenant is refused as not found. Returns ``snapshots``
    (one header row each), ``records`` and ``quarantine`` (unknown files,
    reader failures, record-limit refusals).
    """
    from quarry.operators import raw
    from quarry.sources.dispatch import parse_files, split_parsed

    narrow = files.select("seq", "source_file_id", "tenant_id", "source_id", "filename")
    unknown = None
    if registered is not None:
        # a file must be registered in the caller's tenant (else: not found)
        known = registered.select(F.col("id").alias("source_file_id"), "tenant_id").distinct()
        unknown = narrow.join(known, ["source_file_id", "tenant_id"], "left_anti")
        narrow = narrow.join(known, ["source_file_id", "tenant_id"], "left_semi")
    versions = raw.snapshot_versions(narrow, prior_snapshots).withColumn("snapshot_id", raw.snapshot_id())
    # files are parsed where their bytes are read: the bytes cross no exchange,
    # only the records do, once, to meet the versions of the accepted files
    blobs = contents if contents is not None else files.select("seq", "filename", "content")
    own = versions.select(F.col("seq").cast("string").alias("file_id"), "snapshot_id")
    parsed_all = parse_files(blobs, "seq", "filename", "content").join(own, "file_id").drop("file_id")
    # the parsed RAW records are the stored snapshot data; parse once, then the
    # limit gate, headers, profile and entity branches all read them
    parsed_all = materialize(parsed_all.withColumnRenamed("snapshot_id", "file_id"))
    parsed, parse_errors = split_parsed(parsed_all)
    parsed = parsed.withColumnRenamed("file_id", "snapshot_id")
    kept, verdicts = raw.record_limit(parsed, max_records)
    meta = versions.select("snapshot_id", "source_file_id", "tenant_id", "source_id", "snapshot_version")
    records = kept.join(meta, "snapshot_id")
    refused = (parse_errors.select(F.col("file_id").alias("snapshot_id"), F.col("error").alias("reason"))
               .unionByName(verdicts.filter(F.col("status") == "REJECTED").select("snapshot_id", "reason")))
    # every accepted file gets a header, a file with no record included (count 0)
    counts = raw.build_snapshots(kept, parser_version or raw.PARSER_VERSION)
    headers = (meta.join(refused.select("snapshot_id"), "snapshot_id", "left_anti")
               .join(counts, "snapshot_id", "left")
               .select("snapshot_id", "tenant_id", "source_id", "source_file_id", "snapshot_version",
                       F.coalesce("record_count", F.lit(0)).cast("long").alias("record_count"),
                       F.coalesce("schema_hash", F.sha2(F.lit("[]"), 256)).alias("schema_hash"),
                       F.lit(parser_version or raw.PARSER_VERSION).alias("parser_version"),
                       F.lit("COMPLETE").alias("status")))
    quarantine = refused.join(meta, "snapshot_id")
    if unknown is not None:
        quarantine = quarantine.unionByName(unknown.select(
            F.lit(None).cast("string").alias("snapshot_id"), F.lit("Source file not found").alias("reason"),
            "source_file_id", "tenant_id", "source_id", F.lit(None).cast("long").alias("snapshot_version")))
    return {"snapshots": headers, "records": records, "quarantine": quarantine}


def ingest_and_process(uploads: DataFrame, sources: DataFrame, configuration: Mapping,
                       prior_files: DataFrame | None = None, prior_keys: DataFrame | None = None,
                       prior_snapshots: DataFrame | None = None,
                       max_records: int | None = None, max_bytes: int | None = None) -> dict[str, DataFrame]:
    """The whole chain from file bytes: intake (I1-I6) -> parse (I7-I12) ->
    RAW snapshots (R1-R4) -> profile, normalization, entities, runs (E6).

    Only NEW files are snapshotted, and files that the policy refuses are not
    parsed. Intake works on narrow rows and files are
    parsed where they are read, so no shuffle carries file bytes. A file whose
    reader fails or that exceeds ``max_records`` is quarantined whole. Both
    caps (bytes of a file, records of a snapshot) are off unless given.
    """
    from quarry.operators import intake

    resolved = intake.resolve_uploads(uploads, sources, prior_files, prior_keys, max_bytes)
    files, artifacts = intake.ingest_manifest(resolved)
    new = resolved.filter(F.col("status") == intake.NEW).select(
        "seq", F.col("file_id").alias("source_file_id"), "tenant_id", "source_id",
        F.col("clean_filename").alias("filename"))
    # what one row tells (name, extension, size, type) is judged before any byte
    # is read by a parser; only duplicates and replays are parsed and dropped
    allowed = intake.file_policy(uploads, max_bytes).where("reject_reason IS NULL")
    contents = allowed.select("seq", F.col("clean_filename").alias("filename"), "content")
    snap = snapshot_files(new, prior_snapshots, max_records, contents=contents)
    out = run_pipeline(snap["records"], configuration, snapshots=snap["snapshots"])
    out.update({"resolved": resolved, "source_files": files, "artifacts": artifacts,
                "snapshots": snap["snapshots"], "quarantine": snap["quarantine"]})
    return out
