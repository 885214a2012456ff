"""The schema's CHECK and UNIQUE constraints as data (Q1, Q2, Q3 inputs).

``check_table(df, table)`` runs every CHECK of a table in one pass and
returns one row per violation; ``unique_table(df, table)`` returns every
duplicated key of the table's UNIQUE constraints. Tables are the ones this
engine writes (source_files, artifacts, raw_snapshots, raw_records,
entities, runs, steps, jobs, profiling_results) plus the identity tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.checks import SLUG_SHAPE, check_rules, non_blank, unique_violations

# Enum lists and shapes declared by the schema.
SOURCE_TYPES = ["FILE", "SYSTEM", "IMPORT", "API", "ERP"]
SOURCE_STATUS = ["ACTIVE", "INACTIVE", "ARCHIVED"]
FILE_STATUS = ["RECEIVED", "VERIFIED", "REJECTED", "PROCESSED", "FAILED"]
SNAPSHOT_STATUS = ["CREATED", "COMPLETE", "FAILED"]
ACTIVE_INACTIVE = ["ACTIVE", "INACTIVE"]
RUN_STATUS = ["PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED"]
STEP_STATUS = ["PENDING", "RUNNING", "COMPLETED", "FAILED", "SKIPPED", "CANCELLED"]
CONFIDENCE = ["HIGH", "MEDIUM", "LOW"]
ENTITY_STATUS = ["ACTIVE", "SUPERSEDED", "INVALID"]
TENANT_STATUS = ["ACTIVE", "SUSPENDED", "ARCHIVED"]
MEMBERSHIP_STATUS = ["ACTIVE", "SUSPENDED", "INVITED", "REMOVED"]
ORG_STATUS = ["ACTIVE", "ARCHIVED"]
SHA256_SHAPE = r"\A[0-9a-f]{64}\z"


def _in(col: str, values: list[str]) -> Column:
    return F.col(col).isin(*values)


def _range(col: str, lo: float, hi: float | None = None) -> Column:
    c = F.col(col)
    return (c >= lo) if hi is None else ((c >= lo) & (c <= hi))


def _rules() -> dict[str, dict[str, Column]]:
    return {
        "sources": {"source_type": _in("source_type", SOURCE_TYPES), "status": _in("status", SOURCE_STATUS)},
        "source_files": {"size_bytes": _range("size_bytes", 0),
                         "checksum_sha256": F.col("checksum_sha256").rlike(SHA256_SHAPE),
                         "status": _in("status", FILE_STATUS)},
        "artifacts": {"size_bytes": _range("size_bytes", 0),
                      "checksum_sha256": F.col("checksum_sha256").rlike(SHA256_SHAPE),
                      "version": F.col("version") > 0},
        "raw_snapshots": {"record_count": _range("record_count", 0), "status": _in("status", SNAPSHOT_STATUS)},
        "raw_records": {"record_number": F.col("record_number") > 0},
        "profiles": {"status": _in("status", ACTIVE_INACTIVE)},
        "profile_versions": {"version": F.col("version") > 0},
        "rules": {"status": _in("status", ACTIVE_INACTIVE)},
        "rule_versions": {"version": F.col("version") > 0},
        "jobs": {"status": _in("status", RUN_STATUS)},
        "runs": {"status": _in("status", RUN_STATUS), "progress": _range("progress", 0, 100),
                 "retry_count": _range("retry_count", 0)},
        "steps": {"sequence": F.col("sequence") > 0, "status": _in("status", STEP_STATUS),
                  "progress": _range("progress", 0, 100)},
        "profiling_results": {"confidence": _in("confidence", CONFIDENCE)},
        "entities": {"version": F.col("version") > 0, "status": _in("status", ENTITY_STATUS)},
        "roles": {"status": _in("status", ACTIVE_INACTIVE), "code_nonempty": non_blank(F.col("code"))},
        "permissions": {"status": _in("status", ACTIVE_INACTIVE), "resource_nonempty": non_blank(F.col("resource")),
                        "action_nonempty": non_blank(F.col("action"))},
        "tenants": {"status": _in("status", TENANT_STATUS), "name_nonempty": non_blank(F.col("name")),
                    "slug_format": F.col("slug").rlike(SLUG_SHAPE)},
        "memberships": {"status": _in("status", MEMBERSHIP_STATUS)},
        "bases": {"status": _in("status", ORG_STATUS), "name_nonempty": non_blank(F.col("name")),
                  "slug_format": F.col("slug").rlike(SLUG_SHAPE)},
        "companies": {"status": _in("status", ORG_STATUS), "name_nonempty": non_blank(F.col("name"))},
        "groups": {"status": _in("status", ORG_STATUS), "name_nonempty": non_blank(F.col("name"))},
    }


# UNIQUE constraints per table.
UNIQUE_KEYS: dict[str, list[tuple[str, ...]]] = {
    "sources": [("tenant_id", "id")],
    "source_files": [("tenant_id", "checksum_sha256"), ("tenant_id", "id")],
    "artifacts": [("tenant_id", "storage_provider", "storage_key", "version")],
    "raw_snapshots": [("source_file_id", "snapshot_version"), ("tenant_id", "id")],
    "raw_records": [("snapshot_id", "record_number")],
    "profiles": [("code",)],
    "profile_versions": [("profile_id", "version")],
    "rules": [("code",)],
    "rule_versions": [("rule_id", "version")],
    "jobs": [("tenant_id", "idempotency_key"), ("tenant_id", "id")],
    "runs": [("execution_id",), ("tenant_id", "id")],
    "steps": [("run_id", "sequence"), ("run_id", "idempotency_key")],
    "profiling_results": [("run_id",)],
    "entities": [("run_id", "source_record_id", "version")],
    "roles": [("code",)],
    "permissions": [("resource", "action")],
    "role_permissions": [("role_id", "permission_id")],
    "tenants": [("slug",)],
    "memberships": [("tenant_id", "user_id")],
    "bases": [("tenant_id", "slug")],
    "groups": [("tenant_id", "name")],
}


def _applicable(df: DataFrame, table: str, skip_missing: bool = False) -> dict[str, Column]:
    """The table's CHECKs. A CHECK whose column ``df`` lacks is an error,
    unless the caller says that ``df`` is only a part of the table."""
    column_of = {"code_nonempty": "code", "name_nonempty": "name", "slug_format": "slug",
                 "resource_nonempty": "resource", "action_nonempty": "action"}
    rules = _rules()[table]
    held = {name: rule for name, rule in rules.items() if column_of.get(name, name) in df.columns}
    if not skip_missing and len(held) < len(rules):
        raise ValueError(f"{table} lacks the columns of its checks {sorted(set(rules) - set(held))}")
    return held


def check_table(df: DataFrame, table: str, key: str = "id", skip_missing: bool = False) -> DataFrame:
    """Every CHECK of ``table``, in one pass."""
    return check_rules(df, table, key, _applicable(df, table, skip_missing))


def unique_table(df: DataFrame, table: str, skip_missing: bool = False) -> DataFrame | None:
    """Duplicated keys of every UNIQUE constraint of ``table`` (null parts
    skipped); None without a constraint. A constraint whose columns ``df`` lacks
    is an error, unless the caller says that ``df`` is only a part of the table."""
    out = None
    for keys in UNIQUE_KEYS.get(table, []):
        if not all(k in df.columns for k in keys):
            if skip_missing:
                continue
            raise ValueError(f"{table} lacks the columns of its unique key {keys}")
        v = unique_violations(df, list(keys)).select(
            F.lit(table).alias("table"), F.lit(",".join(keys)).alias("constraint"),
            F.to_json(F.struct(*[F.col(k) for k in keys])).alias("key"), "n")
        out = v if out is None else out.unionByName(v)
    return out


def rule_counts(df: DataFrame, table: str, skip_missing: bool = False) -> DataFrame:
    """Violations per declared CHECK of ``table``: one aggregation pass
    (``count_if`` per rule), one output row per rule, zeros included."""
    rules = _applicable(df, table, skip_missing)
    agg = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(True))).cast("long").alias(name)
                   for name, rule in rules.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in rules)
    return agg.selectExpr(f"stack({len(rules)}, {pairs}) as (rule, violations)").select(
        F.lit(table).alias("table"), "rule", "violations")
