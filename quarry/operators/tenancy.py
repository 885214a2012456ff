"""Tenant reads.

Batch forms of the reference's per-request reads: many users or requests
are answered in one plan by semi/anti joins against the ACTIVE memberships.
Joins are left to adaptive execution, which broadcasts small sides at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMBERSHIP_COLS = ["id", "tenant_id", "user_id", "role_id", "status", "created_at", "updated_at"]


def memberships_of_user(memberships: DataFrame, user_id: str) -> DataFrame:
    """All memberships of a user, any status (a pushed-down filter)."""
    cols = [c for c in MEMBERSHIP_COLS if c in memberships.columns]
    return memberships.filter(F.col("user_id") == user_id).select(*cols)


def membership_context(memberships: DataFrame, tenants: DataFrame, roles: DataFrame) -> DataFrame:
    """Membership with its tenant (id, name, slug, status) and role (id, code, name)."""
    t = tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant_name"),
                       F.col("slug").alias("tenant_slug"), F.col("status").alias("tenant_status"))
    r = roles.select(F.col("id").alias("role_id"), F.col("code").alias("role_code"), F.col("name").alias("role_name"))
    return (memberships.join(t, "tenant_id", "left")
            .join(r, "role_id", "left")
            .select("user_id", "tenant_id", "tenant_name", "tenant_slug", "tenant_status",
                    "role_id", "role_code", "role_name", "status"))


def active_pairs(memberships: DataFrame) -> DataFrame:
    return (memberships.filter(F.col("status") == "ACTIVE")
            .select("user_id", "tenant_id").distinct())


def gated(requests: DataFrame, memberships: DataFrame) -> DataFrame:
    """Requests with ``allowed``: whether (user, tenant) has an ACTIVE
    membership (the tenant's own status is not looked at). One join answers both."""
    pairs = active_pairs(memberships).withColumn("allowed", F.lit(True))
    return (requests.join(pairs, ["user_id", "tenant_id"], "left")
            .withColumn("allowed", F.coalesce("allowed", F.lit(False))))


def active_gate(requests: DataFrame, memberships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T3 as two tables: the allowed requests and the rest."""
    g = gated(requests, memberships)
    return g.where("allowed").drop("allowed"), g.where("NOT allowed").drop("allowed")


def org_lists_of_users(memberships: DataFrame, bases: DataFrame, companies: DataFrame, groups: DataFrame) -> DataFrame:
    """T4 for all users at once: every user's bases, companies and groups."""
    allowed = active_pairs(memberships)
    parts = [df.join(allowed, "tenant_id").select("user_id", F.lit(kind).alias("kind"), "id", "tenant_id", "name", "status")
             for kind, df in (("base", bases), ("company", companies), ("group", groups))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def org_lists(user_id: str, memberships: DataFrame, bases: DataFrame, companies: DataFrame,
              groups: DataFrame) -> DataFrame:
    """T4: bases, companies and groups of every tenant the user may read."""
    allowed = active_pairs(memberships.filter(F.col("user_id") == user_id)).select("tenant_id")
    parts = []
    for kind, df in (("base", bases), ("company", companies), ("group", groups)):
        parts.append(df.join(allowed, "tenant_id", "left_semi")
                     .select(F.lit(kind).alias("kind"), "id", "tenant_id", "name", "status"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scoped_list(df: DataFrame, tenant_id: str) -> DataFrame:
    """T5 list: rows of one tenant only."""
    return df.filter(F.col("tenant_id") == tenant_id)


def scoped_get(df: DataFrame, tenant_id: str, id_col: str, id_value) -> DataFrame:
    """T5 get: a row of another tenant is simply not found (empty)."""
    return df.filter((F.col("tenant_id") == tenant_id) & (F.col(id_col) == id_value))


def run_steps(runs: DataFrame, steps: DataFrame, tenant_id: str, run_id: str) -> DataFrame:
    """T5 steps of a run: the run is checked in the tenant, then its steps."""
    r = runs.filter((F.col("tenant_id") == tenant_id) & (F.col("run_id") == run_id)).select("run_id")
    return steps.join(r, "run_id", "left_semi")


def tenant_steps(runs: DataFrame, steps: DataFrame, tenant_id: str) -> DataFrame:
    """T5 steps of all runs of a tenant (runs filtered first, then a semi-join)."""
    return steps.join(scoped_list(runs, tenant_id).select("run_id"), "run_id", "left_semi")


# What a caller may list and what it may get by id.
LIST_KINDS = ("sources", "source-files")
GET_KINDS = ("raw", "profiling", "runs", "entities")


def read_requests(requests: DataFrame, memberships: DataFrame, items: DataFrame) -> DataFrame:
    """T5 for many callers at once: ``request_id, status, n_items, body``.

    ``requests``: request_id, user_id, tenant_id, kind, id (of gets).
    ``items``: kind, tenant_id, id, body, all readable tables in one. A list
    without a tenant is a VALIDATION_ERROR, a caller without an ACTIVE membership
    a TENANT_ACCESS_ERROR, a row of another tenant (or none) NOT_FOUND, an
    unknown kind too. A list answers with the number of its rows: they are
    counted once per (kind, tenant), not once per request; a get with its row.
    Ids are unique within (kind, tenant).
    """
    r = gated(requests.select("request_id", "user_id", "tenant_id", "kind", "id"), memberships)
    is_list, is_get = F.col("kind").isin(*LIST_KINDS), F.col("kind").isin(*GET_KINDS)
    early = (F.when(is_list & F.col("tenant_id").isNull(), F.lit("VALIDATION_ERROR"))
             .when(~F.col("allowed"), F.lit("TENANT_ACCESS_ERROR"))
             .when(~is_list & ~is_get, F.lit("NOT_FOUND")))
    r = r.select("request_id", "tenant_id", "kind", "id", early.alias("refused"))
    none = F.lit(None).cast("string")
    refused = r.where("refused IS NOT NULL").select(
        "request_id", F.col("refused").alias("status"), F.lit(0).cast("long").alias("n_items"), none.alias("body"))
    live = r.where("refused IS NULL").drop("refused")
    counts = items.where(is_list).groupBy("kind", "tenant_id").agg(F.count(F.lit(1)).alias("n"))
    lists = live.where(is_list).join(counts, ["kind", "tenant_id"], "left").select(
        "request_id", F.lit("OK").alias("status"), F.coalesce("n", F.lit(0).cast("long")).alias("n_items"), none.alias("body"))
    rows = items.where(is_get).select("kind", "tenant_id", "id", "body", F.lit(True).alias("found"))
    gets = live.where(is_get).join(rows, ["kind", "tenant_id", "id"], "left").select(
        "request_id", F.when(F.col("found"), F.lit("OK")).otherwise(F.lit("NOT_FOUND")).alias("status"),
        F.when(F.col("found"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_items"), "body")
    return refused.unionByName(lists).unionByName(gets)
