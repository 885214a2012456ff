"""Integrity checks (Q1-Q4, Q6) as queries that return violations.

Output rows are ``(table, rule, key, detail)`` shaped, one per violation.
As in SQL, a CHECK whose predicate is null passes and a null foreign key
passes; unique keys ignore rows with a null key part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identity-id shape (36 chars of hex digits and dashes, any case),
# slug shape and the enum lists of the schema.
UUID_SHAPE = r"(?i)\A[0-9a-f-]{36}\z"
SLUG_SHAPE = r"\A[a-z0-9][a-z0-9-]{1,62}\z"
SOURCE_STATUS = ["ACTIVE", "INACTIVE", "ARCHIVED"]
FILE_STATUS = ["RECEIVED", "VERIFIED", "REJECTED", "PROCESSED", "FAILED"]
SOURCE_TYPES = ["FILE", "SYSTEM", "IMPORT", "API", "ERP"]
CONFIDENCE = ["HIGH", "MEDIUM", "LOW"]
ENTITY_STATUS = ["ACTIVE", "SUPERSEDED", "INVALID"]


def non_blank(c: Column) -> Column:
    return F.length(F.trim(c)) > 0


def check_rules(df: DataFrame, table: str, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """Q1: one pass over the table; each failing rule gives one row."""
    fails = F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()])
    return (df.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(fails)).alias("rule"))
            .select(F.lit(table).alias("table"), "rule", "key"))


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q2: key values held by more than one row (null key parts excluded)."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return (df.filter(cond).groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n"))
            .filter(F.col("n") > 1))


def partial_unique(df: DataFrame, keys: Sequence[str], where: Column) -> DataFrame:
    """Q3: a unique index restricted by ``where``."""
    return unique_violations(df.filter(where), keys)


def tenant_fk(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id",
              tenant: str = "tenant_id") -> DataFrame:
    """Q4: child rows whose (tenant, fk) has no parent (tenant, id)."""
    p = parent.select(F.col(tenant), F.col(pk).alias(fk)).distinct()
    return child.filter(F.col(fk).isNotNull()).join(p, [tenant, fk], "left_anti")


def uuid_shape(c: Column) -> Column:
    """Q6: 36 characters from [0-9a-f-], any case."""
    return F.coalesce(c.rlike(UUID_SHAPE), F.lit(False))
