"""Table verbs (G1-G4) and insert-on-conflict-do-nothing (Q5).

The reference's repository verbs (insert/find/list/update by id) as batch
DataFrame operations: an upsert is a union plus last-write-wins per id, a
patch is a left join of merged patches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.grouping import first_by
from quarry.functions.rules import payload_map


def with_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    """G1 id rule: a row without an id gets one, derived from its content
    (deterministic, so a retried insert produces the same id)."""
    derived = F.sha2(F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != key])), 256)
    if key not in rows.columns:
        return rows.withColumn(key, derived)
    return rows.withColumn(key, F.coalesce(F.col(key).cast("string"), derived))


def upsert(table: DataFrame, incoming: DataFrame, key: str = "id", order: str = "write_seq") -> DataFrame:
    """G1: the newest write per id. ``table`` has one row per id; only the
    incoming writes are aggregated, and the table's rows pass through an
    anti-join with the few that replace them. ``order`` must be unique per id
    (one write sequence number per write)."""
    newest = first_by(incoming, [key], order, descending=True).select(*table.columns)
    held = table.select(F.col(key), F.col(order).alias("__held"))
    wins = newest.join(held, key, "left").where(F.col("__held").isNull() | (F.col(order) > F.col("__held"))).drop("__held")
    return table.join(wins.select(key), key, "left_anti").unionByName(wins)


def find(table: DataFrame, key: str, value) -> DataFrame:
    """The row with this id (filter pushed to the scan)."""
    return table.filter(F.col(key) == value)


def filter_rows(table: DataFrame, predicate: str | Column) -> DataFrame:
    """Rows matching a predicate (SQL text or Column)."""
    return table.filter(F.expr(predicate) if isinstance(predicate, str) else predicate)


def patch(table: DataFrame, patches: DataFrame, key: str = "id",
          columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Shallow merge of JSON patches ``(id, seq, patch)``.

    Several patches of one id merge in ``seq`` order (last value per field
    wins); a field present with null does overwrite. Errors (id, error) are
    returned for ids not in the table, patches that are no JSON object, and
    fields that are no column. Returns (patched table, errors).
    """
    columns = list(columns or [c for c in table.columns if c != key])
    valid = patches.where(F.schema_of_variant(F.try_parse_json("patch")).startswith("OBJECT"))
    kv = valid.select(key, "seq", F.explode(payload_map("patch")).alias("field", "value"))
    kv = kv.filter(F.col("field").isin(*columns))
    last = kv.groupBy(key, "field").agg(F.max_by(F.to_json("value"), "seq").alias("value_json"))
    merged = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value_json"))).alias("__p"))
    types = dict(table.dtypes)
    out = table.join(merged, key, "left")
    sets = {}
    for c in columns:
        has = F.coalesce(F.map_contains_key("__p", F.lit(c)), F.lit(False))
        new = F.when(F.col("__p")[c] == "null", F.lit(None)).otherwise(
            F.from_json(F.concat(F.lit("["), F.col("__p")[c], F.lit("]")), f"array<{types[c]}>")[0])
        sets[c] = F.when(has, new.cast(types[c])).otherwise(F.col(c))
    patched = out.withColumns(sets).withColumn(
        "patched", F.col("__p").isNotNull()).drop("__p")
    errors = (patches.select(key).distinct().join(table.select(key), key, "left_anti")
              .withColumn("error", F.lit("Not found")))
    shape = F.schema_of_variant(F.try_parse_json("patch"))
    bad = F.coalesce(~shape.startswith("OBJECT"), F.lit(True))
    errors = errors.unionByName(patches.where(bad).select(key, F.lit("Malformed patch").alias("error")))
    extra = (patches.where(~bad).select(key, F.explode(F.json_object_keys("patch")).alias("f"))
             .where(~F.col("f").isin(*columns)).select(key, F.concat(F.lit("Unknown field: "), "f").alias("error")))
    errors = errors.unionByName(extra.distinct())
    return patched, errors


def insert_ignore(table: DataFrame, incoming: DataFrame, keys: Sequence[str],
                  order: str = "seq") -> DataFrame:
    """Q5: ``insert ... on conflict do nothing``: the first incoming row per
    key, only for keys not already present, appended to the table."""
    first = first_by(incoming, list(keys), order)
    new = first.join(table.select(*keys), list(keys), "left_anti")
    return table.unionByName(new.select(*table.columns))
