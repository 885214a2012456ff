"""Column profiling (P1-P5) over RAW records.

Cells are dense: every record of a snapshot is looked at for every column of
that snapshot, with three states (absent / JSON null / value). As in the
reference, a value is excluded only when it is null or ``""``; an absent key
counts as a non-null value whose text is ``"undefined"`` and whose example is
null. ``distinct`` counts ``String(v)`` forms: ``1`` and ``"1"`` are one
value, every object is ``[object Object]``.

Reports do not build these cells: ``sparse_stats`` and ``sparse_examples``
give the same rows from the keys that records have, and take what is absent
from the row counts and from gaps in the record numbers.

Plan shape of dense cells: the per-snapshot column list is joined to the records
(many-to-one; AQE broadcasts it at run time when small and splits a hot
snapshot otherwise), the cells are an ``explode`` (narrow), statistics are a
partial+final aggregation on (snapshot, column), and the first-3 examples use
``row_number() <= 3``, which Spark plans as a partial ``WindowGroupLimit``
before the shuffle, so at most 3 rows per group leave each map task.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.rules import js_number, payload_map, raw_map, value_json

# Domain patterns (case-insensitive substring match).
DOMAIN_PATTERNS = {
    "ARTICLE": "article|sku|reference|designation|barcode|ean",
    "CUSTOMER": "client|customer|siren|siret|vat",
    "SUPPLIER": "supplier|fournisseur|siren|siret",
}
DOMAINS = list(DOMAIN_PATTERNS)

# Places of keys: more than the keys of any record, and below any record number.
PER_RECORD = Decimal(1 << 31)
BEFORE_ALL = Decimal(-(1 << 63) - 1)


def column_order(records: DataFrame, snapshot: str = "snapshot_id") -> DataFrame:
    """(snapshot, column_name, position) in first-appearance order.

    The place of a key (record number, nulls first, then position) is one
    number: its minimum is a hash aggregate that combines map-side, whereas a
    struct's would sort a row per key of every record in the task.
    """
    number = F.coalesce(F.col("record_number").cast("decimal(20,0)"), F.lit(BEFORE_ALL))
    keys = records.select(snapshot, number.alias("number"),
                          F.posexplode(F.json_object_keys("payload")).alias("pos", "column_name"))
    place = F.col("number") * F.lit(PER_RECORD) + F.col("pos")
    firsts = keys.groupBy(snapshot, "column_name").agg(F.min(place).alias("first"))
    w = Window.partitionBy(snapshot).orderBy("first", "column_name")
    return firsts.select(snapshot, "column_name",
                         F.row_number().over(w).cast("long").alias("position"))


def column_lists(order: DataFrame, snapshot: str = "snapshot_id") -> DataFrame:
    """Per snapshot: the ordered array of its column names."""
    return order.groupBy(snapshot).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name"))),
                    lambda s: s["column_name"]).alias("columns"))


# Array nesting levels turned into text exactly; deeper arrays (rare in
# tabular files) fall back to their JSON text with brackets and quotes dropped.
ARRAY_DEPTH = 3


def _scalar_text(v: Column) -> Column:
    return F.regexp_replace(F.to_json(v), r"\.0\z", "")


def _array_text(v: Column, depth: int) -> Column:
    """``Array.prototype.join(",")``: null items are empty, objects are
    ``[object Object]``, nested arrays join recursively."""
    def item(x: Column) -> Column:
        t = F.schema_of_variant(x)
        out = (F.when(x.isNull() | F.is_variant_null(x), F.lit(""))
                .when(t == "STRING", x.cast("string"))
                .when(t.startswith("OBJECT"), F.lit("[object Object]")))
        if depth > 1:
            out = out.when(t.startswith("ARRAY"), _array_text(x, depth - 1))
        else:
            out = out.when(t.startswith("ARRAY"), F.regexp_replace(F.to_json(x), r'[\[\]"]', ""))
        return out.otherwise(_scalar_text(x))
    return F.array_join(F.transform(v.cast("array<variant>"), item), ",", "")


def js_string(v: Column, raw_text: Column | None = None, nested: str = "object") -> Column:
    """``String(v)`` of a JSON value held as a variant.

    ``nested="json"`` (an option, not the reference behaviour) counts objects
    and arrays by their JSON text instead of ``[object Object]``/joined items.
    """
    t = F.schema_of_variant(v)
    out = F.when(t == "STRING", v.cast("string"))
    if nested == "json":
        text = raw_text if raw_text is not None else F.to_json(v)
        out = out.when(t.startswith("OBJECT") | t.startswith("ARRAY"), text)
    else:
        out = (out.when(t.startswith("OBJECT"), F.lit("[object Object]"))
                  .when(t.startswith("ARRAY"), _array_text(v, ARRAY_DEPTH)))
    return out.otherwise(_scalar_text(v))


def rate_text(x: Column) -> Column:
    """JavaScript text of a rate in [0, 1] (``0``, ``0.5``, ``0.0001``), not
    Java's (``0.0``, ``1.0E-4``), with all digits of the double."""
    return F.when(x == 0, F.lit("0")).otherwise(js_number(x, x.cast("string")))


def cells(records: DataFrame, lists: DataFrame, snapshot: str = "snapshot_id") -> DataFrame:
    """Dense cells: (snapshot, record_number, column_name, present, v)."""
    joined = records.select(snapshot, "record_number", payload_map("payload").alias("m"),
                            raw_map("payload").alias("raw")).join(lists, snapshot)
    ex = joined.select(snapshot, "record_number", "m", "raw", F.explode("columns").alias("column_name"))
    present = F.map_contains_key("m", F.col("column_name"))
    return ex.select(snapshot, "record_number", "column_name", present.alias("present"),
                     F.col("m")[F.col("column_name")].alias("v"),
                     F.col("raw")[F.col("column_name")].alias("raw_text"))


def _included(present: Column, v: Column, absent: str = "undefined") -> Column:
    """Excluded: JSON null or ``""``. An absent key is included (as the
    reference's ``undefined``) unless ``absent="null"``."""
    empty = (F.schema_of_variant(v) == "STRING") & (v.cast("string") == "")
    inc = ~(present & (F.is_variant_null(v) | empty))
    return inc & present if absent == "null" else inc


def column_stats(cell_df: DataFrame, snapshot: str = "snapshot_id", absent: str = "undefined",
                 nested: str = "object", approx: bool = False) -> DataFrame:
    """row_count, non_null, null_rate, distinct per (snapshot, column).

    Options (defaults give the reference's numbers): ``absent="null"`` treats
    a missing key as null; ``nested="json"`` counts objects/arrays by JSON
    text; ``approx=True`` uses ``approx_count_distinct`` (HyperLogLog++,
    fixed memory per group) instead of an exact distinct.
    """
    inc = _included(F.col("present"), F.col("v"), absent)
    text = F.when(~F.col("present"), F.lit("undefined")).otherwise(
        js_string(F.col("v"), F.col("raw_text"), nested))
    distinct = F.approx_count_distinct if approx else F.count_distinct
    agg = cell_df.groupBy(snapshot, "column_name").agg(
        F.count(F.lit(1)).cast("long").alias("row_count"),
        F.count_if(inc).cast("long").alias("non_null"),
        distinct(F.when(inc, text)).cast("long").alias("distinct_count"))
    return agg.withColumn("null_rate", F.lit(1) - F.col("non_null") / F.col("row_count"))


def column_examples(cell_df: DataFrame, k: int = 3, snapshot: str = "snapshot_id",
                    absent: str = "undefined") -> DataFrame:
    """P2 examples: the first ``k`` included values by record number."""
    inc = cell_df.filter(_included(F.col("present"), F.col("v"), absent))
    w = Window.partitionBy(snapshot, "column_name").orderBy("record_number")
    return (inc.withColumn("example_rank", F.row_number().over(w))
            .filter(F.col("example_rank") <= k)
            .select(snapshot, "column_name", F.col("example_rank").cast("long"),
                    F.when(F.col("present"), value_json(F.col("v"), F.col("raw_text")))
                     .otherwise(F.lit("null")).alias("example_json")))


# -- the same statistics from present entries only ---------------------------

def present_cells(records: DataFrame, snapshot: str = "snapshot_id", with_text: bool = False) -> DataFrame:
    """One row per key that a record has: (snapshot, record_number,
    column_name, v), and with ``with_text`` the value's JSON text."""
    raw = [raw_map("payload").alias("raw")] if with_text else []
    cols = [snapshot, "record_number", F.explode(payload_map("payload")).alias("column_name", "v"), *raw]
    out = records.select(*cols)
    return out.withColumn("raw_text", F.col("raw")[F.col("column_name")]).drop("raw") if with_text else out


def sparse_stats(records: DataFrame, snapshot: str = "snapshot_id", absent: str = "undefined",
                 nested: str = "object", approx: bool = False) -> DataFrame:
    """``column_stats`` without dense cells: only present entries are grouped;
    what is absent is the snapshot's row count less the present ones, and adds
    the one text ``undefined`` to the distinct values."""
    inc = _included(F.lit(True), F.col("v"), absent)
    json_text = nested == "json"
    entries = present_cells(records, snapshot, json_text).select(
        snapshot, "column_name", inc.alias("inc"),
        F.when(inc, js_string(F.col("v"), F.col("raw_text") if json_text else None, nested)).alias("text"))
    distinct = F.approx_count_distinct if approx else F.count_distinct
    found = entries.groupBy(snapshot, "column_name").agg(
        F.count(F.lit(1)).alias("present"), F.count_if(F.col("inc")).alias("included"), distinct("text").alias("texts"),
        F.coalesce(F.max(F.col("text") == "undefined"), F.lit(False)).alias("named"))
    rows = records.groupBy(snapshot).agg(F.count(F.lit(1)).alias("row_count"))
    gone = F.col("row_count") - F.col("present") if absent == "undefined" else F.lit(0)
    more = F.when((gone > 0) & ~F.col("named"), 1).otherwise(0)
    out = found.join(rows, snapshot).select(
        snapshot, "column_name", F.col("row_count").cast("long").alias("row_count"),
        (F.col("included") + gone).cast("long").alias("non_null"), (F.col("texts") + more).cast("long").alias("distinct_count"))
    return out.withColumn("null_rate", F.lit(1) - F.col("non_null") / F.col("row_count"))


GAP_BUCKET = 64  # record numbers searched for gaps at a time


def first_gaps(records: DataFrame, k: int = 3, snapshot: str = "snapshot_id") -> DataFrame:
    """(snapshot, column_name, record_number) of the first ``k`` records that
    lack a column. Runs of ``GAP_BUCKET`` record numbers are compared as
    arrays: those of all records against those that have the column. Only
    columns that some record lacks are searched."""
    run = F.floor(F.col("record_number") / GAP_BUCKET).alias("run")
    keys = records.select(snapshot, "record_number", run, F.explode(F.array_distinct(F.json_object_keys("payload"))).alias("column_name"))
    have = keys.groupBy(snapshot, "column_name", "run").agg(F.collect_list("record_number").alias("have"))
    runs = records.groupBy(snapshot, run).agg(F.collect_list("record_number").alias("all"))
    rows = runs.groupBy(snapshot).agg(F.sum(F.size("all")).alias("rows"))
    lacking = (have.groupBy(snapshot, "column_name").agg(F.sum(F.size("have")).alias("n")).join(rows, snapshot)
               .where("n < rows").select(snapshot, "column_name"))
    gaps = runs.join(lacking, snapshot).join(have, [snapshot, "column_name", "run"], "left").select(
        snapshot, "column_name", F.array_sort(F.array_except("all", F.coalesce("have", F.array().cast("array<bigint>")))).alias("gone"))
    some = gaps.select(snapshot, "column_name", F.explode(F.slice("gone", 1, k)).alias("record_number"))
    w = Window.partitionBy(snapshot, "column_name").orderBy("record_number")
    return some.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def sparse_examples(records: DataFrame, k: int = 3, snapshot: str = "snapshot_id", absent: str = "undefined") -> DataFrame:
    """``column_examples`` without dense cells: the first included entries,
    merged with the first gaps of each column."""
    w = Window.partitionBy(snapshot, "column_name").orderBy("record_number")
    inc = present_cells(records, snapshot, with_text=True).where(_included(F.lit(True), F.col("v"), absent))
    first = inc.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).select(
        snapshot, "column_name", "record_number", value_json(F.col("v"), F.col("raw_text")).alias("example_json"))
    if absent == "undefined":
        first = first.unionByName(first_gaps(records, k, snapshot).withColumn("example_json", F.lit("null")))
    return (first.withColumn("example_rank", F.row_number().over(w).cast("long")).where(F.col("example_rank") <= k)
            .select(snapshot, "column_name", "example_rank", "example_json"))


def domain_scores(columns_df: DataFrame, snapshot: str = "snapshot_id") -> DataFrame:
    """Per snapshot, the number of column names matching each domain."""
    aggs = [F.count_if(F.col("column_name").rlike("(?i)" + p)).cast("long").alias(d.lower())
            for d, p in DOMAIN_PATTERNS.items()]
    return columns_df.groupBy(snapshot).agg(*aggs)


def domain_decision(scores: DataFrame) -> DataFrame:
    """The domain with the strictly highest score >= 2; HIGH if >= 3."""
    a, c, s = F.col("article"), F.col("customer"), F.col("supplier")
    top = F.greatest(a, c, s)
    second = (F.when(top == a, F.greatest(c, s)).when(top == c, F.greatest(a, s))
              .otherwise(F.greatest(a, c)))
    winner = F.when(top == a, F.lit("ARTICLE")).when(top == c, F.lit("CUSTOMER")).otherwise(F.lit("SUPPLIER"))
    decided = (top >= 2) & (top > second)
    return scores.select(
        "*", F.when(decided, winner).otherwise(F.lit("UNKNOWN")).alias("domain"),
        F.when(decided & (top >= 3), F.lit("HIGH")).when(decided, F.lit("MEDIUM"))
         .otherwise(F.lit("LOW")).alias("confidence"))


def profile(records: DataFrame, snapshot: str = "snapshot_id") -> dict[str, DataFrame]:
    """All profile parts of a set of snapshots. ``cells`` are dense; reports
    are built from present entries (``sparse_stats``, ``sparse_examples``)."""
    order = column_order(records, snapshot)
    lists = column_lists(order, snapshot)
    cell_df = cells(records, lists, snapshot)
    decision = domain_decision(domain_scores(order, snapshot))
    return {"order": order, "lists": lists, "cells": cell_df, "decision": decision}


def profile_report(records: DataFrame, snapshot: str = "snapshot_id", with_result: bool = False) -> DataFrame:
    """P5: one report row per snapshot.

    Columns: domain, confidence, row_count, column_count, columns (JSON array,
    first-appearance order), candidates (JSON object of scores); with
    ``with_result`` also ``result``: the full report JSON with statistics.
    """
    parts = profile(records, snapshot)
    rows = records.groupBy(snapshot).agg(F.count(F.lit(1)).cast("long").alias("row_count"))
    cand = F.to_json(F.struct(F.col("article").alias("ARTICLE"), F.col("customer").alias("CUSTOMER"),
                              F.col("supplier").alias("SUPPLIER")))
    rep = (rows.join(parts["lists"], snapshot, "left").join(parts["decision"], snapshot, "left")
           .select(snapshot,
                   F.coalesce("domain", F.lit("UNKNOWN")).alias("domain"),
                   F.coalesce("confidence", F.lit("LOW")).alias("confidence"),
                   "row_count",
                   F.coalesce(F.size("columns"), F.lit(0)).cast("long").alias("column_count"),
                   F.to_json(F.coalesce("columns", F.array().cast("array<string>"))).alias("columns"),
                   F.coalesce(cand, F.lit('{"ARTICLE":0,"CUSTOMER":0,"SUPPLIER":0}')).alias("candidates")))
    if not with_result:
        return rep
    stats = sparse_stats(records, snapshot)
    ex = (sparse_examples(records, 3, snapshot).groupBy(snapshot, "column_name")
          .agg(F.array_sort(F.collect_list(F.struct("example_rank", "example_json"))).alias("ex")))
    per_col = stats.join(ex, [snapshot, "column_name"], "left").select(
        snapshot, "column_name",
        F.concat(F.lit('{"non_null":'), F.col("non_null").cast("string"),
                 F.lit(',"null_rate":'), rate_text(F.col("null_rate")),
                 F.lit(',"distinct":'), F.col("distinct_count").cast("string"),
                 F.lit(',"examples":['),
                 F.array_join(F.transform(F.coalesce("ex", F.array()), lambda e: e["example_json"]), ","),
                 F.lit("]}")).alias("stat"))
    stat_obj = per_col.groupBy(snapshot).agg(F.map_from_entries(F.collect_list(F.struct("column_name", "stat"))).alias("sm"))
    result = F.concat(
        F.lit('{"domain":"'), F.col("domain"), F.lit('","confidence":"'), F.col("confidence"),
        F.lit('","row_count":'), F.col("row_count").cast("string"),
        F.lit(',"column_count":'), F.col("column_count").cast("string"),
        F.lit(',"columns":'), F.col("columns"),
        F.lit(',"statistics":{'),
        F.array_join(F.transform(F.from_json(F.col("columns"), "array<string>"),
                                 lambda c: F.concat(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2),
                                                    F.lit(":"), F.col("sm")[c])), ","),
        F.lit('},"candidates":'), F.col("candidates"), F.lit("}"))
    return rep.join(stat_obj, snapshot, "left").withColumn("result", result).drop("sm")
