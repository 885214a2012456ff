"""End-to-end chain on the reference's own integration example: an articles
CSV, rules reference: trim+uppercase, designation: collapse_whitespace,
identity on reference; plus duplicate and tenant cases."""

import json

from pyspark.sql import functions as F

from quarry.operators import entity
from quarry.plans.pipeline import ingest_and_process

SCHEMA = ("seq long, tenant_id string, source_id string, filename string, mime_type string, "
          "content string, idempotency_key string")
CONFIG = {"entity_type": "ARTICLE", "identity_fields": ["reference"],
          "field_rules": {"reference": ["trim", "uppercase"], "designation": ["collapse_whitespace"]}}


def test_articles_chain(spark):
    csv = "reference,designation\n A-01 , Produit  Un\nA-02,Produit Deux\n"
    up = spark.createDataFrame([
        (1, "t1", "s1", "articles.csv", "text/csv", csv, None),
        (2, "t1", "s1", "again.csv", "text/csv", csv, None),          # same bytes, same tenant: duplicate
        (3, "t2", "s2", "articles.csv", "text/csv", csv, None),       # same bytes, other tenant: new
        (4, "t1", "s1", "bad.json", "application/json", "{oops", None),
    ], SCHEMA)
    src = spark.createDataFrame([("t1", "s1"), ("t2", "s2")], "tenant_id string, id string")
    out = ingest_and_process(up, src, CONFIG)
    status = {r.seq: r.status for r in out["resolved"].collect()}
    assert status == {1: "NEW", 2: "DUPLICATE", 3: "NEW", 4: "NEW"}
    ents = out["entities"].filter(F.col("tenant_id") == "t1").orderBy("source_record_id").collect()
    assert len(ents) == 2
    norm = sorted(json.loads(e.normalized_payload)["reference"] for e in ents)
    ident = sorted(json.loads(e.identity_payload)["reference"] for e in ents)
    assert norm == ["A-01", "A-02"] and ident == [" A-01 ", "A-02"]
    assert {json.loads(e.normalized_payload)["designation"] for e in ents} == {"Produit Un", "Produit Deux"}
    assert {e.entity_type for e in ents} == {"ARTICLE"}
    runs = {r.tenant_id: (r.raw_records, r.entities, r.profiling_domain) for r in out["runs"].collect()}
    assert runs == {"t1": (2, 2, "ARTICLE"), "t2": (2, 2, "ARTICLE")}
    q = out["quarantine"].collect()
    assert len(q) == 1 and q[0].reason.startswith("Invalid JSON")
    # lineage walk loses no row
    recs = out["records"].withColumn("id", entity.record_id(F.col("snapshot_id"), F.col("record_number")))
    snaps = out["snapshots"].select(F.col("snapshot_id").alias("id"), "tenant_id", "source_file_id")
    files = out["source_files"].select("id", "tenant_id", "source_id")
    sources = src.select("id", "tenant_id")
    lin = {r.tenant_id: (r.entities, r.records, r.files) for r in
           entity.lineage(out["entities"], recs, snaps, files, sources).collect()}
    assert lin == {"t1": (2, 2, 1), "t2": (2, 2, 1)}


def test_same_file_two_snapshots(spark):
    from quarry.plans.pipeline import snapshot_files

    files = spark.createDataFrame([
        (10, "f1", "t1", "s1", "a.json", b'{"a":1}'),
        (11, "f1", "t1", "s1", "a.json", b'{"a":2}'),
        (12, "f2", "t1", "s1", "b.csv", b'x\n"open'),
    ], "seq long, source_file_id string, tenant_id string, source_id string, filename string, content binary")
    prior = spark.createDataFrame([("f9",)], "source_file_id string")
    registered = spark.createDataFrame([("f1", "t1"), ("f2", "t1")], "id string, tenant_id string")
    out = snapshot_files(files.unionByName(files.limit(1).selectExpr(
        "13 as seq", "'f1' as source_file_id", "'t2' as tenant_id", "source_id", "filename", "content")),
        prior, registered=registered)
    heads = sorted((r.source_file_id, r.snapshot_version, r.record_count, r.status) for r in out["snapshots"].collect())
    assert heads == [("f1", 1, 1, "COMPLETE"), ("f1", 2, 1, "COMPLETE")]
    recs = sorted((r.snapshot_version, r.payload) for r in out["records"].collect())
    assert recs == [(1, '{"a":1}'), (2, '{"a":2}')]
    q = sorted((r.source_file_id, r.tenant_id, r.reason) for r in out["quarantine"].collect())
    assert q == [("f1", "t2", "Source file not found"), ("f2", "t1", "Unclosed quoted field")]


def test_profiling_result_rows(spark):
    csv = "reference,designation,ean\nA-01,Produit,\nA-02,Autre,123\n"
    up = spark.createDataFrame([(1, "t1", "s1", "a.csv", "text/csv", csv, None)], SCHEMA)
    src = spark.createDataFrame([("t1", "s1")], "tenant_id string, id string")
    out = ingest_and_process(up, src, CONFIG)
    from quarry.plans.pipeline import profiling_results

    r = profiling_results(out).collect()
    assert len(r) == 1 and r[0].domain == "ARTICLE" and r[0].confidence == "HIGH"
    res = json.loads(r[0].result)
    assert res["statistics"]["ean"] == {"non_null": 1, "null_rate": 0.5, "distinct": 1, "examples": ["123"]}
    run = out["runs"].first()
    assert r[0].run_id == run.run_id and (r[0].row_count, r[0].column_count) == (2, 3)


def test_file_without_records_still_gets_snapshot_and_run(spark):
    up = spark.createDataFrame([(1, "t1", "s1", "empty.csv", "text/csv", "reference,designation\n", None),
                                (2, "t1", "s1", "one.csv", "text/csv", "reference\nA-1\n", None)], SCHEMA)
    src = spark.createDataFrame([("t1", "s1")], "tenant_id string, id string")
    out = ingest_and_process(up, src, CONFIG)
    heads = sorted((r.record_count, r.status) for r in out["snapshots"].collect())
    assert heads == [(0, "COMPLETE"), (1, "COMPLETE")]
    runs = sorted((r.raw_records, r.entities, r.profiling_domain, r.confidence) for r in out["runs"].collect())
    assert runs[0] == (0, 0, "UNKNOWN", "LOW") and runs[1][:2] == (1, 1)
