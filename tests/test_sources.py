"""Landing folder reader, tenant-partitioned tables, trusted CSV lane."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from quarry.operators import intake
from quarry.sources import delimited, files, workbook
from quarry.sources.dispatch import parse_files, split_parsed


def _write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_landing_folder_to_records(spark):
    root = tempfile.mkdtemp(prefix="quarry-landing-")
    _write(f"{root}/t1/s1/a.csv", b"reference,designation\nA-01,Produit\n")
    _write(f"{root}/t1/s1/b.xlsx", workbook.build_workbook(["reference"], [["X-9"]]))
    _write(f"{root}/t2/s9/c.json", b'[{"id":1},{"id":2}]')
    up = files.read_landing(spark, root)
    assert sorted((r.tenant_id, r.source_id, r.filename) for r in up.collect()) == [
        ("t1", "s1", "a.csv"), ("t1", "s1", "b.xlsx"), ("t2", "s9", "c.json")]
    src = spark.createDataFrame([("t1", "s1"), ("t2", "s9")], "tenant_id string, id string")
    res = intake.resolve_uploads(up, src)
    assert {r.status for r in res.collect()} == {"NEW"}
    recs, errs = split_parsed(parse_files(up.withColumn("file_id", F.col("path")), "file_id", "filename", "content"))
    got = sorted(json.loads(r.payload).get("reference") or str(json.loads(r.payload)["id"]) for r in recs.collect())
    assert got == ["1", "2", "A-01", "X-9"] and errs.count() == 0


def test_tenant_partitioned_table(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-table-"), "entities")
    df = spark.createDataFrame([("t1", "e1"), ("t2", "e2"), ("t1", "e3")], "tenant_id string, id string")
    files.append_table(df, path)
    files.append_table(df.limit(1), path)
    one = files.read_table(spark, path, "t1")
    assert sorted(r.id for r in one.collect()) == ["e1", "e1", "e3"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan


def test_trusted_csv_lane(spark):
    root = tempfile.mkdtemp(prefix="quarry-trusted-")
    _write(f"{root}/big.csv", b'ref,name\nA-1,"x, y"\nA-2,"say ""hi"""\n')
    rows = sorted(json.loads(r.payload)["name"] for r in delimited.read_trusted(spark, root).collect())
    assert rows == ['say "hi"', "x, y"]


def test_landing_folder_through_the_whole_chain(spark):
    from quarry.plans.pipeline import ingest_and_process

    root = tempfile.mkdtemp(prefix="quarry-landing-e2e-")
    _write(f"{root}/t1/s1/articles.csv", b"reference,designation\n A-01 ,Produit  Un\n")
    _write(f"{root}/t1/s1/more.xlsx", workbook.build_workbook(["reference", "designation"], [["B-02", "Autre"]]))
    _write(f"{root}/t1/s1/copy.csv", b"reference,designation\n A-01 ,Produit  Un\n")   # same bytes
    _write(f"{root}/t1/s1/run.exe", b"MZ")
    up = files.read_landing(spark, root)
    src = spark.createDataFrame([("t1", "s1")], "tenant_id string, id string")
    cfg = {"entity_type": "ARTICLE", "identity_fields": ["reference"],
           "field_rules": {"reference": ["trim"], "designation": ["collapse_whitespace"]}}
    out = ingest_and_process(up, src, cfg)
    status = sorted((r.clean_filename, r.status) for r in out["resolved"].collect())
    assert status[-1] == ("run.exe", "REJECTED")
    assert sorted(s for _, s in status[:3]) == ["DUPLICATE", "NEW", "NEW"]
    refs = sorted(json.loads(r.normalized_payload)["reference"] for r in out["entities"].collect())
    assert refs == ["A-01", "B-02"]


def test_landing_glob_filter(spark):
    root = tempfile.mkdtemp(prefix="quarry-landing-glob-")
    _write(f"{root}/t1/s1/a.csv", b"x\n1\n")
    _write(f"{root}/t1/s1/notes.txt", b"skip me")
    names = sorted(r.filename for r in files.read_landing(spark, root, glob=files.ACCEPTED_GLOB).collect())
    assert names == ["a.csv"]
    assert files.read_landing(spark, root).count() == 2
