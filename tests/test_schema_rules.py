"""Our own outputs satisfy the schema's CHECK and UNIQUE constraints, and
the rule runners catch injected defects."""

from pyspark.sql import functions as F

from quarry.operators import schema_rules as sr
from quarry.plans import catalog as c
from quarry.plans import fixtures as fx
from quarry.plans.pipeline import ingest_and_process

SF = "/root/testdata/sf0.001"


def test_pipeline_outputs_satisfy_schema(spark):
    src = spark.createDataFrame([(f"t{i}", "orders") for i in range(4)], "tenant_id string, id string")
    out = ingest_and_process(c._csv_uploads(spark, SF), src, c.FILE_CONFIG)
    tables = {"source_files": (out["source_files"], "id"), "artifacts": (out["artifacts"], "id"),
              "raw_snapshots": (out["snapshots"].withColumnRenamed("snapshot_id", "id"), "id"),
              "raw_records": (out["records"], "record_number"),
              "entities": (out["entities"], "entity_id"), "runs": (out["runs"], "run_id")}
    for name, (df, key) in tables.items():
        assert sr.check_table(df, name, key, skip_missing=True).count() == 0, name
        u = sr.unique_table(df, name, skip_missing=True)
        assert u is None or u.count() == 0, name


def test_rules_catch_defects(spark):
    m = fx.memberships(spark, SF)
    assert sr.unique_table(m.unionByName(m.limit(1)), "memberships").count() == 1
    bad = spark.createDataFrame([("x", -1, "z" * 64, "NOPE")], "id string, size_bytes long, checksum_sha256 string, status string")
    rules = sorted(r.rule for r in sr.check_table(bad, "source_files", skip_missing=True).collect())
    assert rules == ["checksum_sha256", "size_bytes", "status"]
    t = fx.tenants(spark, SF)
    assert sr.check_table(t, "tenants", skip_missing=True).filter(F.col("rule") == "slug_format").count() == 0


def test_a_missing_column_is_an_error(spark):
    import pytest

    with pytest.raises(ValueError, match="lacks the columns"):
        sr.check_table(spark.range(1), "source_files")
    with pytest.raises(ValueError, match="lacks the columns"):
        sr.unique_table(spark.range(1), "source_files")
    assert sr.unique_table(spark.range(1), "source_files", skip_missing=True) is None


def test_permission_rules(spark):
    rows = [("1", "files", "read", "ACTIVE"), ("2", "files", "read", "OLD"), ("3", " ", "read", "ACTIVE"), ("4", "files", "", "ACTIVE")]
    df = spark.createDataFrame(rows, "id string, resource string, action string, status string")
    got = {r["rule"]: r["violations"] for r in sr.rule_counts(df, "permissions").collect()}
    assert got == {"status": 1, "resource_nonempty": 1, "action_nonempty": 1}
    assert [(r["key"], r["n"]) for r in sr.unique_table(df, "permissions").collect()] == [('{"resource":"files","action":"read"}', 2)]
