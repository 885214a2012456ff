"""RAW snapshot operators on literal rows."""

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import raw


def test_versions_headers_limits_and_order(spark):
    batch = spark.createDataFrame([("f1", 5), ("f1", 3), ("f2", 4)], "source_file_id string, seq long")
    prior = spark.createDataFrame([("f1",), ("f1",)], "source_file_id string")
    v = {(r.source_file_id, r.seq): r.snapshot_version for r in raw.snapshot_versions(batch, prior).collect()}
    assert v == {("f1", 3): 3, ("f1", 5): 4, ("f2", 4): 1}

    recs = spark.createDataFrame([("s1", "t", 2, '{"b":1,"a":2}'), ("s1", "t", 1, '{"a":1}'), ("s2", "t", 1, "{}")],
                                 "snapshot_id string, tenant_id string, record_number long, payload string")
    heads = {r.snapshot_id: (r.record_count, r.schema_hash) for r in raw.build_snapshots(recs).collect()}
    assert heads["s1"] == (2, hashlib.sha256(b'["a","b"]').hexdigest())
    assert heads["s2"] == (1, hashlib.sha256(b"[]").hexdigest())

    kept, verdicts = raw.record_limit(recs, 1)
    assert sorted((r.snapshot_id, r.status) for r in verdicts.collect()) == [("s1", "REJECTED"), ("s2", "ACCEPTED")]
    assert {r.snapshot_id for r in kept.collect()} == {"s2"}
    kept_all, _ = raw.record_limit(recs, None)
    assert kept_all.count() == 3

    assert [r.record_number for r in raw.ordered_records(recs, "t", "s1").collect()] == [1, 2]
    assert raw.ordered_records(recs, "other", "s1").count() == 0

    snaps = spark.createDataFrame([("t", "f1", 1, "a"), ("t", "f1", 3, "c"), ("t", "f1", 2, "b")],
                                  "tenant_id string, source_file_id string, snapshot_version long, snapshot_id string")
    assert [r.snapshot_id for r in raw.latest_snapshot(snaps).collect()] == ["c"]


def test_versions_of_a_hot_file_spread_over_tasks(spark):
    """Landing sequences are wide decimals far apart; one file has all rows."""
    batch = spark.range(0, 20_000, 1, 8).selectExpr(
        "'hot' AS source_file_id", "cast(cast(id * 977 % 20011 AS decimal(17,0)) * 18446744073709551616BD + 5 AS decimal(38,0)) AS seq")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would merge partitions as small as these
    try:
        got = raw.snapshot_versions(batch)
        tasks = got.groupBy(F.spark_partition_id().alias("t")).count().collect()
        wrong = got.join(batch.select("seq", F.row_number().over(Window.orderBy("seq")).alias("want")), "seq").where("snapshot_version != want")
        assert got.count() == 20_000 and wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(tasks) > 4 and max(t["count"] for t in tasks) < 10_000
