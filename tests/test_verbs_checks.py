"""Skew-aware helpers, table verbs, integrity checks and tenant reads."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.grouping import first_by, row_number_by
from quarry.operators import checks, tables, tenancy


def test_row_number_by_matches_window_on_a_hot_key(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 9)}", i * 7 + rnd.randint(0, 6)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long")
    got = {(r.k, r.o): r.rn for r in row_number_by(df, ["k"], "o", "rn", width=64).collect()}
    want = {(r.k, r.o): r.rn for r in df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o"))).collect()}
    assert got == want


def test_first_by(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o long, v string")
    assert sorted(tuple(r) for r in first_by(df, ["k"], "o").collect()) == [("a", 1, "y"), ("b", 5, "z")]
    assert sorted(tuple(r) for r in first_by(df, ["k"], "o", descending=True).collect()) == [("a", 2, "x"), ("b", 5, "z")]


def test_upsert_patch_insert_ignore(spark):
    t = spark.createDataFrame([(1, "a", 1.0, 0), (2, "b", 2.0, 0)], "id long, name string, bal double, write_seq long")
    new = spark.createDataFrame([(2, "B", 3.0, 1), (3, "c", 4.0, 1)], "id long, name string, bal double, write_seq long")
    assert sorted((r.id, r.name) for r in tables.upsert(t, new).collect()) == [(1, "a"), (2, "B"), (3, "c")]
    patches = spark.createDataFrame([(1, 1, '{"name":"A","bal":null}'), (1, 2, '{"name":"AA"}'), (9, 1, '{"name":"x"}')],
                                    "id long, seq int, patch string")
    patched, errors = tables.patch(t.drop("write_seq"), patches)
    assert sorted((r.id, r.name, r.bal, r.patched) for r in patched.collect()) == [(1, "AA", None, True), (2, "b", 2.0, False)]
    assert [r.id for r in errors.collect()] == [9]
    odd = spark.createDataFrame([(1, 1, '{"name":"A","nick":"x"}'), (2, 1, '{"name":'), (2, 2, None), (2, 3, '[1]')],
                                "id long, seq int, patch string")
    patched, errors = tables.patch(t.drop("write_seq"), odd)
    assert sorted((r.id, r.name) for r in patched.collect()) == [(1, "A"), (2, "b")]
    assert sorted((r.id, r.error) for r in errors.collect()) == [(1, "Unknown field: nick")] + [(2, "Malformed patch")] * 3
    late = spark.createDataFrame([(2, "old", 0.0, -1), (3, "c", 1.0, 7), (3, "d", 1.0, 8)], "id long, name string, bal double, write_seq long")
    assert sorted((r.id, r.name) for r in tables.upsert(t, late).collect()) == [(1, "a"), (2, "b"), (3, "d")]
    inc = spark.createDataFrame([(2, "dup", 0.0, 5, 1), (4, "d1", 0.0, 5, 2), (4, "d2", 0.0, 5, 1)],
                                "id long, name string, bal double, write_seq long, seq int")
    out = tables.insert_ignore(t, inc, ["id"])
    assert sorted((r.id, r.name) for r in out.collect()) == [(1, "a"), (2, "b"), (4, "d2")]


def test_checks(spark):
    df = spark.createDataFrame([(1, "ACTIVE", "ok-slug", "x"), (2, "BOGUS", "Bad Slug", " "), (3, None, None, "y")],
                               "id long, status string, slug string, name string")
    rules = {"status": F.col("status").isin(*checks.SOURCE_STATUS), "slug": F.col("slug").rlike(checks.SLUG_SHAPE),
             "name": checks.non_blank(F.col("name"))}
    got = sorted((r.key, r.rule) for r in checks.check_rules(df, "t", "id", rules).collect())
    assert got == [("2", "name"), ("2", "slug"), ("2", "status")]       # nulls pass, as in SQL CHECK
    u = spark.createDataFrame([("t", "u"), ("t", "u"), ("t", None), ("t", None)], "tenant_id string, user_id string")
    assert [(r.user_id, r.n) for r in checks.unique_violations(u, ["tenant_id", "user_id"]).collect()] == [("u", 2)]
    child = spark.createDataFrame([(1, "t1", "p1"), (2, "t2", "p1"), (3, "t1", None)], "id long, tenant_id string, fk string")
    parent = spark.createDataFrame([("p1", "t1")], "id string, tenant_id string")
    assert [r.id for r in checks.tenant_fk(child, parent, "fk").collect()] == [2]


def test_tenancy(spark):
    m = spark.createDataFrame([("m1", "u1", "t1", "r0", "ACTIVE"), ("m2", "u1", "t2", "r1", "SUSPENDED"),
                               ("m3", "u2", "t2", "r1", "ACTIVE")], "id string, user_id string, tenant_id string, role_id string, status string")
    req = spark.createDataFrame([(1, "u1", "t1"), (2, "u1", "t2"), (3, "u2", "t2")], "request_id long, user_id string, tenant_id string")
    ok, denied = tenancy.active_gate(req, m)
    assert sorted(r.request_id for r in ok.collect()) == [1, 3] and [r.request_id for r in denied.collect()] == [2]
    bases = spark.createDataFrame([("b1", "t1", "B1", "ACTIVE"), ("b2", "t2", "B2", "ACTIVE")], "id string, tenant_id string, name string, status string")
    lists = tenancy.org_lists("u1", m, bases, bases.limit(0), bases.limit(0))
    assert [r.id for r in lists.collect()] == ["b1"]
    assert tenancy.scoped_get(bases, "t1", "id", "b2").count() == 0


def test_hot_key_is_spread_over_tasks(spark):
    n = 60_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 97).cast("string")).alias("k"),
        F.col("id").alias("o"))
    out = row_number_by(df, ["k"], "o", "rn", width=1024).withColumn("pid", F.spark_partition_id())
    hot = out.filter(F.col("k") == "hot")
    assert hot.select("pid").distinct().count() > 1            # not one task for the hot key
    stats = hot.agg(F.min("rn").alias("lo"), F.max("rn").alias("hi"), F.count_distinct("rn").alias("d")).first()
    assert (stats.lo, stats.hi, stats.d) == (1, n // 3, n // 3)


def test_run_steps_and_membership_context(spark):
    runs = spark.createDataFrame([("r1", "t1"), ("r2", "t2")], "run_id string, tenant_id string")
    steps = spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 1)], "run_id string, sequence long")
    assert sorted(r.sequence for r in tenancy.run_steps(runs, steps, "t1", "r1").collect()) == [1, 2]
    assert tenancy.run_steps(runs, steps, "t1", "r2").count() == 0          # other tenant's run: not found
    m = spark.createDataFrame([("m1", "u1", "t1", "r0", "ACTIVE"), ("m2", "u1", "tX", "rX", "INVITED")],
                              "id string, user_id string, tenant_id string, role_id string, status string")
    tenants = spark.createDataFrame([("t1", "One", "one", "ACTIVE")], "id string, name string, slug string, status string")
    roles = spark.createDataFrame([("r0", "OWNER", "Owner")], "id string, code string, name string")
    ctx = {r.tenant_id: (r.tenant_name, r.role_code, r.status) for r in tenancy.membership_context(m, tenants, roles).collect()}
    assert ctx == {"t1": ("One", "OWNER", "ACTIVE"), "tX": (None, None, "INVITED")}


def test_materialize_and_checkpoint_dir(spark):
    from quarry.functions.grouping import materialize
    from quarry.session import ensure_checkpoint_dir

    current = spark.sparkContext.getCheckpointDir()
    assert current and ensure_checkpoint_dir(spark, fallback="/nonexistent/elsewhere") == current
    df = spark.range(100).withColumn("k", F.col("id") % 7)
    cut = materialize(df.groupBy("k").count())
    assert "ExistingRDD" in cut._jdf.queryExecution().executedPlan().toString()     # lineage cut
    small = materialize(df.filter("k = 1"), small=True)
    assert small.is_cached and small.count() == 15
