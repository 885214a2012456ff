"""Run creation and intake history against sequential models, text details."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.functions import redact, rules
from quarry.operators import intake, ledger, profile
from quarry.plans import fixtures as fx


def sequential_runs(rows, jobs=(), taken=()):
    """One request at a time: the rules of run creation, with CONFLICT."""
    run_of = {(t, k): r for t, k, r in jobs}
    ids, out = set(taken), {}
    for seq, tenant, ex, key in sorted(rows):
        key = key if key is not None else f"{tenant}:{ex}"
        if (tenant, key) in run_of:
            if run_of[tenant, key] is not None:
                out[seq] = ("REPLAY", run_of[tenant, key])
                continue
        elif ex in ids:
            run_of[tenant, key] = None
            out[seq] = ("CONFLICT", None)
            continue
        run_of[tenant, key] = f"new {tenant} {key}"
        ids.add(ex)
        out[seq] = ("CREATED", run_of[tenant, key])
    return out


def compare(spark, rows, jobs=(), taken=()):
    df = spark.createDataFrame(rows, "seq long, tenant_id string, execution_id string, idempotency_key string")
    j = spark.createDataFrame(list(jobs), "tenant_id string, idempotency_key string, run_id string")
    r = spark.createDataFrame([(x,) for x in taken], "execution_id string")
    got = ledger.create_runs(df, j, r).collect()
    want = sequential_runs(rows, jobs, taken)
    assert {x.seq: x.status for x in got} == {s: v[0] for s, v in want.items()}
    ids = {}
    for x in got:  # one run id per run, none shared
        run = want[x.seq][1]
        assert (x.run_id is None) == (run is None)
        if run is not None:
            assert ids.setdefault(run, x.run_id) == x.run_id
            assert run.startswith("new") or x.run_id == run
    assert len(set(ids.values())) == len(ids)


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_the_sequential_model(spark, seed):
    rng = random.Random(seed)
    n = [3, 6, 12, 40][seed]
    rows = [(s, rng.choice("ab"), f"e{rng.randrange(n)}", rng.choice([f"k{rng.randrange(n)}", None])) for s in range(150)]
    jobs = [("a", "k0", "old"), ("b", "k1", None), ("a", "k2", None)]
    compare(spark, rows, jobs[:seed], ["e0", "zz"][:seed])


def test_chains_of_late_runs(spark):
    # each late run takes the id that the next opener needs
    rows = [(0, "t", "e0", "k0")]
    for i in range(8):
        rows += [(3 * i + 1, "t", f"e{i}", f"a{i}"), (3 * i + 2, "t", f"e{i + 1}", f"a{i}")]
    compare(spark, rows)
    compare(spark, [(1, "t", "A", "k1"), (2, "t", "A", "k2")], jobs=[("t", "k1", "old")])


def test_orders_equal_the_sequential_model(spark):
    df = fx.ledger(spark, "/root/testdata/sf0.01")
    rows = [(r.seq, r.tenant_id, r.execution_id, r.idempotency_key) for r in df.collect()]
    want = sequential_runs(rows)
    got = {r.seq: r.status for r in ledger.create_runs(df).collect()}
    assert got == {s: v[0] for s, v in want.items()}


def test_steps_and_transitions_of_other_tenants(spark):
    runs = spark.createDataFrame([("r1", "t1"), ("r2", "t2")], "run_id string, tenant_id string")
    steps = spark.createDataFrame([("r1", "t1", 1), ("r2", "t1", 2), ("r9", "t1", 3)], "run_id string, tenant_id string, seq long")
    ok, bad = ledger.steps_of_tenant(steps, runs)
    assert [r.seq for r in ok.collect()] == [1]
    assert sorted((r.seq, r.reason) for r in bad.collect()) == [(2, "Run not found"), (3, "Run not found")]
    t = spark.createDataFrame([("r1", "t1", 1, "RUNNING", 5, "w1"), ("r1", "t2", 2, "FAILED", 9, "x"), ("r1", "t1", 3, "COMPLETED", None, None)],
                              "run_id string, tenant_id string, seq long, status string, progress int, worker string")
    state, bad = ledger.run_state(t.withColumn("ts", F.current_timestamp()), runs)
    s = state.first()
    assert (s.status, s.progress, s.worker, s.transitions) == ("COMPLETED", 5, "w1", 2)
    assert [(r.seq, r.reason) for r in bad.collect()] == [(2, "Run not found")]


UPLOAD = "seq {}, tenant_id string, source_id string, filename string, mime_type string, content string, idempotency_key string"


@pytest.mark.parametrize("kind", ["long", "decimal(38,0)"])
def test_history_comes_first_whatever_the_order_values(spark, kind):
    import hashlib
    from decimal import Decimal

    num = int if kind == "long" else Decimal
    ups = spark.createDataFrame([(num(s), "t", "s", "a.csv", "text/csv", c, k) for s, c, k in
                                 [(-5, "x", None), (7, "x", None), (-9, "new", "old-key"), (3, "fresh", "k"), (-2, "fresh", None), (4, "z", "k")]],
                                UPLOAD.format(kind))
    src = spark.createDataFrame([("t", "s")], "tenant_id string, id string")
    files = spark.createDataFrame([("t", hashlib.sha256(b"x").hexdigest(), "f1")], "tenant_id string, checksum_sha256 string, file_id string")
    keys = spark.createDataFrame([("t", "old-key", "f0", False)], "tenant_id string, idempotency_key string, file_id string, duplicate boolean")
    got = {int(r.seq): (r.status, r.file_id) for r in intake.resolve_uploads(ups, src, files, keys).collect()}
    assert {s: v[0] for s, v in got.items()} == {-5: "DUPLICATE", 7: "DUPLICATE", -9: "REPLAY", 3: "DUPLICATE", -2: "NEW", 4: "REPLAY"}
    assert got[-9][1] == "f0" and got[4][1] == got[3][1] == got[-2][1]


def test_unreadable_history_is_an_error(spark):
    from quarry.streaming.intake_stream import _read_prior

    root = tempfile.mkdtemp(prefix="quarry-prior-")
    assert _read_prior(spark, f"{root}/none", 3) is None
    os.makedirs(f"{root}/t/batch_id=1")
    with open(f"{root}/t/batch_id=1/part-0.parquet", "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):  # noqa: B017
        _read_prior(spark, f"{root}/t", 3).count()


def test_number_and_string_text(spark):
    values = ["12345678.5", "1e-7", "1e+21", "1.5e20", "123456789012345680000", "0.0001", "-2.5e-9", "1e300", "0.1"]
    rows = [(json.dumps({"a": 1})[:-1] + f',"n":{v}}}',) for v in values]
    df = spark.createDataFrame(rows, "payload string")
    out = [json.loads(r.p)["n"] for r in rules.normalize_payload(df, {"x": ["trim"]}, out="p").select("p").collect()]
    assert out == [json.loads(v) for v in values]
    text = [r.p.split('"n":')[1][:-1] for r in rules.normalize_payload(df, {"x": ["trim"]}, out="p").select("p").collect()]
    assert text[:3] == ["12345678.5", "1e-7", "1e+21"] and text[3] == "150000000000000000000" and text[6] == "-2.5e-9"
    odd = {"a\u2028b": 1, "c\u0085": "x\u001f", "d": "C:\\u001F"}
    one = spark.createDataFrame([(json.dumps(odd, ensure_ascii=False),)], "payload string")
    got = rules.normalize_payload(one, {"zz": ["trim"]}, out="p").first().p
    assert json.loads(got) == odd and "\\u001f" in got and "\\\\u001F" in got


def test_rate_text(spark):
    rates = [0.0, 1.0, 0.5, 1 - 999 / 1000, 1 - 99999 / 100000, 1e-7, 2 / 3]
    df = spark.createDataFrame([(r,) for r in rates], "x double").select(profile.rate_text(F.col("x")).alias("t"))
    assert [r.t for r in df.collect()] == ["0", "1", "0.5", "0.0010000000000000009", "0.00000999999999995449", "1e-7", "0.6666666666666666"]


def test_a_bad_line_is_a_row(spark):
    df = spark.createDataFrame([('{"token":"x","a":[{"Password":1}]}',), ('{"token":',), (None,)], "j string")
    got = df.select(redact.redact_json("j").alias("r"), redact.redact_error("j").alias("e")).collect()
    assert [(r.r, r.e) for r in got] == [('{"token":"[REDACTED]","a":[{"Password":"[REDACTED]"}]}', None), (None, "Malformed JSON"), (None, None)]


def test_a_long_chain_of_failures_takes_few_rounds(spark, monkeypatch):
    """Pointer jumping: 5000 ids that fail one after another."""
    rounds = []
    real = ledger.materialize
    monkeypatch.setattr(ledger, "materialize", lambda df: rounds.append(1) or real(df))
    n = 5000
    links = spark.range(n).selectExpr("concat('e', id) AS a_exec", "concat('e', id + 1) AS b_exec")
    links = links.unionByName(spark.range(50).selectExpr("concat('x', id) AS a_exec", "concat('x', id + 1) AS b_exec"))
    failed = spark.createDataFrame([("e0",), ("x30",)], "execution_id string")
    got = {r[0] for r in ledger._spread(failed, links).collect()}
    assert got == {f"e{i}" for i in range(n + 1)} | {f"x{i}" for i in range(30, 51)}
    assert len(rounds) <= 2 + 2 * 14
