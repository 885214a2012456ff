"""Normalization rules, payload normalization, profiling semantics, ledger folds."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import rules, text
from quarry.functions.redact import redact_text
from quarry.operators import checks, entity, ledger, profile


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("o")).first().o


def test_text_rules(spark):
    assert one(spark, " \ufeff a b \u3000\n", text.js_trim) == "a b"
    assert one(spark, " a \t\u2003 b  ", text.collapse_whitespace) == "a b"
    assert one(spark, "straße", text.uppercase) == "STRASSE"
    assert one(spark, "Éléphant ﬁ", text.strip_diacritics) == "Elephant fi"
    assert one(spark, " a-01/x ", text.identifier_compact) == "A01X"
    assert one(spark, "  ça  va ", lambda c: rules.chain(c, ["collapse_whitespace", "strip_diacritics", "uppercase"])) == "CA VA"
    with pytest.raises(ValueError, match="Unknown normalization rule: nope"):
        rules.chain(F.col("v"), ["trim", "nope"])


def test_payload_only_strings_change(spark):
    df = spark.createDataFrame([('{"ref":" a-01 ","n":-1.5,"s":"-1.5","z":null,"o":{"x":" y "}}',)], "payload string")
    out = rules.normalize_payload(df, {"ref": ["trim", "uppercase"], "n": ["identifier_compact"],
                                       "s": ["identifier_compact"], "o": ["trim"], "absent": ["trim"]})
    assert json.loads(out.first().normalized_payload) == {"ref": "A-01", "n": -1.5, "s": "15", "z": None, "o": {"x": " y "}}
    assert list(json.loads(out.first().normalized_payload)) == ["ref", "n", "s", "z", "o"]


def test_identity_uses_raw_payload(spark):
    df = spark.createDataFrame([('{"reference":" A-01 ","b":null,"c":1}',)], "payload string")
    got = entity.identity_projection(df, ["reference", "b", "missing"]).first().identity_payload
    assert got == '{"reference":" A-01 ","b":null}'


def test_profile_absent_counts_as_value(spark):
    recs = spark.createDataFrame([
        ("s", 1, '{"sku":"1","client":null}'),
        ("s", 2, '{"sku":1,"client":""}'),
        ("s", 3, '{"client":"x","vat":{"a":1}}'),
        ("s", 4, '{"vat":{"b":2},"sku":"undefined"}'),
    ], "snapshot_id string, record_number long, payload string")
    p = profile.profile(recs)
    assert [r.column_name for r in p["order"].orderBy("position").collect()] == ["sku", "client", "vat"]
    st = {r.column_name: r for r in profile.column_stats(p["cells"]).collect()}
    # sku: "1", 1 (same text), absent (undefined), "undefined" -> 2 distinct, 4 non-null
    assert (st["sku"].non_null, st["sku"].distinct_count) == (4, 2)
    assert (st["client"].non_null, st["client"].distinct_count, st["client"].null_rate) == (2, 2, 0.5)
    assert st["vat"].distinct_count == 2      # undefined + [object Object]
    ex = sorted((r.column_name, r.example_rank, r.example_json) for r in profile.column_examples(p["cells"]).collect())
    assert [e for e in ex if e[0] == "vat"] == [("vat", 1, "null"), ("vat", 2, "null"), ("vat", 3, '{"a":1}')]
    rep = profile.profile_report(recs).first()
    assert (rep.domain, rep.confidence, rep.row_count, rep.column_count) == ("CUSTOMER", "MEDIUM", 4, 3)
    assert rep.candidates == '{"ARTICLE":1,"CUSTOMER":2,"SUPPLIER":0}'


def test_domain_decision(spark):
    cols = spark.createDataFrame([("a", "reference"), ("a", "designation"), ("a", "ean"), ("b", "siren"),
                                  ("b", "siret"), ("c", "client_id"), ("c", "vat_no"), ("c", "sku")],
                                 "snapshot_id string, column_name string")
    d = {r.snapshot_id: (r.domain, r.confidence) for r in profile.domain_decision(profile.domain_scores(cols)).collect()}
    assert d == {"a": ("ARTICLE", "HIGH"), "b": ("UNKNOWN", "LOW"), "c": ("CUSTOMER", "MEDIUM")}


def sequential_steps(rows):
    created, out = [], {}
    for run, seq, sequence, key in sorted(rows, key=lambda r: r[1]):
        hit = [s for s in created if s[0] == run and (s[3] == key or s[2] == sequence)]
        if hit:
            out[seq] = ("EXISTING", min(h[1] for h in hit))
        else:
            created.append((run, seq, sequence, key))
            out[seq] = ("CREATED", seq)
    return out


def test_step_creation_matches_sequential_or_rule(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["r1", "r2"]), seq, rnd.randint(1, 4), rnd.choice(["a", "b", "c", None]))
            for seq in range(120)]
    df = spark.createDataFrame(rows, "run_id string, seq long, sequence long, idempotency_key string")
    got = {r.seq: (r.status, r.step_seq) for r in ledger.create_steps(df).collect()}
    assert got == sequential_steps(rows)


def test_run_creation(spark):
    df = spark.createDataFrame([(1, "t1", "e1", "same-key"), (2, "t1", "e2", "same-key"), (3, "t2", "e1", "k"),
                                (4, "t1", "e4", None), (5, "t2", "e5", "k"), (6, "t2", "e6", "k")],
                               "seq long, tenant_id string, execution_id string, idempotency_key string")
    got = {r.seq: (r.status, r.run_id) for r in ledger.create_runs(df).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["CREATED", "REPLAY", "CONFLICT", "CREATED", "CREATED", "REPLAY"]
    assert got[2][1] == got[1][1] and got[3][1] is None and got[6][1] == got[5][1] != got[1][1]


def test_run_state_fold(spark):
    df = spark.createDataFrame([("r", 1, "RUNNING", "2024-01-01 00:00:00", None),
                                ("r", 2, "RUNNING", "2024-01-02 00:00:00", 10),
                                ("r", 3, "BOGUS", "2024-01-03 00:00:00", None),
                                ("r", 4, "COMPLETED", "2024-01-04 00:00:00", 100)],
                               "run_id string, seq long, status string, ts string, progress int")
    df = df.withColumn("ts", F.to_timestamp("ts"))
    state, bad = ledger.run_state(df)
    s = state.first()
    assert (s.status, str(s.started_at), str(s.finished_at), s.progress, s.transitions) == (
        "COMPLETED", "2024-01-02 00:00:00", "2024-01-04 00:00:00", 100, 3)
    assert bad.count() == 1


def test_config_hash_matches_table_form(spark):
    cfg = {"entity_type": "ARTICLE", "identity_fields": ["reference"]}
    snap = ledger.config_snapshot(cfg, "pv", None)
    df = spark.createDataFrame([("pv", None, json.dumps(cfg, separators=(",", ":")))],
                               "profile_version_id string, rule_version_id string, configuration string")
    r = ledger.config_versions(df).first()
    assert (r.configuration_version, r.configuration_hash) == (snap["configuration_version"], snap["configuration_hash"])
    assert snap["configuration_version"].startswith("cfg-") and len(snap["configuration_version"]) == 20


def test_redaction_and_uuid_shape(spark):
    assert redact_text('{"token":"x","safe":1,"nested":{"PassWord":2,"list":[{"cookie":3}]}}') == \
        '{"token":"[REDACTED]","safe":1,"nested":{"PassWord":"[REDACTED]","list":[{"cookie":"[REDACTED]"}]}}'
    df = spark.createDataFrame([("123e4567-e89b-12d3-a456-426614174000",), ("123E4567-E89B-12D3-A456-426614174000",),
                                ("123e4567-e89b-12d3-a456-42661417400",), ("123e4567-e89b-12d3-a456-42661417400g",)], "v string")
    assert [r.ok for r in df.select(checks.uuid_shape(F.col("v")).alias("ok")).collect()] == [True, True, False, False]


def test_nested_values_keep_member_order(spark):
    df = spark.createDataFrame([(1, '{"b":{"z":1,"a":[2,{"y":3,"c":4}]},"ref":" x ","n":1.5}')],
                               "record_number long, payload string")
    out = rules.normalize_payload(df, {"ref": ["trim"]}).first().normalized_payload
    assert out == '{"b":{"z":1,"a":[2,{"y":3,"c":4}]},"ref":"x","n":1.5}'
    ident = entity.identity_projection(df, ["b"]).first().identity_payload
    assert ident == '{"b":{"z":1,"a":[2,{"y":3,"c":4}]}}'
    recs = df.withColumn("snapshot_id", F.lit("s"))
    p = profile.profile(recs)
    ex = {r.column_name: r.example_json for r in profile.column_examples(p["cells"]).collect()}
    assert ex == {"b": '{"z":1,"a":[2,{"y":3,"c":4}]}', "ref": '" x "', "n": "1.5"}


def test_profile_result_json(spark):
    recs = spark.createDataFrame([("s", 1, '{"reference":"A","ean":null,"designation":"x"}'),
                                  ("s", 2, '{"reference":"B","designation":"x","sku":"1"}')],
                                 "snapshot_id string, record_number long, payload string")
    r = json.loads(profile.profile_report(recs, with_result=True).first().result)
    assert r["domain"] == "ARTICLE" and r["confidence"] == "HIGH"
    assert r["columns"] == ["reference", "ean", "designation", "sku"]
    assert r["statistics"]["ean"] == {"non_null": 1, "null_rate": 0.5, "distinct": 1, "examples": [None]}
    assert r["statistics"]["designation"] == {"non_null": 2, "null_rate": 0.0, "distinct": 1, "examples": ["x", "x"]}
    assert r["candidates"] == {"ARTICLE": 4, "CUSTOMER": 0, "SUPPLIER": 0}
    assert list(r) == ["domain", "confidence", "row_count", "column_count", "columns", "statistics", "candidates"]


def test_rate_text(spark):
    vals = [0.0, 1.0, 0.5, 1 / 3, 2 / 3, 0.0001, 0.25]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.t for r in df.select(profile.rate_text(F.col("x")).alias("t")).collect()]
    assert got == ["0", "1", "0.5", "0.3333333333333333", "0.6666666666666666", "0.0001", "0.25"]


def test_control_characters_escape_like_javascript(spark):
    df = spark.createDataFrame([('{"ref":" a\\u001f\\u000b\\n ","k":"\\u001e"}',)], "payload string")
    out = rules.normalize_payload(df, {"ref": ["trim"]}).first().normalized_payload
    assert out == '{"ref":"a\\u001f","k":"\\u001e"}'   # VT is JS whitespace: trimmed


def test_profile_options(spark):
    recs = spark.createDataFrame([
        ("s", 1, '{"a":{"x":1},"b":"1"}'),
        ("s", 2, '{"a":{"x":2}}'),
        ("s", 3, '{"a":{"x":1},"b":"2"}'),
    ], "snapshot_id string, record_number long, payload string")
    cells = profile.profile(recs)["cells"]
    ref = {r.column_name: (r.non_null, r.distinct_count) for r in profile.column_stats(cells).collect()}
    assert ref == {"a": (3, 1), "b": (3, 3)}           # [object Object]; "1", undefined, "2"
    opt = {r.column_name: (r.non_null, r.distinct_count)
           for r in profile.column_stats(cells, absent="null", nested="json").collect()}
    assert opt == {"a": (3, 2), "b": (2, 2)}
    approx = {r.column_name: r.distinct_count for r in profile.column_stats(cells, approx=True).collect()}
    assert approx == {"a": 1, "b": 3}
    ex = [r.example_json for r in profile.column_examples(cells, absent="null").collect() if r.column_name == "b"]
    assert sorted(ex) == ['"1"', '"2"']


def test_array_values_stringify_like_javascript(spark):
    recs = spark.createDataFrame([
        ("s", 1, '{"a":[1,null,"x,y",[2,[3,4]],{"k":1},true,1.50]}'),
        ("s", 2, '{"a":"1,,x,y,2,3,4,[object Object],true,1.5"}'),
        ("s", 3, '{"a":[]}'),
        ("s", 4, '{"a":""}'),
    ], "snapshot_id string, record_number long, payload string")
    st = profile.column_stats(profile.profile(recs)["cells"]).first()
    # row 1 and row 2 have the same String() text; [] stringifies to "" but is not excluded
    assert (st.non_null, st.distinct_count) == (3, 2)


def test_steps_and_runs_with_history(spark):
    prior = spark.createDataFrame([("r1", 1, "a")], "run_id string, sequence long, idempotency_key string")
    steps = spark.createDataFrame([("r1", 10, 2, "a"), ("r1", 11, 1, "b"), ("r1", 12, 2, "c"), ("r2", 13, 1, "a")],
                                  "run_id string, seq long, sequence long, idempotency_key string")
    got = {r.seq: (r.status, r.step_seq) for r in ledger.create_steps(steps, prior).collect()}
    assert got == {10: ("EXISTING", -1), 11: ("EXISTING", -1), 12: ("CREATED", 12), 13: ("CREATED", 13)}
    reqs = spark.createDataFrame([(1, "t1", "e1", "k-old"), (2, "t1", "e9", None), (3, "t1", "e3", "k-new")],
                                 "seq long, tenant_id string, execution_id string, idempotency_key string")
    jobs = spark.createDataFrame([("t1", "k-old", "run-old")], "tenant_id string, idempotency_key string, run_id string")
    runs = spark.createDataFrame([("e9",)], "execution_id string")
    out = {r.seq: (r.status, r.run_id) for r in ledger.create_runs(reqs, jobs, runs).collect()}
    assert out[1] == ("REPLAY", "run-old") and out[2][0] == "CONFLICT" and out[3][0] == "CREATED"


def test_sparse_profile_as_dense(spark):
    """Ragged records: same statistics and examples as from dense cells, and
    no row count above the present entries."""
    import random

    rnd = random.Random(4)
    values = ["1", 1, None, "", "undefined", {"x": 1}, [1, [2]], 2.5, True, "é", 10**9]
    rows = []
    for s, n in (("s", 400), ("t", 3), ("u", 1), ("v", 150)):
        for i in range(n):
            keys = ["always", "late"] if i > 100 else ["always"]
            keys += [k for k in ("often", "rare") if rnd.random() < (0.9 if k == "often" else 0.02)]
            rows.append((s, i * 2 + 1 if s == "v" else i + 1, json.dumps({k: rnd.choice(values) for k in keys})))
    rows.append(("w", 1, "{}"))
    recs = spark.createDataFrame(rows, "snapshot_id string, record_number long, payload string").repartition(4)
    dense = profile.profile(recs)["cells"]
    for option in ({}, {"absent": "null"}, {"nested": "json"}):
        want = sorted(map(tuple, profile.column_stats(dense, **option).collect()))
        got = profile.sparse_stats(recs, **option)
        assert got.columns == profile.column_stats(dense, **option).columns
        assert sorted(map(tuple, got.collect())) == want, option
    for absent in ("undefined", "null"):
        want = sorted(map(tuple, profile.column_examples(dense, 3, absent=absent).collect()))
        assert sorted(map(tuple, profile.sparse_examples(recs, 3, absent=absent).collect())) == want, absent
    assert profile.present_cells(recs).count() == sum(len(json.loads(p)) for *_, p in rows)
