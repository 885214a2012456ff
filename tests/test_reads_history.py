"""Reads of many callers (T5) and batches that see the history of earlier ones."""

from quarry.operators import intake, tenancy

MEMBERS = [("m1", "ann", "t1", "ACTIVE"), ("m2", "ann", "t2", "SUSPENDED"), ("m3", "bob", "t2", "ACTIVE"), ("m4", "ann", "t1", "ACTIVE")]
ITEMS = [("sources", "t1", "s1", "{}"), ("sources", "t1", "s2", "{}"), ("sources", "t2", "s1", "{}"),
         ("runs", "t2", "r1", '{"n":1}'), ("raw", "t1", "r1", '{"n":2}')]


def test_requests_are_answered_within_their_tenant(spark):
    m = spark.createDataFrame(MEMBERS, "id string, user_id string, tenant_id string, status string")
    items = spark.createDataFrame(ITEMS, "kind string, tenant_id string, id string, body string")
    asked = [(1, "ann", "t1", "sources", None), (2, "ann", "t2", "sources", None), (3, "ann", None, "sources", None),
             (4, "bob", "t2", "runs", "r1"), (5, "ann", "t1", "runs", "r1"), (6, "ann", "t1", "raw", "r1"), (7, "ann", None, "runs", "r1"),
             (8, "bob", "t2", "source-files", None), (9, "ann", "t1", "other", "r1"), (10, None, None, None, None), (11, "bob", "t2", "runs", None)]
    r = spark.createDataFrame(asked, "request_id long, user_id string, tenant_id string, kind string, id string")
    got = {x["request_id"]: (x["status"], x["n_items"], x["body"]) for x in tenancy.read_requests(r, m, items).collect()}
    no = "TENANT_ACCESS_ERROR"
    assert got == {1: ("OK", 2, None), 2: (no, 0, None), 3: ("VALIDATION_ERROR", 0, None), 4: ("OK", 1, '{"n":1}'),
                   5: ("NOT_FOUND", 0, None), 6: ("OK", 1, '{"n":2}'), 7: (no, 0, None), 8: ("OK", 0, None),
                   9: ("NOT_FOUND", 0, None), 10: (no, 0, None), 11: ("NOT_FOUND", 0, None)}
    assert tenancy.read_requests(r.where("request_id < 0"), m, items).count() == 0


def test_later_batches_see_earlier_ones(spark):
    src = spark.createDataFrame([("t", "s")], "tenant_id string, id string")
    cols = "seq long, tenant_id string, source_id string, filename string, mime_type string, content string, idempotency_key string"
    up = lambda *rows: spark.createDataFrame([(i, "t", "s", f"{i}.csv", "text/csv", c, k) for i, c, k in rows], cols)
    one, two, three = intake.resolve_in_turn(
        [up((1, "a", "k1"), (2, "b", None)), up((1, "a", None), (2, "c", "k1"), (3, "c", "k2")), up((1, "c", None), (2, "x", "k2"))], src)
    told = lambda df: {r["seq"]: (r["status"], r["duplicate"], r["idempotent_replay"]) for r in df.collect()}
    assert told(one) == {1: ("NEW", False, False), 2: ("NEW", False, False)}
    assert told(two) == {1: ("DUPLICATE", True, False), 2: ("REPLAY", False, True), 3: ("NEW", False, False)}
    assert told(three) == {1: ("DUPLICATE", True, False), 2: ("REPLAY", False, True)}
    ids = {(n, r["seq"]): r["file_id"] for n, df in enumerate((one, two, three)) for r in df.collect()}
    assert ids[0, 1] == ids[1, 1] == ids[1, 2] and ids[1, 3] == ids[2, 1] == ids[2, 2]
