"""Intake: literal cases and a randomized comparison of the set-at-a-time
resolution with a sequential model of one-upload-at-a-time handling."""

import hashlib
import random

from pyspark.sql import functions as F

from quarry.operators import intake

WS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
ALLOWED = {".csv": {"text/csv", "application/csv"}, ".tsv": {"text/tab-separated-values", "text/tsv"},
           ".json": {"application/json", "text/json"}, ".pdf": {"application/pdf"}}


def policy(name, size, mime):
    n = (name or "").strip(WS)
    if not n:
        return "Filename is required"
    if len(n.encode("utf-16-le")) // 2 > 255:
        return "Filename is too long"
    if "/" in n or "\\" in n:
        return "Filename must not contain path separators"
    if n in (".", ".."):
        return "Invalid filename"
    if any(ord(c) < 32 or ord(c) == 127 for c in n):
        return "Filename contains control characters"
    ext = n[n.rfind("."):].lower() if "." in n else ""
    if ext not in ALLOWED and ext not in (".xlsx", ".xlsm"):
        return f"Unsupported file extension: {ext or '(none)'}"
    if size < 0 or size > 25 * 1024 * 1024:
        return "File exceeds configured size limit"
    if not mime:
        return "MIME type is required"
    if mime not in ALLOWED.get(ext, set()) and mime != "application/octet-stream":
        return f"MIME type does not match extension: {mime}"
    if ".." in n:
        return "Invalid storage key"
    return None


def sequential(rows, sources):
    files, keys, out = set(), {}, {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        t = r["tenant_id"]
        key = None
        if r["idempotency_key"] is not None:
            key = r["idempotency_key"].strip(WS)
            if not key or len(key) > 255:
                out[r["seq"]] = ("REJECTED", "Invalid Idempotency-Key", None)
                continue
            if (t, key) in keys:
                out[r["seq"]] = ("REPLAY", None, keys[(t, key)])
                continue
        if (t, r["source_id"]) not in sources:
            out[r["seq"]] = ("REJECTED", "Source not found", None)
            continue
        why = policy(r["filename"], len(r["content"].encode()), r["mime_type"])
        if why:
            out[r["seq"]] = ("REJECTED", why, None)
            continue
        cs = hashlib.sha256(r["content"].encode()).hexdigest()
        fid = hashlib.sha256(f"file|{t}|{cs}".encode()).hexdigest()
        status = "DUPLICATE" if (t, cs) in files else "NEW"
        files.add((t, cs))
        out[r["seq"]] = (status, None, fid)
        if key:
            keys[(t, key)] = fid
    return out


SCHEMA = ("seq long, tenant_id string, source_id string, filename string, mime_type string, "
          "content string, idempotency_key string")


def run_spark(spark, rows, sources):
    up = spark.createDataFrame([tuple(r[k] for k in ("seq", "tenant_id", "source_id", "filename", "mime_type",
                                                     "content", "idempotency_key")) for r in rows], SCHEMA)
    src = spark.createDataFrame(sorted(sources), "tenant_id string, id string")
    res = intake.resolve_uploads(up, src).collect()
    return {r.seq: (r.status, r.reason, r.file_id) for r in res}


def test_reference_cases(spark):
    rows = [
        dict(seq=1, tenant_id="t1", source_id="s", filename="a.csv", mime_type="text/csv", content="a,b\n1,2", idempotency_key="k1"),
        dict(seq=2, tenant_id="t1", source_id="s", filename="a.csv", mime_type="text/csv", content="a,b\n1,2", idempotency_key="k1"),
        dict(seq=3, tenant_id="t1", source_id="s", filename="b.json", mime_type="application/json", content='{"id":1}', idempotency_key=None),
        dict(seq=4, tenant_id="t1", source_id="s", filename="c.json", mime_type="application/json", content='{"id":1}', idempotency_key=None),
        dict(seq=5, tenant_id="t2", source_id="s", filename="c.json", mime_type="application/json", content='{"id":1}', idempotency_key=None),
        dict(seq=6, tenant_id="t1", source_id="s", filename="x.exe", mime_type="text/csv", content="z", idempotency_key=None),
        dict(seq=7, tenant_id="t1", source_id="other", filename="x.csv", mime_type="text/csv", content="z", idempotency_key=None),
        dict(seq=8, tenant_id="t1", source_id="s", filename="x.csv", mime_type="text/csv", content="z", idempotency_key="   "),
        dict(seq=9, tenant_id="t1", source_id="s", filename="a..b.csv", mime_type="text/csv", content="q", idempotency_key=None),
    ]
    got = run_spark(spark, rows, {("t1", "s"), ("t2", "s")})
    assert got[1][0] == "NEW" and got[2] == ("REPLAY", None, got[1][2])
    assert got[3][0] == "NEW" and got[4] == ("DUPLICATE", None, got[3][2])
    assert got[5][0] == "NEW" and got[5][2] != got[3][2]          # other tenant: not a duplicate
    assert got[6] == ("REJECTED", "Unsupported file extension: .exe", None)
    assert got[7] == ("REJECTED", "Source not found", None)
    assert got[8] == ("REJECTED", "Invalid Idempotency-Key", None)
    assert got[9] == ("REJECTED", "Invalid storage key", None)


def test_random_traces_match_sequential_model(spark):
    rnd = random.Random(7)
    names = ["a.csv", "b.json", " c.tsv ", "x.exe", "d/e.csv", "", "f..json", "g.PDF", "noext"]
    mimes = ["text/csv", "application/json", "application/octet-stream", "text/tsv", "", "application/pdf"]
    keys = [None, None, None, "k1", "k2", " k1 ", "", "k3"]
    rows = []
    for seq in range(400):
        rows.append(dict(seq=seq, tenant_id=rnd.choice(["t1", "t2"]), source_id=rnd.choice(["s1", "s2", "s3"]),
                         filename=rnd.choice(names), mime_type=rnd.choice(mimes),
                         content=rnd.choice(["x", "y", "z", "w,v"]), idempotency_key=rnd.choice(keys)))
    sources = {("t1", "s1"), ("t1", "s2"), ("t2", "s1")}
    assert run_spark(spark, rows, sources) == sequential(rows, sources)


def test_manifest_and_prior_batches(spark):
    rows = [dict(seq=1, tenant_id="t", source_id="s", filename=" r.csv ", mime_type="text/csv", content="a", idempotency_key="k")]
    up = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    src = spark.createDataFrame([("t", "s")], "tenant_id string, id string")
    res = intake.resolve_uploads(up, src)
    files, arts = intake.ingest_manifest(res)
    f = files.collect()[0]
    a = arts.collect()[0]
    assert f.original_name == "r.csv" and f.status == "VERIFIED"
    assert a.storage_key == f"t/sources/{f.id}/r.csv" and a.version == 1
    # a second batch sees the stored file and key
    prior_files = files.select("tenant_id", "checksum_sha256", F.col("id").alias("file_id"))
    prior_keys = intake.registered_keys(res)
    rows2 = [(2, "t", "s", "other.csv", "text/csv", "a", None), (3, "t", "s", "x.exe", "text/csv", "b", "k")]
    up2 = spark.createDataFrame(rows2, SCHEMA)
    got = {r.seq: (r.status, r.file_id) for r in intake.resolve_uploads(up2, src, prior_files, prior_keys).collect()}
    assert got == {2: ("DUPLICATE", f.id), 3: ("REPLAY", f.id)}


def test_error_codes_and_generated_ids(spark):
    from quarry.operators import tables

    rows = [(1, "t", "s", "a.exe", "text/csv", "x", None), (2, "t", "nope", "a.csv", "text/csv", "x", None),
            (3, "t", "s", "a.csv", "text/csv", "x", "")]
    up = spark.createDataFrame(rows, SCHEMA)
    src = spark.createDataFrame([("t", "s")], "tenant_id string, id string")
    got = {r.seq: r.error_code for r in intake.resolve_uploads(up, src).collect()}
    assert got == {1: "VALIDATION_ERROR", 2: "NOT_FOUND", 3: "VALIDATION_ERROR"}
    t = spark.createDataFrame([(None, "a"), ("x", "b"), (None, "a")], "id string, v string")
    ids = [r.id for r in tables.with_ids(t).collect()]
    assert ids[1] == "x" and ids[0] == ids[2] and len(ids[0]) == 64


def test_policy_edges(spark):
    astral = "\U0001F600"
    rows = [
        (1, "a" * 251 + ".csv", 10, "text/csv"),                 # 255 units: ok
        (2, "a" * 252 + ".csv", 10, "text/csv"),                 # 256 units
        (3, astral * 126 + ".csv", 10, "text/csv"),              # 126*2 + 4 = 256 units
        (4, "a\x07b.csv", 10, "text/csv"),
        (5, "..", 10, "text/csv"),
        (6, "README", 10, "text/csv"),
        (7, "a.csv", 10, "text/csv; charset=utf-8"),
        (8, "a.csv", 26214401, "text/csv"),
        (9, "a.csv", 26214400, "application/octet-stream"),
        (10, "a.XLSM", 10, "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
        (11, "a.pdf", 10, ""),
    ]
    df = spark.createDataFrame(rows, "seq long, filename string, size_bytes long, mime_type string")
    got = {r.seq: r.reject_reason for r in intake.file_policy(df, intake.MAX_BYTES).collect()}
    assert got == {
        1: None, 2: "Filename is too long", 3: "Filename is too long",
        4: "Filename contains control characters", 5: "Invalid filename",
        6: "Unsupported file extension: (none)",
        7: "MIME type does not match extension: text/csv; charset=utf-8",
        8: "File exceeds configured size limit", 9: None, 10: None, 11: "MIME type is required"}
