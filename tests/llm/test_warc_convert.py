import base64
import gzip
import hashlib
import random

import pytest

from quarry.llm import warc_convert as w
from quarry.llm.common import new_folder

V1 = (b"filedesc://old.arc 0.0.0.0 19970102030405 text/plain 73\n1 0 Archive\nURL IP-address Archive-date Content-type Archive-length\n"
      )


def digest(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def test_versions_and_declared_lengths():
    block = b"HTTP/1.0 200 OK\r\nX-Page-Id: 4\r\n\r\nhttp://looks.like/ 1.2.3.4 19990101000000 text/html 5\nabc"
    rows = [("http://a/", "1.2.3.4", "19990203040506", "text/html", block), ("dns:a", "1.2.3.4", "1999", "text/dns", b"\n\n")]
    for version, n in ((1, 5), (2, 10)):
        got = list(w.read_arc(w.arc_file(rows, version, "t.arc")))
        assert [len(h) for _, h, _, _ in got] == [n] * 3
        assert [b for _, _, b, _ in got[1:]] == [block, b"\n\n"]
        kinds = [w.convert(h, b) for _, h, b, _ in got]
        assert [k["kind"] for k in kinds] == ["warcinfo", "response", "resource"]
        assert kinds[1]["date"] == "1999-02-03T04:05:06Z" and kinds[2]["date"] == "1999-01-01T00:00:00Z"
        assert kinds[1]["page_id"] == 4 and kinds[1]["payload_digest"] == digest(block.split(b"\r\n\r\n")[1])
    cut = list(w.read_arc(w.arc_file(rows, 1, "t.arc")[:-3]))
    assert [r for *_, r in cut] == [None, None, "a record is cut off: 0 of 2 bytes"]


ROWS = [("http://a/ b c", "1.2.3.4", "19990203040506", "text/html", b"HTTP/1.0 200 OK\r\nX-Page-Id: 1\r\n\r\none"),
        ("http://b/", "1.2.3.4", "19990203040506", "text/html", b"HTTP/1.0 200 OK\r\nX-Page-Id: 2\r\n\r\ntwo")]


def members(data, cuts):
    return b"".join(gzip.compress(data[x:y]) for x, y in zip([0, *cuts], [*cuts, len(data)]))


def test_damaged_archives_are_rows(spark):
    one, two = w.arc_file(ROWS, 1, "t.arc"), w.arc_file(ROWS, 2, "t.arc")
    at = one.index(b"http://b/")
    zipped = members(one, [one.index(b"http://a/"), at])
    second = zipped.index(w.GZIP, 5)
    files = {
        "plain": one, "version 2": two, "members": zipped, "one member": gzip.compress(two), "none": None, "empty": b"",
        "cut": one[:-4], "cut line": one[:at + 5], "text": b"no line feed", "lines": b"a\nb c\nd\n" + one,
        "odd line": one[:at] + b"garbage 1 2\nmore\n" + one[at:], "length": one[:at] + one[at:].replace(b" %d\n" % len(ROWS[1][4]), b" x\n"),
        "cut member": zipped[:-40], "damaged member": zipped[:second + 12] + b"\xff\xff\xff\xff" + zipped[second + 16:],
        "tail": zipped + b"rubbish", "not gzip": w.GZIP + b"\xff" * 30}
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "path string, content binary")
    got = {}
    for r in w.convert_archives(df.selectExpr("*", "1 AS kind", "'x' AS reason")).collect():
        pages, bad = got.setdefault(r["path"], ([], []))
        (bad if r["kind"] == "broken" else pages).append(r["reason"] if r["kind"] == "broken" else r["page_id"])
    whole = {k: sorted(x for x in pages if x) for k, (pages, _) in got.items()}
    for k in ("plain", "version 2", "members", "one member"):
        assert whole[k] == [1, 2] and got[k][1] == [], k
    assert "none" not in got and "empty" not in got
    assert whole["cut"] == [1] and got["cut"][1][0].startswith("a record is cut off")
    assert whole["cut line"] == [1] and got["cut line"][1] == ["a record line without an end"]
    assert got["text"] == ([], ["a record line without an end"])
    assert whole["lines"] == whole["odd line"] == [1, 2] and len(got["lines"][1]) == len(got["odd line"][1]) == 1
    assert whole["length"] == [1] and len(got["length"][1]) == 1
    assert whole["cut member"] == [1] and "a gzip member is cut off" in got["cut member"][1]
    assert 2 in whole["damaged member"] and "a gzip member is damaged" in got["damaged member"][1]
    assert whole["tail"] == [1, 2] and got["tail"][1] == ["a gzip member is damaged"]
    assert got["not gzip"][0] == [] and len(got["not gzip"][1]) >= 1
    uris = {r["uri"] for r in w.convert_archives(df.where("path = 'plain'")).collect()}
    assert "http://a/ b c" in uris


@pytest.mark.parametrize("seed", range(4))
def test_any_change_of_bytes_is_survived(seed):
    rng, good = random.Random(seed), (w.arc_file(ROWS, 1 + seed % 2, "t.arc"))
    warc = b"".join(w.warc_record({**w.convert(h, b), "refers_to": None}) + b"\r\n\r\n" for _, h, b, _ in w.read_arc(good))
    assert [w.page_of(h, b)["page_id"] for _, h, b, _ in w.parse_warc(warc)] == [None, 1, 2]
    for raw in (good, gzip.compress(good), warc, members(warc, [400, 700])):
        for _ in range(300):
            bad = bytearray(raw)
            for _ in range(rng.randint(1, 6)):
                i = rng.randrange(len(bad))
                bad[i:i + rng.randint(0, 3)] = bytes(rng.randrange(256) for _ in range(rng.randint(0, 3)))
            data, _ = w.unzipped(bytes(bad))
            for _, h, b, _ in w.read_arc(data):
                h is None or w.convert(h, b)
            for _, h, b, _ in w.parse_warc(data):
                h is None or w.page_of(h, b)


def test_archives_are_bounded_by_bytes(spark):
    rows = [(i, f"http://x/{i}", chr(97 + i % 26) * 40_000 + str(i)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    path = new_folder(spark, "t")
    w.write_warc(w.mark_revisits(w.convert_archives(w.pages_to_arc(pages)).where("kind = 'response'")), path, bytes_per_file=100_000)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").collect()
    assert len(files) >= 20 and max(len(gzip.decompress(f["content"])) for f in files) <= 100_000
    assert sorted(r["page_id"] for r in w.read_warc(spark, path).collect()) == list(range(40))


def test_pages_round_trip(spark):
    rows = [(5, "http://a/ b\n", "<p>x</p>"), (3, None, "<p>x</p>"), (9, "http://c/", "<p>x</p>"), (1, "u", None), (2, "u", ""),
            (7, "é", "café\r\n\r\nWARC/1.1\r\n"), (8, "v", "z" * 3_000_000), (3, None, "<p>x</p>"), (None, "n", "<p>x</p>"),
            (11, "http://c/", "HTTP/1.1 200 OK\r\n\r\nnested")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'k' AS kind", "1 AS payload")
    records = w.convert_archives(w.pages_to_arc(pages, per_file=3)).where("kind != 'warcinfo'")
    path = new_folder(spark, "t")
    w.write_warc(w.mark_revisits(records), path, records_per_file=2)
    got = w.read_warc(spark, path).collect()
    assert len(got) == len(rows) and all(r["payload_intact"] for r in got)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min(j for j, _, h in rows if j is not None and (h or "") == (html or ""))
        again = i is not None and i > first
        want.append((i, len(data), digest(data), "revisit" if again else "response", first if again else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) \
        == sorted(want, key=key)


def test_minimum_size_and_empty(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", ""), (4, "d", "")], "page_id long, url string, html string")
    r = w.mark_revisits(w.convert_archives(w.pages_to_arc(pages)).where("kind='response'"), min_bytes=1).collect()
    assert {x["page_id"]: x["refers_to"] for x in r} == {1: None, 2: 1, 3: None, 4: None}
    empty = w.convert_archives(w.pages_to_arc(pages.where("page_id > 9")))
    path = new_folder(spark, "t")
    w.write_warc(w.mark_revisits(empty), path)
    assert w.read_warc(spark, path).count() == 0
