"""Range readers against the whole-file readers, for cuts at every byte."""

import random

import pytest

from quarry.sources import delimited, jsondoc, split
from quarry.sources.dispatch import decode_text

CSV = {
    "plain": b"a,b\n1,2\n3,4\n",
    "quotes over lines": b'\xef\xbb\xbfa;b\r\n"x\r\ny";2\r\n\r\n"he said ""no""";\r\n;;\r\nlast;one;more',
    "cr only": b"a\tb\r1\t\"2\r3\"\r\r4",
    "unclosed": b'a,b\n1,"2\n3,4\n',
    "doubled header": b"a,b,a\n1,2,3\n",
    "unclosed and doubled": b'a,a\n1,"2',
    "one row": b'"a\nb",c',
    "bad utf-8": b"a,b\n\xff\xc3,\xe9\n\xc3\xa9,x\n",
    "index keys": b"10,b,2\nx,y,z\n",
    "empty": b"",
    "blank rows": b"\n\n,,\n\"\",\na,b\n\n1,2",
    "long first line": b"a;b;c" + b";d" * 30 + b"\n1,2;3\n",
}
JSON = {
    "records": b'[{"a":1,"b":[1,{"c":"x,]"}]}, 2.50 ,null,[1,2],"s\\\\",{"k":"\\"],["}]',
    "object": b' {"a":[1,2,3], "b":"x"} ',
    "scalar": b"17", "empty array": b"\xef\xbb\xbf [ ]\n", "one": b"[ [1,2] ]", "empty": b"",
    "no end": b'[1,{"a":2}', "trailing": b"[1,2] x", "two arrays": b"[1],[2]", "hole": b"[1,,2]", "last comma": b"[1,2,]", "first comma": b"[,1]",
    "brackets": b"[1,[2},3]", "closed early": b"[1],2,[3]", "nan": b"[1,NaN,2]", "open string": b'[1,"a,b]', "backslash": b'["a\\\\",",","\\\\\\"",1]',
    "unicode": '["é,","日本",{"ключ":"\\u00e9"}]'.encode(), "space then mark": b" \xef\xbb\xbf[1,2]", "index keys": b'[{"b":1,"2":2,"1":1e3}]',
}


def whole(reader, data):
    try:
        return [(k, p) for k, p in enumerate(reader(decode_text(data)), 1)], None
    except ValueError as e:
        return [], str(e)


def in_ranges(spark, files):
    rows = [(name, pos, data[pos:pos + size]) for name, data, size in files for pos in range(0, max(len(data), 1), size)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "file_id string, pos long, data binary").repartition(5)


def by_file(parsed):
    got = {}
    for r in parsed.collect():
        rows, error = got.get(r["file_id"], ([], None))
        got[r["file_id"]] = (sorted([*rows, (r["record_number"], r["payload"])]) if r["error"] is None else rows, r["error"] or error)
    return got


def check(spark, texts, reader, parse, message):
    files = [(f"{name}/{size}", data, size) for name, data in texts.items() for size in {1, 2, 3, 5, 7, 1000}]
    got = by_file(parse(in_ranges(spark, files)))
    for name, data, _ in files:
        rows, error = whole(reader, data)
        mine = got.get(name, ([], None))
        assert mine[0] == rows, name
        assert message(mine[1]) == message(error), name


def test_delimited_ranges_as_whole_files(spark):
    check(spark, CSV, lambda t: delimited.records_of(t, ".csv"), split.parse_delimited_split, lambda e: e)


def test_json_ranges_as_whole_files(spark):
    """The same files fail; messages name another place."""
    check(spark, JSON, jsondoc.records_of, split.parse_json_split, lambda e: e and e.split(":")[0])


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rnd = random.Random(seed)
    texts = {str(i): "".join(rnd.choice(['a', 'b', '"', '""', ',', '\n', '\r\n', '\r', ' ', 'é', ';']) for _ in range(rnd.randint(0, 40))).encode()
             for i in range(150)}
    files = [(n, t, rnd.randint(1, 9)) for n, t in texts.items()]
    got = by_file(split.parse_delimited_split(in_ranges(spark, files)))
    for n, t, _ in files:
        rows, error = whole(lambda x: delimited.records_of(x, ".csv"), t)
        mine = got.get(n, ([], None))
        assert (mine[0], mine[1]) == (rows, error), t


def test_given_delimiter_and_contents_in_rows(spark):
    files = spark.createDataFrame([("f", "a,b\tc\n1,2\t3\n")], "file_id string, content string")
    got = split.parse_delimited_split(split.cut(files, 4), delimiter="\t").collect()
    assert [(r["record_number"], r["payload"]) for r in got] == [(1, '{"a,b":"1,2","c":"3"}')]


def test_stored_file_is_split_by_spark(spark, tmp_path):
    rows = [f'{i},"v ""{i}""\r\nnext {i}",{"x" * (i % 50)}' for i in range(4000)]
    data = ("id,text,pad\r\n" + "\r\n".join(rows)).encode()
    (tmp_path / "big.csv").write_bytes(data)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(16 << 10))
    try:
        ranges = split.read_ranges(spark, str(tmp_path), range_bytes=4096)
        assert ranges.rdd.getNumPartitions() > 4
        got = split.parse_delimited_split(ranges).orderBy("record_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [(r["record_number"], r["payload"]) for r in got] == whole(lambda t: delimited.records_of(t, ".csv"), data)[0]
    assert {r["file_id"].rsplit("/", 1)[1] for r in got} == {"big.csv"}


def test_no_files(spark):
    none = spark.createDataFrame([], "file_id string, pos long, data binary")
    assert split.parse_delimited_split(none).count() == 0 and split.parse_json_split(none).count() == 0
