"""Literal-row tests of the readers (delimited, JSON, workbook, dispatch)."""

import json

import pytest

from quarry.sources import delimited, jsondoc, workbook
from quarry.sources.dispatch import parse_files, split_parsed


def recs(text, ext=".csv"):
    return [json.loads(p) for p in delimited.records_of(text, ext)]


def test_csv_keeps_spaces_and_strings():
    assert recs("Ref,Name\n A-01 ,Produit") == [{"Ref": " A-01 ", "Name": "Produit"}]


def test_duplicate_header_rejected():
    with pytest.raises(ValueError, match="Duplicate header: A"):
        recs("A,A\n1,2")


def test_tsv_and_detection():
    assert recs("A\tB\n1\t2", ".tsv") == [{"A": "1", "B": "2"}]
    assert delimited.detect_delimiter_text("a;b;c\nx") == ";"
    assert delimited.detect_delimiter_text("a,b\tc") == ","          # tie -> comma first
    assert delimited.detect_delimiter_text("a\tb;c") == "\t"         # tie -> tab before ;
    assert delimited.detect_delimiter_text("a;b\rc,d,e,f") == ","    # CR-only: whole text is line 1


def test_quotes_anywhere_and_doubled():
    assert recs('h1,h2\n"a,b",c""d\n') == [{"h1": "a,b", "h2": "cd"}]
    assert recs('h\n"x""y"') == [{"h": 'x"y'}]
    assert recs('h\nab"c\nd"') == [{"h": "abc\nd"}]                 # mid-cell quote opens
    with pytest.raises(ValueError, match="Unclosed quoted field"):
        recs('h\n"abc')


def test_row_ends_blank_rows_padding():
    assert recs("a,b\r\n1,2\r3\n,\n\n4,5,6") == [
        {"a": "1", "b": "2"}, {"a": "3", "b": None}, {"a": "4", "b": "5"}]
    assert recs("a,b\n1,") == [{"a": "1", "b": ""}]                 # empty cell is "", not null
    assert recs("a,b\n") == []                                       # header only
    assert recs("") == []


def test_integer_like_headers_come_first():
    out = list(delimited.records_of("b,2,1\nx,y,z", ".csv"))
    assert out == ['{"1":"z","2":"y","b":"x"}']


def test_json_shapes():
    assert [json.loads(x) for x in jsondoc.records_of('{"a":1}')] == [{"a": 1}]
    assert [json.loads(x) for x in jsondoc.records_of('[{"a":1},{"a":2}]')] == [{"a": 1}, {"a": 2}]
    assert list(jsondoc.records_of("[1,null,[2],\"s\"]")) == [
        '{"value":1}', '{"value":null}', '{"value":[2]}', '{"value":"s"}']
    assert list(jsondoc.records_of("[]")) == []
    assert list(jsondoc.records_of('{"a":1,"a":2,"b":1.50,"c":1e3}')) == ['{"a":2,"b":1.5,"c":1000}']
    for bad in ('{"a":1} x', "NaN", "[1,]"):
        with pytest.raises(ValueError):
            list(jsondoc.records_of(bad))


def test_workbook_roundtrip_and_sparse_cells():
    data = workbook.build_workbook(["reference", "designation", "x"],
                                   [["A-01", "Produit", None], [None, None, None], ["A&<2", None, "1"]])
    out = [json.loads(x) for x in workbook.records_of(data)]
    assert out == [{"reference": "A-01", "designation": "Produit", "x": None},
                   {"reference": "A&<2", "designation": None, "x": "1"}]
    dup = workbook.build_workbook(["a", "a"], [["1", "2"]])
    with pytest.raises(ValueError, match="Duplicate header"):
        list(workbook.records_of(dup))
    with pytest.raises(ValueError, match="Invalid XLSX"):
        list(workbook.records_of(b"not a zip"))


def test_dispatch_routes_and_quarantines(spark):
    files = spark.createDataFrame([
        ("1", "a.csv", b"Ref,Name\n A-01 ,Produit"),
        ("2", "b.json", b'\xef\xbb\xbf[{"a":1},{"a":2}]'),
        ("3", "c.pdf", b"%PDF raw \xff"),
        ("4", "d.exe", b"MZ"),
        ("5", "e.csv", b'h\n"open'),
        ("6", "f.xlsx", workbook.build_workbook(["k"], [["v"]])),
    ], "file_id string, filename string, content binary")
    recs_df, errs = split_parsed(parse_files(files))
    got = sorted((r.file_id, r.record_number, r.payload) for r in recs_df.collect())
    assert got == [("1", 1, '{"Ref":" A-01 ","Name":"Produit"}'), ("2", 1, '{"a":1}'), ("2", 2, '{"a":2}'),
                   ("3", 1, '{"extracted_text":"%PDF raw �"}'), ("6", 1, '{"k":"v"}')]
    assert sorted((r.file_id, r.error) for r in errs.collect()) == [
        ("4", "Unsupported parser: .exe"), ("5", "Unclosed quoted field")]


def test_lone_surrogates_survive_the_arrow_path(spark):
    files = spark.createDataFrame([("1", "a.json", b'[{"a":"x\\ud800y"},"\\ud83d\\ude00"]')],
                                  "file_id string, filename string, content binary")
    recs, errs = split_parsed(parse_files(files))
    got = sorted(r.payload for r in recs.collect())
    assert got == ['{"a":"x\\ud800y"}', '{"value":"\U0001F600"}'] and errs.count() == 0
