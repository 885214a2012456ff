"""Streamed workbooks against the whole-document reader."""

import io
import re
import tracemalloc
import zipfile

from quarry.sources import workbook, workbook_stream


def rewritten(data, changes):
    """The archive with entries replaced (None: left out)."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            body = changes.get(name, old.read(name))
            if body is not None:
                new.writestr(name, body)
    return out.getvalue()


SHEET, SHARED = "xl/worksheets/sheet1.xml", "xl/sharedStrings.xml"
PLAIN = workbook.build_workbook(["a", "b", "10"], [["x", None, "1"], [None, None, None], ["", "", ""], ["é & <y>", "2", "3"], [None, "last", None]])
NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def sheet(rows):
    return f'<worksheet xmlns="{NS}"><sheetData>{rows}</sheetData></worksheet>'


STRINGS = f'<sst xmlns="{NS}"><si><t>name</t></si><si><r><t>rich </t></r><r><t>text</t></r></si><si><t/></si><si><t>v</t></si></sst>'
ROWS = ('<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>3</v></c></row>'
        '<row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>1.50</v></c><c r="C2" t="s"><v>99</v></c></row>'
        '<row><c r="A3" t="s"><v>2</v></c></row><row/>'
        '<row><c t="s"><v>-1</v></c><c r="A5" t="s"><v>0</v></c><c r="E5" t="b"><v>1</v></c></row>'
        '<row><c r="B6" t="s"><v>x</v></c><c r="C6" t="inlineStr"><is><t>in</t><t>line</t></is></c></row>'
        '<row><c r="A7" t="s"><v>-1</v></c></row>')
FILES = {
    "plain": PLAIN,
    "shared": rewritten(PLAIN, {SHEET: sheet(ROWS), SHARED: STRINGS}),
    "no strings": rewritten(PLAIN, {SHEET: sheet(ROWS), SHARED: None}),
    "doubled": rewritten(PLAIN, {SHEET: sheet(ROWS.replace('<v>3</v>', '<v>0</v>', 1)), SHARED: STRINGS}),
    "no sheet entry": rewritten(PLAIN, {SHEET: None}),
    "broken late": rewritten(PLAIN, {SHEET: sheet(ROWS)[:-30], SHARED: STRINGS}),
    "broken strings": rewritten(PLAIN, {SHARED: "<sst><si>"}),
    "no rows": rewritten(PLAIN, {SHEET: sheet("")}),
    "not a zip": b"PK nothing", "empty": b"",
}


def whole(data):
    try:
        return [(k, p) for k, p in enumerate(workbook.records_of(data), 1)], None
    except Exception as e:
        return [], str(e)


def test_streamed_as_whole(spark):
    df = spark.createDataFrame([(n, bytearray(d)) for n, d in FILES.items()], "file_id string, content binary").repartition(3)
    got = {}
    for r in workbook_stream.parse_workbooks(df).collect():
        rows, error = got.get(r["file_id"], ([], None))
        got[r["file_id"]] = (sorted([*rows, (r["record_number"], r["payload"])]) if r["error"] is None else rows, r["error"] or error)
    for name, data in FILES.items():
        assert got.get(name, ([], None)) == whole(data), name


def test_memory_is_flat_over_rows():
    """Ten times the rows, hardly more memory (the archive itself aside)."""
    def peak(n):
        row = '<row r="{0}"><c r="A{0}"><v>{0}</v></c><c r="B{0}" t="inlineStr"><is><t>some text {0}</t></is></c></row>'
        data = rewritten(PLAIN, {SHEET: sheet("".join(row.format(i) for i in range(n)))})
        tracemalloc.start()
        try:
            rows = sum(kind == "cells" for kind, _ in workbook_stream.stream(data))
            return rows, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
    (few, small), (many, large) = peak(6_000), peak(60_000)
    assert (few, many) == (6_000, 60_000)
    assert large < 1.5 * small + 200_000


def test_rows_of_one_file_spread(spark):
    data = workbook.build_workbook(["k"], [[str(i)] for i in range(9000)])
    got = workbook_stream.parse_workbooks(spark.createDataFrame([("f", bytearray(data))], "file_id string, content binary"))
    assert re.search(r"rangepartitioning|Scan ExistingRDD", got._jdf.queryExecution().executedPlan().toString())
    rows = sorted(got.collect(), key=lambda r: r["record_number"])
    assert [(r["record_number"], r["payload"]) for r in rows] == [(i + 1, f'{{"k":"{i}"}}') for i in range(9000)]
