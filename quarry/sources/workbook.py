"""Workbooks (I10): first sheet of an XLSX/XLSM archive -> records.

Reads the first ``<sheet>`` of ``xl/workbook.xml`` through the workbook
relations (default ``worksheets/sheet1.xml``). Shared strings and inline
strings give text; any other cell gives the raw text of ``<v>`` (numbers,
dates and booleans stay text). Missing cells are null, an empty cell is
``""``. The first row is the header (duplicates are an error); rows whose
cells are all null/empty are dropped. XML entities are decoded by the XML
parser. Macros are never run.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

from quarry.functions import jsvalues

_NS_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_NS_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_NS_PKG = "http://schemas.openxmlformats.org/package/2006/relationships"
_M = "{%s}" % _NS_MAIN


class WorkbookError(ValueError):
    pass


def column_number(ref: str) -> int:
    m = re.match(r"([A-Za-z]+)", ref or "")
    if not m:
        return 1
    n = 0
    for ch in m.group(1).upper():
        n = n * 26 + (ord(ch) - 64)
    return n


def _text_of(el) -> str:
    return "".join(t.text or "" for t in el.iter(_M + "t"))


def first_sheet_path(zf: zipfile.ZipFile) -> tuple[str, set[str]]:
    """The entry of the first sheet, and all entries' names."""
    names = set(zf.namelist())
    if "xl/workbook.xml" not in names:
        raise WorkbookError("Invalid XLSX: workbook.xml missing")
    wb = ET.fromstring(zf.read("xl/workbook.xml"))
    sheets = list(wb.iter(_M + "sheet"))
    if not sheets:
        raise WorkbookError("XLSX contains no sheet")
    rid = sheets[0].get("{%s}id" % _NS_REL)
    target = "worksheets/sheet1.xml"
    if "xl/_rels/workbook.xml.rels" in names:
        rels = ET.fromstring(zf.read("xl/_rels/workbook.xml.rels"))
        for r in rels.iter("{%s}Relationship" % _NS_PKG):
            if r.get("Id") == rid and r.get("Target"):
                target = r.get("Target").lstrip("/")
                break
    path = target if target.startswith("xl/") else f"xl/{target}"
    if path not in names:
        raise WorkbookError("XLSX worksheet missing")
    return path, names


def rows_of(data: bytes) -> list[list]:
    try:
        zf = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise WorkbookError(f"Invalid XLSX: {e}") from None
    path, names = first_sheet_path(zf)
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        sst = ET.fromstring(zf.read("xl/sharedStrings.xml"))
        shared = [_text_of(si) for si in sst.iter(_M + "si")]
    sheet = ET.fromstring(zf.read(path))
    matrix: list[list] = []
    for row in sheet.iter(_M + "row"):
        cells = []
        for c in row.iter(_M + "c"):
            kind = c.get("t", "")
            v = c.find(_M + "v")
            raw = (v.text or "") if v is not None else ""
            if kind == "s":
                try:
                    value = shared[int(raw)]
                except (ValueError, IndexError):
                    value = ""
            elif kind == "inlineStr":
                is_el = c.find(_M + "is")
                value = _text_of(is_el) if is_el is not None else ""
            else:
                value = raw
            cells.append((column_number(c.get("r", "")), value))
        width = max((i for i, _ in cells), default=0)
        line = [None] * width
        for i, value in cells:
            line[i - 1] = value
        matrix.append(line)
    return matrix


def records_of(data: bytes):
    matrix = rows_of(data)
    header = ["" if v is None else str(v) for v in (matrix[0] if matrix else [])]
    if len(set(header)) != len(header):
        raise WorkbookError("Duplicate header")
    for line in matrix[1:]:
        if not any(v is not None and v != "" for v in line):
            continue
        rec = {h: (line[i] if i < len(line) else None) for i, h in enumerate(header)}
        yield jsvalues.record_text(rec)


def _cell_ref(col: int, row: int) -> str:
    letters = ""
    while col:
        col, rem = divmod(col - 1, 26)
        letters = chr(65 + rem) + letters
    return f"{letters}{row}"


def _esc(s: str) -> str:
    return (s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
             .replace('"', "&quot;"))


def build_workbook(header: list[str], rows: list[list]) -> bytes:
    """Write a minimal one-sheet XLSX: header as shared strings, cells inline.

    ``None`` cells are left out (sparse), so they read back as null.
    """
    sst = "".join(f"<si><t>{_esc(h)}</t></si>" for h in header)
    out_rows = ["<row r=\"1\">" + "".join(
        f'<c r="{_cell_ref(i + 1, 1)}" t="s"><v>{i}</v></c>' for i in range(len(header))) + "</row>"]
    for r, line in enumerate(rows, start=2):
        cells = "".join(
            f'<c r="{_cell_ref(i + 1, r)}" t="inlineStr"><is><t xml:space="preserve">{_esc(str(v))}</t></is></c>'
            for i, v in enumerate(line) if v is not None)
        out_rows.append(f'<row r="{r}">{cells}</row>')
    files = {
        "[Content_Types].xml": (
            '<?xml version="1.0" encoding="UTF-8"?>'
            '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
            '<Override PartName="/xl/sharedStrings.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sharedStrings+xml"/>'
            "</Types>"),
        "_rels/.rels": (
            f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_NS_PKG}">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
            "</Relationships>"),
        "xl/workbook.xml": (
            f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS_MAIN}" xmlns:r="{_NS_REL}">'
            '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'),
        "xl/_rels/workbook.xml.rels": (
            f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_NS_PKG}">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
            '<Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/sharedStrings" Target="sharedStrings.xml"/>'
            "</Relationships>"),
        "xl/sharedStrings.xml": (
            f'<?xml version="1.0" encoding="UTF-8"?><sst xmlns="{_NS_MAIN}" count="{len(header)}" '
            f'uniqueCount="{len(header)}">{sst}</sst>'),
        "xl/worksheets/sheet1.xml": (
            f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS_MAIN}"><sheetData>'
            + "".join(out_rows) + "</sheetData></worksheet>"),
    }
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for name, body in files.items():
            zf.writestr(name, body)
    return buf.getvalue()
