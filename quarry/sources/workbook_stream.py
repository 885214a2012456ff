"""Workbooks as a stream of rows (I10 for big sheets).

The sheet's XML is read by events while its zip entry inflates, and every
element is dropped when its row is done: memory does not grow with the sheet.
Shared strings are a table of their own, ``(file_id, nth, text)``, read the
same way and joined to the cells that refer to them, so they are never held as
a list. Rows leave in parts of bounded size, are numbered in two levels, and
become records as in ``workbook.records_of``: same rows, same errors, one
error row for a file that cannot be read.

Inflating one sheet is sequential, so a file is read by one task; all that
follows is spread by (file, row).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import jsvalues
from quarry.functions.grouping import materialize, number_within
from quarry.sources.workbook import _M, WorkbookError, _text_of, column_number, first_sheet_path

PART = 4096
#: One stream holds both kinds: a row has cells, a shared string has ``text``.
STREAM = "file_id string, nth long, cells array<struct<col: int, value: string, ref: int>>, text string, error string"
_SCHEMA = pa.schema([("file_id", pa.string()), ("nth", pa.int64()),
                     ("cells", pa.list_(pa.struct([("col", pa.int32()), ("value", pa.string()), ("ref", pa.int32())]))),
                     ("text", pa.string()), ("error", pa.string())])


def elements(source, tag: str) -> Iterator[ET.Element]:
    """Elements ``tag`` of an XML stream, one at a time; what they leave in
    their parents is dropped."""
    open_ = []
    for event, el in ET.iterparse(source, events=("start", "end")):
        if event == "start":
            open_.append(el)
            continue
        open_.pop()
        if el.tag == tag:
            yield el
        if el.tag == tag or not any(x.tag == tag for x in open_):
            el.clear()
            if open_:
                open_[-1].remove(el)


def cell_of(c: ET.Element) -> dict:
    """A cell: its column and its text, or the number of its shared string."""
    kind, v = c.get("t", ""), c.find(_M + "v")
    raw = (v.text or "") if v is not None else ""
    col = column_number(c.get("r", ""))
    if kind == "s":
        try:
            ref = int(raw)
        except ValueError:
            ref = None
        known = ref is not None and abs(ref) < 1 << 31
        return {"col": col, "value": None if known else "", "ref": ref if known else None}
    if kind == "inlineStr":
        inner = c.find(_M + "is")
        raw = _text_of(inner) if inner is not None else ""
    return {"col": col, "value": raw, "ref": None}


def stream(data: bytes) -> Iterator[tuple[str, object]]:
    """``("text", string)`` per shared string, then ``("cells", cells)`` per row."""
    try:
        zf = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise WorkbookError(f"Invalid XLSX: {e}") from None
    path, names = first_sheet_path(zf)
    if "xl/sharedStrings.xml" in names:
        with zf.open("xl/sharedStrings.xml") as f:
            for si in elements(f, _M + "si"):
                yield "text", _text_of(si)
    with zf.open(path) as f:
        for row in elements(f, _M + "row"):
            yield "cells", [cell_of(c) for c in row.iter(_M + "c")]


def _stream_files(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file_id, data = b.column(0)[i].as_py(), b.column(1)[i].as_py() or b""
                out, n = [], {"text": 0, "cells": 0}
                try:
                    for kind, value in stream(data):
                        out.append({"file_id": file_id, "nth": n[kind], kind: value})
                        n[kind] += 1
                        if len(out) >= PART:
                            yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                            out = []
                except Exception as e:  # reader failure: the file's error row; its other rows are dropped below
                    out.append({"file_id": file_id, "error": str(e)})
                if out:
                    yield pa.RecordBatch.from_pylist(out, _SCHEMA)
    return files.mapInArrow(run, STREAM)


def _lines(rows: DataFrame) -> DataFrame:
    """``file_id, nth, line`` with shared strings filled in; blank rows other
    than the first are dropped."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, lines = [], []
            for k, (nth, cells, found) in enumerate(zip(*(b.column(c).to_pylist() for c in ("nth", "cells", "found")), strict=True)):
                texts = {f["k"]: f["text"] for f in found or []}
                line: list = [None] * max((c["col"] for c in cells), default=0)
                for i, c in enumerate(cells):
                    line[c["col"] - 1] = c["value"] if c["ref"] is None else texts.get(i, "")
                if nth == 0 or any(line):
                    keep.append(k)
                    lines.append(line)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("file_id").take(at), b.column("nth").take(at), pa.array(lines, pa.list_(pa.string()))],
                                             ["file_id", "nth", "line"])
    return rows.select("file_id", "nth", "cells", "found").mapInArrow(run, "file_id string, nth long, line array<string>")


def parse_workbooks(files: DataFrame, file_id: str = "file_id", content: str = "content") -> DataFrame:
    """``file_id, record_number, payload, error`` of workbooks held as bytes."""
    read = materialize(_stream_files(files.select(F.col(file_id).cast("string"), F.col(content).cast("binary"))))
    rows = read.where("cells IS NOT NULL").select("file_id", "nth", "cells")
    strings = read.where("text IS NOT NULL").select("file_id", F.col("nth").cast("int").alias("ref"), "text")
    # as in the list reader, a negative number counts from the end
    last = strings.groupBy("file_id").agg((F.max("ref") + 1).alias("size"))
    refs = rows.select("file_id", "nth", F.posexplode("cells").alias("k", "c")).where("c.ref IS NOT NULL").select(
        "file_id", "nth", "k", F.col("c.ref").alias("ref"))
    negative = refs.where("ref < 0").join(last, "file_id").select("file_id", "nth", "k", (F.col("ref") + F.col("size")).alias("ref"))
    found = refs.where("ref >= 0").unionByName(negative).join(strings, ["file_id", "ref"]).groupBy("file_id", "nth").agg(
        F.collect_list(F.struct("k", "text")).alias("found"))
    lines = materialize(_lines(rows.join(found, ["file_id", "nth"], "left")))
    blank = F.transform("line", lambda v: F.coalesce(v, F.lit("")))
    header = lines.where("nth = 0").select("file_id", blank.alias("header"))
    errors = read.where("error IS NOT NULL").select("file_id", "error").unionByName(
        header.where("size(array_distinct(header)) < size(header)").select("file_id", F.lit("Duplicate header").alias("error")))
    errors = errors.groupBy("file_id").agg(F.max("error").alias("error"), F.min("error").alias("other"))
    errors = errors.select("file_id", F.when(F.col("error") == "Duplicate header", F.col("other")).otherwise(F.col("error")).alias("error"))
    body = number_within(lines.where("nth > 0"), ["file_id"], ["nth"], "record_number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [jsvalues.record_text({h: (line[i] if i < len(line) else None) for i, h in enumerate(names)})
                     for names, line in zip(b.column("header").to_pylist(), b.column("line").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("record_number"), pa.array(texts, pa.string())],
                                             ["file_id", "record_number", "payload"])
    records = body.join(header, "file_id").mapInArrow(run, "file_id string, record_number long, payload string")
    none = F.lit(None)
    return records.join(errors, "file_id", "left_anti").withColumn("error", none.cast("string")).unionByName(
        errors.select("file_id", none.cast("long").alias("record_number"), none.cast("string").alias("payload"), "error"))
