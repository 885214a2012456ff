"""Exact readers for one big file in many tasks.

A file is given as byte ranges ``(file_id, pos, data)``, cut anywhere, with
``pos`` ascending through the file. ``read_ranges`` makes them of stored files
with Spark's splittable text source. No task holds a whole file:

1. every range tells, for each state it may start in, the state it ends in:
   inside or outside quotes for delimited text; inside or outside a string,
   after a backslash or not, and the change of depth for JSON;
2. a scan over these summaries (one narrow row per range, streamed in order)
   fixes the state each range starts in, and the last earlier range that holds
   a row end: there the row still open at the range's start began;
3. every range then cuts its bytes at row ends (JSON: commas between elements).
   Rows inside it are parsed there; the first and last piece are fragments,
   and fragments of one row meet by (file, range where it began);
4. counts of rows per range and their prefix sums number the records.

Results equal the whole-file readers' (``delimited.records_of``,
``jsondoc.records_of``): CR and LF each end a row, as the blank row inside a
CRLF is dropped anyway; a character cut in two is whole again in its row; bad
UTF-8 is replaced row by row with the same result, as row ends are ASCII. A
file that cannot be read is one error row. JSON errors name the element.

Ranges whose file has no row end in them (one huge row) meet in one row, as a
record does in any reader.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import jsvalues
from quarry.functions.grouping import materialize
from quarry.sources import jsondoc
from quarry.sources.delimited import DELIMITERS, ParseError, split_rows
from quarry.sources.dispatch import decode_text

RANGE_BYTES = 1 << 20
#: ``k`` of the row that is open at a range's end; its other rows have 0, 1, ...
OPEN = 1 << 40
PIECES = "file_id string, at long, k long, part long, row array<string>, fragment binary, error string"
PARSED = "file_id string, record_number long, payload string, error string"


def read_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Stored text files as ranges of whole lines. Spark splits the files;
    ``pos`` is the split's begin and a number within it."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("begin"),
        F.col("value").cast("binary").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, k, held, size = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file_id": [now[0]], "pos": [(now[1] << 20) + k], "data": [b"".join(held)]})
        for b in batches:
            for f, begin, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (f, begin) != now or size >= range_bytes:
                    if held:
                        yield flush()
                    now, k, held, size = (f, begin), k + 1 if (f, begin) == now else 0, [], 0
                held += (line, b"\n")
                size += len(line) + 1
        if held:
            yield flush()
    return lines.mapInArrow(run, "file_id string, pos long, data binary")


def cut(files: DataFrame, range_bytes: int = RANGE_BYTES, file_id: str = "file_id", content: str = "content") -> DataFrame:
    """Contents held in rows as ranges."""
    data = F.col(content).cast("binary")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.octet_length(data).cast("long") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    at = files.select(F.col(file_id).cast("string").alias("file_id"), data.alias("data"), F.explode(starts).alias("pos"))
    return at.select("file_id", "pos", F.expr(f"substring(data, cast(pos + 1 as int), {int(range_bytes)})").alias("data"))


# -- states and cuts of one range --------------------------------------------

def bytes_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def row_ends(data: bytes, inside: int) -> np.ndarray:
    """Places of CR and LF outside quotes."""
    b = bytes_of(data)
    odd = (np.cumsum(b == 34) + inside) & 1
    return np.flatnonzero(((b == 10) | (b == 13)) & (odd == 0))


def json_marks(data: bytes, inside: int, escaped: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Per byte: outside strings, and the change of depth; then the state after
    the last byte. A quote after an odd run of backslashes is part of a string."""
    b, at = bytes_of(data), np.arange(len(data))
    slash = b == 92
    last = np.maximum.accumulate(np.where(slash, -1, at)) if len(b) else at
    run = np.where(last < 0, at + 1 + escaped, at - last)  # backslashes up to here
    before = np.concatenate(([escaped], np.where(slash, run, 0)[:-1])) if len(b) else at
    quotes = np.cumsum((b == 34) & (before % 2 == 0)) + inside
    outside = (quotes & 1 == 0) & (b != 34)
    depth = np.where(outside & ((b == 91) | (b == 123)), 1, 0) - np.where(outside & ((b == 93) | (b == 125)), 1, 0)
    if not len(b):
        return outside, depth, inside, escaped
    return outside, depth, int(quotes[-1] & 1), int(run[-1] & 1) if slash[-1] else 0


def commas(data: bytes, inside: int, escaped: int, depth: int) -> np.ndarray:
    """Places of the commas between elements of the document's array."""
    outside, change, _, _ = json_marks(data, inside, escaped)
    return np.flatnonzero((bytes_of(data) == 44) & outside & (depth + np.cumsum(change) == 1))


def first_line_counts(data: bytes) -> tuple[bool, list[int]]:
    """Whether an LF is in ``data``, and the delimiters before the first one."""
    line, lf, _ = data.partition(b"\n")
    return bool(lf), [line.count(d.encode()) for d in DELIMITERS]


# -- scans -------------------------------------------------------------------

def scanned(summaries: DataFrame, walk: Callable, ddl: str) -> DataFrame:
    """``walk(rows of one file in order)`` for every file: summaries are
    narrow, stream through, and only what ``walk`` holds is in memory."""
    names = [f.split()[0] for f in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for b in batches:
                yield from b.to_pylist()
        out = []
        for row in walk(rows()):
            out.append(row)
            if len(out) == 8192:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(names, ddl.split(", "), strict=True)])
    return summaries.repartition("file_id").sortWithinPartitions("file_id", "pos").mapInArrow(run, ddl)


def _walk_delimited(rows: Iterator[dict]) -> Iterator[dict]:
    """State, place of the open row and delimiter of each range. The delimiter
    is known at the first LF; ranges before it wait (the first line's)."""
    file_id, waiting = None, []
    for r in rows:
        if r["file_id"] != file_id:
            yield from _with_delimiter(waiting, counts if file_id is not None else None)
            file_id, inside, open_at, waiting, counts, known = r["file_id"], 0, -1, [], [0] * len(DELIMITERS), False
        waiting.append({"file_id": file_id, "pos": r["pos"], "inside": inside, "open_at": open_at})
        if r["ends_inside"] if inside else r["ends_outside"]:
            open_at = r["pos"]
        inside = (inside + r["quotes"]) & 1
        if not known:
            counts = [a + b for a, b in zip(counts, r["counts"], strict=True)]
            known = r["lf"]
        if known:
            yield from _with_delimiter(waiting, counts)
            waiting = []
    if file_id is not None:
        yield from _with_delimiter(waiting, counts)


def _with_delimiter(rows: list[dict], counts: list[int] | None) -> Iterator[dict]:
    if rows:
        best = DELIMITERS[counts.index(max(counts))]
        yield from ({**r, "delimiter": best} for r in rows)


def _walk_json(rows: Iterator[dict]) -> Iterator[dict]:
    """State, depth, place of the open element and kind of document of each range."""
    file_id = None
    for r in rows:
        if r["file_id"] != file_id:
            file_id, inside, escaped, depth, open_at, is_array = r["file_id"], 0, 0, 0, -1, None
        if is_array is None and r["first"] is not None:
            is_array = r["first"] == ord("[")
        yield {"file_id": file_id, "pos": r["pos"], "inside": inside, "escaped": escaped, "depth": depth,
               "open_at": open_at, "is_array": bool(is_array)}
        state = r["states"][inside + escaped]
        if is_array and 1 - depth in state["commas"]:
            open_at = r["pos"]
        inside, escaped, depth = state["inside"], state["escaped"], depth + state["change"]


# -- pieces ------------------------------------------------------------------

def _pieces(placed: DataFrame, cut_range: Callable, parse: Callable) -> DataFrame:
    """Rows and fragments of every range (``PIECES``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in (x for i in range(b.num_rows) for x in b.slice(i, 1).to_pylist()):
                data, pos, out = r["data"], r["pos"], []
                ends = cut_range(r)
                if len(ends):
                    first, last = int(ends[0]), int(ends[-1])
                    out.append((r["open_at"], OPEN, pos, None, data[:first], None))
                    if last > first:
                        rows, error = parse(data[first + 1:last], len(ends) - 1, r)
                        out += [(pos, k, pos, row, None, None) for k, row in enumerate(rows)]
                        if error:
                            out.append((pos, 0, pos, None, None, error))
                    out.append((pos, OPEN, pos, None, data[last + 1:], None))
                else:
                    out.append((r["open_at"], OPEN, pos, None, data, None))
                cols = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r["file_id"]] * len(out), pa.string()), *map(pa.array, cols, types)],
                                                 ["file_id", "at", "k", "part", "row", "fragment", "error"])
    return materialize(placed.mapInArrow(run, PIECES))


def _joined(pieces: DataFrame, facts: DataFrame, parse: Callable) -> DataFrame:
    """Rows put together from fragments: ``file_id, at, k, row, error``; ``parse(bytes,
    first in the file, last in the file, fact)`` gives (row or None, error)."""
    open_rows = pieces.where("fragment IS NOT NULL").groupBy("file_id", "at").agg(
        F.array_sort(F.collect_list(F.struct("part", "fragment"))).alias("parts"))
    whole = open_rows.select("file_id", "at", F.expr("transform(parts, x -> x.fragment)").alias("parts")).join(facts, "file_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                row, error = parse(b"".join(r["parts"]), r["at"] == -1, r["at"] == r["last_at"], r["fact"])
                if row is not None or error:
                    out.append({"file_id": r["file_id"], "at": r["at"], "k": OPEN, "row": row, "error": error})
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("file_id", pa.string()), ("at", pa.int64()), ("k", pa.int64()), ("row", pa.list_(pa.string())), ("error", pa.string())]))
    return whole.mapInArrow(run, "file_id string, at long, k long, row array<string>, error string")


def _numbered(pieces: DataFrame, joined: DataFrame) -> DataFrame:
    """``file_id, nth, row`` with ``nth`` from 0 through each file."""
    cols = ["file_id", "at", "k", "row"]
    rows = pieces.where("row IS NOT NULL").select(*cols).unionByName(joined.where("row IS NOT NULL").select(*cols))
    inner = F.count(F.when(F.col("k") < OPEN, 1))
    counts = rows.groupBy("file_id", "at").agg(F.count(F.lit(1)).alias("n"), inner.alias("inner"))
    before = Window.partitionBy("file_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    counts = counts.select("file_id", "at", "inner", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(counts, ["file_id", "at"]).select(
        "file_id", (F.col("before") + F.least("k", "inner")).alias("nth"), "row")


def _file_facts(pieces: DataFrame, facts: DataFrame) -> DataFrame:
    last = pieces.where("fragment IS NOT NULL").groupBy("file_id").agg(F.max("at").alias("last_at"))
    return facts.join(last, "file_id")


def _with_errors(records: DataFrame, errors: DataFrame) -> DataFrame:
    """Records of files without an error, and a row for each with one."""
    good = records.join(errors, "file_id", "left_anti").withColumn("error", F.lit(None).cast("string"))
    none = F.lit(None)
    return good.unionByName(errors.select("file_id", none.cast("long").alias("record_number"), none.cast("string").alias("payload"), "error"))


# -- readers -----------------------------------------------------------------

def parse_delimited_split(ranges: DataFrame, delimiter: str | None = None) -> DataFrame:
    """I8 over ranges: ``file_id, record_number, payload, error``. ``delimiter``:
    that of all files (``.tsv``); by default each file's first line tells."""
    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for f, pos, data in zip(*(b.column(n) for n in ("file_id", "pos", "data")), strict=True):
                raw = data.as_py() or b""
                lf, counts = first_line_counts(raw)
                out.append({"file_id": f.as_py(), "pos": pos.as_py(), "quotes": raw.count(b'"') & 1, "ends_outside": bool(len(row_ends(raw, 0))),
                            "ends_inside": bool(len(row_ends(raw, 1))), "lf": lf, "counts": counts})
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("file_id", pa.string()), ("pos", pa.int64()), ("quotes", pa.int32()), ("ends_outside", pa.bool_()), ("ends_inside", pa.bool_()),
                ("lf", pa.bool_()), ("counts", pa.list_(pa.int64()))]))
    ranges = ranges.select(F.col("file_id").cast("string").alias("file_id"), F.col("pos").cast("long").alias("pos"),
                           F.coalesce("data", F.lit(b"")).alias("data"))
    summaries = materialize(ranges.mapInArrow(summary, "file_id string, pos long, quotes int, ends_outside boolean, ends_inside boolean, "
                                                       "lf boolean, counts array<long>"))
    starts = scanned(summaries, _walk_delimited, "file_id string, pos long, inside int, open_at long, delimiter string")
    if delimiter:
        starts = starts.withColumn("delimiter", F.lit(delimiter))
    starts = materialize(starts)

    def rows_of(data: bytes, _most: int, r: dict) -> tuple[list, str | None]:
        return split_rows(data.decode("utf-8", "replace"), r["delimiter"]), None

    def row_of(data: bytes, first: bool, _last: bool, delim: str) -> tuple[list[str] | None, str | None]:
        text = decode_text(data) if first else data.decode("utf-8", "replace")
        try:
            rows = split_rows(text, delim)
        except ParseError as e:
            return None, str(e)
        return (rows[0] if rows else None), None
    pieces = _pieces(ranges.join(starts, ["file_id", "pos"]), lambda r: row_ends(r["data"], r["inside"]), rows_of)
    facts = _file_facts(pieces, starts.groupBy("file_id").agg(F.first("delimiter").alias("fact")))
    joined = materialize(_joined(pieces, facts, row_of))
    rows = materialize(_numbered(pieces, joined))

    header = rows.where("nth = 0").select("file_id", F.col("row").alias("header"))
    again = F.expr("filter(header, (h, i) -> array_position(header, h) <= i)")
    errors = joined.where("error IS NOT NULL").select("file_id", "error")
    doubled = header.select("file_id", F.get(again, F.lit(0)).alias("name")).where("name IS NOT NULL")
    errors = errors.unionByName(doubled.select("file_id", F.concat(F.lit("Duplicate header: "), "name").alias("error")))
    errors = errors.groupBy("file_id").agg(F.max("error").alias("error"))  # an unclosed field is told first

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for names, row in zip(b.column("header").to_pylist(), b.column("row").to_pylist(), strict=True):
                cells = row[:len(names)] + [None] * (len(names) - len(row))
                texts.append(jsvalues.record_text(dict(zip(names, cells, strict=True))))
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("nth"), pa.array(texts, pa.string())],
                                             ["file_id", "record_number", "payload"])
    records = rows.where("nth > 0").join(header, "file_id").mapInArrow(payloads, "file_id string, record_number long, payload string")
    return _with_errors(records, errors)


def parse_json_split(ranges: DataFrame) -> DataFrame:
    """I9 over ranges: ``file_id, record_number, payload, error``."""
    states = [(0, 0), (1, 0), (1, 1)]

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for f, pos, data in zip(*(b.column(n) for n in ("file_id", "pos", "data")), strict=True):
                raw, found = data.as_py() or b"", []
                for inside, escaped in states:
                    outside, change, i, e = json_marks(raw, inside, escaped)
                    level = np.cumsum(change)
                    found.append({"inside": i, "escaped": e, "change": int(level[-1]) if len(raw) else 0,
                                  "commas": np.unique(level[(bytes_of(raw) == 44) & outside]).tolist()})
                text = raw.lstrip(b" \t\r\n\xef\xbb\xbf")
                out.append({"file_id": f.as_py(), "pos": pos.as_py(), "first": text[0] if text else None, "states": found})
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("file_id", pa.string()), ("pos", pa.int64()), ("first", pa.int32()),
                ("states", pa.list_(pa.struct([("inside", pa.int32()), ("escaped", pa.int32()), ("change", pa.int64()),
                                               ("commas", pa.list_(pa.int64()))])))]))
    ranges = ranges.select(F.col("file_id").cast("string").alias("file_id"), F.col("pos").cast("long").alias("pos"),
                           F.coalesce("data", F.lit(b"")).alias("data"))
    summaries = ranges.mapInArrow(summary, "file_id string, pos long, first int, states array<struct<inside: int, escaped: int, change: long, "
                                           "commas: array<long>>>")
    starts = materialize(scanned(summaries, _walk_json, "file_id string, pos long, inside int, escaped int, depth long, open_at long, "
                                                        "is_array boolean"))

    def elements(data: bytes, count: int, _r: dict) -> tuple[list, str | None]:
        try:
            got = [[x] for x in jsondoc.records_of("[" + data.decode("utf-8", "replace") + "]")]
            return (got, None) if len(got) == count else ([], "Invalid JSON: Expecting value")
        except (ValueError, RecursionError) as e:
            return [], str(e)

    def element(data: bytes, first: bool, last: bool, is_array: bool) -> tuple[list[str] | None, str | None]:
        text = decode_text(data) if first else data.decode("utf-8", "replace")
        try:
            if not is_array:
                return list(jsondoc.records_of(text)), None
            blank = " \t\r\n"
            if first:
                text = text.lstrip(blank)
                if not text.startswith("["):
                    raise ValueError("Invalid JSON: Expecting value")
                text = text[1:]
            if last:
                text = text.rstrip(blank)
                if not text.endswith("]"):
                    raise ValueError("Invalid JSON: the array does not end with the document")
                text = text[:-1]
            if first and last and not text.strip(blank):
                return None, None
            if not text.strip(blank):
                raise ValueError("Invalid JSON: Expecting value")
            got = list(jsondoc.records_of("[" + text + "]"))
            if len(got) != 1:
                raise ValueError("Invalid JSON: brackets do not match")
            return got, None
        except (ValueError, RecursionError) as e:
            return None, str(e)
    pieces = _pieces(ranges.join(starts, ["file_id", "pos"]),
                     lambda r: commas(r["data"], r["inside"], r["escaped"], r["depth"]) if r["is_array"] else [], elements)
    facts = _file_facts(pieces, starts.groupBy("file_id").agg(F.max("is_array").alias("fact")))
    joined = materialize(_joined(pieces, facts, element))
    failed = pieces.where("error IS NOT NULL").select("file_id", "at", "k", "error").unionByName(
        joined.where("error IS NOT NULL").select("file_id", "at", "k", "error"))
    errors = failed.groupBy("file_id").agg(F.min_by("error", F.struct("at", "k")).alias("error"))
    records = _numbered(pieces, joined).select("file_id", (F.col("nth") + 1).alias("record_number"), F.col("row")[0].alias("payload"))
    return _with_errors(records, errors)
