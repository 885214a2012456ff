"""Parse dispatch (I11, I12): route each file by extension to its reader.

* ``.pdf`` -> one record ``{"extracted_text": text}`` (lossy UTF-8, no
  extraction), a JVM-only projection;
* ``.csv``/``.tsv``/``.json``/``.xlsx``/``.xlsm`` -> one ``mapInPandas``
  pass; each task parses whole files one at a time and yields records in
  bounded chunks. Arrow input batches are capped by
  ``spark.sql.execution.arrow.maxBytesPerBatch``, so blob rows stay bounded;
* anything else -> error ``Unsupported parser: <ext>``.

A reader failure quarantines that one file with its reason (error row with a
null record number); the batch goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources import delimited, jsondoc, workbook

RECORD_SCHEMA = "file_id string, record_number long, payload string, error string"
PYTHON_LANE = (".csv", ".tsv", ".json", ".xlsx", ".xlsm")
CHUNK = 8192


def extension_of(name: Column) -> Column:
    """Lower-cased text from the last dot, else ``""``."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)\z", 1))


def decode_text(data: bytes) -> str:
    text = data.decode("utf-8", errors="replace")
    return text[1:] if text.startswith("\ufeff") else text


def _records(ext: str, data: bytes):
    if ext in (".csv", ".tsv"):
        return delimited.records_of(decode_text(data), ext)
    if ext == ".json":
        return jsondoc.records_of(decode_text(data))
    return workbook.records_of(data)


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parse whole files; a file's records are emitted only once it parsed
    fully (a file is either all records or one error row). Records of many
    small files are gathered into output batches of up to ``CHUNK`` rows."""
    cols = ["file_id", "record_number", "payload", "error"]
    ids: list = []
    nums: list = []
    payloads: list = []
    errors: list = []

    def flush():
        out = pd.DataFrame({"file_id": ids, "record_number": nums, "payload": payloads, "error": errors},
                           columns=cols)
        ids.clear(), nums.clear(), payloads.clear(), errors.clear()
        return out

    for pdf in batches:
        for file_id, ext, data in zip(pdf["file_id"], pdf["extension"], pdf["content"]):
            try:
                recs = list(_records(ext, bytes(data)))
            except Exception as e:  # reader failure -> quarantine this file
                ids.append(file_id), nums.append(None), payloads.append(None), errors.append(str(e))
                continue
            for i, payload in enumerate(recs, start=1):
                ids.append(file_id), nums.append(i), payloads.append(payload), errors.append(None)
                if len(ids) >= CHUNK:
                    yield flush()
            if len(ids) >= CHUNK:
                yield flush()
    if ids:
        yield flush()


def parse_partitions(spark) -> int:
    """Tasks for the CPU-bound Python lane: at least one per core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def parse_files(files: DataFrame, file_id: str = "file_id", filename: str = "filename",
                content: str = "content", partitions: int | None = None) -> DataFrame:
    """All files -> ``(file_id, record_number, payload, error)``.

    A file is either fully parsed or quarantined with one error row.
    ``partitions``: hash-spread the Python-lane files over this many tasks. Use it
    when the input comes out of a shuffle that AQE may have coalesced into a
    few partitions (parsing is CPU-bound); an explicit count is kept by AQE.
    Leave it unset for files read straight from storage (already split).
    """
    raw = F.col(content)
    data = raw if dict(files.dtypes)[content] == "binary" else raw.cast("binary")
    base = files.select(F.col(file_id).cast("string").alias("file_id"),
                        extension_of(F.col(filename)).alias("extension"),
                        data.alias("content"))

    text = F.make_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(text, r"\A\x{FEFF}", "")
    pdf_lane = (base.filter(F.col("extension") == ".pdf")
                .select("file_id", F.lit(1).cast("long").alias("record_number"),
                        F.to_json(F.struct(text.alias("extracted_text"))).alias("payload"),
                        F.lit(None).cast("string").alias("error")))
    bad = (base.filter(~F.col("extension").isin(".pdf", *PYTHON_LANE))
           .select("file_id", F.lit(None).cast("long").alias("record_number"),
                   F.lit(None).cast("string").alias("payload"),
                   F.concat(F.lit("Unsupported parser: "), F.col("extension")).alias("error")))
    py_files = base.filter(F.col("extension").isin(*PYTHON_LANE))
    if partitions:
        py_files = py_files.repartition(partitions, "file_id")
    py_lane = py_files.mapInPandas(_parse_batches, RECORD_SCHEMA)
    return py_lane.unionByName(pdf_lane).unionByName(bad)


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine). A failed file has exactly one error row and no
    record, so both sides are plain filters of one parse."""
    records = parsed.filter(F.col("error").isNull()).drop("error")
    errors = parsed.filter(F.col("error").isNotNull()).select("file_id", "error")
    return records, errors
