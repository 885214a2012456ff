"""Best-fit packing of tokenised documents into sequences of fixed length.

A document is its token ids, then a separator id. One longer than the
sequence length is cut into full pieces, of which the first takes the rest
(so it may be shorter); full pieces fill a sequence of their own. All other
pieces are packed by bounded-space online best fit: a fixed number of bins is
open, a bitset has bit f set when an open bin has f free places, a piece goes
to the bin with the least sufficient space, and when all bins are in use the
fullest closes.

Scale: texts are read and encoded in the map tasks; only lengths and sums of
ids travel. Pieces are dealt evenly by hash over shards of a bounded number of
pieces, each packed on its own, so a hot source or document spreads over all
shards. What sharding costs is the open bins left at each shard's end.

Defined cases: a null text is an empty document (the separator alone);
repeated rows are packed as documents of their own; null ids are kept; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .tokens import encoder, tokenizer_path

LENGTH, SEPARATOR_ID = 2048, 0
OPEN_BINS, SHARD_PIECES = 4096, 200_000


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    first = n % length or min(n, length)
    return [(0, first), *((at, length) for at in range(first, n, length))]


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, separator: int = SEPARATOR_ID,
                 keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, packed as
    little-endian unsigned 32-bit, with ``keep_ids``)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def run(it):
        enc, end = encoder(tokenizer), int(separator).to_bytes(4, "little")
        for b in it:
            cols = [[] for _ in names]
            for i, t in enumerate(b.column(1)):
                ids = enc.packed(t.as_py() or "") + end
                for k, (at, n) in enumerate(cuts(len(ids) // 4, length)):
                    raw = ids[4 * at:4 * (at + n)]
                    for c, v in zip(cols, (i, k, at, n, zlib.crc32(raw), raw), strict=False):
                        c.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=False)]
            arrays[0] = b.column(0).take(arrays[0])
            yield pa.RecordBatch.from_arrays(arrays, names)
    ddl = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def best_fit(lengths: list[int], length: int = LENGTH, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """Bin and offset of every item, in order, by bounded-space best fit."""
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    free_bits, by_free, n_open, n_bins = 0, [[] for _ in range(length + 1)], 0, 0
    for i, n in enumerate(lengths):
        fit = free_bits >> n
        if fit:
            free = n + (fit & -fit).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                free_bits ^= 1 << free
            n_open -= 1
        else:
            if n_open >= open_bins:  # the fullest closes
                tight = (free_bits & -free_bits).bit_length() - 1
                by_free[tight].pop()
                if not by_free[tight]:
                    free_bits ^= 1 << tight
                n_open -= 1
            b, free, n_bins = n_bins, length, n_bins + 1
        bins[i], offsets[i] = b, length - free
        left = free - n
        if left:
            if not by_free[left]:
                free_bits |= 1 << left
            by_free[left].append(b)
            n_open += 1
    return bins, offsets


def pack(pieces: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``pieces`` should be a
    stored table: it is read twice (for its size, then for the packing)."""
    part = pieces.where(F.col("length") < length)
    shards = max(1, -(-part.count() // shard_pieces))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = part.withColumn("order", order).withColumn("shard", F.pmod("order", F.lit(shards)).cast("int"))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["order", "doc_id", "piece"], kind="stable", ignore_index=True)
        bins, offsets = best_fit(g["length"].tolist(), length, open_bins)
        g["sequence_id"] = np.array(bins, "i8") * shards + int(g["shard"].iloc[0])
        g["offset"] = np.array(offsets, "i8")
        return g[schema.names]
    packed = dealt.groupBy("shard").applyInPandas(run, schema)
    full = (pieces.where(F.col("length") >= length)
            .withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, keep_ids: bool = False, separator: int = SEPARATOR_ID, **options) -> DataFrame:
    """The packed pieces of ``docs``; with ``keep_ids`` each with its token ids
    (``ids``, packed), which meet their places by the stored row's number."""
    pieces = token_pieces(docs, tokenizer, options.get("length", LENGTH), separator, keep_ids)
    if not keep_ids:
        return pack(saved(pieces, "pieces"), **options)
    pieces = saved(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(pieces.drop("ids"), **options).join(pieces.select("row", "ids"), "row").drop("row")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


#: SQL has no tokenizer; the query is tested against a brute-force version.
SQL = None
