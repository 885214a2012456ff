"""Language-model scoring by online logistic context mixing.

A document's words (A-Z lower-cased, single spaces, then an end byte) are
coded bit by bit along a Huffman tree of byte frequencies. For every bit,
predictors of several orders look up what followed the same context (the last
bytes and the tree node) in the training documents, as log odds. A
gate (which orders know the context) picks one of 16 weight vectors, the
weighted sum is refined by an adaptive correction per probability class, and
the logistic of the sum is the bit's probability. Weights and corrections
start from values fitted on training documents and go on learning online,
every ``STEP`` bits of a document, from that document alone: so scores do not
depend on the order or the place of documents, and are true probabilities.
Their sum of logarithms is the document's score; divided by the bytes it gives
bits per byte.

Training documents are those whose crc32(doc_id as text) mod 7 is not 2. Of
them, remainder 3 fits weights and corrections, and the others fill the
context tables, so weights are not fitted on contexts a text supplied itself.

Scale: texts are packed once into compressed blocks of bounded size. Context
counts and token counts grow with the corpus, are kept by slice and are never
broadcast: a block sends its distinct words, and its distinct contexts with
the byte that follows, once, and gets back counts and log odds in its order.
So a frequent context costs an entry per block, not one per use. Contexts are
told apart exactly (at most six bytes fit a 64-bit key), so none is blurred by
another one however large the input is.

Defined cases: a null text is an empty one, whose only token is the end; a
null doc_id counts as the text "" for the split; repeated rows are documents
of their own; texts are scored whole, however long; without training documents
counts are zero and every bit has probability 1/2 at first; other columns are
ignored; an empty table gives an empty result. Words are told apart by 64-bit
hashes.
"""

from __future__ import annotations

import heapq
import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once_each, saved, table, words
from .shingles import mix, word_hashes

ORDERS = (1, 2, 3, 4, 6)
TABLE_BITS = (20, 21, 22, 22, 22)  # of small models in memory (``slots``) alone
SUB = 8  # parts of a slice of contexts, which are summed one by one
BLOCK_BYTES, BLOCK_DOCS, PART_BYTES, PART_DOCS, TRAIN_BYTES = 8 << 20, 16384, 1 << 20, 4096, 64 << 20
STEP, RATE, FIX_RATE, CLASSES, GATES = 256, 0.02, 0.05, 33, 16
END = 10
HELD_OUT, WEIGHT_FOLD, FOLDS = 2, 3, 7
_U = np.uint64


def fold(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


# --- blocks of texts ------------------------------------------------------------

BLOCK_DDL = "block string, ids array<bigint>, n_bytes bigint, texts binary"


def text_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of normalised texts, one per line, compressed. Names are unique,
    whatever the blocks hold; the saved table fixes them."""
    def run(it):
        pack = zstandard.ZstdCompressor(level=3)
        ids, texts, size = [], [], 0

        def flush():
            raw = b"".join(t + b"\n" for t in texts)
            return pa.RecordBatch.from_pydict({
                "block": [uuid.uuid4().hex], "ids": pa.array([ids], pa.list_(pa.int64())), "n_bytes": pa.array([len(raw)], pa.int64()),
                "texts": pa.array([pack.compress(raw)], pa.binary())})
        for b in it:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = b" ".join(words((t.as_py() or "").encode("utf-8", "surrogatepass")))
                ids.append(i)
                texts.append(text)
                size += len(text) + 1
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCK_DDL)


def unpacked(raw: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(raw).split(b"\n")[:-1]


def rows_of(b: pa.RecordBatch):
    """Rows of a batch, one at a time: a block is large."""
    for i in range(b.num_rows):
        yield tuple(c[i].as_py() for c in b.columns)


def packed(x: np.ndarray) -> bytes:
    """Numbers, compressed byte place by byte place."""
    return zstandard.ZstdCompressor(level=1).compress(x.view("u1").reshape(len(x), x.itemsize).T.tobytes())


def unpacked_numbers(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "u1").reshape(size, -1).T).view(kind).ravel()


# --- token counts ----------------------------------------------------------------

def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of texts in groups of bounded bytes, for its arrays are
    several times as large as the texts."""
    at = np.cumsum([0, *(len(t) + 1 for t in texts)]) // PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(at[:-1])) + 1).tolist(), len(texts)]
    got = [word_hashes(texts[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
    return np.concatenate([h for h, _ in got]), np.concatenate([n for _, n in got])


def vocabulary(texts: list[bytes], ids: list, slices: int):
    """Distinct words of a block in order of (slice, hash): their hashes,
    slices, uses in training documents, and for every word of the block its
    place among them and its document."""
    hashes, per_doc = hashed_words(texts)
    doc = np.repeat(np.arange(len(texts)), per_doc)
    # told apart by their high bits, which fit 64 bits with places, unless two hashes share those
    low = _U(max(len(hashes) - 1, 0).bit_length())
    one, place = distinct_of(hashes >> low)
    distinct = hashes[one]
    if not np.array_equal(distinct[place], hashes):
        distinct, place = np.unique(hashes, return_inverse=True)
    train = np.array([fold(i) != HELD_OUT for i in ids], bool)
    uses = np.bincount(place[train[doc]], minlength=len(distinct))
    part = (distinct >> _U(33)).astype("i8") % slices
    order = np.argsort(part, kind="stable")
    back = np.empty(len(order), "i8")
    back[order] = np.arange(len(order))
    return distinct[order], part[order], uses[order], back[place], doc


def token_counts(blocks: DataFrame, slices: int) -> tuple[DataFrame, int, int]:
    """Per block and slice, the corpus counts of the block's words in their
    order, packed; the number of distinct training words and of their uses."""
    def send(it):
        for b in it:
            for name, ids, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                h, part, uses, _, _ = vocabulary(unpacked(raw), ids, slices)
                cuts = np.searchsorted(part, np.arange(slices + 1))
                out = [(s, name, packed(np.diff(h[x:y], prepend=_U(0))), packed(uses[x:y].astype("<u4")))
                       for s, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.binary()),
                                                        strict=True)], ["slice", "block", "hashes", "uses"])

    def total(g: pa.Table) -> pa.Table:
        blocks_, hashes, uses = (g.column(c).to_pylist() for c in ("block", "hashes", "uses"))
        every = [np.cumsum(unpacked_numbers(x, "<u8"), dtype=_U) for x in hashes]
        distinct, place = np.unique(np.concatenate(every), return_inverse=True)
        c = np.bincount(place, np.concatenate([unpacked_numbers(x, "<u4") for x in uses]), len(distinct)).astype("i8")
        cuts = np.cumsum([0, *map(len, every)])
        counts = [packed(c[place[x:y]].astype("<u8")) for x, y in zip(cuts, cuts[1:], strict=False)]
        n = len(blocks_)
        return pa.table({"block": pa.array([*blocks_, ""], pa.string()), "slice": pa.array([g.column("slice")[0].as_py()] * (n + 1), pa.int32()),
                         "counts": pa.array([*counts, None], pa.binary()),
                         "distinct": pa.array([0] * n + [int((c > 0).sum())], pa.int64()),
                         "uses": pa.array([0] * n + [int(c.sum())], pa.int64())})
    sent = blocks.select("block", "ids", "texts").mapInArrow(send, "slice int, block string, hashes binary, uses binary")
    got = saved(sent.groupBy("slice").applyInArrow(
        total, "block string, slice int, counts binary, distinct bigint, uses bigint"), "token-counts")
    v, n = got.agg(F.sum("distinct"), F.sum("uses")).first()
    return got.where("counts IS NOT NULL").select("block", "slice", "counts"), int(v or 0), int(n or 0)


# --- bits -------------------------------------------------------------------------

class Code:
    """Huffman code of the bytes: per byte its path of nodes and bits."""

    def __init__(self, counts: list[int]):
        heap = [(c + 1, b, b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        up: dict[int, tuple[int, int]] = {}
        node = 256
        while len(heap) > 1:
            (x, _, a), (y, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            up[a], up[b] = (node, 0), (node, 1)
            heapq.heappush(heap, (x + y, node, node))
            node += 1
        paths = []
        for b in range(256):
            path, at = [], b
            while at in up:
                at, bit = up[at]
                path.append((at - 256, bit))
            paths.append(path[::-1])
        self.length = np.array([len(p) for p in paths], "i4")
        self.first = np.concatenate(([0], np.cumsum(self.length)[:-1])).astype("i4")
        self.nodes = np.array([n for p in paths for n, _ in p], "u4")
        self.bits = np.array([b for p in paths for _, b in p], "u1")
        #: Bytes in order of their paths: those below any node are neighbours.
        self.ranked = np.array(sorted(range(256), key=lambda b: [bit for _, bit in paths[b]]), "i4")
        self.rank = np.argsort(self.ranked).astype("u8")

    def expand(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every bit of bytes ``x``: its byte's place, tree node and value."""
        n = self.length[x]
        ends = np.cumsum(n, dtype="i4")
        byte = np.repeat(np.arange(len(x), dtype="i4"), n)
        at = np.repeat(self.first[x] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0, dtype="i4")
        return byte, self.nodes[at], self.bits[at]


def contexts(x: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Per order, the hash of the bytes before each byte, back to its text's begin."""
    since = np.arange(len(x)) - begin
    c, out = np.zeros(len(x), _U), []
    for k in range(1, max(ORDERS) + 1):
        before = np.full(len(x), END, _U)
        before[k:] = x[:-k] if k <= len(x) else 0
        before[since < k] = END
        c = (c << _U(8)) | before
        if k in ORDERS:
            out.append(((c + _U(k)) * _U(0x9E3779B97F4A7C15) >> _U(32)).astype("u4"))
    return out


def parts(texts: list[bytes]) -> list[list[int]]:
    """Text numbers in groups of bounded bytes and texts, longer texts first,
    so that texts of a group have similar lengths."""
    out, size = [], 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        if not out or size >= PART_BYTES or len(out[-1]) >= PART_DOCS:
            out.append([])
            size = 0
        out[-1].append(i)
        size += len(texts[i]) + 1
    return out


def slots(texts: list[bytes], code: Code):
    """Bits of ``texts`` for a model in memory: hashed table places per order, values, and the place of
    each text's first bit (with the total at the end)."""
    x = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], "i8")
    starts = np.cumsum(sizes) - sizes
    byte, node, bit = code.expand(x)
    spread = node * np.uint32(0x9E3779B1)
    at = [((h >> np.uint32(32 - bits))[byte] + spread) & np.uint32((1 << bits) - 1)
          for h, bits in zip(contexts(x, np.repeat(starts, sizes)), TABLE_BITS, strict=True)]
    bits_before = np.concatenate(([0], np.cumsum(code.length[x], dtype="i8")))
    return at, bit, np.concatenate((bits_before[starts], bits_before[-1:]))


# --- context counts ---------------------------------------------------------------

def byte_code(blocks: DataFrame) -> Code:
    """The code for the byte frequencies of training texts (256 sums)."""
    def run(it):
        n = np.zeros(256, "i8")
        for b in it:
            for ids, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                some = b"\n".join(t for i, t in zip(ids, unpacked(raw), strict=True) if fold(i) != HELD_OUT) + b"\n"
                n += np.bincount(np.frombuffer(some, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(n)], ["byte", "n"])
    got = blocks.select("ids", "texts").mapInArrow(run, "byte bigint, n bigint").groupBy("byte").agg(F.sum("n").alias("n"))
    counts = [0] * 256
    for r in got.collect():
        counts[r["byte"]] = r["n"]
    return Code(counts)


def distinct_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct number, in their order, and each
    number's place among them (as ``np.unique``; numbers are sorted with their
    places in their low bits, which takes a fraction of the time)."""
    n = len(x)
    low = max(n - 1, 0).bit_length()
    if int(x.max(initial=0)).bit_length() + low <= 64:
        s = (x << _U(low)) | np.arange(n, dtype=_U)
        s.sort()
        order = (s & _U((1 << low) - 1)).astype("i8")
        s >>= _U(low)
    else:
        order = np.argsort(x, kind="stable")
        s = x[order]
    new = np.ones(n, bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    place = np.empty(n, "i4")
    place[order] = np.cumsum(new, dtype="i4") - 1
    return order[new], place


def numbered(x: np.ndarray) -> np.ndarray:
    """The number of each one's value, of sorted ``x``."""
    new = np.zeros(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.cumsum(new, dtype="u8")


class Grams:
    """A block's contexts of every order with the byte that follows each: the
    distinct ones in order of (part, order, key). A key has the order, the
    context (nearest byte first) and the byte's rank."""

    def __init__(self, texts: list[bytes], code: Code, parts_: int, trains: list[bool] | None = None):
        self.code, self.texts = code, texts
        self.sizes = np.array([len(t) + 1 for t in texts], "i8")
        s = self.keys_of(range(len(texts)))[1]
        s <<= _U(1)
        if trains is not None:
            s |= np.repeat(np.asarray(trains, bool), self.sizes)
        s.sort()
        new = np.ones(len(s), bool)
        for i in range(1, len(s), 1 << 20):
            np.greater(s[i:i + (1 << 20)] ^ s[i - 1:i - 1 + (1 << 20)][:len(s) - i], 1, out=new[i:i + (1 << 20)])
        first = np.flatnonzero(new)
        uses = np.add.reduceat(s.view("u1")[::8] & np.uint8(1), first, dtype="u4") if len(s) else np.zeros(0, "u4")
        key = s[first] >> _U(1)
        del s, new, first
        #: The distinct contexts of the highest order with their bytes.
        self.top = key
        keys, counts, place, places = [], [], None, []
        for k in sorted(ORDERS, reverse=True):  # each from the distinct ones of the order above
            keys.append(key | _U(k << 56))
            counts.append(uses)
            places.append(place)
            lower = max((o for o in ORDERS if o < k), default=k)
            if lower < k:
                key = (key >> _U(8 + 8 * (k - lower)) << _U(8)) | key & _U(255)
                one, up = distinct_of(numbered(key >> _U(8)) << _U(8) | key & _U(255))
                key, uses = key[one], np.bincount(up, uses, len(one)).astype("u4")
                place = up if place is None else up[place]
        first = np.cumsum([0, *map(len, keys)])
        every = np.concatenate(keys)
        del key, keys
        part = ((mix(every >> _U(8)) >> _U(33)) % _U(parts_)).astype("u2" if parts_ <= 1 << 16 else "u4")
        order = np.argsort(part, kind="stable")
        every = every[order]
        lengths = code.length[code.ranked[(every & _U(255)).astype("u1")]]
        at = np.empty(len(order), "i4" if lengths.sum(dtype="i8") < 1 << 31 else "i8")
        at[order] = np.cumsum(lengths, dtype="i8") - lengths
        #: Per order, where the log odds of each of ``top`` begin.
        self.at = [at[first[i]:first[i + 1]] if p is None else at[first[i]:first[i + 1]][p] for i, p in enumerate(places)][::-1]
        if trains is not None:
            self.keys, self.part, self.uses = every, part[order], np.concatenate(counts)[order]

    def keys_of(self, some) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of texts ``some`` and the key of the highest order of each."""
        raw = b"".join([bytes([END]) * 8, *(self.texts[i] + b"\n" for i in some)])
        x = np.frombuffer(raw, "u1")[8:]
        key = np.ndarray((len(x),), "<u8", raw, strides=(1,)) >> _U(16)  # the six bytes before each one
        sizes = self.sizes[some]
        starts = np.cumsum(sizes) - sizes
        for since in range(max(ORDERS)):  # back to its text's begin alone
            at = starts[sizes > since] + since
            low = _U((1 << 8 * (6 - since)) - 1)
            key[at] = key[at] & ~low | _U(END * 0x010101010101) & low
        key <<= _U(8)
        for i in range(0, len(x), 1 << 20):
            key[i:i + (1 << 20)] |= self.code.rank[x[i:i + (1 << 20)]]
        return x, key

    def bits(self, some: list[int], odds: np.ndarray):
        """Of texts ``some``: per order and bit the log odds, the bits' values,
        and the place of each text's first bit (with the total at the end)."""
        x, key = self.keys_of(some)
        # told apart by the four nearest bytes first: those and their places fit 64 bits
        _, near = distinct_of(key >> _U(24))
        one, place = distinct_of(near.astype(_U) << _U(24) | key & _U(0xFFFFFF))
        found = np.searchsorted(self.top, key[one])
        begin = [at[found] for at in self.at]
        del key, near, one, found
        eight = np.concatenate((odds, np.zeros(8, "i1")))
        eight = np.ndarray((len(odds) + 1,), "<u8", eight, strides=(1,))  # the eight log odds from each place on
        eight = [eight[at] for at in begin]
        length = self.code.length[x]
        before = np.concatenate(([0], np.cumsum(length, dtype="i8")))
        bit, out = np.empty(before[-1], "u1"), np.empty((len(ORDERS), before[-1]), "i1")
        for i in range(0, len(x), 1 << 15):  # few at once, which stay near the processor
            n = length[i:i + (1 << 15)]
            first = before[i:i + len(n)] - before[i]
            y = np.arange(n.sum())
            here = slice(before[i], before[i] + len(y))
            np.take(self.code.bits, y + np.repeat(self.code.first[x[i:i + (1 << 15)]] - first, n), out=bit[here], mode="clip")
            y += np.repeat(np.arange(len(n)) * 8 - first, n)
            for o, e in zip(out, eight, strict=True):
                np.take(e.take(place[i:i + (1 << 15)]).view("i1"), y, out=o[here], mode="clip")
        long = np.flatnonzero(length > 8)  # of paths longer than that the rest
        n = length[long] - 8
        y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 8
        for o, at in zip(out, begin, strict=True):
            o[np.repeat(before[long], n) + y] = odds[np.repeat(at[place[long]], n) + y]
        return out, bit, before[np.concatenate(([0], np.cumsum(self.sizes[some])))]


def path_odds(keys: np.ndarray, counts: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """For sorted distinct ``keys`` with their counts: for every bit of each
    one's byte, 16 times the log odds of a 1 at that node of its context, as
    signed bytes (0: unseen), and where each key's bits begin."""
    context, byte = keys >> _U(8), code.ranked[(keys & _U(255)).astype("i8")]
    length = code.length[byte]
    begin = np.cumsum(length, dtype="i8") - length
    out = np.zeros(int(length.sum()), "i1")
    live = np.arange(len(keys))
    for d in range(int(length.max(initial=0))):
        live = live[length[live] > d]
        path = code.first[byte[live]] + d
        c, node, n = context[live], code.nodes[path], counts[live]
        starts = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (node[1:] != node[:-1]))))
        one = np.add.reduceat(n * code.bits[path], starts)
        zero = np.add.reduceat(n, starts) - one
        q = np.clip(np.rint(16 * np.log((one + 0.4) / (zero + 0.4))), -127, 127).astype("i1")
        q[(q == 0) & (one > zero)], q[(q == 0) & (one < zero)] = 1, -1
        out[begin[live] + d] = np.repeat(q, np.diff(np.append(starts, len(live))))
    return out, begin


def context_odds(blocks: DataFrame, code: Code, slices: int) -> DataFrame:
    """``block, slice, odds``: the log odds (``path_odds``) of the block's
    contexts in their order, packed by part, from the counts of all training
    documents that do not fit weights."""
    def send(it):
        for b in it:
            for name, ids, raw in rows_of(b):
                g = Grams(unpacked(raw), code, slices * SUB, [fold(i) not in (HELD_OUT, WEIGHT_FOLD) for i in ids])
                cuts = np.searchsorted(g.part, np.arange(slices * SUB + 1)).tolist()
                keys = [packed(np.diff(g.keys[x:y], prepend=_U(0))) for x, y in zip(cuts, cuts[1:], strict=False)]
                uses = [packed(g.uses[x:y].astype("<u4")) for x, y in zip(cuts, cuts[1:], strict=False)]
                for s in range(slices):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s], pa.int32()), pa.array([name], pa.string()),
                         pa.array([keys[s * SUB:(s + 1) * SUB]], pa.list_(pa.binary())),
                         pa.array([uses[s * SUB:(s + 1) * SUB]], pa.list_(pa.binary()))], ["slice", "block", "keys", "uses"])

    def total(g: pa.Table) -> pa.Table:
        pack = zstandard.ZstdCompressor(level=1)
        keys, uses = g.column("keys").to_pylist(), g.column("uses").to_pylist()
        out: list[list[bytes]] = [[] for _ in keys]
        for s in range(SUB):
            every = [np.cumsum(unpacked_numbers(k[s], "<u8"), dtype=_U) for k in keys]
            cuts = np.cumsum([0, *map(len, every)]).tolist()
            distinct, place = np.unique(np.concatenate(every), return_inverse=True)
            n = np.concatenate([unpacked_numbers(u[s], "<u4") for u in uses])
            odds, begin = path_odds(distinct, np.bincount(place, n, len(distinct)), code)
            length = np.diff(np.append(begin, len(odds)))
            for o, x, y in zip(out, cuts, cuts[1:], strict=False):
                m = length[place[x:y]]
                at = np.repeat(begin[place[x:y]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                o.append(pack.compress(odds[at].tobytes()))
        return pa.table({"block": g.column("block"), "slice": g.column("slice"), "odds": pa.array(out, pa.list_(pa.binary()))})
    sent = blocks.select("block", "ids", "texts").mapInArrow(send, "slice int, block string, keys array<binary>, uses array<binary>")
    return sent.groupBy("slice").applyInArrow(total, "block string, slice int, odds array<binary>")


def whole(got: list) -> np.ndarray:
    """A block's log odds from its rows of all slices."""
    read = zstandard.ZstdDecompressor()
    return np.frombuffer(b"".join(read.decompress(p) for r in once_each(got) for p in r["odds"]), "i1")


# --- mixing -----------------------------------------------------------------------

class Mixer:
    """Weights per gate (the last is a constant's) and corrections per class."""

    def __init__(self, weights: np.ndarray | None = None, fixes: np.ndarray | None = None):
        n = len(ORDERS) + 1
        self.weights = np.tile(np.array([0.3] * (n - 1) + [0.0], "f4"), (GATES, 1)) if weights is None else weights
        self.fixes = np.zeros((GATES, CLASSES), "f4") if fixes is None else fixes

    def run(self, tables: list[np.ndarray], texts: list[bytes], code: Code) -> np.ndarray:
        """Bits of every text by a model in memory."""
        at, bit, first = slots(texts, code)
        return self.mixed(np.stack([t.take(a) for t, a in zip(tables, at, strict=True)]), bit, first)

    def mixed(self, odds: np.ndarray, bit: np.ndarray, first: np.ndarray, shared: bool = False) -> np.ndarray:
        """Bits of every text, given the log odds of its bits. Each text learns
        from its own start; with ``shared`` (for fitting) all go on from the
        same weights instead, which keep what they learnt."""
        gate = ((odds[2] != 0) + 2 * (odds[3] != 0).astype("u1") + 4 * (odds[4] != 0).astype("u1")
                + 8 * (np.abs(odds[4].astype("i2")) > 32).astype("u1")).astype("u1")
        count, n = len(first) - 1, len(ORDERS)
        lanes = 1 if shared else count
        w = np.tile(self.weights, (lanes, 1)).T.copy()  # (input, lane and gate)
        fix = np.tile(self.fixes, (lanes, 1))
        bits, sizes, unit = np.zeros(count), np.diff(first), np.float32(1 / 16)
        for s in range(0, int(sizes.max(initial=0)), STEP):
            live = np.flatnonzero(sizes > s)
            size = np.minimum(sizes[live] - s, STEP)
            ends = np.cumsum(size)
            j = np.repeat(first[live] + s - (ends - size), size) + np.arange(ends[-1])
            # a step's bits in order of (text, gate): each such row of weights has one run
            cell = gate.take(j)
            if not shared:
                cell = np.repeat(np.arange(len(live), dtype="u2" if len(live) * GATES <= 1 << 16 else "i8") * GATES, size) + cell
            order = np.argsort(cell, kind="stable")
            j, cell = j[order], cell[order]
            starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            runs = np.diff(np.append(starts, len(j)))
            row = cell[starts].astype("i8")
            if not shared:
                row = live[row // GATES] * GATES + row % GATES
            x = [o.take(j).astype("f4") for o in odds]
            z = np.repeat(w[n, row], runs)
            for k in range(n):
                z += np.repeat(w[k, row] * unit, runs) * x[k]
            cell = np.repeat(np.arange(len(row), dtype="i4") * CLASSES, runs)
            cell += np.clip(np.rint(z * 2) + CLASSES // 2, 0, CLASSES - 1).astype("i4")
            z += fix[row].ravel().take(cell)
            z = np.clip(z, -16, 16)
            y = bit.take(j).astype("f4")
            cost = np.log(1 + np.exp((1 - 2 * y) * z).astype("f8"))
            if shared:
                bits += np.bincount(np.repeat(live, size)[order], cost, count)
            else:
                bits[live] += np.add.reduceat(cost, ends - size)
            err = y - 1 / (1 + np.exp(-z))
            # a step's mean gradient, times what its number of bits is worth
            scale = (RATE * np.sqrt(runs) / runs).astype("f4")
            for k in range(n):
                w[k, row] += scale * unit * np.add.reduceat(err * x[k], starts, dtype="f8").astype("f4")
            w[n, row] += scale * np.add.reduceat(err, starts, dtype="f8").astype("f4")
            # counts and sums of errors (each below 1) in one number
            both = np.bincount(cell, err.astype("f8") + 16384, len(row) * CLASSES).reshape(-1, CLASSES)
            cells = np.rint(both / 16384)
            fix[row] += (FIX_RATE * (both - cells * 16384) / (cells + 8)).astype("f4")
        if shared:
            self.weights, self.fixes = w.T.copy(), fix
        return bits / math.log(2)


def fit_mixer(looked: RDD, code: Code, slices: int, tasks: int) -> Mixer:
    """Weights and corrections fitted online on the weight fold: each task
    learns in turn from its texts, and the tasks' results are averaged by bits."""
    def run(it):
        m, bits = Mixer(), 0
        for ids, raw, got, _ in it:
            mine = [i for i, d in enumerate(ids) if fold(d) == WEIGHT_FOLD]
            if not mine:
                continue
            texts = unpacked(raw)
            g, odds = Grams(texts, code, slices * SUB), whole(got)
            for part in parts([texts[i] for i in mine]):
                found, bit, first = g.bits([mine[i] for i in part], odds)
                for k in range(0, len(part), 16):
                    cut = first[k:k + 17]
                    m.mixed(found[:, cut[0]:cut[-1]], bit[cut[0]:cut[-1]], cut - cut[0], shared=True)
                bits += sum(len(texts[mine[i]]) + 1 for i in part)
            del g, odds, found  # before the next block's
        yield np.concatenate((m.weights.ravel(), m.fixes.ravel(), [1])).astype("f8") * bits
    n = GATES * (len(ORDERS) + 1)
    got = looked.coalesce(tasks).mapPartitions(run).treeAggregate(np.zeros(n + GATES * CLASSES + 1), np.add, np.add)
    if not got[-1]:
        return Mixer()
    flat = (got[:-1] / got[-1]).astype("f4")
    return Mixer(flat[:n].reshape(GATES, -1).copy(), flat[n:].reshape(GATES, CLASSES).copy())


SCORE_DDL = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
             "base_score double, score double, n_bytes bigint, bits_per_byte double")


def scores(docs: DataFrame) -> DataFrame:
    """A row of ``SCORE_DDL`` per document."""
    blocks = saved(text_blocks(docs), "text-blocks")
    size, n_docs = blocks.agg(F.sum("n_bytes"), F.sum(F.size("ids"))).first()
    train_docs = sum_of(blocks, lambda i: fold(i) != HELD_OUT)
    slices = max(12, -(-int(size or 0) // (32 << 20)))
    tasks = max(6, -(-int(size or 0) // TRAIN_BYTES))
    counts, distinct, uses = token_counts(blocks, slices)
    # the end is a token too
    v, n = distinct + (train_docs > 0), uses + train_docs
    code = byte_code(blocks)
    odds = context_odds(blocks, code, slices).groupBy("block").agg(F.collect_list(F.struct("slice", "odds")).alias("odds"))
    per_block = counts.groupBy("block").agg(F.collect_list(F.struct("slice", "counts")).alias("counts"))
    looked = blocks.select("block", "ids", "texts").join(odds, "block").join(per_block, "block", "left")
    looked = looked.select("ids", "texts", "odds", "counts").rdd  # shuffled once for fitting and scoring, and stored no second time
    mixer = fit_mixer(looked, code, slices, tasks)

    def run(it):
        for ids, raw, found, got in it:
            texts = unpacked(raw)
            _, _, _, place, doc = vocabulary(texts, ids, slices)
            c = np.concatenate([np.zeros(0, "<u8"), *(unpacked_numbers(x["counts"], "<u8") for x in once_each(got or []))])[place]
            k = len(texts)
            tokens = np.bincount(doc, minlength=k) + 1
            known = np.bincount(doc, c > 0, k).astype("i8") + (train_docs > 0)
            base = (np.bincount(doc, np.log10(c + 1.0), k) + math.log10(train_docs + 1)
                    - tokens * math.log10(n + v + 1))
            del c, place, doc
            bits = np.zeros(k)
            g, odds = Grams(texts, code, slices * SUB), whole(found)
            for part in parts(texts):
                bits[part] = mixer.mixed(*g.bits(part, odds))
            del g, odds  # before the next block's
            size = np.array([len(t) + 1 for t in texts], "i8")
            yield from zip(ids, [fold(i) == HELD_OUT for i in ids], tokens.tolist(), known.tolist(), [n] * k, base.tolist(),
                           (-bits * math.log10(2)).tolist(), size.tolist(), (bits / size).tolist(), strict=True)
    return docs.sparkSession.createDataFrame(looked.mapPartitions(run), SCORE_DDL, verifySchema=False)


def sum_of(blocks: DataFrame, holds) -> int:
    """Number of documents whose id ``holds``."""
    def run(it):
        n = sum(bool(holds(i)) for b in it for ids in b.column(0).to_pylist() for i in ids)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])
    return int(blocks.select("ids").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0)


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


#: Online mixing cannot be told in SQL. The counts and base scores are tested
#: against a brute-force version, the model on tiny texts and by its held-out score.
SQL = None
