"""Exact n-gram Jaccard self-join with signature trees.

Documents are sets of 5-word shingles; two link when 100 * |A & B| >= 80 *
|A | B|. Texts with equal sets are one class, which is compared once.

Routing. Under any fixed order of shingles, linked sets share one of the first
|A| // 5 + 1 shingles of each (prefix filter), so classes meet in a block per
prefix shingle. The order is by document frequency: rare ones first, so what
many documents share (a passage, a licence) is in the prefix of those only
that consist of little else, and shingles that one document alone has route
nothing. Blocks with equal members count once.

Trees. Within a block, classes are leaves of a signature tree: every leaf has
its size, the number of its shingles that others share, and a bitmap with a
bit per shingle (at least four places for each); a node has the OR of
its bitmaps, the ranges of sizes and shared shingles, and the largest number
of shingles beyond bits. A dual traversal from (root, root) drops a pair of
nodes if their size ranges exclude a link or the most shingles they can have
in common (common bits plus shingles beyond bits, and no more than either
shares with anyone) are too few. Surviving leaf pairs are verified on the
texts' whole sets.

Two rounds. First, blocks give their most promising pairs (each member with
the best earlier one), and in blocks of more than ``block`` classes all
members are compared with a few pivots. Verified links give components. Then
blocks whose members are of one component by now are dropped unseen, and all
others are searched for every pair of different components. Of a shingle that
many classes hold, each task makes sub-blocks of at most ``SUB * block`` holders; their summaries (ranges of sizes, largest cap, components) are
joined, and only pairs of sub-blocks that could hold a link are formed, each a
bounded group. Links found inside one component cannot change the result, so
components are exact although not every link of a group of copies is looked at.

Scale: texts are read once into compressed blocks of bounded size. For the
frequencies each block sends its distinct shingles once (32 bits each, in as
many slices as the corpus needs) and gets back their counts. Further on, only
class ids, signatures and the texts of candidate pairs (compressed) travel. A
task sends one row per shingle that many of its classes hold, not one per
holder. Nothing is gathered but a bitset of fixed size.

Defined cases: null or empty texts have an empty set, link with nothing and
are their own component; texts of one to four words have one shingle; rows
that repeat a doc_id are documents that link as their texts do; a null doc_id
is kept and never names a component unless the whole component has no other;
other columns are ignored; an empty table gives an empty result. Sets are
compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, once_each, saved, table, words
from .shingles import mix, set_id, shingle_sets

BLOCK, FANOUT, BITS_LOG = 64, 8, 24
MARK = -(1 << 63)  # stands for "many classes of one task hold this shingle"
_U = np.uint64
SLICE_SHINGLES, BLOCK_BYTES = 2_000_000, 4 << 20
DOC_DDL = "doc_id bigint, text_hash bigint, cid bigint, n int"
SIG_DDL = "cid bigint, n int, cap int, bits binary, keys binary"


def linked(both: int, a: int, b: int) -> bool:
    return 100 * both >= 80 * (a + b - both)


def need(total):
    """Least overlap of linked sets of ``total`` shingles together: ceil(4/9 total)."""
    return (4 * total + 8) // 9


# --- signatures ---------------------------------------------------------------

def bitmap(s: np.ndarray) -> bytes:
    width = max(256, 1 << (4 * len(s) - 1).bit_length())
    on = np.zeros(width, bool)
    on[(s & _U(width - 1)).astype("i8")] = True
    return np.packbits(on, bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap at a smaller width of ``size`` bytes, as 64-bit words."""
    a = np.frombuffer(bits, "<u8")
    while len(a) * 8 > size:
        a = a[:len(a) // 2] | a[len(a) // 2:]
    return a


def prefix(s: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The shingles that route a set: the first of its order that others
    share. ``df``: their document frequencies."""
    k = len(s) // 5 + 1 - int((df < 2).sum())
    if k <= 0:
        return s[:0]
    shared = df >= 2
    s, df = s[shared], df[shared]
    return s[np.lexsort((s, df))[:k]]


def in_bitset(bitset: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether the place of each 64-bit number is set."""
    at = (mix(x) >> _U(64 - BITS_LOG)).astype("i8")
    return (bitset[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitset_of(numbers: DataFrame) -> np.ndarray:
    """A bitset of 2 ** BITS_LOG places (a fixed size, whatever the data) of
    the numbers in the only column; gathered as at most 256 partial bitsets'
    union, each of one slice of the places."""
    slices = 256
    per = (1 << BITS_LOG) // 8 // slices

    def places(it):
        for b in it:
            x = b.column(0).to_numpy(zero_copy_only=False).view(_U)
            at = np.unique(mix(x) >> _U(64 - BITS_LOG)).astype("i8")
            yield pa.RecordBatch.from_arrays([pa.array(at // (per * 8)), pa.array(at % (per * 8))], ["slice", "at"])

    def union(g: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(per * 8, bool)
        on[g["at"].to_numpy()] = True
        return pd.DataFrame({"slice": [int(g["slice"].iloc[0])], "bits": [np.packbits(on, bitorder="little").tobytes()]})
    p = numbers.mapInArrow(places, "slice bigint, at bigint").distinct()
    out = np.zeros((1 << BITS_LOG) // 8, np.uint8)
    for r in p.groupBy("slice").applyInPandas(union, "slice bigint, bits binary").collect():
        out[r["slice"] * per:(r["slice"] + 1) * per] = np.frombuffer(r["bits"], np.uint8)
    return out


def encoded(column) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in column]


def small(batches, rows: int = 500):
    """Slices of record batches, so that a task holds few texts and sets at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def documents(docs: DataFrame) -> DataFrame:
    """Class id and set size of every document."""
    def run(it):
        for b in small(it):
            sets = shingle_sets(encoded(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([set_id(s) for s in sets], pa.int64()),
                 pa.array(list(map(len, sets)), pa.int32())], ["doc_id", "text_hash", "cid", "n"])
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, DOC_DDL)


def text_blocks(docs: DataFrame) -> DataFrame:
    """``block, cids, texts``: normalised texts, one per line, compressed; a
    class comes once per task at most, empty sets not at all. Names are unique,
    whatever the blocks hold; the saved table fixes them."""
    def run(it):
        seen: set[int] = set()
        pack = zstandard.ZstdCompressor(level=3)
        cids, texts, size = [], [], 0

        def flush():
            return pa.RecordBatch.from_pydict({
                "block": [uuid.uuid4().hex], "cids": pa.array([cids], pa.list_(pa.int64())),
                "texts": pa.array([pack.compress(b"".join(t + b"\n" for t in texts))], pa.binary())})
        for b in small(it):
            plain = [b" ".join(words(t)) for t in encoded(b.column(0))]
            for t, s in zip(plain, shingle_sets(plain), strict=True):
                cid = set_id(s)
                if len(s) and cid not in seen:
                    seen.add(cid)
                    cids.append(cid)
                    texts.append(t)
                    size += len(t) + 1
                    if size >= BLOCK_BYTES:
                        yield flush()
                        cids, texts, size = [], [], 0
        if cids:
            yield flush()
    return docs.select("text").mapInArrow(run, "block string, cids array<bigint>, texts binary")


def unpacked(raw: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(raw).split(b"\n")[:-1]


def sliced(sets: list[np.ndarray], slices: int):
    """Distinct shingles of a block by (slice, 32 bits): slices, bits, number
    of the block's sets that hold each, and each shingle's place among them."""
    h = np.concatenate(sets) if sets else np.zeros(0, _U)
    short = ((h >> _U(40)) % _U(slices)) << _U(32) | (h & _U(0xFFFFFFFF))
    distinct, place, n = np.unique(short, return_inverse=True, return_counts=True)
    return (distinct >> _U(32)).astype("i8"), distinct.astype("<u4"), np.minimum(n, 255).astype("u1"), place


def frequencies(blocks_: DataFrame, slices: int) -> DataFrame:
    """``block, slice, df``: how many sets of the corpus hold each of a
    block's distinct shingles, in their order (packed bytes; 255: or more).
    Two shingles may share 32 bits: a count may be too high, never too low."""
    def send(it):
        pack = zstandard.ZstdCompressor(level=1)
        for b in it:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part, bits, n, _ = sliced(shingle_sets(unpacked(raw)), slices)
                cuts = np.searchsorted(part, np.arange(slices + 1))
                out = [(s, name, pack.compress(np.diff(bits[x:y], prepend=np.uint32(0)).tobytes()), pack.compress(n[x:y].tobytes()))
                       for s, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.binary()),
                                                        strict=True)], ["slice", "block", "bits", "n"])

    def total(g: pa.Table) -> pa.Table:
        read, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        bits = [np.cumsum(np.frombuffer(read.decompress(x.as_py()), "<u4"), dtype="<u4") for x in g.column("bits")]
        n = np.concatenate([np.frombuffer(read.decompress(x.as_py()), "u1") for x in g.column("n")])
        distinct, place = np.unique(np.concatenate(bits), return_inverse=True)
        df = np.minimum(np.bincount(place, n, len(distinct)), 255).astype("u1")[place]
        cuts = np.cumsum([0, *map(len, bits)])
        return pa.table({"block": g.column("block"), "slice": g.column("slice"),
                         "df": pa.array([pack.compress(df[x:y].tobytes()) for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())})
    sent = blocks_.select("block", "texts").mapInArrow(send, "slice int, block string, bits binary, n binary")
    return sent.groupBy("slice").applyInArrow(total, "block string, slice int, df binary")


def signatures(blocks_: DataFrame, slices: int) -> DataFrame:
    """Classes that share enough to link: size, most shingles they can have in
    common with another (``cap``), bitmap and routing shingles."""
    df = frequencies(blocks_, slices).groupBy("block").agg(F.collect_list(F.struct("slice", "df")).alias("df"))

    def run(it):
        read = zstandard.ZstdDecompressor()
        for b in it:
            for cids, raw, got in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                sets = shingle_sets(unpacked(raw))
                *_, place = sliced(sets, slices)
                counts = np.frombuffer(b"".join(read.decompress(x["df"]) for x in once_each(got)), "u1")[place]
                rows, at = [], 0
                for cid, s in zip(cids, sets, strict=True):
                    mine = counts[at:at + len(s)]
                    at += len(s)
                    keys = prefix(s, mine)
                    if len(keys):
                        rows.append((cid, len(s), int((mine >= 2).sum()), bitmap(s), keys.tobytes()))
                if rows:
                    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                                     ["cid", "n", "cap", "bits", "keys"])
    return blocks_.join(df, "block").select("cids", "texts", "df").mapInArrow(run, SIG_DDL)


# --- blocks -------------------------------------------------------------------

ROUTE_DDL = "key bigint, cid bigint, pivot bigint, own bigint"
PIVOTS = 4
BLOCK_DDL = "kind string, fp bigint, members array<bigint>"


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in ``key``."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, "i8")
    return starts, np.diff(np.append(starts, len(key)))


def pivots_of(cids: np.ndarray, own: np.ndarray) -> list[int]:
    """Members that most others are likely to link with: those with the fewest
    shingles of their own (of a text's near copies, those closest to it)."""
    return cids[np.lexsort((mix(cids.view(_U)), own))[:PIVOTS]].tolist()


def routes(held: list[tuple[int, int, np.ndarray]], block: int) -> pa.RecordBatch:
    """(shingle, class) rows of one batch of classes. A shingle that more than
    ``block`` of them hold is sent with its pivots and a mark only, and its
    holders are only paired with the pivots."""
    sizes = [len(k) for *_, k in held]
    key = np.concatenate([k for *_, k in held]).view("i8") if held else np.zeros(0, "i8")
    cid, own = (np.repeat(np.array(c, "i8"), sizes) for c in ([c for c, *_ in held], [u for _, u, _ in held]))
    o = np.argsort(key, kind="stable")
    key, cid, own = key[o], cid[o], own[o]
    starts, n = runs(key)
    cols = [key, cid, np.full(len(key), MARK), own]
    if len(n) and n.max() > block:
        drop, more, pairs = np.zeros(len(key), bool), [], set()
        for s, m in zip(starts[n > block].tolist(), n[n > block].tolist(), strict=True):
            k, members, u = int(key[s]), cid[s:s + m], own[s:s + m]
            drop[s:s + m] = True
            more.append((k, MARK, MARK, 0))
            for p in pivots_of(members, u):
                more.append((k, p, MARK, int(u[np.flatnonzero(members == p)[0]])))
                pairs.update((c, p) for c in members.tolist() if c != p)
        more += [(c, c, p, 0) for c, p in pairs]
        extra = np.array(more, "i8").reshape(-1, 4)
        cols = [np.concatenate((c[~drop], extra[:, j])) for j, c in enumerate(cols)]
    return pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["key", "cid", "pivot", "own"])


def route(sigs: DataFrame, block: int) -> DataFrame:
    def run(it):
        held, size = [], 0
        for b in it:
            for c, u, k in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                held.append((c, u, np.frombuffer(k, _U)))
                size += len(k) // 8
                if size >= 2_000_000:
                    yield routes(held, block)
                    held, size = [], 0
        if held:
            yield routes(held, block)
    return sigs.select("cid", F.col("n") - F.col("cap"), "keys").mapInArrow(run, ROUTE_DDL)


def blocks(rows: DataFrame, tasks: int, block: int) -> DataFrame:
    """Blocks of classes that share a shingle: ``kind`` 'block' (all members
    may be compared) or 'star' (the first with the others; for shingles of more
    than ``block`` classes). Blocks of equal members have equal ``fp``."""
    names = ["key", "cid", "pivot", "own"]

    def run(it):
        got = [b for b in it if b.num_rows]
        if not got:
            return
        cols = [np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in got]) for n in names]
        yield from batched(found(*cols), BLOCK_SCHEMA)

    def found(key, cid, pivot, own):
        star = pivot != MARK
        for p in np.unique(pivot[star]).tolist():
            yield from stars(p, np.unique(cid[star & (pivot == p)]))
        o = np.lexsort((cid, key))
        o = o[~star[o]]
        key, cid, own = key[o], cid[o], own[o]
        if not len(key):
            return
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])))
        key, cid, own = key[new], cid[new], own[new]
        starts, n = runs(key)
        done: set[int] = set()
        for s, m in zip(starts[n > 1].tolist(), n[n > 1].tolist(), strict=True):
            members = cid[s:s + m]
            marked = bool(members[0] == MARK)
            if marked or m > block:
                for p in pivots_of(members[marked:], own[s + marked:s + m]):
                    yield from stars(p, members[marked:])
                continue
            fp = id_of(members)
            if fp not in done:
                done.add(fp)
                yield "block", fp, members.tolist()

    def stars(p, members):
        rest = members[members != p].tolist()
        for i in range(0, len(rest), 2 * block):
            part = [p, *rest[i:i + 2 * block]]
            yield "star", id_of(np.array(part, "i8")), part
    return rows.select(*names).repartition(tasks, "key").mapInArrow(run, BLOCK_DDL)


BLOCK_SCHEMA = pa.schema([("kind", pa.string()), ("fp", pa.int64()), ("members", pa.list_(pa.int64()))])


def batched(rows, schema: pa.Schema, most: int = 20_000):
    """Record batches of rows (tuples)."""
    out = []
    for r in rows:
        out.append(r)
        if len(out) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


# --- sub-blocks: what many classes share, in bounded parts ---------------------

SUB = 16  # a sub-block has at most so many times ``block`` classes
HELD_DDL = "key bigint, cid bigint, n int, cap int, comp bigint, sub array<bigint>, high int, other bigint"
HELD_SCHEMA = pa.schema([("key", pa.int64()), ("cid", pa.int64()), ("n", pa.int32()), ("cap", pa.int32()), ("comp", pa.int64()),
                         ("sub", pa.list_(pa.int64())), ("high", pa.int32()), ("other", pa.int64())])


def sub_blocks(key: int, cid, n, cap, comp, size: int, apart: int):
    """Rows of ``HELD_DDL`` for the holders of one shingle in parts of at most
    ``size``: members, the least and greatest set size, the largest cap, and
    the least and greatest component. Components with more than ``apart``
    holders have parts of their own (which meet nowhere), all others come by
    set size."""
    _, at, count = np.unique(comp, return_inverse=True, return_counts=True)
    own = np.where(count[at] > apart, comp, MARK)
    o = np.lexsort((cid, n, own))
    for s, m in zip(*(x.tolist() for x in runs(own[o])), strict=True):
        for i in range(s, s + m, size):
            at = o[i:min(i + size, s + m)]
            members = np.unique(cid[at])
            yield (key, id_of(members), int(n[at].min()), int(cap[at].max()), int(comp[at].min()), members.tolist(),
                   int(n[at].max()), int(comp[at].max()))


def merged(subs: list, size: int):
    """The sub-blocks of one shingle (rows of ``HELD_DDL``), of which those of
    many tasks are small, in fewer of at most ``size``: components with many
    holders by themselves, all others by set size."""
    count: dict[int, int] = {}
    for _, _, _, _, comp, members, _, other in subs:
        if comp == other:
            count[comp] = count.get(comp, 0) + len(members)
    own = [r[4] if r[4] == r[7] and count[r[4]] > size // 4 else MARK for r in subs]
    some: list = []
    for k in [*sorted(range(len(subs)), key=lambda k: (own[k], subs[k][2], subs[k][1])), None]:
        if some and (k is None or own[k] != own[some[0]] or sum(len(subs[i][5]) for i in some) + len(subs[k][5]) > size):
            if len(some) == 1:
                yield subs[some[0]]
            else:
                key, _, n, cap, comp, members, high, other = zip(*(subs[i] for i in some), strict=True)
                every = np.unique(np.concatenate([np.array(m, "i8") for m in members]))
                yield key[0], id_of(every), min(n), max(cap), min(comp), every.tolist(), max(high), max(other)
            some = []
        if k is not None:
            some.append(k)


def held(classes: DataFrame, block: int) -> DataFrame:
    """Per routing shingle its classes. A task that holds one more than
    ``block`` times sends sub-blocks of these holders (``sub`` is not null, ``cid`` is the
    sub-block's id), so no later task meets all holders of a frequent one.
    ``cap`` is what a class can share with another one if this shingle is the
    first they share in the common order: the ones before it do not count."""
    def run(it):
        some, size = [], 0
        for b in it:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                some.append((*row[:4], np.frombuffer(row[4], _U)))
                size += len(row[4]) // 8
                if size >= 2_000_000:
                    yield from batched(rows_of(some), HELD_SCHEMA)
                    some, size = [], 0
        if some:
            yield from batched(rows_of(some), HELD_SCHEMA)

    def rows_of(some):
        sizes = [len(k) for *_, k in some]
        key = np.concatenate([k for *_, k in some]).view("i8")
        cid, n, cap, comp = (np.repeat(np.array(c, "i8"), sizes) for c in list(zip(*some, strict=True))[:4])
        ends = np.cumsum(sizes)
        cap -= np.arange(len(key)) - np.repeat(ends - sizes, sizes)  # routing shingles are in that order
        o = np.argsort(key, kind="stable")
        key, cid, n, cap, comp = key[o], cid[o], n[o], cap[o], comp[o]
        starts, m = runs(key)
        plain = np.repeat(m <= block, m)
        yield from ((k, c, x, y, z, None, None, None) for k, c, x, y, z in
                    zip(*(v[plain].tolist() for v in (key, cid, n, cap, comp)), strict=True))
        for s, e in zip(starts[m > block].tolist(), (starts + m)[m > block].tolist(), strict=True):
            yield from sub_blocks(int(key[s]), cid[s:e], n[s:e], cap[s:e], comp[s:e], SUB * block, block // 4)
    return classes.select("cid", "n", "cap", "comp", "keys").mapInArrow(run, HELD_DDL)


def gathered(rows: DataFrame, tasks: int, block: int) -> DataFrame:
    """Rows of ``held`` by shingle: few holders are one block, more of them (or
    a shingle that has sub-blocks already) become sub-blocks, too, and small
    sub-blocks of a shingle one. The result has ``HELD_DDL``; a whole block's
    ``other`` is null."""
    def run(it):
        got = [b for b in it if b.num_rows]
        if not got:
            return
        yield from batched(found(pa.Table.from_batches(got)), HELD_SCHEMA)

    def found(t: pa.Table):
        is_sub = t.column("sub").is_valid().to_numpy()
        key, cid, n, cap, comp = (t.column(c).to_numpy() for c in ("key", "cid", "n", "cap", "comp"))
        keep = t.filter(pa.array(is_sub)).sort_by("key")
        hot_keys = np.sort(key[is_sub])
        hot = np.unique(hot_keys)
        left = set(hot.tolist())  # whose sub-blocks are all there is

        def merged_with(k: int, more):
            left.discard(k)
            x, y = np.searchsorted(hot_keys, k, "left"), np.searchsorted(hot_keys, k, "right")
            got = keep.slice(x, y - x)
            return merged([*zip(*(got.column(c).to_pylist() for c in HELD_SCHEMA.names), strict=True), *more], SUB * block)
        o = np.lexsort((cid, key))
        o = o[~is_sub[o]]
        key, cid, n, cap, comp = key[o], cid[o], n[o], cap[o], comp[o]
        starts, m = runs(key)
        mixed = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts) if len(key) else np.zeros(0, bool)
        frequent = np.isin(key[starts], hot) | (m > 2 * block)
        done: set[int] = set()
        for s, e, f in zip(starts[mixed | frequent].tolist(), (starts + m)[mixed | frequent].tolist(), frequent[mixed | frequent].tolist(), strict=True):
            if f:
                size = SUB * block
                yield from merged_with(int(key[s]), sub_blocks(int(key[s]), cid[s:e], n[s:e], cap[s:e], comp[s:e], size, size // 4))
                continue
            members = np.unique(cid[s:e])
            fp = id_of(members)
            if fp not in done and 10 * int(cap[s:e].max()) >= 8 * int(n[s:e].min()):
                done.add(fp)
                yield int(key[s]), fp, None, None, None, members.tolist(), None, None
        for k in sorted(left):
            yield from merged_with(k, [])
    return rows.repartition(tasks, "key").mapInArrow(run, HELD_DDL)


def sub_pairs(subs: DataFrame) -> DataFrame:
    """``a, b`` (a <= b): pairs of sub-blocks of one shingle in which classes
    could link, by the ranges of their sizes, their caps and components."""
    cols = ["key", F.col("cid").alias("fp"), F.col("n").alias("low"), "high", "cap", F.col("comp").alias("first"), F.col("other").alias("last")]
    x = subs.select(*cols).dropDuplicates(["key", "fp"])
    y = x.select("key", *[F.col(c).alias(f"{c}2") for c in x.columns[1:]])
    # the pair of least sizes that may link: need() of both, each at most 5/4 of the other
    least = F.expr("greatest(low, cast(ceil(low2 * 0.8) AS int)) + greatest(low2, cast(ceil(low * 0.8) AS int))")
    may = ((F.col("fp") <= F.col("fp2")) & (4 * F.col("low") <= 5 * F.col("high2")) & (4 * F.col("low2") <= 5 * F.col("high"))
           & (9 * F.least("cap", "cap2") >= 4 * least)
           & ((F.col("first") != F.col("last")) | (F.col("first2") != F.col("last2")) | (F.col("first") != F.col("first2"))))
    return x.join(y, "key").where(may).select(F.col("fp").alias("a"), F.col("fp2").alias("b")).distinct()


def block_rows(found: DataFrame) -> DataFrame:
    """``kind, fp, pos, cid``: a row per member of the blocks."""
    return found.select("kind", "fp", F.posexplode("members").alias("pos", "cid"))


def sub_rows(found: DataFrame) -> DataFrame:
    """``block_rows`` of whole blocks and of pairs of sub-blocks (``cross``:
    ``pos`` tells the side; a sub-block with itself is a plain block)."""
    whole = found.where("other IS NULL").select(F.lit("block").alias("kind"), F.col("cid").alias("fp"), F.col("sub").alias("members"))
    subs = found.where("other IS NOT NULL")
    members = subs.select(F.col("cid").alias("id"), "sub").dropDuplicates(["id"])
    pairs = sub_pairs(subs)
    alone = pairs.where("a = b").join(members, F.col("a") == F.col("id")).select(
        F.lit("block").alias("kind"), F.col("a").alias("fp"), F.col("sub").alias("members"))
    sides = pairs.where("a < b").select(F.xxhash64("a", "b").alias("fp"), F.posexplode(F.array("a", "b")).alias("pos", "id"))
    cross = sides.join(members, "id").select(F.lit("cross").alias("kind"), "fp", "pos", F.explode("sub").alias("cid"))
    return block_rows(whole.unionByName(alone).dropDuplicates(["kind", "fp"])).unionByName(cross)


def id_of(members: np.ndarray) -> int:
    return int(mix(mix(members.view(_U)).sum(dtype=_U, keepdims=True) + _U(len(members))).view("i8")[0])


# --- signature trees ----------------------------------------------------------

class Tree:
    """Leaves in order of size; node levels with ``FANOUT`` children each."""

    def __init__(self, n: np.ndarray, cap: np.ndarray, bits: list[bytes]):
        self.order = np.argsort(n, kind="stable")
        n, cap = n[self.order], cap[self.order]
        size = min(map(len, bits))
        maps = np.stack([folded(bits[i], size) for i in self.order])
        over = n - np.bitwise_count(maps).sum(1).astype("i8")  # shingles beyond bits
        self.levels = [(maps, n, n, cap, over)]
        while len(self.levels[-1][1]) > 1:
            w, low, high, c, o = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(w, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                                np.maximum.reduceat(c, at), np.maximum.reduceat(o, at)))

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether some classes below nodes a and b could link, by size range
        and by the most shingles they can share."""
        w, low, high, cap, over = self.levels[level]
        fits = (4 * low[a] <= 5 * high[b]) & (4 * low[b] <= 5 * high[a])
        fits &= np.minimum(cap[a], cap[b]) >= need(low[a] + low[b])
        a, b = a[fits], b[fits]
        common = np.bitwise_count(w[a] & w[b]).sum(1).astype("i8")
        most = np.minimum(common + np.minimum(over[a], over[b]), np.minimum(cap[a], cap[b]))
        fits[fits] = most >= need(low[a] + low[b])
        return fits

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf pairs (i < j, in the order of the input rows) that may link,
        and by how much the most they can share exceeds their need."""
        a = b = np.zeros(1, "i8")
        for level in range(len(self.levels) - 1, 0, -1):
            keep = self.may_link(level, a, b)
            a, b = a[keep], b[keep]
            below = len(self.levels[level - 1][1])
            x = (a[:, None] * FANOUT + np.arange(FANOUT)).repeat(FANOUT, 1).ravel()
            y = np.tile(b[:, None] * FANOUT + np.arange(FANOUT), (1, FANOUT)).ravel()
            ok = (x < below) & (y < below) & (x <= y)
            a, b = x[ok], y[ok]
        ok = a < b
        a, b = a[ok], b[ok]
        keep = self.may_link(0, a, b) if len(a) else np.zeros(0, bool)
        a, b = a[keep], b[keep]
        w, n, _, _, over = self.levels[0]
        most = np.bitwise_count(w[a] & w[b]).sum(1).astype("i8") + np.minimum(over[a], over[b])
        return self.order[a], self.order[b], most * 9 - 4 * (n[a] + n[b])


def fits_bitmaps(na: int, ca: int, a: bytes, nb: int, cb: int, b: bytes) -> bool:
    """The leaf test at the pair's own, larger width (sizes, caps, bitmaps)."""
    if 4 * max(na, nb) > 5 * min(na, nb) or min(ca, cb) < need(na + nb):
        return False
    size = min(len(a), len(b))
    x, y = folded(a, size), folded(b, size)
    common = int(np.bitwise_count(x & y).sum())
    over = min(na - int(np.bitwise_count(x).sum()), nb - int(np.bitwise_count(y).sum()))
    return min(common + over, ca, cb) >= need(na + nb)


def block_pairs(cid, n, cap, bits, comp, star: bool, few: bool, side=None) -> set[tuple[int, int]]:
    """Class pairs of one block to verify: of different components, with ``side``
    only those across, and with ``few`` only each member's most promising one."""
    if star:
        pairs = ((0, j) for j in range(1, len(cid)))
        return {tuple(sorted((cid[i], cid[j]))) for i, j in pairs
                if comp[i] != comp[j] and fits_bitmaps(n[i], cap[i], bits[i], n[j], cap[j], bits[j])}
    a, b, gain = Tree(np.array(n, "i8"), np.array(cap, "i8"), bits).pairs()
    out, used = set(), set()
    for k in np.argsort(-gain, kind="stable").tolist() if few else range(len(a)):
        i, j = int(a[k]), int(b[k])
        if comp[i] == comp[j] or few and i in used and j in used or side and side[i] == side[j]:
            continue
        if fits_bitmaps(n[i], cap[i], bits[i], n[j], cap[j], bits[j]):
            used |= {i, j}
            out.add(tuple(sorted((cid[i], cid[j]))))
    return out


def candidates(members: DataFrame, classes: DataFrame, few: bool, tasks: int) -> DataFrame:
    """Distinct pairs ``a, b`` of class ids to verify, by signature trees over
    blocks given as ``block_rows``. ``classes``: cid, n, cap, bits, comp."""
    rows = members.join(classes.select("cid", "n", "cap", "bits", "comp"), "cid").withColumn(
        "part", F.pmod(F.xxhash64("fp", "kind"), F.lit(tasks * 32)))

    def run(g: pa.Table) -> pa.Table:
        # bitmaps are large: they stay where they are, and a block's are taken in turn
        order = pc.sort_indices(g.select(["kind", "fp", "pos"]), [("kind", "ascending"), ("fp", "ascending"), ("pos", "ascending")])
        kind, fp, pos, cid, n, cap, comp = (g.column(c).take(order).to_pylist() for c in ("kind", "fp", "pos", "cid", "n", "cap", "comp"))
        order, held_bits = order.to_pylist(), g.column("bits")
        out: set[tuple[int, int]] = set()
        s = 0
        for e in range(1, len(fp) + 1):
            if e == len(fp) or (kind[e], fp[e]) != (kind[s], fp[s]):
                if len(set(comp[s:e])) > 1:
                    bits = [held_bits[i].as_py() for i in order[s:e]]
                    if e - s == 2:  # a tree of two leaves
                        if fits_bitmaps(n[s], cap[s], bits[0], n[s + 1], cap[s + 1], bits[1]):
                            out.add(tuple(sorted(cid[s:e])))
                    else:
                        out |= block_pairs(cid[s:e], n[s:e], cap[s:e], bits, comp[s:e], kind[s] == "star", few,
                                           pos[s:e] if kind[s] == "cross" else None)
                s = e
        pairs = sorted(out)
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})
    return rows.groupBy("part").applyInArrow(run, "a bigint, b bigint").distinct()


# --- verification -------------------------------------------------------------

def class_texts(blocks_: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``cid, packed``: a compressed text of every class in the bitset."""
    shared = blocks_.sparkSession.sparkContext.broadcast(wanted)

    def run(it):
        pack = zstandard.ZstdCompressor(level=3)
        for b in it:
            for cids, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = np.flatnonzero(in_bitset(shared.value, np.array(cids, "i8").view(_U)))
                texts = unpacked(raw) if len(at) else []
                yield pa.RecordBatch.from_arrays([pa.array([cids[i] for i in at], pa.int64()),
                                                  pa.array([pack.compress(texts[i]) for i in at], pa.binary())], ["cid", "packed"])
    return blocks_.select("cids", "texts").mapInArrow(run, "cid bigint, packed binary").dropDuplicates(["cid"])


def verify(blocks_: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets link."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    texts = class_texts(blocks_, bitset_of(ends)).join(ends, "cid", "left_semi")
    texts = saved(texts, "class-texts")

    def run(it):
        read = zstandard.ZstdDecompressor()
        last: tuple = (None, None)
        for b in it:
            out = []
            xs, ys = b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
                if last[0] != x:
                    last = (x, shingle_sets([read.decompress(x)])[0])
                p, q = last[1], shingle_sets([read.decompress(y)])[0]
                both = len(np.intersect1d(p, q, assume_unique=True))
                if linked(both, len(p), len(q)):
                    out.append(i)
            at = pa.array(out, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])
    left = texts.withColumnsRenamed({"cid": "a", "packed": "text_a"})
    right = texts.withColumnsRenamed({"cid": "b", "packed": "text_b"})
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a bigint, b bigint")


# --- components ---------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """``cid, comp`` of every class with a link: the smallest class id it can
    reach. Edges are pulled to their smallest neighbours (large star, small
    star) until nothing changes; every round is a pair of map-side minima."""
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u > v").distinct()
        large = saved(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "small-star")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    ends = edges.select(F.col("u").alias("cid"), F.col("v").alias("comp"))
    return ends.unionByName(edges.select(F.col("v").alias("cid"), F.col("v").alias("comp"))).groupBy("cid").agg(
        F.min("comp").alias("comp"))


def joined(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document, with the hash of
    its text, its class and its component's smallest class."""
    spark = docs.sparkSession
    members = saved(documents(docs), "documents")
    total = members.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    slices = max(12, total // SLICE_SHINGLES + 1)
    blocks_ = saved(text_blocks(docs), "text-blocks")
    sigs = saved(signatures(blocks_, slices), "signatures")
    keys = sigs.agg(F.sum(F.length("keys")).cast("long")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keys // 8 // 500_000 + 1)
    classes = sigs.select("cid", "n", "cap", "bits").dropDuplicates(["cid"])

    first = blocks(route(sigs, block), tasks, block).dropDuplicates(["kind", "fp"])
    pairs = saved(candidates(block_rows(first), classes.withColumn("comp", F.col("cid")), True, tasks), "pairs")
    links = saved(verify(blocks_, pairs), "links")
    comp = saved(components(links), "components")

    now = sigs.dropDuplicates(["cid"]).join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    now = saved(now, "classes")
    again = saved(gathered(held(now, block), tasks, block), "blocks")
    more = candidates(sub_rows(again), now, False, tasks).join(pairs, ["a", "b"], "left_anti")
    links = links.unionByName(verify(blocks_, saved(more, "pairs")))
    comp = components(links)

    rows = members.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    rows = saved(rows, "members")
    named = rows.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    some = rows.where("n > 0").join(named, "comp")
    none = rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
    cols = ["doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "text_hash", F.col("cid").alias("class_id"),
            F.col("comp").alias("component_class")]
    return some.select(*cols).unionByName(none.select(*cols))


def one_per_component(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component: one with its smallest doc_id
    (no doc_id, if no row has one), of several that with the smallest hash of
    its text. Rows with an empty set link with nothing, so all of them stay."""
    found = joined(docs, **options)
    one = (found.where("n_shingles > 0 AND doc_id <=> component_id").groupBy("component_class")
           .agg(F.min(F.struct("text_hash", "doc_id")).alias("k")))
    keep = saved(one.select(F.col("k.doc_id").alias("k1"), F.col("k.text_hash").alias("k2")), "kept")
    some = F.coalesce(docs["text"].rlike(f"[^{SPACE_CLASS}]"), F.lit(False))
    same = docs["doc_id"].eqNullSafe(keep["k1"]) & (F.xxhash64(docs["text"]) == keep["k2"])
    stay = docs.where(some).join(keep, same, "left_semi")
    twice = found.where("n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1")
    if not twice.isEmpty():  # whole rows repeat
        stay = stay.dropDuplicates(["doc_id", "text"])
    return stay.unionByName(docs.where(~some))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN s p ON p.doc_id = x JOIN s q ON q.doc_id = y
  WHERE 100 * both_ >= 80 * (len(p.s) + len(q.s) - both_)),
n AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, n.y FROM r JOIN n ON r.y = n.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.y) AS component_id FROM s JOIN r ON r.x = s.doc_id GROUP BY ALL
"""
