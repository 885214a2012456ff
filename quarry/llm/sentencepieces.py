"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding is the score-ordered agenda: a text starts as its characters, every
adjacent pair whose join is a piece enters a priority queue by (higher score,
further left), the best pair still standing is merged, and the pairs it forms
with its neighbours enter in turn, until the queue is empty. Symbols that are
no piece become byte pieces (with byte fallback) or the unknown id, where runs
of unknown symbols are one id; merged pieces marked unused are split again
into the pair they came from; user-defined pieces are matched first, longest
first, and never merged. Decoding joins pieces, reads runs of byte pieces as
UTF-8 (a malformed byte is U+FFFD) and drops the space put before a text. Every
text is decoded from its ids.

Where no piece of the vocabulary holds a space mark after another character
(true of vocabularies trained within words), no merge crosses the start of a
word, nor a border between characters that no piece holds side by side. Then a
text is cut there, and each distinct part is merged once per worker process.
The agenda then runs over arrays, for all new parts of a batch at once. The
memo holds two generations of a bounded size and changes no result. Other
models are merged over whole texts, pair by pair.

``encode_documents`` checks the result against the sentencepiece library in
the same Arrow batch (``agrees``: ids and decoded text are equal): every
distinct word that the batch brings anew, and whole texts where runs of spaces
or marks forbid that cut; with ``whole`` all texts as they are.

Scale: one narrow pass over the texts in map tasks; nothing is shuffled,
collected or broadcast. A task holds one Arrow batch, one text's parts and
the memo. A lost task is run again.

Defined cases: a null text is an empty one, and an empty text has no ids and
decodes to an empty text; repeated rows give repeated rows; a null doc_id is
kept; other columns are ignored; an empty table gives an empty result; a part
without spaces of any length is one agenda (its memory is in proportion to
it). Models of another type, or with a normalisation table or with the space
mark as a suffix, raise ValueError.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
MEMO_PARTS, SLICE_BYTES, SHORT = 500_000, 8 << 20, 64
#: Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_MODEL = 2
#: What the library decodes the unknown id to, where the model does not say.
UNKNOWN_SURFACE = " ⁇ "


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Merges:
    """One vocabulary: ``encode(text) -> ids`` and ``decode(ids) -> text``."""

    def __init__(self, model: bytes, memo_parts: int = MEMO_PARTS):
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(model)
        norm, train = m.normalizer_spec, m.trainer_spec
        if train.model_type != MERGE_MODEL or norm.precompiled_charsmap or train.treat_whitespace_as_suffix:
            raise ValueError("not a merge-type model that keeps texts as they are")
        self.prefix, self.squeeze, self.mark_spaces = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        self.ids, self.order, self.unused, self.bytes, self.unknown = {}, {}, set(), {}, 0
        self.surface, self.control = [], set()
        user = []
        for i, p in enumerate(m.pieces):
            self.surface.append(p.piece)
            if p.type in (NORMAL, USER_DEFINED, UNUSED):
                self.ids[p.piece] = i
                self.order[p.piece] = -p.score
            if p.type == UNUSED:
                self.unused.add(p.piece)
            elif p.type == USER_DEFINED:
                user.append(p.piece)
            elif p.type == BYTE:
                self.bytes[i] = int(p.piece[3:5], 16)
            elif p.type == CONTROL:
                self.control.add(i)
            elif p.type == UNKNOWN:
                self.unknown = i
        self.unknown_surface = train.unk_surface if train.HasField("unk_surface") else UNKNOWN_SURFACE
        #: The bytes that each id decodes to.
        self.raw = pa.array([bytes([self.bytes[i]]) if i in self.bytes else
                             (self.unknown_surface if i == self.unknown else p.replace(MARK, " ")).encode()
                             for i, p in enumerate(self.surface)], pa.binary())
        self.byte_ids = {v: k for k, v in self.bytes.items()} if train.byte_fallback else {}
        self.user = re.compile("|".join(map(re.escape, sorted(user, key=len, reverse=True)))) if user else None
        self.part = self._part_pattern() if self.byte_ids and not user else None
        self.by_words = bool(self.part and self.prefix and self.mark_spaces and not self.squeeze)
        self.most, self.memo, self.older, self.fresh = memo_parts, {}, {}, []
        self.pairs = Pairs(self) if self.by_words and not self.unused else None

    def _part_pattern(self) -> re.Pattern | None:
        """Parts that no merge crosses: marks, then a run of letters and
        numbers or a run of other characters, where every character that some
        piece puts beside another character counts as one itself. None where
        a piece holds a mark after a character."""
        pairs = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(y == MARK != x for x, y in pairs):
            return None
        beside = [set(xy) for xy in pairs if MARK not in xy]
        other = {c for xy in pairs for c in xy if unicodedata.category(c)[0] not in "LMN"} - {MARK} | {"\n"}
        while more := {c for xy in beside if xy & other for c in xy} - other:
            other |= more
        some = "".join(map(re.escape, sorted(other)))
        return re.compile(f"{MARK}*(?:[^{some}{MARK}]+|[{some}]+)|{MARK}+")

    # -- encoding ---------------------------------------------------------

    def normal(self, text: str) -> str:
        """The text with marked spaces and the space put before it."""
        if self.squeeze:
            text = re.sub(" +", " ", text.lstrip(" ")).rstrip(" " + MARK)
        if not text:
            return ""
        if self.prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.mark_spaces else text

    def parts(self, normal: str) -> list[str]:
        """Parts of a normal text that no merge crosses; their join is the text."""
        if self.part:
            return self.part.findall(normal)
        return [normal] if normal else []

    def _symbols(self, part: str) -> tuple[list[str], set[int]]:
        if not self.user:
            return list(part), set()
        symbols, frozen, at = [], set(), 0
        for hit in self.user.finditer(part):
            symbols += part[at:hit.start()]
            frozen.add(len(symbols))
            symbols.append(hit.group())
            at = hit.end()
        return symbols + list(part[at:]), frozen

    def merged(self, part: str) -> list[str]:
        """The symbols left when the agenda of adjacent pairs is empty."""
        sym, frozen = self._symbols(part)
        order, unused, halves = self.order.get, self.unused, {}
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i, both in enumerate(map(add, sym, sym[1:])):
            at = order(both)
            if at is not None and not (frozen and (i in frozen or i + 1 in frozen)):
                agenda.append((at, i, both))
                if both in unused:
                    halves[both] = (sym[i], sym[i + 1])
        heapify(agenda)
        while agenda:
            _, i, both = heappop(agenda)
            j = after[i]
            if j >= n or not sym[i] or len(sym[i]) + len(sym[j]) != len(both):
                continue  # one of the two was merged elsewhere meanwhile
            sym[i], sym[j] = both, ""
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
            for left, right in ((h, i), (i, k)):
                if left < 0 or right >= n or (frozen and (left in frozen or right in frozen)):
                    continue
                both = sym[left] + sym[right]
                at = order(both)
                if at is not None:
                    heappush(agenda, (at, left, both))
                    if both in unused:
                        halves[both] = (sym[left], sym[right])
        out = [s for s in sym if s]
        while halves and any(s in unused and s in halves for s in out):
            out = [h for s in out for h in (halves[s] if s in unused and s in halves else (s,))]
        return out

    def _part_ids(self, part: str) -> list[int]:
        symbols, ids = self.merged(part), self.ids
        if all(map(ids.__contains__, symbols)):
            return list(map(ids.__getitem__, symbols))
        out, was_unknown = [], False
        for s in symbols:
            i = ids.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in s.encode()]
            elif not was_unknown:
                out.append(self.unknown)
            was_unknown = i is None and not self.byte_ids
        return out

    def _learn(self, part: str) -> str:
        """The ids of a part as text, put into the memo."""
        return self._keep(part, self.older.get(part) or ",".join(map(str, self._part_ids(part))))

    def _keep(self, part: str, ids: str) -> str:
        if len(part) <= SHORT:
            if len(self.memo) >= self.most:
                self.memo, self.older = {}, self.memo
            self.memo[part] = ids
        return ids

    def _of_parts(self, normal: str) -> str:
        got = self.memo.get(normal)
        if got is None:
            parts = self.parts(normal)
            if len(parts) == 1:
                return self._learn(normal)
            got = ",".join([self.memo.get(p) or self._learn(p) for p in parts])
        return got

    def encode_text(self, text: str) -> str:
        """The ids as decimals joined by commas."""
        return self._of_parts(self.normal(text))

    def _words(self, words: list[str]) -> list[str]:
        """The ids of distinct marked words, from the memo or for all new ones at once."""
        got = list(map(self.memo.get, words))
        missing = [w for w, g in zip(words, got, strict=True) if g is None]
        known = {w: self.older[w] for w in missing if w in self.older}
        new = [w for w in missing if w not in known]
        short = [w for w in new if len(w) <= SHORT] if self.pairs else []
        ids = dict(zip(short, self.pairs.merged(short), strict=True)) if short else {}
        ids.update((w, self._of_parts(w)) for w in new if w not in ids)
        self.fresh += ((w[1:], ids[w]) for w in new)
        known |= ids
        if len(self.memo) + len(known) > self.most:
            self.memo, self.older = {}, self.memo
        self.memo.update((w, i) for w, i in known.items() if len(w) <= SHORT)
        return [known[w] if g is None else g for w, g in zip(words, got, strict=True)]

    def is_plain(self, text: str) -> bool:
        """Whether single spaces between words are all the space marks of ``text``."""
        return bool(text) and text[0] != " " != text[-1] and "  " not in text and MARK not in text

    def encode_texts(self, texts: list[str]) -> list[str]:
        """``encode_text`` of many texts. Plain ones are cut into words by
        Arrow, and each distinct word is looked up once."""
        out = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if self.is_plain(t)] if self.by_words else []
        if plain:
            words = pc.split_pattern(pa.array([texts[k] for k in plain], pa.string()), " ")
            coded = words.flatten().dictionary_encode()
            marked = [MARK + w for w in coded.dictionary.to_pylist()]
            ids = pa.array(self._words(marked), pa.string())
            joined = pc.binary_join(pa.ListArray.from_arrays(words.offsets, ids.take(coded.indices)), ",")
            for k, v in zip(plain, joined.to_pylist(), strict=True):
                out[k] = v
        return [self.encode_text(t) if v is None else v for t, v in zip(texts, out, strict=True)]

    def encode(self, text: str) -> list[int]:
        ids = self.encode_text(text)
        return list(map(int, ids.split(","))) if ids else []

    # -- decoding ---------------------------------------------------------

    def _joined(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            b = self.bytes.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(utf8(bytes(run)))
                run = bytearray()
            if i not in self.control:
                out.append(self.unknown_surface if i == self.unknown else self.surface[i].replace(MARK, " "))
        if run:
            out.append(utf8(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self._unprefixed(self._joined(ids), next((i for i in ids if i not in self.control), None))

    def decode_texts(self, ids: list[str]) -> list[str]:
        """``decode`` of the ids (decimals joined by commas) of many texts, whose
        pieces are looked up and joined at once as bytes. Where a text's bytes
        are UTF-8, so is every run of byte pieces in it; others go id by id."""
        out = [""] * len(ids)
        some = [k for k, v in enumerate(ids) if v]
        cut = pc.split_pattern(pa.array([ids[k] for k in some], pa.string()), ",")
        numbers = cut.flatten().cast(pa.int32())
        ends = cut.offsets.to_numpy()
        if len(numbers) and np.isin(numbers.to_numpy(), list(self.control)).any():  # they part runs of bytes
            return [self.decode(list(map(int, v.split(",")))) if v else "" for v in ids]
        joined = pc.binary_join(pa.ListArray.from_arrays(cut.offsets, self.raw.take(numbers)), pa.scalar(b"", pa.binary()))
        firsts = numbers.take(pa.array(ends[:-1])).to_pylist()
        for k, raw, first in zip(some, joined.to_pylist(), firsts, strict=True):
            try:
                out[k] = self._unprefixed(raw.decode(), first)
            except UnicodeDecodeError:
                out[k] = self.decode(list(map(int, ids[k].split(","))))
        return out

    def _unprefixed(self, text: str, first: int | None) -> str:
        """A decoded text without the space put before it; ``first``: its first id that is no control."""
        if first is None or not (self.prefix or self.squeeze) or first in self.bytes or first == self.unknown:
            return text
        if self.squeeze:
            return text.lstrip(" ")
        return text[1:] if text[:1] == " " else text


class Pairs:
    """The agenda for many short parts at once: every round takes the best
    pair (highest score, then furthest left) of each part that has one."""

    NONE = 1 << 30

    def __init__(self, m: Merges):
        chars = {c for p in m.ids for c in p} | set(map(chr, range(128)))
        self.m, self.names = m, [*m.ids, *sorted(chars - set(m.ids))]
        at = {p: k for k, p in enumerate(self.names)}
        self.of_char = np.full(0x110000, -1, "i4")
        for c in chars:
            self.of_char[ord(c)] = at[c]
        rank = {v: k for k, v in enumerate(sorted(set(m.order.values())))}
        rows = sorted((at[p[:k]] * len(at) + at[p[k:]], rank[m.order[p]], at[p])
                      for p in m.ids for k in range(1, len(p)) if p[:k] in at and p[k:] in at)
        self.keys, self.ranks, self.joined = (np.array(c, "i8") for c in zip(*rows, strict=True)) if rows else [np.zeros(0, "i8")] * 3
        self.texts = pa.array([str(m.ids[p]) if p in m.ids else ",".join(str(m.byte_ids[b]) for b in p.encode()) for p in self.names],
                              pa.string())

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and join of pairs of symbols (rank ``NONE``: no piece)."""
        if not len(self.keys):
            return np.full(len(a), self.NONE, "i8"), np.zeros(len(a), "i8")
        key = a.astype("i8") * len(self.names) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.NONE), self.joined[at]

    def merged(self, parts: list[str]) -> list[str]:
        """The ids of every part, as text."""
        sym = self.of_char[np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")]
        sizes = np.array(list(map(len, parts)), "i8")
        starts = np.cumsum(sizes) - sizes
        odd = np.minimum.reduceat(sym, starts) < 0 if len(parts) else np.zeros(0, bool)  # characters of no piece
        out: list = [",".join(map(str, self.m._part_ids(p))) if o else None for p, o in zip(parts, odd.tolist(), strict=True)]
        row, done_rows, done_sizes, done = np.flatnonzero(~odd), [], [], []
        sym = sym[np.repeat(~odd, sizes)]
        sizes = sizes[row]
        rank, joined = self.look(sym[:-1], sym[1:]) if len(sym) else (sym, sym)
        rank, joined = np.append(rank, self.NONE), np.append(joined, 0)
        while len(row):
            ends = np.cumsum(sizes)
            rank[ends - 1] = self.NONE
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), ends - sizes)
            hit = best >> 32 < self.NONE
            stay = np.repeat(hit, sizes)
            done_rows.append(row[~hit])
            done_sizes.append(sizes[~hit])
            done.append(sym[~stay])
            at = best[hit] & 0xFFFFFFFF
            sym[at] = joined[at]
            stay[at + 1] = False
            moved = np.cumsum(stay)[at] - 1
            sym, rank, joined, row, sizes = sym[stay], rank[stay], joined[stay], row[hit], sizes[hit] - 1
            if not len(row):
                break
            first = np.cumsum(sizes) - sizes
            for left in (moved[moved > first] - 1, moved[moved < first + sizes - 1]):
                rank[left], joined[left] = self.look(sym[left], sym[left + 1])
        if done:
            rows, sizes = np.concatenate(done_rows), np.concatenate(done_sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()),
                                             self.texts.take(pa.array(np.concatenate(done))))
            for r, ids in zip(rows.tolist(), pc.binary_join(lists, ",").to_pylist(), strict=True):
                out[r] = ids
        return out


def utf8(raw: bytes) -> str:
    """``raw`` as text; each byte that starts no well-formed character is U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at:at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


class Checked:
    """A vocabulary beside the library's own. Words that a batch brings anew
    are encoded and decoded by both; texts that are not cut into words (or all,
    with ``whole``) are compared as they are. A text cut into words agrees only
    if its own ids decode to it."""

    def __init__(self, model: bytes, whole: bool = False, memo_parts: int = MEMO_PARTS):
        import sentencepiece

        self.ours, self.whole, self.wrong = Merges(model, memo_parts), whole, set()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)

    def encode_texts(self, texts: list[str]) -> tuple[list[str], list[bool], list[str]]:
        """The ids of every text, whether the library agrees, and what the ids decode to."""
        ids = self.ours.encode_texts(texts)
        fresh, self.ours.fresh = self.ours.fresh, []
        theirs = self.library.encode([w for w, _ in fresh], num_threads=1)
        for (word, mine), other, back in zip(fresh, theirs, self.library.decode(theirs) if theirs else [], strict=True):
            if mine != ",".join(map(str, other)) or word != back:
                self.wrong.add(word)
        decoded = self.ours.decode_texts(ids)
        return ids, list(map(self._agrees, texts, ids, decoded)), decoded

    def _agrees(self, text: str, ids: str, decoded: str) -> bool:
        if not self.whole and self.ours.by_words and self.ours.is_plain(text):
            return decoded == text and (not self.wrong or self.wrong.isdisjoint(text.split(" ")))
        numbers = list(map(int, ids.split(","))) if ids else []
        return numbers == self.library.encode(text, num_threads=1) and decoded == self.library.decode(numbers)


_models: dict[tuple, Checked] = {}


def checked(path: str, whole: bool = False) -> Checked:
    """This worker process's vocabulary, for all its tasks."""
    if (path, whole) not in _models:
        with open(path, "rb") as f:
            _models[path, whole] = Checked(f.read(), whole)
    return _models[path, whole]


def encode_documents(docs: DataFrame, model: str, keep: bool = False, whole: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, agrees`` per document;
    with ``keep`` also ``ids`` (array of int) and ``decoded``. ``whole``: the
    library encodes whole texts, not each distinct word."""
    ddl = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, agrees boolean"
    types = [pa.int64(), pa.string(), pa.string(), pa.bool_()]
    if keep:
        ddl, types = ddl + ", ids array<int>, decoded string", [*types, pa.list_(pa.int32()), pa.string()]

    def run(batches):
        both = checked(model, whole)
        for b in (part for batch in batches for part in slices(batch)):
            cols = [[] for _ in types]
            texts = [t or "" for t in b.column(1).to_pylist()]
            for ids, same, decoded in zip(*both.encode_texts(texts), strict=True):
                row = [ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(),
                       hashlib.sha256(decoded.encode()).hexdigest(), same]
                if keep:
                    row += [list(map(int, ids.split(","))) if ids else [], decoded]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, types)],
                                             [f.split()[0] for f in ddl.split(", ")])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch with about ``most`` bytes of text each, and a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    at = total = 0
    for k, n in enumerate(sizes):
        if k > at and total + n > most:
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)


def text_of(ours: Merges, text: str, ids: str | Sequence[int]) -> str:
    """``decode`` of a text's own ids; ``text`` itself is not looked at."""
    return ours.decode_texts([ids if isinstance(ids, str) else ",".join(map(str, ids))])[0]


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), model_path())


#: SQL has no vocabulary; the query is tested against the library and a brute-force merger.
SQL = None
