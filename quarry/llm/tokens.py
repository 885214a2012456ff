"""Tokenizer access shared by token counts and packing.

Byte-level BPE never joins tokens across its pre-token boundaries. So a text
is cut at places that are boundaries for certain, and each distinct piece is
encoded by the tokenizer once per worker process; its ids and offsets are
reused. Certain places are: before a single space between two other
characters, on either side of a single line feed between two others, and
before a comma or full stop that follows a letter or digit and precedes one of
these. Texts with other white space are cut only before single spaces. The
memo is bounded; when it is full it starts anew, which changes no result.
"""

from __future__ import annotations

import re
import struct
from itertools import accumulate

import numpy as np

MEMO_PIECES = 600_000


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


#: All white space but the space and the line feed.
_ODD_SPACES = [chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                0x2028, 0x2029, 0x202F, 0x205F, 0x3000) if c != 0x0A]
_ODD = [*_ODD_SPACES, "  ", "\n\n", " \n", "\n ", "\0"]
_ODD_STOP = re.compile(r"[.,](?=\s)(?<![^\W_][.,])")


def plain(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between other characters."""
    return bool(text) and text[0] not in " \n" and text[-1] not in " \n" and not any(map(text.__contains__, _ODD))


def cut(text: str) -> list[str]:
    """Pieces of ``text`` that encode independently; their join is ``text``."""
    if not plain(text):
        parts = text.split(" ")
        out = [parts[0]]
        for p in parts[1:]:
            before = out[-1]
            if p and before and not p[0].isspace() and not before[-1].isspace():
                out.append(" " + p)
            else:
                out[-1] = before + " " + p
        return out
    marked = text.replace("\n", "\0\n\0").replace(" ", "\0 ")
    if not _ODD_STOP.search(text):
        marked = marked.replace(",\0", "\0,\0").replace(".\0", "\0.\0")
    return marked.split("\0")


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, offsets: bool = False) -> Encoder:
    """The encoder of this worker process, whose memo serves all its tasks."""
    key = (path, offsets)
    if key not in _encoders:
        _encoders[key] = Encoder(path, offsets=offsets)
    return _encoders[key]


class Encoder:
    """Ids (packed little-endian unsigned 32-bit) and offsets of whole texts."""

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES, offsets: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one Spark task, one core
        from tokenizers import Tokenizer

        self.tok, self.most, self.offsets = Tokenizer.from_file(path), memo_pieces, offsets
        self.ids: dict[str, bytes] = {}
        self.spans: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        new = list(set(pieces).difference(self.ids))
        if len(self.ids) + len(new) > self.most:
            self.ids, self.spans = {}, {}
            new = list(set(pieces))
        run = self.tok.encode_batch if self.offsets else self.tok.encode_batch_fast
        for at in range(0, len(new), 4096):
            some = new[at:at + 4096]
            for p, e in zip(some, run(some, add_special_tokens=False), strict=True):
                self.ids[p] = struct.pack(f"<{len(e.ids)}I", *e.ids)
                if self.offsets:
                    self.spans[p] = struct.pack(f"<{2 * len(e.ids)}q", *(x for o in e.offsets for x in o))

    def packed(self, text: str) -> bytes:
        pieces = cut(text)
        self._learn(pieces)
        return b"".join(map(self.ids.__getitem__, pieces))

    def token_spans(self, text: str) -> np.ndarray:
        """(n, 2) character offsets of every token, end exclusive."""
        pieces = cut(text)
        self._learn(pieces)
        raw = list(map(self.spans.__getitem__, pieces))
        spans = np.frombuffer(b"".join(raw), "<i8").reshape(-1, 2)
        starts = np.array([0, *accumulate(map(len, pieces))][:-1], "i8")
        return spans + np.repeat(starts, np.array(list(map(len, raw)), "i8") // 16)[:, None]
