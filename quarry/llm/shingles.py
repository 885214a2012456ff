"""Sets of word shingles as 64-bit hashes, computed with numpy for many texts
at once. A word's hash is a polynomial over a fixed random value per byte
(prefix sums give every word's in one pass); a shingle's mixes its words'."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _byte_values() -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=_U) * _U(_R))
    v[ord("A"):ord("Z") + 1] = v[ord("a"):ord("z") + 1]
    return v


_VALUE = _byte_values()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = mix(np.arange(101, 101 + SHINGLE, dtype=_U)) | _U(1)
_powers = {"r": np.ones(1, _U), "i": np.ones(1, _U)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        a = np.full(n, _R if kind == "r" else _RINV, _U)
        a[0] = 1
        _powers[kind] = np.multiply.accumulate(a)
    return _powers[kind][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and the number of words of each text."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    total = np.concatenate((np.zeros(1, _U), np.cumsum(_VALUE[buf] * _power("r", len(buf)), dtype=_U)))
    hashes = mix((total[ends] - total[starts]) * _power("i", len(buf))[starts] + (ends - starts).astype(_U))
    lengths = np.array([len(t) + 1 for t in texts], "i8")
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    return hashes, np.diff(np.searchsorted(starts, bounds))


def shingle_sets(texts: list[bytes], most_bytes: int = 1 << 20) -> list[np.ndarray]:
    """Per text, the ascending distinct hashes of its shingles."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most_bytes):
            size += len(texts[end])
            end += 1
        hashes, counts = word_hashes(texts[at:end])
        n = max(0, len(hashes) - SHINGLE + 1)
        rolled = np.zeros(n, _U)
        for j in range(SHINGLE):
            rolled += hashes[j:j + n] * _PLACE[j]
        rolled = mix(rolled)
        s = 0
        for c in counts.tolist():
            if c >= SHINGLE:
                out.append(np.unique(rolled[s:s + c - SHINGLE + 1]))
            elif c:
                short = (hashes[s:s + c] * _PLACE[:c]).sum(dtype=_U) + _U(c)
                out.append(mix(np.array([short], _U)))
            else:
                out.append(np.zeros(0, _U))
            s += c
        at = end
    return out


def set_id(s: np.ndarray) -> int:
    """64-bit id of a set (signed); 0 for the empty one."""
    if not len(s):
        return 0
    x = int(mix(mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U, keepdims=True) + _U(len(s)))[0])
    return x - (1 << 64) if x >> 63 else x
