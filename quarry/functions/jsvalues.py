"""Per-value helpers that give JavaScript's JSON semantics inside Arrow tasks.

Used by the Python parsing lanes (delimited, JSON, workbook) and by
redaction. They are small, per-value functions; Spark partitions the work.

* ``loads``: strict JSON (no trailing text, no NaN/Infinity), numbers as
  IEEE doubles, duplicate keys last-wins at first position, and integer-like
  keys first in ascending order, as in a JavaScript object.
* ``dumps``: compact text as ``JSON.stringify`` writes it.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

_MAX_INDEX = 2**32 - 2
# text that may need the exact (slow) path: index-like keys or long digit runs
_SLOW_HINT = re.compile(r'"(?:0|[1-9][0-9]{0,9})"\s*:|[0-9]{16}')


class _NeedsExactPath(Exception):
    pass


def _no_float(_text: str):
    raise _NeedsExactPath


def _is_index_key(k: str) -> bool:
    if not k or (len(k) > 1 and k[0] == "0") or not k.isascii() or not k.isdigit():
        return False
    return int(k) <= _MAX_INDEX


def js_order(pairs) -> dict:
    """Order keys like a JavaScript object: array-index keys first, ascending."""
    d: dict = {}
    for k, v in pairs:
        d[k] = v
    idx = [k for k in d if _is_index_key(k)]
    if not idx:
        return d
    out = {k: d[k] for k in sorted(idx, key=int)}
    out.update((k, v) for k, v in d.items() if not _is_index_key(k))
    return out


def _reject_constant(name: str):
    raise ValueError(f"Unexpected token {name} in JSON")


def _parse_int(text: str):
    v = int(text)
    return v if abs(v) <= 2**53 else float(v)


def loads(text: str) -> Any:
    return json.loads(text, object_pairs_hook=js_order, parse_int=_parse_int,
                      parse_constant=_reject_constant)


def loads_plain(text: str):
    """Fast path: ``(True, value)`` when the C parser gives exactly the
    JavaScript result (no floats, no big ints, no index-like keys), so the
    value can be written back with ``compact``; else ``(False, None)``."""
    if _SLOW_HINT.search(text):
        return False, None
    try:
        return True, json.loads(text, parse_float=_no_float, parse_constant=_reject_constant)
    except _NeedsExactPath:
        return False, None


_LONE_SURROGATE = re.compile("[\ud800-\udfff]")


def _escape_lone_surrogates(text: str) -> str:
    """Lone UTF-16 surrogates are written as ``\\udXXX`` escapes, as the
    well-formed ``JSON.stringify`` does (and the text stays valid UTF-8)."""
    if not _LONE_SURROGATE.search(text):
        return text
    return _LONE_SURROGATE.sub(lambda m: "\\u%04x" % ord(m.group()), text)


def compact(value: Any) -> str:
    """``JSON.stringify`` for values holding no floats (C encoder)."""
    return _escape_lone_surrogates(json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def number_text(x: float | int) -> str:
    """``String(x)`` for a JavaScript number."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return str(x)
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    r = repr(float(x))
    sign = "-" if r.startswith("-") else ""
    r = r.lstrip("-")
    mant, _, exp = r.partition("e")
    e = int(exp) if exp else 0
    int_part, _, frac = mant.partition(".")
    digits = (int_part + frac).lstrip("0")
    # decimal exponent n such that value = 0.d1d2... * 10^n
    n = len(int_part) + e if int_part != "0" else e - (len(frac) - len(frac.lstrip("0")))
    digits = digits.rstrip("0") or "0"
    k = len(digits)
    if k <= n <= 21:
        return sign + digits + "0" * (n - k)
    if 0 < n <= 21:
        return sign + digits[:n] + "." + digits[n:]
    if -6 < n <= 0:
        return sign + "0." + "0" * (-n) + digits
    e2 = n - 1
    es = ("+" if e2 >= 0 else "-") + str(abs(e2))
    if k == 1:
        return sign + digits + "e" + es
    return sign + digits[0] + "." + digits[1:] + "e" + es


def dumps(value: Any) -> str:
    """Compact JSON text as ``JSON.stringify`` gives it."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        if isinstance(value, float) and (math.isnan(value) or math.isinf(value)):
            return "null"
        return number_text(value)
    if isinstance(value, str):
        return _escape_lone_surrogates(json.dumps(value, ensure_ascii=False))
    if isinstance(value, dict):
        value = js_order(value.items())
        return "{" + ",".join(dumps(str(k)) + ":" + dumps(v) for k, v in value.items()) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(dumps(v) for v in value) + "]"
    return json.dumps(str(value), ensure_ascii=False)


def record_text(record: dict) -> str:
    """Payload text for one record of string/null cells (keys in JavaScript
    object order)."""
    if any(_is_index_key(k) for k in record):
        record = js_order(record.items())
    return compact(record)
