"""JSON documents.

An array gives one record per element: plain objects stay, anything else
(null, scalar, nested array) becomes ``{"value": v}``; ``[]`` gives no
record. An object gives one record; a scalar gives ``{"value": v}``. Parsing
is strict (trailing text and NaN/Infinity are errors), duplicate keys keep the
last value, and keys keep JavaScript object order.
"""

from __future__ import annotations

from quarry.functions import jsvalues


def records_of(text: str):
    try:
        plain, value = jsvalues.loads_plain(text)
        if not plain:
            value = jsvalues.loads(text)
    except ValueError as e:  # json.JSONDecodeError is a ValueError
        raise ValueError(f"Invalid JSON: {e}") from None
    out = jsvalues.compact if plain else jsvalues.dumps
    if isinstance(value, list):
        for v in value:
            yield out(v if isinstance(v, dict) else {"value": v})
    elif isinstance(value, dict):
        yield out(value)
    else:
        yield out({"value": value})
