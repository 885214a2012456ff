"""Sensitive-key redaction (S1) at any depth of a JSON value.

A key matches when its lower-cased form is one of ``SENSITIVE_KEYS``; its
value (of any type) becomes ``"[REDACTED]"``. Arrays are walked, scalars are
unchanged. Runs as an Arrow-batched pandas UDF over a JSON text column. Text
that is no JSON has no redacted form: it becomes null, and ``redact_error``
tells why, so that one bad line fails no job and leaks no secret.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import jsvalues

# The sensitive key names.
SENSITIVE_KEYS = frozenset(["password", "token", "access_token", "refresh_token", "secret",
                            "api_key", "authorization", "cookie"])
MASK = "[REDACTED]"


def sanitize(value):
    if isinstance(value, dict):
        return {k: (MASK if k.lower() in SENSITIVE_KEYS else sanitize(v)) for k, v in value.items()}
    if isinstance(value, list):
        return [sanitize(v) for v in value]
    return value


def redact_text(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        ok, value = jsvalues.loads_plain(text)
        if ok:
            return jsvalues.compact(sanitize(value))
        return jsvalues.dumps(sanitize(jsvalues.loads(text)))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _redact_udf(s: pd.Series) -> pd.Series:
    return s.map(redact_text)


def redact_json(col: Column | str) -> Column:
    return _redact_udf(F.col(col) if isinstance(col, str) else col)


def redact_error(col: Column | str) -> Column:
    """``Malformed JSON`` where ``redact_json`` gives null for a text, else null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNotNull() & redact_json(c).isNull(), F.lit("Malformed JSON"))
