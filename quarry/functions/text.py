"""String rules N1-N6 as Spark Column expressions.

All rules except ``strip_diacritics`` are built-in JVM expressions and stay
inside whole-stage codegen. NFKD has no built-in, so N5 is an Arrow-batched
pandas UDF (one call per batch, not per row).
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The whitespace set of JavaScript's \s and String.prototype.trim
# (TAB LF VT FF CR SPACE U+00A0 U+1680 U+2000-U+200A U+2028 U+2029 U+202F
# U+205F U+3000 U+FEFF). Java's \s is ASCII only, so the class is explicit.
JS_WS_CLASS = (r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}"
               r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]")

# Combining diacritical marks removed after NFKD (U+0300-U+036F).
_COMBINING = re.compile("[\\u0300-\\u036f]")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def js_trim(col: Column | str) -> Column:
    """JavaScript ``trim`` (Unicode whitespace and BOM at both ends)."""
    return F.regexp_replace(_c(col), r"\A" + JS_WS_CLASS + r"++|(?<!" + JS_WS_CLASS + r")" + JS_WS_CLASS + r"++\z", "")


def lowercase(col: Column | str) -> Column:
    """Full Unicode lower-casing, locale-free."""
    return F.lower(_c(col))


def uppercase(col: Column | str) -> Column:
    """Full Unicode upper-casing (``ß`` -> ``SS``)."""
    return F.upper(_c(col))


def collapse_whitespace(col: Column | str) -> Column:
    """Runs of whitespace -> one space, then trim (only spaces remain at ends)."""
    return F.trim(F.regexp_replace(_c(col), JS_WS_CLASS + "+", " "))


def strip_diacritics_text(value: str | None) -> str | None:
    """NFKD, then drop U+0300-U+036F; other marks stay decomposed."""
    if value is None:
        return None
    return _COMBINING.sub("", unicodedata.normalize("NFKD", value))


@F.pandas_udf(T.StringType())
def _strip_diacritics_udf(s: pd.Series) -> pd.Series:
    out = s.str.normalize("NFKD").str.replace(_COMBINING, "", regex=True)
    return out.where(s.notna(), None)


def strip_diacritics(col: Column | str) -> Column:
    """Compatibility decomposition then removal of combining marks. ASCII
    text is its own decomposition: Python sees a null for it."""
    c = _c(col)
    odd = _strip_diacritics_udf(F.when(c.rlike(r"[^\x00-\x7F]"), c))
    return F.coalesce(odd, c)


def identifier_compact(col: Column | str) -> Column:
    """Keep ASCII letters and digits, then upper-case."""
    return F.upper(F.regexp_replace(_c(col), "[^A-Za-z0-9]", ""))


def utf16_length(col: Column | str) -> Column:
    """Length in UTF-16 code units, as JavaScript counts it."""
    c = _c(col)
    astral = F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.length(c) + astral
