"""Rule registry and chains (N7) and payload normalization.

A rule is a ``Column -> Column`` function. A chain is folded at plan time into
one nested expression, so Catalyst collapses it into a single projection.
Payloads are JSON text; values are handled as ``MAP<STRING, VARIANT>`` so that
strings, numbers, booleans, nulls and absent keys stay distinct. Only string
values change; everything else passes through.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text

# The rule names and what each one does.
RULES: Mapping[str, Callable[[Column], Column]] = {
    "trim": text.js_trim,
    "lowercase": text.lowercase,
    "uppercase": text.uppercase,
    "collapse_whitespace": text.collapse_whitespace,
    "strip_diacritics": text.strip_diacritics,
    "identifier_compact": text.identifier_compact,
}

PAYLOAD_MAP = "map<string,variant>"


def validate_rules(names: Sequence[str]) -> None:
    """Reject unknown rule names before any job starts."""
    for name in names:
        if name not in RULES:
            raise ValueError(f"Unknown normalization rule: {name}")


def validate_field_rules(field_rules: Mapping[str, Sequence[str]]) -> None:
    for names in field_rules.values():
        validate_rules(names)


def chain(col: Column | str, names: Sequence[str]) -> Column:
    """Apply the named rules left to right on a string column."""
    validate_rules(names)
    out = F.col(col) if isinstance(col, str) else col
    for name in names:
        out = RULES[name](out)
    return out


def payload_map(payload: Column | str) -> Column:
    """Parse payload JSON text into an ordered ``MAP<STRING, VARIANT>``."""
    p = F.col(payload) if isinstance(payload, str) else payload
    return F.from_json(p, PAYLOAD_MAP)


def is_string_variant(v: Column) -> Column:
    return F.schema_of_variant(v) == F.lit("STRING")


def raw_map(payload: Column | str) -> Column:
    """Payload as ``MAP<STRING, STRING>``: non-string values keep their JSON
    text, nested objects in their original member order."""
    p = F.col(payload) if isinstance(payload, str) else payload
    return F.from_json(p, "map<string,string>")


# Control characters whose \u escape holds hex letters (the
# others print as digits or short escapes such as \n); JavaScript writes them
# in lower case, Spark's JSON writer in upper case.
_UPPER_HEX_ESCAPES = ["000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F"]


def js_escapes(json_text: Column) -> Column:
    """Lower-case the hex digits of unicode escapes, as ``JSON.stringify`` writes them."""
    out = json_text
    for h in _UPPER_HEX_ESCAPES:
        # an escape follows an even number of backslashes; after an odd number it is text
        out = F.regexp_replace(out, r"(?<!\\)((?:\\\\)*)\\u" + h, "$1\\\\u" + h.lower())
    return F.when(json_text.contains("\\u00"), out).otherwise(json_text)


def json_quote(c: Column) -> Column:
    """A string as a JSON string literal (JavaScript escaping)."""
    text = F.to_json(F.array(c))
    return js_escapes(F.substring(text, F.lit(2), F.length(text) - 2))


def js_number(x: Column, text: Column) -> Column:
    """JavaScript's text of a number whose Java text is ``text``: plain from
    1e-6 up to 1e21, else an exponent with its sign."""
    a = F.abs(x)
    digits = F.when(a < 1, x.cast("decimal(38,30)").cast("string")).when(
        a < 1e20, x.cast("decimal(38,17)").cast("string")).otherwise(x.cast("decimal(38,0)").cast("string"))
    digits = F.when(digits.contains("."), F.regexp_replace(F.regexp_replace(digits, r"0+\z", ""), r"\.\z", "")).otherwise(digits)
    plain = F.when(text.contains("E"), digits).otherwise(F.regexp_replace(text, r"\.0\z", ""))
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), "E-", "e-"), "E", "e+")
    return F.when((a >= 1e21) | (a < 1e-6), power).otherwise(plain)


def value_json(v: Column, raw_text: Column) -> Column:
    """JSON text of one payload value: strings re-serialized, JSON null as
    ``null``, anything else verbatim from the raw payload text (numbers in
    exponent form as JavaScript writes them)."""
    exponent = raw_text.rlike(r"\A-?[0-9.]+E-?[0-9]+\z")
    return (F.when(F.is_variant_null(v), F.lit("null"))
             .when(is_string_variant(v), js_escapes(F.to_json(v)))
             .when(exponent, js_number(raw_text.try_cast("double"), raw_text))
             .otherwise(raw_text))


def rebuild_payload(vmap: Column, raw: Column, keep=None) -> Column:
    """Payload text from the ordered entries of ``vmap`` (keys kept in order,
    optionally filtered by ``keep(key)``), values via ``value_json``."""
    entries = F.map_entries(vmap)
    if keep is not None:
        entries = F.filter(entries, lambda e: keep(e["key"]))
    parts = F.transform(entries, lambda e: F.concat(json_quote(e["key"]), F.lit(":"),
                                                     value_json(e["value"], raw[e["key"]])))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def normalize_payload(df: DataFrame, field_rules: Mapping[str, Sequence[str]],
                      payload: str = "payload", out: str = "normalized_payload") -> DataFrame:
    """Run each present field through its chain; other keys unchanged.

    Each field's new value is computed as its own column first (so a pandas
    rule such as ``strip_diacritics`` is evaluated in an Arrow batch), then
    written back into the map with ``transform_values``; key order is kept.
    """
    validate_field_rules(field_rules)
    tmp = "__m"
    work = df.withColumn(tmp, payload_map(payload))
    fields = [f for f, names in field_rules.items() if names]
    new_cols = {}
    for i, f in enumerate(fields):
        v = F.col(tmp)[F.lit(f)]
        s = F.when(is_string_variant(v), v.cast("string"))
        new_cols[f"__n{i}"] = chain(s, field_rules[f]).cast("variant")
    if new_cols:
        work = work.withColumns(new_cols)

    def rewrite(k: Column, v: Column) -> Column:
        expr = None
        for i, f in enumerate(fields):
            cond = (k == F.lit(f)) & is_string_variant(v)
            expr = F.when(cond, F.col(f"__n{i}")) if expr is None else expr.when(cond, F.col(f"__n{i}"))
        return v if expr is None else expr.otherwise(v)

    # written back entry by entry: changed strings re-serialized, other values
    # verbatim (nested objects keep their member order)
    rewritten = F.transform_values(F.col(tmp), rewrite)
    result = rebuild_payload(rewritten, raw_map(payload))
    return work.withColumn(out, result).drop(tmp, *new_cols.keys())
