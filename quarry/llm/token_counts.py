"""Token counts by offset-mapped attribution.

A whole document is encoded once, with the character offsets of its tokens.
Sections (here: lines, each with the line feed that ends it) are intervals of
characters; tokens are joined to them by interval. A token that crosses a
boundary is allocated by an explicit rule:

* ``start``: to the section that holds its first character,
* ``end``: to the section that holds its last character,
* ``most``: to the section that holds most of its characters, the first of equals.

So each token counts once and a document's sections add up to its total.
Tokens that share one character (pieces of its UTF-8 bytes) each count.

Defined cases: a null text is an empty one; an empty text has one section of
no characters and no tokens; repeated rows give repeated results; null ids are
kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import encoder, tokenizer_path

RULES = ("start", "end", "most")


def line_starts(text: str) -> list[int]:
    """Start of every line; a final line feed opens no further section."""
    out, at = [0], text.find("\n")
    while 0 <= at < len(text) - 1:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def allocate(spans: np.ndarray, starts: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """The section of every token, and whether the token crosses a boundary.

    ``starts``: ascending section starts, the first 0; sections cover the text.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    first = np.searchsorted(starts, spans[:, 0], "right") - 1
    last = np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), "right") - 1
    crosses = first != last
    if rule == "start":
        return first, crosses
    if rule == "end":
        return last, crosses
    best = first.copy()
    ends = np.append(starts[1:], np.iinfo("i8").max)
    for i in np.flatnonzero(crosses):
        over = [min(spans[i, 1], ends[s]) - max(spans[i, 0], starts[s]) for s in range(first[i], last[i] + 1)]
        best[i] = first[i] + int(np.argmax(over))
    return best, crosses


def section_tokens(docs: DataFrame, tokenizer: str, rule: str = "start",
                   sections: Callable[[str], list[int]] = line_starts) -> DataFrame:
    """``doc_id, section, start_char, end_char, n_tokens, n_crossing`` for
    every section of every document."""
    def run(it):
        enc = encoder(tokenizer, offsets=True)
        for b in it:
            ids, at, cols, held = b.column(0), 0, [[], [], [], [], [], []], 0
            for i, t in enumerate(b.column(1)):
                text = t.as_py() or ""
                starts = np.array(sections(text), "i8")
                got, crosses = allocate(enc.token_spans(text), starts, rule)
                n = len(starts)
                for c, v in zip(cols, (np.full(n, i), np.arange(n), starts, np.append(starts[1:], len(text)),
                                       np.bincount(got, minlength=n), np.bincount(got[crosses], minlength=n)),
                                strict=True):
                    c.append(v)
                held += n
                if held >= 20_000:
                    yield flush(ids, cols)
                    cols, held = [[], [], [], [], [], []], 0
            if held:
                yield flush(ids, cols)

    def flush(ids, cols):
        a = [np.concatenate(c).astype("i8") for c in cols]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a[0])), *map(pa.array, a[1:])],
                                          ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id bigint, section bigint, start_char bigint, end_char bigint, n_tokens bigint, n_crossing bigint")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


#: SQL has no tokenizer; the query is tested against the tokenizer's own offsets.
SQL = None
