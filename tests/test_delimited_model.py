"""Randomized equivalence of the regex row splitter with a plain token state
machine written from the parsing rules (quote toggles anywhere, doubled quote
inside quotes, LF/CR/CRLF row ends, blank rows dropped)."""

import random
import re

import pytest

from quarry.sources.delimited import ParseError, split_rows


def token_model(text, delim):
    toks = re.findall(r'[^"\r\n' + re.escape(delim) + r']+|"|\r\n|\r|\n|' + re.escape(delim), text)
    rows, row, cell, quoted, i = [], [], [], False, 0
    while i < len(toks):
        t = toks[i]
        i += 1
        if t == '"':
            if quoted and i < len(toks) and toks[i] == '"':
                cell.append('"')
                i += 1
            else:
                quoted = not quoted
        elif quoted:
            cell.append(t)
        elif t == delim:
            row.append("".join(cell))
            cell = []
        elif t in ("\n", "\r", "\r\n"):
            row.append("".join(cell))
            cell = []
            if any(row):
                rows.append(row)
            row = []
        else:
            cell.append(t)
    if quoted:
        raise ParseError("Unclosed quoted field")
    row.append("".join(cell))
    if any(row):
        rows.append(row)
    return rows


@pytest.mark.parametrize("delim", [",", "\t", ";"])
def test_regex_splitter_matches_token_model(delim):
    rnd = random.Random(11)
    alphabet = ["a", "b", " ", '"', '""', delim, "\n", "\r", "\r\n", "x y", ","]
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14)))
        try:
            want = token_model(text, delim)
        except ParseError:
            with pytest.raises(ParseError):
                split_rows(text, delim)
            continue
        assert split_rows(text, delim) == want, repr(text)
