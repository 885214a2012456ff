"""Personal data by fixed patterns and a skip-chain conditional random field.

Fixed patterns give the base spans (email, ip, card, phone). Every base span
and every other candidate (a digit group, a word with an ``@``, or a repeat of
an email's local part) is a node; its label is one of the four kinds or none.
Potentials:

* node: how often units of the same shape carry each label in the whole
  corpus; a base span is held to its kind,
* chain: between units that follow each other within a line,
* skip: between all units, however distant, that share a key (the same last
  digits, the same local part of an email). What a unit's certain partners say
  is a constant, as their labels are known; and all units of a key, certain or
  not, share a hub: a hidden variable whose value they tend to take. So two
  uncertain repeats support each other, and the work is linear in the units.

All counts behind the potentials are sums over all documents (``fit``, one
grouped aggregation with a few hundred cells). Loopy belief propagation runs
within each document, along its lines and between units and hubs, both ways
(tested against sums over all labels); a unit whose most likely label is a
kind becomes a span. So a number that is no base span on its own is one where
the same digits are a card or phone elsewhere in the text, however often they
repeat. Base spans are always kept.

Defined cases: a null text is an empty one, without spans; texts are searched
whole, however long; repeated rows give repeated results; null ids are kept;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only start where a run of digits does: else long runs cost their square.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().-]*[0-9])+")
_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_NOT_ALNUM = re.compile(r"[^a-z0-9]+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost non-overlapping matches of ``_EMAIL``: one can only start
    at the start of a run of local characters that ends at an ``@``."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the fixed patterns, ascending."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- nodes and edges ---------------------------------------------------------

def keys_of(kind_or_none: int, part: str) -> list[str]:
    """Keys by which units count as repeated or similar."""
    if "@" in part:
        local = _NOT_ALNUM.sub("", part.split("@")[0].lower())
        return [f"e{local}"] if len(local) >= 4 else []
    digits = _NOT_DIGIT.sub("", part)
    if kind_or_none == 1 or len(digits) < 7:
        return []
    return [f"d{digits[-10:]}"] if len(digits) >= 10 else [f"s{digits[-7:]}"]


def shape(part: str) -> str:
    n = len(_NOT_DIGIT.sub("", part))
    return "@" if "@" in part else f"{min(n, 20)}{'.' if part.count('.') == 3 else ''}"


def units(text: str, base: list[Span]) -> list[tuple[int, int, int, str]]:
    """(start, end, base kind or NONE, key text) of all candidate units."""
    out = [(s, e, k, text[s:e]) for s, k, e in base]
    starts, ends = [], []  # of the merged base spans
    for s, _, e in base:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def free(s: int, e: int) -> bool:
        i = bisect_right(ends, s)
        return i == len(ends) or starts[i] >= e

    if _DIGIT.search(text):
        out += [(m.start(), m.end(), NONE, m[0]) for m in _NUMBER.finditer(text)
                if len(_NOT_DIGIT.sub("", m[0])) >= 7 and free(*m.span())]
    at = text.find("@")
    while at >= 0:
        s, e = at, at + 1
        while s > 0 and text[s - 1] in _LOCAL:
            s -= 1
        while e < len(text) and text[e] in _LOCAL:
            e += 1
        if e - s > 5 and s < at and free(s, e):
            out.append((s, e, NONE, text[s:e]))
        at = text.find("@", e)
    locals_ = {x for x in (text[s:e].split("@")[0] for s, k, e in base if k == 0) if len(x) >= 5 and not x.isalpha()}
    if locals_:
        out += [(m.start(), m.end(), NONE, f"{m[0]}@") for m in _RUN.finditer(text)
                if m[0] in locals_ and text[m.end():m.end() + 1] != "@" and free(*m.span())]
    return sorted(set(out))


def chains(text: str, nodes: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """Units that follow each other within a line."""
    return [(i - 1, i) for i in range(1, len(nodes))
            if 0 <= nodes[i][0] - nodes[i - 1][1] <= 80 and "\n" not in text[nodes[i - 1][1]:nodes[i][0]]]


def hubs(nodes: list[tuple[int, int, int, str]]) -> dict[str, list[int]]:
    """Per key, how many certain units of each kind hold it."""
    out: dict[str, list[int]] = {}
    for _, _, k, part in nodes:
        if k != NONE:
            for key in keys_of(k, part):
                out.setdefault(key, [0] * NONE)[k] += 1
    return out


# --- potentials --------------------------------------------------------------

def cells(text: str) -> list[tuple[str, str, int]]:
    """What a document adds to the counts: (group, cell, number)."""
    nodes = units(text, base_spans(text))
    out = [("node", f"{shape(p)}|{k}", 1) for _, _, k, p in nodes]
    # labels that other evidence holds: only pairs of base spans tell agreement
    out += [("chain", "same" if nodes[a][2] == nodes[b][2] else "other", 1)
            for a, b in chains(text, nodes) if NONE not in (nodes[a][2], nodes[b][2])]
    for n in hubs(nodes).values():  # all pairs of a hub
        same = sum(x * (x - 1) // 2 for x in n)
        out += [("skip", "same", same), ("skip", "other", sum(n) * (sum(n) - 1) // 2 - same)]
    return out


def fit(docs: DataFrame) -> dict[str, int]:
    """Counts over all documents: a table bounded by shapes and labels."""
    def run(it):
        total: dict = defaultdict(int)
        for b in it:
            for t in b.column(0):
                for group, cell, n in cells(t.as_py() or ""):
                    total[f"{group}:{cell}"] += n
        yield pa.RecordBatch.from_pydict({"cell": pa.array(list(total), pa.string()),
                                          "n": pa.array(list(total.values()), pa.int64())})
    g = docs.select("text").mapInArrow(run, "cell string, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    return {r["cell"]: r["n"] for r in g.collect()}


class Model:
    """Log potentials from the counts. A node's odds against a kind are held
    within ``node_most``, the weight of a shared key is at least ``skip_least``:
    one certain occurrence can convince an uncertain one, shape alone cannot."""

    def __init__(self, counts: dict[str, int], node_most: float = 4.0, skip_least: float = 5.0,
                 skip_most: float = 9.0, chain_most: float = 0.5):
        by_shape: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(NONE + 1))
        for cell, n in counts.items():
            if cell.startswith("node:"):
                s, k = cell[5:].rsplit("|", 1)
                by_shape[s][int(k)] += n
        total = sum(by_shape.values(), np.zeros(NONE + 1)) + 1
        prior = total / total.sum()

        def log_node(c: np.ndarray) -> np.ndarray:
            p = np.log((c + 4 * prior) / (c.sum() + 4))
            kinds = np.clip(p[:NONE] - p[NONE], -node_most, -node_most / 2)  # no rule holds: none is likelier
            return np.append(kinds, 0.0)
        self.nodes = {s: log_node(c) for s, c in by_shape.items()}
        self.rare = log_node(np.zeros(NONE + 1))

        def agree(kind: str, least: float, most: float) -> float:
            same, other = counts.get(f"{kind}:same", 0), counts.get(f"{kind}:other", 0)
            return float(np.clip(math.log((same + 1) / (other + 1)), least, most))
        self.skip, self.chain = agree("skip", skip_least, skip_most), agree("chain", -chain_most, chain_most)

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Base spans and those that belief propagation adds, ascending."""
        if not base:
            return base  # without a certain unit every unit stays none
        nodes = units(text, base)
        if len(nodes) == len(base):
            return base
        label = beliefs(*self.graph(text, nodes))[:len(nodes)].argmax(1)
        added = [(s, int(l), e) for (s, e, k, _), l in zip(nodes, label, strict=True) if k == NONE and l != NONE]
        return sorted([*base, *added])

    def graph(self, text: str, nodes: list[tuple[int, int, int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The document's random field: log potentials of its variables (the
        units, then a hub for every key that several units hold, with none of
        its own), edges and their weights. A skip edge to a certain unit adds a
        constant, as that unit's label is known; units of a key share the hub."""
        said = hubs(nodes)
        held: dict[str, list[int]] = {}
        for i, (_, _, k, part) in enumerate(nodes):
            for key in keys_of(k, part):
                held.setdefault(key, []).append(i)
        shared = [x for x in held.values() if len(x) > 1]
        node = np.zeros((len(nodes) + len(shared), NONE + 1))
        for i, (_, _, k, part) in enumerate(nodes):
            if k != NONE:
                node[i] = -50.0
                node[i, k] = 0.0
                continue
            node[i] = self.nodes.get(shape(part), self.rare)
            for key in keys_of(k, part):
                node[i, :NONE] += self.skip * np.array(said.get(key, [0] * NONE))
        near = chains(text, nodes)
        far = [(i, len(nodes) + h) for h, x in enumerate(shared) for i in x]
        return (node, np.array(near + far, "i8").reshape(-1, 2),
                np.array([self.chain] * len(near) + [self.skip] * len(far)))


def beliefs(node: np.ndarray, links: np.ndarray, weights: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Log marginals (but for a constant) by loopy sum-product messages, both
    ways over every edge, damped by half; exact where there is no loop."""
    n = len(links)
    a, b = np.concatenate((links, links[:, ::-1])).T
    pair = np.concatenate((weights, weights))[:, None, None] * np.eye(node.shape[1])
    back = np.concatenate((np.arange(n) + n, np.arange(n)))
    msg = np.zeros((2 * n, node.shape[1]))  # from a to b
    belief = node.copy()
    for _ in range(rounds):
        out = (belief[a] - msg[back])[:, :, None] + pair
        new = np.logaddexp.reduce(out, axis=1)
        new -= new.max(1, keepdims=True)
        done = np.abs(new - msg).max(initial=0) < 1e-6
        msg = new if done else 0.5 * msg + 0.5 * new
        belief = node.copy()
        np.add.at(belief, b, msg)
        if done:
            break
    return belief


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, counts and digest of the base spans, all ``spans``."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(it):
        for batch in it:
            cols: list[list] = [[] for _ in names[1:]]
            for t in batch.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                every = model.spans(text, base)
                n = [sum(k == j for _, k, _ in base) for j in range(NONE)]
                said = joined(base)
                for c, v in zip(cols, (*n, hashlib.sha256(said.encode()).hexdigest(), joined(every),
                                       len(every) - len(base)), strict=True):
                    c.append(v)
            types = [pa.int64()] * NONE + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, types)], names)
    ddl = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with ``[KIND]`` for every span; overlapping spans become one."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with every span masked in ``text`` (a null text stays null)."""
    at = docs.columns.index("text")

    def run(it):
        for b in it:
            new = []
            for t in b.column(at):
                text = t.as_py()
                new.append(text if not text else mask(text, model.spans(text, base_spans(text))))
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
    return docs.mapInArrow(run, docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, Model(fit(docs)))


#: Neither offsets of all matches nor message passing can be told in SQL; the
#: query is tested against a brute-force version.
SQL = None
