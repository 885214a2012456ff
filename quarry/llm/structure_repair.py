"""Conversation structure repair by weighted CYK parsing of intervals.

A conversation's roles should read ``(s?(ua)+)?`` (initials of system, user and
assistant). Its rows may be kept (cost 0), given another role (user or
assistant, 3) or deleted (4; blank and repeated rows must be), and rows with
empty text may be inserted anywhere (user or assistant, 3); a row left in place
whose text stops short adds 3. The cheapest edits win, ties the ASCII-least
audit (the edits' initials K, R, D, I in order).

The repair grammar is in Chomsky normal form. A nonterminal is the set of
substrings of right conversations with given first and last letters (``ua`` is
``(ua)+``, ``uu`` is ``u(au)*``, ``ss`` is ``s`` alone), or ``""`` for nothing
left. ``XY -> XL RY`` holds where ``LR`` may stand side by side; nothing left
beside ``X`` gives ``X``. A cell of the chart, for rows i to j, holds per
nonterminal the least (cost, audit). Cells of single rows come from the edits,
longer ones from all splits, by span length; every cell is closed under
insertions at both ends. The least audit of a span is made of the least audits
of its parts, as equal costs never make one audit the beginning of another.

Scale: rows are numbered in two levels, so no conversation must fit one task.
A chart spans at most ``SPAN`` rows; its top cell then is one position of the
next chart, so a long conversation takes a few rounds of bounded groups, and
equal blocks are parsed once per worker process. Repeats are found by an
aggregate over (conversation, role, text hash). A conversation's audit is one
value and its SHA-256 runs through its text in order, so these two are
linear in the longest conversation; texts are streamed there, not held.

Defined cases: null roles and texts are one space, a null ``conv_id`` is a
conversation of its own; rows go by (turn, role, hash of the text), a null
turn first; repeated rows are rows; an initial other than s, u and a is in no
legal pair; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.grouping import number_within

from .common import CRC_TABLE_SQL, crc32_sql, saved, table

SPAN = 32
SPACES = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
NAMES = {"s": "system", "u": "user", "a": "assistant"}
#: Letters that may stand side by side, and what a whole conversation may be.
SIDE_BY_SIDE = ("su", "ua", "au")
ROOTS = ("", "ua", "sa")

Cell = dict[str, tuple[int, str]]


# -- the grammar -------------------------------------------------------------

def _rules() -> tuple[tuple[str, str, str], ...]:
    """(left, right, result) of every binary rule."""
    spans = ["ss", *(f + l for f in "sua" for l in "ua")]
    rules = [(x, y, x[0] + y[1]) for x in spans for y in spans if x[1] + y[0] in SIDE_BY_SIDE]
    return (("", "", ""), *(("", x, x) for x in spans), *((x, "", x) for x in spans), *rules)


RULES = _rules()
INSERTED = {"uu": (INSERT, "I"), "aa": (INSERT, "I")}


def combined(left: Cell, right: Cell, into: Cell) -> None:
    """``into`` with what a split into ``left`` and ``right`` gives."""
    for x, y, z in RULES:
        a, b = left.get(x), right.get(y)
        if a is None or b is None:
            continue
        cost, best = a[0] + b[0], into.get(z)
        if best is None or cost < best[0] or (cost == best[0] and a[1] + b[1] < best[1]):
            into[z] = (cost, a[1] + b[1])


def closed(cell: Cell) -> Cell:
    """``cell`` with insertions at both ends, until none is cheaper."""
    while True:
        before = dict(cell)
        combined(before, INSERTED, cell)
        combined(INSERTED, before, cell)
        if cell == before:
            return cell


def row_cell(symbol: str) -> Cell:
    """A row: its role's initial (``o`` for others), upper case if its text
    stops short, ``x`` if it must go."""
    cell = {"": (DELETE, "D")}
    if symbol != "x":
        role, more = symbol.lower(), UNFINISHED if symbol.isupper() else 0
        for to in "ua":
            cell[to + to] = (REROLE + more, "R")
        if role in NAMES:
            cell[role + role] = (KEEP + more, "K")
    return closed(cell)


def chart(cells: Sequence[Cell]) -> Cell:
    """The top cell over neighbouring spans, combined by span length."""
    n = len(cells)
    spans = {(i, i + 1): c for i, c in enumerate(cells)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell: Cell = {}
            for k in range(i + 1, i + length):
                combined(spans[i, k], spans[k, i + length], cell)
            spans[i, i + length] = closed(cell)
    return spans[0, n]


@lru_cache(maxsize=100_000)
def block_cell(symbols: str) -> Cell:
    return chart([row_cell(s) for s in symbols])


def best_root(cell: Cell) -> tuple[int, str, str]:
    """(cost, audit, plan): the plan has a letter per edit: ``k`` kept, ``d``
    deleted, ``u`` and ``a`` the new role, ``U`` and ``A`` an inserted row's."""
    root = min((r for r in ROOTS if r in cell), key=cell.__getitem__)
    cost, audit = cell[root]
    plan, at = [], -1 if root[:1] == "s" else 0
    for e in audit:
        if e == "D":
            plan.append("d")
            continue
        role = "s" if at < 0 else "ua"[at & 1]
        plan.append("k" if e == "K" else role if e == "R" else role.upper())
        at += 1
    return cost, audit, "".join(plan)


# -- rows --------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """``conv, turn, role, text, copy`` after the damage that a row's checksum
    chooses; ``conv`` is ``conv_id`` as text, ``-`` for null."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    c = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("-")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        text_of("role").alias("role"), text_of("text").alias("text"),
        (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return c.where("kind != 0").select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` plus ``text_hash`` and ``pos`` (place in the conversation, from 0)."""
    hashed = rows.withColumn("text_hash", F.unhex(F.sha2("text", 256)))
    out = number_within(hashed, ["conv"], ["turn", "role", "text_hash", "copy"], "pos", store=lambda d: saved(d, "turns"))
    return out.withColumn("pos", F.col("pos") - 1)


def faults(rows: DataFrame) -> DataFrame:
    """``conv, pos, turn, initial, fault`` (blank, duplicate, truncated or null)
    of numbered rows."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    narrow = rows.select(
        "conv", "pos", "turn", "role", "text_hash", F.when(initial.isin(*NAMES), initial).otherwise("o").alias("initial"),
        (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("short"))
    first = rows.groupBy("conv", "role", "text_hash").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("first"))
    fault = (F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("short"), "truncated"))
    return narrow.join(first, ["conv", "pos"], "left").select("conv", "pos", "turn", "initial", fault.alias("fault"))


CELL = pa.list_(pa.struct([("name", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
STATE = "conv string, block bigint, cell array<struct<name: string, cost: bigint, audit: string>>, first string, last string, illegal bigint"


def _state(b: pa.RecordBatch, cells: list[Cell], first: list[str], last: list[str], illegal: list[int]) -> pa.RecordBatch:
    rows = [[{"name": n, "cost": c, "audit": a} for n, (c, a) in cell.items()] for cell in cells]
    return pa.RecordBatch.from_arrays(
        [b.column("conv"), b.column("block"), pa.array(rows, CELL), pa.array(first, pa.string()), pa.array(last, pa.string()),
         pa.array(illegal, pa.int64())], ["conv", "block", "cell", "first", "last", "illegal"])


def strange(initials: str) -> int:
    """Neighbours that may not stand side by side."""
    return sum(x + y not in SIDE_BY_SIDE for x, y in zip(initials, initials[1:]))


def parsed_blocks(marked: DataFrame, span: int = SPAN) -> DataFrame:
    """The top cell of every ``span`` rows."""
    symbol = (F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial"))
              .otherwise(F.col("initial")))
    rows = F.array_sort(F.collect_list(F.struct("pos", symbol.alias("symbol"), "initial")))
    text = lambda name: F.array_join(F.transform("rows", lambda r: r[name]), "").alias(name)
    blocks = (marked.groupBy("conv", F.expr(f"pos div {span}").alias("block")).agg(rows.alias("rows"))
              .select("conv", "block", text("symbol"), text("initial")))

    def run(batches):
        for b in batches:
            initials = b.column("initial").to_pylist()
            cells = [block_cell(s) for s in b.column("symbol").to_pylist()]
            yield _state(b, cells, [i[0] for i in initials], [i[-1] for i in initials], [strange(i) for i in initials])
    return blocks.mapInArrow(run, STATE)


def parsed_spans(state: DataFrame, span: int = SPAN) -> DataFrame:
    """The next chart: the top cells of ``span`` neighbours are its positions."""
    spans = F.array_sort(F.collect_list(F.struct("block", "cell", "first", "last", "illegal")))
    groups = state.groupBy("conv", F.expr(f"block div {span}").alias("block")).agg(spans.alias("spans"))

    def run(batches):
        for b in batches:
            cells, first, last, illegal = [], [], [], []
            for spans in b.column("spans").to_pylist():
                cells.append(chart([{c["name"]: (c["cost"], c["audit"]) for c in s["cell"]} for s in spans]))
                first.append(spans[0]["first"])
                last.append(spans[-1]["last"])
                illegal.append(sum(s["illegal"] for s in spans)
                               + sum(x["last"] + y["first"] not in SIDE_BY_SIDE for x, y in zip(spans, spans[1:])))
            yield _state(b, cells, first, last, illegal)
    return groups.mapInArrow(run, STATE)


def parsed(marked: DataFrame, span: int = SPAN) -> DataFrame:
    """``conv, cost, audit, plan, illegal`` per conversation."""
    most = (marked.agg(F.max("pos")).first()[0] or 0) // span
    state = parsed_blocks(marked, span)
    while most > 0:
        state, most = parsed_spans(state, span), most // span

    def run(batches):
        for b in batches:
            best = [best_root({c["name"]: (c["cost"], c["audit"]) for c in cell}) for cell in b.column("cell").to_pylist()]
            cost, audit, plan = zip(*best, strict=True) if best else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column("conv"), pa.array(cost, pa.int64()), pa.array(audit, pa.string()), pa.array(plan, pa.string()),
                 b.column("illegal")], ["conv", "cost", "audit", "plan", "illegal"])
    return state.mapInArrow(run, "conv string, cost bigint, audit string, plan string, illegal bigint")


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv, pos, lines`` in order of (conv, pos),
    where ``lines`` are the ``role:text`` that stand for a row and the inserted
    ones before it (those after the last row have a place of their own)."""
    edits = F.array_append(F.regexp_extract_all("plan", F.lit("([UA]*[kuad])"), F.lit(1)),
                           F.concat(F.regexp_extract("plan", "([UA]*)$", 1), F.lit("d")))
    e = plans.select("conv", F.posexplode(edits).alias("pos", "edit"))
    e = e.withColumn("pos", F.col("pos").cast("long")).where("edit != 'd'")
    full = e.join(rows.select("conv", "pos", "role", "text"), ["conv", "pos"], "left")
    name = lambda letter: F.when(letter == "u", NAMES["u"]).otherwise(NAMES["a"])
    inserted = F.transform(F.split(F.expr("substring(edit, 1, length(edit) - 1)"), ""), lambda x: F.concat(name(F.lower(x)), F.lit(":")))
    mine = F.substring("edit", -1, 1)
    own = F.when(mine == "k", F.concat("role", F.lit(":"), "text")).when(mine != "d", F.concat(name(mine), F.lit(":"), "text"))
    some = F.when(F.length("edit") > 1, inserted).otherwise(F.array().cast("array<string>"))
    return full.select("conv", "pos", F.concat(some, F.when(mine == "d", F.array().cast("array<string>")).otherwise(F.array(own))).alias("lines"))


def digests(lines: DataFrame) -> DataFrame:
    """``conv, repaired_sha256``: every conversation's lines run through one
    hash in order; no conversation's text is held whole."""
    ordered = lines.repartition("conv").sortWithinPartitions("conv", "pos")

    def run(batches):
        conv, h, done = None, None, []
        for b in batches:
            for c, some in zip(b.column("conv").to_pylist(), b.column("lines").to_pylist(), strict=True):
                if c != conv:
                    if h:
                        done.append((conv, h.hexdigest()))
                    conv, h, lead = c, hashlib.sha256(), ""
                for line in some:
                    h.update((lead + line).encode())
                    lead = "\n"
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["conv", "repaired_sha256"])
                done = []
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([h.hexdigest()])], ["conv", "repaired_sha256"])
    return ordered.mapInArrow(run, "conv string, repaired_sha256 string")


def repair(rows: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(faults per row, plans per conversation, repaired lines) of rows
    ``conv, turn, role, text, copy``."""
    places = numbered(rows)
    marked = saved(faults(places), "turn-faults")
    plans = saved(parsed(marked, span), "turn-plans")
    return marked, plans, repaired(places, plans)


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "conversations"))


def report(conversations: DataFrame, span: int = SPAN) -> DataFrame:
    """The damaged and repaired conversations' counts, costs, audits and digests."""
    marked, plans, lines = repair(damaged(conversations), span)
    kinds = ("blank", "duplicate", "truncated")
    turns = marked.groupBy("conv", "turn").agg(*[F.count(F.when(F.col("fault") == k, 1)).alias(k) for k in kinds])
    counts = turns.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"), *[F.sum(k).alias(k) for k in kinds])
    ids = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")).alias("conv")).distinct()
    out = ids.join(counts, "conv", "left").join(plans, "conv", "left").join(digests(lines), "conv", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        F.when(F.col("conv") != "-", F.col("conv")).cast("long").alias("conv_id"), number("gaps"), *map(number, kinds),
        number("illegal"), number("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The same result by another method: the least (cost, audit) per row and state
#: of the pattern's automaton (0 before anything, 1 after s, 2 after u, 3 after a).
SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM c, (VALUES (0), (1)) v(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
r AS MATERIALIZED (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS initial,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS before
  FROM damaged),
f AS MATERIALIZED (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM r),
inserts(was, will, k) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (1, 2, 1), (3, 2, 1), (2, 3, 1), (0, 3, 2), (1, 3, 2)),
letters(was, letter, will) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
edits AS MATERIALIZED (
  SELECT conv_id, pos, n, s.state AS was, s.state AS will, 4 AS cost, 'D' AS edit FROM f, (VALUES (0), (1), (2), (3)) s(state)
  UNION ALL
  SELECT conv_id, pos, n, was, will, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K'
  FROM f JOIN letters ON letter = initial WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT conv_id, pos, n, was, will, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R'
  FROM f JOIN letters ON letter <> 's' WHERE fault NOT IN ('blank', 'duplicate')),
moves AS MATERIALIZED (
  SELECT e.conv_id, e.pos, e.n, i.was, e.will, e.cost + 3 * i.k AS cost, repeat('I', i.k) || e.edit AS edit
  FROM edits e JOIN inserts i ON i.will = e.was),
best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS state, lpad('0', 12, '0') AS least, n FROM f
  UNION ALL
  SELECT b.conv_id, b.pos + 1, m.will,
    min(lpad((substr(least, 1, 12)::BIGINT + m.cost)::VARCHAR, 12, '0') || substr(least, 13) || m.edit), b.n
  FROM best b JOIN moves m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.pos = b.pos + 1 AND m.was = b.state
  GROUP BY b.conv_id, b.pos, m.will, b.n),
ends AS MATERIALIZED (
  SELECT conv_id, substr(min(whole), 1, 12)::BIGINT AS cost, substr(min(whole), 13) AS audit
  FROM (SELECT conv_id, lpad((substr(least, 1, 12)::BIGINT + 3 * k)::VARCHAR, 12, '0') || substr(least, 13) || repeat('I', k) AS whole
        FROM best JOIN inserts ON was = state AND ((will = 3) OR (was = 0 AND will = 0)) WHERE pos = n)
  GROUP BY conv_id),
steps AS (
  SELECT conv_id, i, substr(audit, i::INTEGER, 1) AS edit FROM ends, range(1, (SELECT max(length(audit)) + 1 FROM ends)) g(i) WHERE i <= length(audit)),
placed AS (
  SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER w AS pos, count(*) FILTER (WHERE edit <> 'D') OVER w AS nth_out
  FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
shown AS (
  SELECT p.conv_id, p.i, p.edit, p.nth_out, f.role, f.text, max(CASE WHEN p.nth_out = 1 AND p.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END)
    OVER (PARTITION BY p.conv_id) AS system
  FROM placed p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos AND p.edit <> 'I' WHERE p.edit <> 'D'),
hashes AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth_out - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY i)) AS repaired_sha256
  FROM shown GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM i.conv_id
"""
