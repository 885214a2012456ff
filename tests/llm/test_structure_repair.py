import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from quarry.llm import structure_repair as s

S = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                  T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
ROLE = {"u": "user", "a": "assistant"}
RIGHT = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def fault_of(row, before):
    end = row[3].strip(" \t\n\x0b\f\r")
    return "blank" if not end else "duplicate" if (row[2], row[3]) in before else "" if end[-1] in ".!?" else "truncated"


def least(rows, kinds):
    """(cost, audit, output) by a walk from the left over the pattern's states
    (what the output ends with; S is the beginning)."""
    step = {("S", "s"): "s", ("S", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def inserted(states):
        for _ in range(3):
            for (st, (cost, audit, out)) in list(states.items()):
                for r in "ua":
                    if (st, r) in step:
                        new = (cost + 3, audit + "I", (*out, ROLE[r] + ":"))
                        to = step[st, r]
                        states[to] = min(states.get(to, new), new)
        return states
    states = inserted({"S": (0, "", ())})
    for (_, _, role, text), kind in zip(rows, kinds, strict=True):
        after = {}
        for st, (cost, audit, out) in states.items():
            options = [(st, (cost + 4, audit + "D", out))]
            if kind not in ("blank", "duplicate"):
                more = 3 if kind == "truncated" else 0
                if (st, role[:1]) in step:
                    options.append((step[st, role[:1]], (cost + more, audit + "K", (*out, f"{role}:{text}"))))
                options += [(step[st, r], (cost + 3 + more, audit + "R", (*out, f"{ROLE[r]}:{text}"))) for r in "ua" if (st, r) in step]
            for to, new in options:
                after[to] = min(after.get(to, new), new)
        states = inserted(after)
    return min(states[x] for x in "Sa" if x in states)


def brute(rows):
    out = set()
    hurt = damage(rows)
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in hurt if r[0] == c),
                      key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        kinds, before = [], set()
        for r in mine:
            kinds.append(fault_of(r, before))
            before.add((r[2], r[3]))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, lines = least(mine, kinds)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out.add((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"),
                 kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def random_rows(seed, conversations, most):
    rnd = random.Random(seed)
    texts = ["Yes.", "no", "  \n", "", None, "Why?", "é ok!", "a. b", "Yes."] + [f"t{i}." for i in range(40)]
    roles = ["user", "assistant"] * 6 + ["system", "tool", "agent", "", None]
    return [(c, rnd.choice([t, t, t, t + rnd.randint(0, 2), None]), rnd.choice(roles), rnd.choice(texts))
            for c in range(conversations) for t in range(rnd.randint(1, most))]


def test_chart_against_every_edit():
    """All sequences of edits with up to three insertions, on up to three rows."""
    for symbols in map("".join, itertools.chain.from_iterable(itertools.product("suaUox", repeat=n) for n in (1, 2, 3))):
        found = []
        for edits in itertools.product("DKR", repeat=len(symbols)):
            if any(x == "x" and e != "D" for x, e in zip(symbols, edits)):
                continue
            for gaps in itertools.product(range(4), repeat=len(symbols) + 1):
                if sum(gaps) > 3:
                    continue
                audit = "".join("I" * g + e for g, e in zip(gaps, (*edits, "")))
                slots = [("ua", 3)] * gaps[0]
                for x, e, g in zip(symbols, edits, gaps[1:]):
                    more = 3 if x.isupper() else 0
                    slots += {"D": [("", 4)], "K": [(x.lower(), more)], "R": [("ua", 3 + more)]}[e] + [("ua", 3)] * g
                cost = sum(c for _, c in slots)
                if any(RIGHT.match("".join(p)) for p in itertools.product(*[x or [""] for x, _ in slots])):
                    found.append((cost, audit))
        assert s.best_root(s.block_cell(symbols))[:2] == min(found), symbols


@pytest.mark.parametrize("span", [2, 3, 32])
def test_report_against_brute_force(spark, span):
    rows = random_rows(span, 60, 14) + [(1000, t, "user", f"hot {t}") for t in range(90)]
    df = spark.createDataFrame(rows, S).repartition(5)
    assert {tuple(r) for r in s.report(df, span).collect()} == brute(rows)


def test_defined_cases(spark):
    rows = [(None, None, None, None), (None, 3, "user", "x."), (5, 0, "user", "same."), (5, 0, "user", "same."), (6, 0, "assistant", "long " * 30_000),
            (7, -4, "system", "s."), (7, 9, "user", "u.")]
    df = spark.createDataFrame(rows, S).selectExpr(
        "*", "1 AS pos", "'c' AS conv", "'c' AS kind", "2 AS copy", "'c' AS fault", "'c' AS block", "'c' AS audit")
    assert {tuple(r) for r in s.report(df).collect()} == brute(rows)
    assert s.report(spark.createDataFrame([], S)).count() == 0


def test_conversation_without_rows_after_damage(spark):
    gone = next(t for t in range(500) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, gone, "user", "x.")], S)
    assert [tuple(r) for r in s.report(df).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversation_takes_bounded_groups(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}." if t % 50 else f"turn {t}") for t in range(1500)]
    rows += [(2, t, "assistant", f"turn {t}!") for t in range(300)]
    assert {tuple(r) for r in s.report(spark.createDataFrame(rows, S)).collect()} == brute(rows)
