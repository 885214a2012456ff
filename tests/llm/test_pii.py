import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import pii as p

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def luhn(d):
    t = [int(c) for c in d][::-1]
    return (sum(t[0::2]) + sum(sum(divmod(2 * x, 10)) for x in t[1::2])) % 10 == 0


def brute(text):
    """The four patterns as they are written."""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("a@.b-1234567890+ ()%é,\n")), max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert p.base_spans(text) == brute(text)


CARD, PHONE = "4111 1111 1111 1111", "+1 (555) 123-4567"


def test_repeats_become_consistent(spark, make_docs):
    rows = [(1, f"call {PHONE} now.\n" + "word " * 500 + "or 15551234567 later"), (2, "only 15551234567 here"),
            (3, f"pay {CARD} and " + "x " * 50 + "4111111111111111 9"), (4, "mail jo.smith7@ex.org; jo.smith7 said, user jo.smith7@ex")]
    docs = make_docs(rows)
    m = p.Model(p.fit(docs))
    got = {r["doc_id"]: r for r in p.find(docs, m).collect()}
    assert "phone:" in got[1]["spans"].split(",")[1] and got[1]["n_phone"] == 1 and got[1]["n_added"] == 1
    assert got[2]["spans"] == "" and got[2]["n_added"] == 0
    assert got[4]["n_email"] == 1 and got[4]["n_added"] == 2
    for i, t in rows:  # base spans stay
        assert set(p.joined(brute(t)).split(",")) - {""} <= set(got[i]["spans"].split(","))


def test_whole_table_and_edges(spark, make_docs, edge_rows):
    rng = random.Random(1)
    rows = [*edge_rows, (50, "4111111111111111 " * 3000), (51, ("a.b@c.d " + PHONE + " 1.2.3.4\n") * 400)]
    rows += [(60 + i, "".join(rng.choice("a@.b-123+ ()\n") for _ in range(400))) for i in range(20)]
    docs = make_docs(rows, extra=True)
    got = p.find(docs, p.Model(p.fit(docs))).collect()
    want = sorted((str(i), p.joined(brute(t or "")), *(sum(k == n for _, k, _ in brute(t or "")) for n in range(4))) for i, t in rows)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted((str(r["doc_id"]), r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got) \
        == sorted((i, digest(s), *n) for i, s, *n in want)
    assert p.find(make_docs([]), p.Model(p.fit(make_docs([])))).count() == 0


def test_masking(spark, make_docs):
    docs = make_docs([(1, f"a@b.co, {PHONE}, 10.0.0.1"), (2, None), (3, "clean text 12345")], extra=True)
    got = {r["doc_id"]: r["text"] for r in p.redact(docs, p.Model(p.fit(docs))).collect()}
    assert got == {1: "[EMAIL], [PHONE], [IP]", 2: None, 3: "clean text 12345"}


def exact(node, kind, w):
    """Whether ``kind`` is likelier than none for one of ``m`` equal bare units
    whose pairs are all linked, also with a certain unit of ``kind``: sums over
    how many of them have each label. ``node``: (m, log potentials)."""
    m, theta = node

    def total(n, fixed):  # log sum over the labels of n units, beside units of fixed labels
        out = np.full(n + 1, -np.inf)
        out[0] = 0.0
        for label, t in enumerate(theta):
            c = np.arange(n + 1)
            held = c + fixed.count(label)
            f = c * t + w * held * (held - 1) / 2 - np.array([math.lgamma(x + 1) for x in c])
            out = np.array([np.logaddexp.reduce(out[:k + 1] + f[k::-1]) for k in range(n + 1)])
        return out[n]
    return theta[kind] + total(m - 1, [kind, kind]) > theta[p.NONE] + total(m - 1, [kind, p.NONE])


@pytest.mark.parametrize("m", [1, 2, 3, 10, 1000])
def test_every_repeat_is_found_however_many(m):
    text = f"call {PHONE} now.\n" + "".join("word " * 30 + "or 15551234567 later\n" for _ in range(m))
    alone = "".join("word " * 30 + "or 15551234567 later\n" for _ in range(m))
    base = p.base_spans(text)
    assert len(base) == 1
    for w in (5.0, 7.0, 9.0):
        for odds in (2.0, 3.0, 4.0):
            model = p.Model({}, skip_least=w, skip_most=w)
            theta = np.array([-odds] * p.NONE + [0.0])
            model.nodes, model.rare = {}, theta
            assert exact((m, theta), 3, w)
            assert len(model.spans(text, base)) == 1 + m
            assert model.spans(alone, p.base_spans(alone)) == []


def test_exact_inference_is_that_of_all_labels():
    for m, w, odds, chosen in ((3, 5.0, 4.0, True), (3, 1.0, 4.0, False), (2, 5.0, 2.0, True)):
        theta = np.array([-odds] * p.NONE + [0.0])
        got = np.zeros(p.NONE + 1)
        for labels in itertools.product(range(p.NONE + 1), repeat=m):
            every = (3, *labels)
            same = sum(a == b for a, b in itertools.combinations(every, 2))
            got[labels[0]] += math.exp(sum(theta[x] for x in labels) + w * same)
        assert (got[3] > got[p.NONE]) == exact((m, theta), 3, w) == chosen


def test_agreement_counts_all_pairs_of_a_key():
    text = f"{PHONE}\n15551234567\n{PHONE}\n15551234567\n{PHONE}\n"
    assert sum(n for g, c, n in p.cells(text) if (g, c) == ("skip", "same")) == 3


def marginals(node, links, weights):
    """Of all variables, by summing over every assignment."""
    n, k = node.shape
    out = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        w = math.exp(sum(node[i, x] for i, x in enumerate(labels))
                     + sum(v for (i, j), v in zip(links, weights) if labels[i] == labels[j]))
        for i, x in enumerate(labels):
            out[i, x] += w
    return out / out.sum(1, keepdims=True)


def normal(belief):
    e = np.exp(belief - belief.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@pytest.mark.parametrize("weight", [0.3, 1.0, 2.5, 5.0])
def test_messages_through_a_hub_in_doubt_are_exact(weight):
    """No certain unit, uncertain ones of several shapes: a tree, so marginals
    are exact, the hub's too, and each unit's evidence reaches the others."""
    text = "\n".join(["15551234567", "+1 5551234567x", "1-555-123-4567"])
    nodes = p.units(text, [])
    model = p.Model({}, skip_least=weight, skip_most=weight)
    rng = np.random.default_rng(3)
    node, links, weights = model.graph(text, nodes)
    assert len(node) == len(nodes) + 1 and len(links) == len(nodes) >= 3
    node[:len(nodes)] = rng.normal(0, 1, (len(nodes), p.NONE + 1))
    got, want = normal(p.beliefs(node, links, weights)), marginals(node, links, weights)
    assert want[-1].max() < 0.9  # the hub is in doubt
    assert np.abs(got - want).max() < 1e-4
    node[0, 3] += 3  # evidence of one uncertain unit moves the others
    moved = normal(p.beliefs(node, links, weights))
    assert (moved[1:, 3] > got[1:, 3]).all()


def test_certain_units_of_two_kinds_leave_the_hub_in_doubt():
    """A loop (hub and line) and certain units that disagree: the label of each
    uncertain unit is that of exact inference."""
    text = "+15551234567 and 15551234567 or 1-555-123-4567\nthen 15551234567"
    first = p.base_spans(text)
    assert [k for _, k, _ in first] == [3]
    for other in (0, 1, 2):  # as if the last one were certain, of another kind
        base = sorted([*first, (text.rindex("15551234567"), other, len(text))])
        nodes = p.units(text, base)
        model = p.Model({}, skip_least=1.5, skip_most=1.5)
        model.chain = 0.5
        node, links, weights = model.graph(text, nodes)
        node = np.maximum(node, -12)
        assert len(links) > len(node) - 1  # a loop
        got, want = normal(p.beliefs(node, links, weights)), marginals(node, links, weights)
        assert (got[:-1].argmax(1) == want[:-1].argmax(1)).all()
        assert np.abs(got - want).max() < 0.1
