import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from quarry.llm import context_mixing as m
from quarry.llm.common import shared_dir, table


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def brute(rows):
    train = [t for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted((str(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
                   round(sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)


@pytest.mark.parametrize("extra", [False, True])
def test_counts_and_base_scores(spark, make_docs, edge_rows, extra):
    rows = [*edge_rows, *[(i, f"common w{i % 7} words É{i} end") for i in range(20, 80)]]
    got = m.scores(make_docs(rows, extra=extra)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == brute(rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert m.scores(make_docs([])).count() == 0


def test_held_out_is_better_than_bytes_alone(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    r = m.scores(docs).where("held_out").selectExpr("sum(score) AS s", "sum(n_bytes) AS n", "sum(base_score) AS b").first()
    assert -r["s"] / math.log10(2) / r["n"] < 2.4


def model(texts):
    n = np.bincount(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), minlength=256)
    code = m.Code(n.tolist())
    counts = [np.zeros(2 << b) for b in m.TABLE_BITS]
    for part in m.parts(texts):
        at, bit, _ = m.slots([texts[i] for i in part], code)
        for c, a in zip(counts, at, strict=True):
            np.add.at(c, a * np.uint32(2) + bit, 1)
    odds = [np.log((c[1::2] + 0.4) / (c[0::2] + 0.4)) for c in counts]
    return code, [np.clip(np.rint(16 * o), -127, 127).astype("i1") for o in odds]


def test_scores_do_not_depend_on_neighbours():
    texts = [b"the cat sat on the mat", b"", b"the dog sat on the log " * 40, b"zq"]
    code, tables = model(texts)
    together = m.Mixer().run(tables, texts, code)
    alone = [m.Mixer().run(tables, [t], code)[0] for t in texts]
    assert together == pytest.approx(alone, rel=1e-4)


def test_probabilities_of_one_place_add_up_to_one():
    """All continuations of a text by one byte, given what came before."""
    code, tables = model([b"abcabcabd", b"abd"])
    lone = m.Mixer()
    base = lone.run(tables, [b"abcab"], code)[0]
    total = 0.0
    for b in range(256):
        bits = lone.run(tables, [b"abcab" + bytes([b])], code)[0] if b != 10 else base
        # the last byte's bits alone: without the end byte that follows it
        at, bit, first = m.slots([b"abcab" + bytes([b])], code)
        end = int(code.length[10])
        if b == 10:
            continue
        z = _bits_before_end(lone, tables, b"abcab" + bytes([b]), code, end)
        z0 = _bits_before_end(lone, tables, b"abcab", code, end)
        total += 2 ** -(z - z0)
    total += 2 ** -(base - _bits_before_end(lone, tables, b"abcab", code, int(code.length[10])))
    assert total == pytest.approx(1, abs=1e-3)


def _bits_before_end(mixer, tables, text, code, end):
    """Bits of a short text without its end byte (it is below one step)."""
    keep = m.slots

    def cut(texts, c):
        at, bit, first = keep(texts, c)
        n = len(bit) - end
        return [a[:n] for a in at], bit[:n], np.array([0, n])
    m.slots = cut
    try:
        return mixer.run(tables, [text], code)[0]
    finally:
        m.slots = keep


def test_context_odds_are_those_of_all_training_texts(spark, make_docs):
    """No context is blurred or cut: noise fills more places than any table of fixed size has."""
    rng = np.random.default_rng(1)
    noise = "".join(map(chr, rng.integers(97, 123, 1_500_000)))
    rows = [(i, f"the cat number {i % 5} sat on mat {i * i}") for i in range(60)] + [(100, noise), (101, noise[:300_000][::-1])]
    docs = make_docs(rows).repartition(3)
    blocks = m.saved(m.text_blocks(docs), "text-blocks")
    code, slices = m.byte_code(blocks), 3
    got = {r["block"]: r["odds"] for r in m.context_odds(blocks, code, slices).groupBy("block").agg(
        m.F.collect_list(m.F.struct("slice", "odds")).alias("odds")).collect()}
    node_counts = Counter()
    path = [[(int(code.nodes[code.first[b] + d]), int(code.bits[code.first[b] + d])) for d in range(code.length[b])] for b in range(256)]
    small = [t.encode() for i, t in rows if i < 100 and m.fold(i) not in (m.HELD_OUT, m.WEIGHT_FOLD)]
    big = [t.encode() for i, t in rows if i >= 100 and m.fold(i) not in (m.HELD_OUT, m.WEIGHT_FOLD)]
    assert big
    for t in small:
        for i, b in enumerate(t + b"\n"):
            for node, bit in path[b]:
                node_counts[(b"\n" * 6 + t)[i:i + 6], node, bit] += 1
    alone = set().union(*({(b"\n" * 6 + t)[i:i + 6] for i in range(len(t) + 1)} for t in big))
    seen = unseen = 0
    for r in blocks.collect():
        texts = m.unpacked(r["texts"])
        g, odds = m.Grams(texts, code, slices * m.SUB, [False] * len(texts)), m.whole(got[r["block"]])
        for j, t in enumerate(texts):
            if len(t) > 1000:
                continue
            found, bit, first = g.bits([j], odds)
            assert first.tolist() == [0, found.shape[1]] and bit.tolist() == [y for b in t + b"\n" for _, y in path[b]]
            at = 0
            for i, b in enumerate(t + b"\n"):
                c = (b"\n" * 6 + t)[i:i + 6]
                for node, _ in path[b]:
                    if c not in alone:
                        zero, one = node_counts[c, node, 0], node_counts[c, node, 1]
                        assert abs(found[4, at] - np.clip(16 * math.log((one + 0.4) / (zero + 0.4)), -127, 127)) <= 1
                        seen, unseen = seen + (zero + one > 0), unseen + (zero + one == 0)
                    at += 1
    assert seen > 1000 and unseen > 100


def test_held_out_bits_fall_as_training_grows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    fold = "crc32(CAST(doc_id AS string)) % 7"
    held = docs.where(f"{fold} = 2 AND doc_id % 4 = 0")
    bits = []
    for n in (16, 4, 1):
        r = m.scores(held.unionByName(docs.where(f"{fold} <> 2 AND doc_id % {n} = 0"))).where("held_out")
        bits.append(r.selectExpr("-sum(score) / log10(2) / sum(n_bytes)").first()[0])
    print(bits)
    assert bits[0] > bits[1] > bits[2]


def stored(path):
    return sum(p.stat().st_size for p in path.rglob("*") if p.is_file())


def test_log_odds_are_not_stored_a_second_time(spark, make_docs):
    """Shuffles hold the looked-up log odds; beside them only texts and token counts are stored."""
    rng = np.random.default_rng(2)
    rows = [(i, "".join(map(chr, rng.integers(97, 123, 20_000)))) for i in range(40)]
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = stored(folder)
    assert m.scores(make_docs(rows)).count() == len(rows)
    assert stored(folder) - before < sum(len(t) for _, t in rows)


def test_blocks_share_what_many_texts_hold(spark, make_docs):
    """Contexts that texts have in common are sent and looked up once for many texts: here those of 8 MB."""
    text = "".join(map(chr, np.random.default_rng(3).integers(97, 123, 100_000)))
    blocks = m.saved(m.text_blocks(make_docs([(i, text) for i in range(80)]).coalesce(1)), "text-blocks")
    assert blocks.count() == 1
    code = m.byte_code(blocks)
    packed = m.context_odds(blocks, code, 2).selectExpr("aggregate(odds, 0, (n, x) -> n + length(x)) AS n").groupBy().sum("n").first()[0]
    assert packed < 5 * 5 * len(text)  # at most five orders of about five bits a byte, of one text


@pytest.mark.parametrize("shared", [False, True])
def test_mixing_is_that_of_the_plain_rule(shared):
    """Against a version bit by bit, with steps of many gates, classes and lengths."""
    rng = np.random.default_rng(4)
    first = np.cumsum([0, 700, 3, 256, 1])
    bit = rng.integers(0, 2, first[-1]).astype("u1")
    odds = rng.integers(-127, 128, (5, first[-1])).astype("i1") * (rng.random((5, first[-1])) < 0.6)
    mixer = m.Mixer()
    got = mixer.mixed(odds.astype("i1"), bit, first, shared=shared)
    w, fix = [[np.tile([0.3] * 5 + [0.0], (16, 1)) for _ in range(4)], [np.zeros((16, 33)) for _ in range(4)]]
    if shared:
        w, fix = [w[0]] * 4, [fix[0]] * 4
    want = np.zeros(4)
    for s in range(0, 700, m.STEP):
        dw, df = {}, {}
        for t in range(4):
            for j in range(first[t] + s, min(first[t] + s + m.STEP, first[t + 1])):
                o = odds[:, j].astype(int)
                g = (o[2] != 0) + 2 * (o[3] != 0) + 4 * (o[4] != 0) + 8 * (abs(o[4]) > 32)
                x = np.array([*(o / 16), 1.0])
                z = w[t][g] @ x
                c = int(np.clip(np.rint(z * 2) + 16, 0, 32))
                z = np.clip(z + fix[t][g, c], -16, 16)
                err = bit[j] - 1 / (1 + math.exp(-z))
                want[t] += np.logaddexp(0, -z if bit[j] else z) / math.log(2)
                lane = 0 if shared else t
                dw.setdefault((lane, g), []).append(err * x)
                df.setdefault((lane, g, c), []).append(err)
        for (t, g), v in dw.items():
            w[t][g] += m.RATE * np.sqrt(len(v)) / len(v) * np.sum(v, axis=0)
        for (t, g, c), v in df.items():
            fix[t][g, c] += m.FIX_RATE * sum(v) / (len(v) + 8)
    assert got == pytest.approx(want, rel=1e-3)
    if shared:
        assert mixer.weights == pytest.approx(w[0], abs=1e-3) and mixer.fixes == pytest.approx(fix[0], abs=1e-3)


def test_hashes_that_share_high_bits_stay_apart(monkeypatch):
    hashes = np.array([7, 8, 7, 9, 1 << 60, 8], "u8")
    monkeypatch.setattr(m, "word_hashes", lambda texts: (hashes, np.array([6])))
    distinct, _, uses, place, _ = m.vocabulary([b"x"], [next(i for i in range(9) if m.fold(i) != m.HELD_OUT)], 1)
    assert distinct[place].tolist() == hashes.tolist() and sorted(distinct.tolist()) == [7, 8, 9, 1 << 60]
    assert uses[place].tolist() == [2, 2, 2, 1, 1, 2]
