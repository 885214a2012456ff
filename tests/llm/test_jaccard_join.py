import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import context_mixing
from quarry.llm import jaccard_join as j
from quarry.llm import shingles as s


def shingles(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and j.linked(both, len(sets[a]), len(sets[b])):
                comp[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None] if sets[a] else [i]
        out.append((i, len(sets[a]), min(ids, default=None)))
    return out


KEY = lambda r: tuple(str(x) for x in r)


def corpus(seed, groups=12, singles=30):
    """Near copies at all distances, shared passages, exact copies."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, rows = text(40), []
    for g in range(groups):
        base = text(rng.randint(6, 120))
        for _ in range(rng.randint(2, 14)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w))
    for _ in range(singles):
        w = text(rng.randint(1, 60))
        k = rng.randint(0, len(w))
        rows.append(" ".join(w[:k] + passage + w[k:]) if rng.random() < 0.6 else " ".join(w))
    rows += [rows[0].upper(), rows[1].replace(" ", " \n "), " ".join(passage), " ".join(passage)]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


def test_sets_match_words():
    texts = ["", "a", "A b\tc\vd", "a b c d e", "a b c d e a b c d e a", "\u0085x é É ß \x1f y z q", " ".join(map(str, range(3000)))]
    got = s.shingle_sets([t.encode() for t in texts], most_bytes=20)
    assert [len(x) for x in got] == [len(shingles(t)) for t in texts]
    one = s.shingle_sets([t.encode() for t in texts])
    assert all((a == b).all() for a, b in zip(got, one, strict=True))
    assert s.set_id(s.shingle_sets([b"A b c d e"])[0]) == s.set_id(s.shingle_sets([b"a  b c d E"])[0])


@pytest.mark.parametrize("block", [2, 64])
def test_components_equal_brute_force(spark, make_docs, block):
    rows = corpus(block)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.joined(make_docs(rows, extra=True), block=block).collect()]
    assert sorted(got, key=KEY) == sorted(brute(rows), key=KEY)


def test_edges(spark, make_docs, edge_rows):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.joined(make_docs(edge_rows)).collect()]
    assert sorted(got, key=KEY) == sorted(brute(edge_rows), key=KEY)
    assert j.joined(make_docs([])).count() == 0


def test_tree_keeps_every_linked_pair():
    rng = np.random.default_rng(2)
    for _ in range(20):
        base = rng.integers(0, 1 << 63, 300).astype("u8")
        sets = [np.unique(np.concatenate((base[rng.random(300) < rng.uniform(0.7, 1)],
                                          rng.integers(0, 1 << 63, rng.integers(0, 40)).astype("u8")))) for _ in range(30)]
        a, b, _ = j.Tree(np.array([len(x) for x in sets]), np.array([len(x) for x in sets]), [j.bitmap(x) for x in sets]).pairs()
        got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
        for x in range(30):
            for y in range(x):
                both = len(np.intersect1d(sets[x], sets[y]))
                if j.linked(both, len(sets[x]), len(sets[y])):
                    assert (y, x) in got
                    n, k = len(sets[x]), len(sets[y])
                    assert j.fits_bitmaps(n, n, j.bitmap(sets[x]), k, k, j.bitmap(sets[y]))


def test_one_row_of_each_component_stays(spark, make_docs, edge_rows):
    rows = [*edge_rows, *[(i + 1000, t) for i, t in corpus(9, 5, 5)]]
    kept = j.one_per_component(make_docs(rows)).collect()
    want = brute(rows)
    empty = sum(n == 0 for _, n, _ in want)
    assert len(kept) == empty + len({c for _, n, c in want if n})
    assert sorted(str(r["doc_id"]) for r in kept if shingles(r["text"])) == sorted({str(c) for _, n, c in want if n})


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (-5, 200)]
    got = {r["cid"]: r["comp"] for r in j.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, -5: -5, 200: -5}


def test_partitions_of_copies_of_one_text(spark):
    """Every row is a partition: blocks of equal classes keep names of their own."""
    rows = []
    for k in range(8):
        text = " ".join(f"t{k}w{i}" for i in range(13))
        rows += [(10 * k, text), (10 * k + 1, text), (10 * k + 2, f"{text} more{k} tail{k}")]  # 9 of 11 shingles
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id bigint, text string")
    blocks = j.saved(j.text_blocks(docs), "text-blocks")
    assert blocks.select("block").distinct().count() == blocks.count() == len(rows)
    got = j.frequencies(blocks, 3)
    assert got.count() == got.select("block", "slice").distinct().count()
    assert all(r["component_id"] == r["doc_id"] // 10 * 10 for r in j.joined(docs).collect())


def test_blocks_of_context_mixing_have_names_of_their_own(spark):
    docs = spark.createDataFrame(spark.sparkContext.parallelize([(2, "one text")] * 4, 4), "doc_id bigint, text string")
    blocks = context_mixing.saved(context_mixing.text_blocks(docs), "text-blocks")
    assert blocks.select("block").distinct().count() == blocks.count() == 4
    got = context_mixing.scores(docs).collect()
    assert len(got) == 4 and {(r["n_tokens"], r["train_tokens"]) for r in got} == {(3, 12)}


def boilerplate(m, own=15):
    """Texts of one passage of 100 words and 15 words of their own: all share
    shingles, none links."""
    passage = " ".join(f"p{i}" for i in range(100))
    return [(k, f"{passage} " + " ".join(f"d{k}x{i}" for i in range(own))) for k in range(m)]


def test_hot_shingles_make_rows_in_proportion(spark, make_docs):
    counts = {}
    for m in (600, 2400):
        docs = make_docs(boilerplate(m))
        sigs = j.saved(j.signatures(j.saved(j.text_blocks(docs), "text-blocks"), 3), "signatures")
        now = sigs.dropDuplicates(["cid"]).withColumn("comp", F.col("cid"))
        found = j.saved(j.gathered(j.held(now, 16), 8, 16), "blocks")
        assert found.agg(F.max(F.size("sub"))).first()[0] <= 16 * j.SUB
        counts[m] = found.agg(F.sum(F.size("sub"))).first()[0], j.sub_rows(found).count()
    assert counts[2400][0] <= 4.4 * counts[600][0]  # holders of each shingle once
    assert counts[2400][1] <= 4.4 * counts[600][1] + 100  # and no pair of sub-blocks that caps exclude
    got = j.joined(make_docs(boilerplate(300)), block=8).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got)


def test_links_across_sub_blocks(spark, make_docs):
    """One boilerplate group with hidden links between texts that share most of their own words."""
    rows = boilerplate(150, own=40)
    rows += [(1000 + k, rows[k][1].rsplit(" ", 2)[0] + f" other{k}") for k in range(0, 150, 7)]
    rows += [(2000 + k, rows[k][1].replace(f"d{k}x20", "z")) for k in range(3, 150, 11)]
    random.Random(3).shuffle(rows)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.joined(make_docs(rows), block=4).collect()]
    assert sorted(got, key=KEY) == sorted(brute(rows), key=KEY)


def test_rows_of_a_shared_shingle_grow_with_its_holders(spark):
    many, few, parts = 2400, 60, 24
    comp = [0] * many + [1 + k // 2 for k in range(few)]
    rows = [(k, 100 + k % 7, 100, c, np.array([5], "u8").tobytes()) for k, c in enumerate(comp)]
    rows = [rows[i] for p in range(parts) for i in range(p, len(rows), parts)]
    classes = spark.createDataFrame(rows, "cid bigint, n int, cap int, comp bigint, keys binary").repartition(parts, "n", "cid")
    found = j.gathered(j.held(classes, 32), 4, 32)
    got = j.sub_rows(found).collect()
    assert len(got) <= 3 * len(rows)  # pairs of the tasks' parts would be many times that
    sides = {}
    for r in got:
        sides.setdefault((r["kind"], r["fp"]), ([], []))[r["pos"] if r["kind"] == "cross" else 0].append(r["cid"])
    met = set()
    for (kind, _), (a, b) in sides.items():
        assert len(a) <= 32 * j.SUB and len(b) <= 32 * j.SUB
        met |= {(min(x, y), max(x, y)) for x in a for y in (b if kind == "cross" else a) if comp[x] != comp[y]}
    assert met == {(x, y) for x in range(many + few) for y in range(max(x + 1, many), many + few) if comp[x] != comp[y]}
