import itertools
import random

import duckdb
import pyarrow as pa
import pytest

from quarry.llm import decontaminate as d


def words(t):
    return [w.decode() for w in (t or "").encode().lower().split()]


def brute(docs, items, window=d.WINDOW, share=d.MIN_SHARE):
    """Every window of every diagonal of every text and item."""
    out = {}
    for i, a in docs:
        for k, b in items:
            x, y = words(a), words(b)
            diagonals = range(1 - len(y), len(x)) if y else ()
            for s in diagonals:
                agree = [0 <= q + s < len(x) and x[q + s] == y[q] for q in range(len(y))]
                n = min(window, len(y))
                best = max(sum(agree[q:q + n]) for q in range(len(y) - n + 1))
                if best >= n * share:
                    out.setdefault((i, a, k, b), []).append((s, sum(agree), best, n, len(y)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 30])))) for k in range(24)]
    items += [(50, None), (51, ""), (52, items[3][1]), (None, "v1 v2 v3 v4 v5 v6 v7 v8 v9")]
    docs = []
    for i in range(40):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            y = words(rng.choice(items[:24])[1])
            y = [rng.choice(vocab) if rng.random() < 0.15 else t for t in y]
            at = rng.randint(0, len(w))
            w[at:at] = y
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (7, docs[8][1]), (None, items[5][1].upper()), docs[0], (102, ("x " * 4000) + items[5][1])]
    return docs, items


def test_equals_brute_force(spark, make_docs):
    rows, items = corpus(4)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'q' AS words", "0 AS seed")
    want = brute(set(rows), set(items))
    for limit in (d.BROADCAST_SEEDS, 0):  # broadcast and shuffled seeds
        got = d.overlaps(make_docs(rows, extra=True), bench, broadcast_seeds=limit)
        got = sorted(map(str, ((r["doc_id"], r["item_id"], r["doc_start"], r["matches"], r["window_matches"], r["window_words"],
                               r["item_words"]) for r in got.collect())))
        assert got == sorted(str((i, k, *r)) for (i, _, k, _), v in want.items() for r in v)
    bad = {(i, a) for i, a, _, _ in want}
    kept = d.clean(make_docs(rows), bench).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept))) == sorted(str(r) for r in rows if r not in bad)


def test_substitutions_are_tolerated(spark, make_docs):
    item = " ".join(f"t{i}" for i in range(30))
    some = " ".join("other" if i % 7 == 3 else f"t{i}" for i in range(30))
    far = " ".join("other" if i % 2 else f"t{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = d.clean(make_docs([(1, f"a b {some} c"), (2, f"a b {far} c"), (3, item[:20])]), bench).collect()
    assert sorted(r["doc_id"] for r in kept) == [2, 3]


def test_empty_tables_and_native_plan(spark, make_docs):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert d.overlaps(make_docs([]), bench).count() == 0
    df = d.overlaps(make_docs([(1, "a b c d")]), bench.where("item_id > 5"))
    assert df.count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("n", range(1, 16))
def test_masks_miss_no_allowed_substitution(n):
    """Whichever words of an item differ, some mask hits a place without them."""
    masks = [*d.MASKS, *(d.short_masks(n) if n < d.SHORT else [])]
    window = min(n, d.WINDOW)
    allowed = max(k for k in range(window) if window - k >= window * d.MIN_SHARE)
    for changed in itertools.combinations(range(window), allowed):
        assert any(not {at + p for p in d.places(m)} & set(changed)
                   for m in masks for at in range(window - len(m) + 1)), changed


def test_sql_finds_short_items_too(spark, make_docs):
    rows, items = corpus(9)
    rows = [r for r in rows if r[0] != 102]
    con = duckdb.connect()
    for name, cols, data in (("documents", ("doc_id", "text"), rows), ("benchmark", ("item_id", "text"), items)):
        con.register(name, pa.table({c: pa.array(v, pa.int64() if i == 0 else pa.string()) for i, (c, v) in
                                     enumerate(zip(cols, zip(*data)))}))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.best_overlap(d.overlaps(make_docs(rows), bench))
    want = con.execute(d.SQL).to_arrow_table().to_pylist()
    assert sorted(str([r[c] for c in got.columns]) for r in got.collect()) == sorted(str([r[c] for c in got.columns]) for r in want)
