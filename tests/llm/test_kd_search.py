import random

import numpy as np
from pyspark.sql import types as T

from quarry.llm import kd_search as k

S = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                  T.StructField("score", T.StringType())])


def brute(rows, wanted, top):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in ok if wanted(i)}:
        s = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in ok if i != q and len(c) == len(v))[:top]
        out |= {(q, r + 1, i, -n) for r, (n, i) in enumerate(s)}
    return out


def run(spark, rows, **options):
    v = k.usable(spark.createDataFrame(rows, S), "vec_id", "embedding")
    return sorted(tuple(r) for r in k.top_k(v, v.where("id % 3 = 0"), 5, **options).collect())


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], "x") for i in range(150)]
    hot = [0.5] * 6
    rows += [(200 + i, hot, "x") for i in range(60)]  # ties
    rows += [(300, None, "x"), (301, [], "x"), (302, [1.0, None], "x"), (303, [float("nan")] * 6, "x"),
             (306, [float("inf")] * 6, "x"), (None, hot, "x"), (309, [1.0, 2.0], "x"), (310, [3.0, -2.0], "x")]
    want = sorted(brute(rows, lambda i: i % 3 == 0, 5))
    assert run(spark, rows, shard_rows=40, block_queries=16) == want
    assert run(spark, rows) == want


def test_repeated_rows_few_rows_and_none(spark):
    rows = [(3, [1.0, 1.0], "x"), (3, [1.0, 1.0], "x"), (4, [2.0, 0.0], "x"), (4, [2.0, 0.0], "x")]
    assert run(spark, rows) == [(3, 1, 4, 131072), (3, 2, 4, 131072)]
    assert run(spark, []) == []


def test_large_components_stay_exact():
    ids, v = np.arange(4), np.array([[2 ** 31, 1], [2 ** 31, 2], [-2 ** 31, 3], [1, 1]], "i8")
    got = k.search(k.build(ids, v, 1), [9], np.array([[2 ** 30, 7]], "i8"), [None], 2)
    assert got == [(9, 1, 2 ** 61 + 14), (9, 0, 2 ** 61 + 7)]


def test_propagated_limit_prunes():
    rng = np.random.default_rng(1)
    tree = k.build(np.arange(500), rng.integers(-99, 99, (500, 4)), 8)
    q = rng.integers(-99, 99, (1, 4))
    best = k.search(tree, [-1], q, [None], 5)
    limit = (best[2][2], best[2][1])
    assert k.search(tree, [-1], q, [limit], 5) == best[:2] or k.search(tree, [-1], q, [limit], 5)[:2] == best[:2]


def test_shards_are_boxes_that_limits_rule_out(spark):
    """Clusters: shards follow them, most pairs of blocks and shards are never
    formed, and results stay those of brute force."""
    rng = random.Random(5)
    at = [[rng.choice([-20, 20]) + rng.gauss(0, 0.1) for _ in range(4)] for _ in range(16)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in at[i % 16]], "x") for i in range(960)]
    assert run(spark, rows, shard_rows=40, block_queries=16) == sorted(brute(rows, lambda i: i % 3 == 0, 5))
    v = k.usable(spark.createDataFrame(rows, S), "vec_id", "embedding")
    cells = k.cells_of(v, 40)
    placed = k.dealt(v, cells)
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert len(sizes) >= 24 and max(sizes) <= 80 and sum(sizes) == 960
    trees = k.shard_trees(placed)
    best = {q: (n, i) for q, r, i, n in brute(rows, lambda i: True, 5) if r == 5}
    limits = spark.createDataFrame([(q, n, i) for q, (n, i) in best.items()], "id long, limit_score long, limit_id long")
    later = k.blocks(placed.select("id", "dim", "vec", "cell").join(limits, "id"), 64)
    assert k.reachable(later, k.box_groups(trees)).count() < later.count() * len(sizes) / 3


def test_one_vector_may_hold_a_third_of_all_rows(spark):
    rng = random.Random(6)
    rows = [(i, [1.0, 1.0, 1.0] if i % 3 else [rng.gauss(0, 1) for _ in range(3)], "x") for i in range(600)]
    v = k.usable(spark.createDataFrame(rows, S), "vec_id", "embedding")
    sizes = [r["count"] for r in k.dealt(v, k.cells_of(v, 50)).groupBy("shard").count().collect()]
    assert max(sizes) <= 100
    assert run(spark, rows, shard_rows=50, block_queries=32) == sorted(brute(rows, lambda i: i % 3 == 0, 5))
