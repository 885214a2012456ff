"""Exact top-k search by inner product with KD-trees per shard.

Vectors are dealt over shards of a bounded number of rows by the top of a
KD-tree: median splits of a bounded sample (``SAMPLE_VALUES`` components), so
shards are boxes of their own; every row is indexed, and a cell that the sample
finds too full is dealt further by hash. Each shard is split at medians into a
KD-tree whose nodes keep a tight bounding box and their smallest id. A node's
bound is the largest inner product any point of its box can have with the
query. Traversal is best-first (highest bound, then smallest id) and stops when
no node left can beat the k-th result so far.

The k-th result is propagated: every block of queries (of one cell) first
searches the shard of its own cell, and takes the score and id of its k-th
result as the limit into all others. The root boxes of all shards are columns
of their own; blocks meet them in groups of ``BOX_SHARDS``, and only shards
whose box can beat the limit of some query of the block are sent to it.

Queries go in blocks of bounded size, so neither they nor the trees are ever
broadcast or gathered whole. All arithmetic is on integers (as doubles only
where every sum is below 2^53), so results are exact.

Defined cases: rows whose id or vector is null, or whose vector is empty or
holds a null or non-finite component take no part; only vectors of the same
number of components are compared; ties go to the smaller id; a query is not
its own candidate, by id; repeated rows of other ids each count, a repeated
query is one query; other columns are ignored; an empty table gives an empty
result; scores must fit 64 bits.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS = 8192, 512, 256
#: Components in the sample that fits the shards' splits; rows of it a cell has at least; boxes of a group.
SAMPLE_VALUES, CELL_SAMPLE, BOX_SHARDS = 1 << 21, 8, 1024


def scaled_floor(x: Column, scale: int = 256) -> Column:
    return F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vecs: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id``, ``vec`` (array of long), ``dim`` of the rows that take part."""
    finite = F.forall(F.col(vec_col), lambda v: v.isNotNull() & ~F.isnan(v.cast("double"))
                      & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    v = vecs.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite)
    return v.select(F.col(id_col).cast("long").alias("id"), scaled_floor(F.col(vec_col)).alias("vec"),
                    F.size(vec_col).alias("dim"))


# --- tree -------------------------------------------------------------------

def build(ids: np.ndarray, vecs: np.ndarray, leaf: int = LEAF_ROWS) -> dict:
    """KD-tree as arrays: rows in tree order, and per node its row range,
    children (-1: leaf), box and smallest id."""
    order = np.argsort(ids, kind="stable")
    ids, vecs = ids[order].copy(), vecs[order].copy()
    start, end, left, right, lo, hi, least = [], [], [], [], [], [], []

    def node(s: int, e: int) -> int:
        k = len(start)
        box_lo, box_hi = vecs[s:e].min(0), vecs[s:e].max(0)
        for c, v in zip((start, end, left, right, lo, hi, least), (s, e, -1, -1, box_lo, box_hi, ids[s:e].min()),
                        strict=True):
            c.append(v)
        return k

    todo = [node(0, len(ids))]
    while todo:
        k = todo.pop()
        s, e = start[k], end[k]
        if e - s <= leaf:
            continue
        spread = hi[k] - lo[k]
        axis = int(np.argmax(spread))
        o = s + (np.argsort(vecs[s:e, axis], kind="stable") if spread[axis] else np.argsort(ids[s:e], kind="stable"))
        ids[s:e], vecs[s:e] = ids[o], vecs[o]
        mid = (s + e) // 2
        left[k], right[k] = node(s, mid), node(mid, e)
        todo += [left[k], right[k]]
    return {"ids": ids, "vecs": vecs, "start": start, "end": end, "left": left, "right": right,
            "lo": np.array(lo), "hi": np.array(hi), "least": [int(x) for x in least]}


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer ``a @ b.T``."""
    most = lambda x: int(np.abs(x).max()) if x.size else 0
    if most(a) * most(b) * a.shape[-1] < 1 << 53:
        return (a.astype("f8") @ b.astype("f8").T).astype("i8")
    return a.astype(object) @ b.astype(object).T


def box_bounds(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Per query and box, the largest inner product with any point of the box."""
    return products(np.maximum(queries, 0), hi) + products(np.minimum(queries, 0), lo)


def search(tree: dict, qids: list[int], queries: np.ndarray, limits: list[tuple[int, int] | None], k: int
           ) -> list[tuple[int, int, int]]:
    """(query, id, score) of at most k rows per query, those that may be among
    the best k given the limit (score, id) of a k-th result found elsewhere."""
    bounds = box_bounds(queries, tree["lo"], tree["hi"]).tolist()
    out, least = [], tree["least"]
    for q, (qid, limit) in enumerate(zip(qids, limits, strict=True)):
        best: list[tuple[int, int]] = []  # (-score, id), ascending
        worst = (-limit[0], limit[1]) if limit else None
        heap = [(-bounds[q][0], least[0], 0)]
        while heap:
            neg, low, n = heapq.heappop(heap)
            if worst is not None and (neg, low) >= worst:
                break  # every node left is bounded below the k-th result
            if tree["left"][n] >= 0:
                for c in (tree["left"][n], tree["right"][n]):
                    heapq.heappush(heap, (-bounds[q][c], least[c], c))
                continue
            s, e = tree["start"][n], tree["end"][n]
            ids, score = tree["ids"][s:e], products(queries[q:q + 1], tree["vecs"][s:e])[0]
            keep = ids != qid
            if worst is not None:
                keep &= score >= -worst[0]
            rows = np.flatnonzero(keep)
            if len(rows) > k:
                rows = rows[np.lexsort((ids[rows], -score[rows].astype("i8")))[:k]]
            best = sorted([*best, *((-int(score[r]), int(ids[r])) for r in rows)])[:k]
            if len(best) == k and (worst is None or best[-1] < worst):
                worst = best[-1]
        out += [(qid, i, -neg) for neg, i in best]
    return out


# --- Spark ------------------------------------------------------------------

Cells = dict[int, list[tuple]]


def median_cells(sample: np.ndarray, total: float, shard_rows: int) -> list[tuple]:
    """Splits of ``sample`` at medians, as nodes (axis, value, left, right): a
    row goes left below the value. A leaf is (-1, first shard, shards, 0): its
    ``total`` share of rows, in shards of ``shard_rows``."""
    nodes: list[tuple] = [()]
    todo, first = [(0, np.arange(len(sample)))], 0
    while todo:
        n, rows = todo.pop()
        share = total * len(rows) / max(len(sample), 1)
        x = sample[rows]
        axis = int(np.argmax(x.max(0) - x.min(0))) if len(rows) else 0
        value = int(np.median(x[:, axis])) if len(rows) else 0
        below = x[:, axis] < value if len(rows) else np.zeros(0, bool)
        if not below.any() and len(rows):  # the median is the least value: split above it
            value += 1
            below = x[:, axis] < value
        if share <= shard_rows or len(rows) < 2 * CELL_SAMPLE or below.all() or not below.any():
            shards = max(1, -(-int(share) // shard_rows))
            nodes[n] = (-1, first, shards, 0)
            first += shards
            continue
        left, right = len(nodes), len(nodes) + 1
        nodes += [(), ()]
        nodes[n] = (axis, value, left, right)
        todo += [(left, rows[below]), (right, rows[~below])]
    return nodes


def cells_of(vecs: DataFrame, shard_rows: int) -> Cells:
    """Per number of components, ``median_cells`` of a bounded sample."""
    total, widest = vecs.agg(F.count(F.lit(1)), F.max("dim")).first()
    if not total:
        return {}
    rows = max(1, SAMPLE_VALUES // widest)
    some = vecs if total <= rows else vecs.sample(rows / total / 2, seed=1).limit(rows)
    by_dim: dict[int, list] = {}
    for r in some.select("dim", "vec").collect():
        by_dim.setdefault(r["dim"], []).append(r["vec"])
    sampled = sum(map(len, by_dim.values()))
    return {d: median_cells(np.array(v, "i8"), total * len(v) / sampled, shard_rows) for d, v in by_dim.items()}


def dealt(vecs: DataFrame, cells: Cells) -> DataFrame:
    """``vecs`` with ``cell`` and ``shard`` (a row of a size that the sample
    lacks is in cell 0). A row's shard in its cell is by hash of its place."""
    def run(it):
        for g in it:
            cell, shard = np.zeros(len(g), "i8"), np.zeros(len(g), "i8")
            dims, salt = g["dim"].to_numpy(), g["salt"].to_numpy("i8")
            for d in np.unique(dims):
                nodes = cells.get(int(d), [(-1, 0, 1, 0)])
                rows = np.flatnonzero(dims == d)
                x = np.array(g["vec"].iloc[rows].tolist(), "i8")
                todo = [(0, np.arange(len(rows)))]
                while todo:
                    n, some = todo.pop()
                    axis, value, left, right = nodes[n]
                    if axis < 0:
                        cell[rows[some]], shard[rows[some]] = value, value + salt[rows[some]] % left
                    elif len(some):
                        below = x[some, axis] < value
                        todo += [(left, some[below]), (right, some[~below])]
            yield g.drop(columns="salt").assign(cell=cell, shard=shard)
    # repeated rows are told apart: a third of all rows may be one row
    salted = vecs.select("id", "vec", "dim", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(1 << 31)).alias("salt"))
    return salted.mapInPandas(run, "id bigint, vec array<bigint>, dim int, cell bigint, shard bigint")


def shard_trees(placed: DataFrame) -> DataFrame:
    """``dim, shard, tree`` and the root's box (``lo``, ``hi``, ``least``)."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        tree = build(g["id"].to_numpy("i8"), np.array(g["vec"].tolist(), "i8"))
        return pd.DataFrame({"dim": [int(g["dim"].iloc[0])], "shard": [int(g["shard"].iloc[0])],
                             "tree": [pickle.dumps(tree, protocol=5)], "lo": [tree["lo"][0].tolist()],
                             "hi": [tree["hi"][0].tolist()], "least": [tree["least"][0]]})
    return saved(placed.groupBy("dim", "shard").applyInPandas(
        run, "dim int, shard bigint, tree binary, lo array<bigint>, hi array<bigint>, least bigint"), "kd-trees")


def box_groups(trees: DataFrame) -> DataFrame:
    """The root boxes of ``BOX_SHARDS`` neighbouring shards: ``dim, part, boxes``."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        packed = (g["shard"].tolist(), np.array(g["lo"].tolist(), "i8"), np.array(g["hi"].tolist(), "i8"), g["least"].tolist())
        return pd.DataFrame({"dim": [int(g["dim"].iloc[0])], "part": [int(g["part"].iloc[0])], "boxes": [pickle.dumps(packed, protocol=5)]})
    parts = trees.select("dim", "shard", "lo", "hi", "least", F.floor(F.col("shard") / BOX_SHARDS).cast("long").alias("part"))
    return saved(parts.groupBy("dim", "part").applyInPandas(run, "dim int, part bigint, boxes binary"), "kd-boxes")


def blocks(queries: DataFrame, size: int) -> DataFrame:
    """One row per block of queries of one cell: ``dim, cell, block, queries`` (pickled)."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        limits = [None if pd.isna(s) else (int(s), int(i))
                  for s, i in zip(g["limit_score"], g["limit_id"], strict=True)]
        packed = (g["id"].tolist(), np.array(g["vec"].tolist(), "i8"), limits)
        return pd.DataFrame({"dim": [int(g["dim"].iloc[0])], "cell": [int(g["cell"].iloc[0])], "block": [int(g["block"].iloc[0])],
                             "queries": [pickle.dumps(packed, protocol=5)]})
    per_cell = queries.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("n"))
    numbered = queries.join(per_cell, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("n")).cast("int")).drop("n")
    return numbered.groupBy("dim", "cell", "block").applyInPandas(run, "dim int, cell bigint, block int, queries binary")


def reachable(later: DataFrame, groups: DataFrame) -> DataFrame:
    """``dim, cell, block, shard`` where the shard's box can beat the limit of a
    query of the block; its own cell's first shard, searched before, is left out."""
    def run(it):
        for g in it:
            out = []
            for dim, cell, block, queries, boxes in zip(*(g[c] for c in ("dim", "cell", "block", "queries", "boxes")), strict=True):
                (_, vecs, limits), (shards, lo, hi, least) = pickle.loads(queries), pickle.loads(boxes)
                bounds, least = box_bounds(vecs, lo, hi), np.array(least)
                can = np.zeros(len(shards), bool)
                for b, limit in zip(bounds, limits, strict=True):
                    can |= True if limit is None else (b > limit[0]) | ((b == limit[0]) & (least < limit[1]))
                out += [(dim, cell, block, s) for s, c in zip(shards, can, strict=True) if c and s != cell]
            yield pd.DataFrame(out, columns=["dim", "cell", "block", "shard"])
    # a stated set of queries, in blocks, against the groups of boxes
    last = groups.agg(F.max("part")).first()[0]
    each = later.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long"))))
    pairs = each.join(groups, ["dim", "part"]).select("dim", "cell", "block", "queries", "boxes")
    return pairs.mapInPandas(run, "dim int, cell bigint, block int, shard bigint")


def search_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """Searches of (tree, queries) rows: ``query_id, vec_id, score``."""
    def run(it):
        for g in it:
            found = []
            for tree, queries in zip(g["tree"], g["queries"], strict=True):
                found += search(pickle.loads(tree), *pickle.loads(queries), k)
            yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])
    return pairs.select("tree", "queries").mapInPandas(run, "query_id bigint, vec_id bigint, score bigint")


def top_k(vecs: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS,
          block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of ``vecs`` with the
    highest inner product for each of ``queries`` (both: id, vec, dim)."""
    cells = cells_of(vecs, shard_rows)
    trees = shard_trees(dealt(vecs, cells))
    asked = dealt(queries.groupBy("id", "dim").agg(F.min("vec").alias("vec")), cells)
    asked = saved(asked.select("id", "dim", "vec", "cell"), "kd-queries")
    plain = asked.withColumn("limit_score", F.lit(None).cast("long")).withColumn("limit_id", F.lit(None).cast("long"))
    home = trees.select("dim", F.col("shard").alias("cell"), "tree")  # a cell has the number of its first shard
    near = saved(search_pairs(blocks(plain, block_queries).join(home, ["dim", "cell"]), k), "kd-near")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = (near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k)
           .select(F.col("query_id").alias("id"), F.col("score").alias("limit_score"), F.col("vec_id").alias("limit_id")))
    later = saved(blocks(asked.join(kth, "id", "left"), block_queries), "kd-blocks")
    wanted = reachable(later, box_groups(trees))
    far = search_pairs(wanted.join(later, ["dim", "cell", "block"]).join(trees.select("dim", "shard", "tree"), ["dim", "shard"]), k)
    rank = F.row_number().over(w)
    return (near.unionByName(far).withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op5_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vecs, vecs.where(F.col("id") % 50 == 0), 5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
