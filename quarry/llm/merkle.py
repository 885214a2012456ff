"""Merkle manifest of a dataset, proofs acquired by butterfly exchange.

Every row is a leaf, the hash of its columns; the leaves of a tree (here: a
language) in their order are combined two by two, level by level (a last node
alone is hashed alone), to the tree's root; the roots of all trees, in order
of their keys, are the leaves of a last tree, whose root signs the dataset. A
leaf's proof holds the siblings on its way up.

Leaves are numbered within their tree and cut into aligned blocks of
``2 ** bits`` consecutive ones. A block builds its own subtree. Then, round by
round, aligned groups of ``2 ** fan_bits`` neighbouring subtrees swap their
roots: each block of a group gets the roots of all the group's subtrees, one
from each, from the block at its own place there (a last subtree that is
shorter serves several places with each block). It hashes the group's upper
levels itself, redundantly, and so keeps its own upper siblings on the way up:
after the last round every block knows the root and its proof, and nothing is
handed down again.

Scale: texts are hashed where they are read; rows of two digests travel. A
tree that holds most rows is numbered in two levels (``number_within``) and
spread over its blocks; a block is a bounded group, a block receives at most
``2 ** fan_bits`` roots a round, and the number of rounds is the logarithm of
the largest tree's blocks. Only that number reaches the driver. Leaves are
stored in the shared folder; everything after is recomputed from there.

Defined cases: null columns hash as ``-``; rows of one id order by their
leaves, so repeated rows are equal neighbouring leaves; a null id is first and
is never tampered with; a null key is a tree of its own, first in order; other
columns are ignored; a tree of one leaf is that leaf; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.grouping import number_within

from .common import CRC_TABLE_SQL, crc32_sql, saved, table

BLOCK_BITS, FAN_BITS = 12, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    """H: lowercase hex SHA-256 of the parts' text, one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """A value as its length in UTF-8 bytes, a colon and itself; null is ``-``."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


# -- trees as plain lists: one block, or one group of subtree roots ----------

def above(nodes: list[str]) -> list[str]:
    """The next level."""
    return [digest(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]


def levels_of(count: int) -> int:
    """Levels above ``count`` nodes until one remains."""
    return (count - 1).bit_length()


def climb(nodes: list[str], at: int, levels: int) -> tuple[str, list[str | None]]:
    """The node ``levels`` above all of ``nodes``, and the siblings met on the
    way from place ``at`` (None where a node has none)."""
    siblings = []
    for _ in range(levels):
        other = at ^ 1
        siblings.append(nodes[other] if other < len(nodes) else None)
        nodes, at = above(nodes), at >> 1
    return nodes[0], siblings


def fold(node: str, at: int, siblings: Sequence[str | None]) -> str:
    """The root that a node at place ``at`` and its siblings give."""
    for s in siblings:
        node = digest(node) if s is None else digest(s, node) if at & 1 else digest(node, s)
        at >>= 1
    return node


def all_siblings(nodes: list[str], levels: int) -> list[list[str | None]]:
    """``climb``'s siblings for every place at once."""
    out = [[] for _ in nodes]
    for level in range(levels):
        for i, o in enumerate(out):
            other = (i >> level) ^ 1
            o.append(nodes[other] if other < len(nodes) else None)
        nodes = above(nodes)
    return out


# -- the exchange ------------------------------------------------------------

def place(leaves: DataFrame, order: Sequence[str], bits: int) -> DataFrame:
    """``leaves`` (with ``tree`` and ``digest``) plus ``at`` (place in the tree, from 0) and ``block``."""
    numbered = number_within(leaves, ["tree"], order, "at", store=lambda d: saved(d, "merkle-leaves"))
    return numbered.withColumn("at", F.col("at") - 1).withColumn("block", F.shiftright("at", bits))


def subtrees(placed: DataFrame, bits: int) -> DataFrame:
    """A row per block: ``tree, block, blocks, leaves, root, upper``: its own
    subtree's root (``bits`` levels up, or the whole tree's if it has one block)."""
    schema = "tree string, block bigint, size bigint, alone string, aligned string"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        nodes = g.sort_values("at")["digest"].tolist()
        alone, _ = climb(nodes, 0, levels_of(len(nodes)))
        return pd.DataFrame([[g["tree"].iloc[0], g["block"].iloc[0], len(nodes), alone, climb(nodes, 0, bits)[0]]],
                            columns=["tree", "block", "size", "alone", "aligned"])
    own = saved(placed.select("tree", "block", "at", "digest").groupBy("tree", "block").applyInPandas(run, schema), "merkle-blocks")
    counts = own.groupBy("tree").agg(F.count(F.lit(1)).alias("blocks"), F.sum("size").alias("leaves"))
    return own.join(counts, "tree").select(
        "tree", "block", "blocks", "leaves", F.when(F.col("blocks") == 1, F.col("alone")).otherwise(F.col("aligned")).alias("root"),
        F.array().cast("array<string>").alias("upper"))


def exchange(state: DataFrame, turn: int, fan_bits: int) -> DataFrame:
    """One round: blocks of aligned groups of subtrees swap roots and hash
    their group's levels. ``turn`` counts from 0; a subtree now spans
    ``2 ** (fan_bits * turn)`` blocks."""
    low = fan_bits * turn
    span = 1 << low
    names = {"lo": f"shiftleft(shiftright(block, {low + fan_bits}), {fan_bits})",  # the group's first subtree
             "place": f"block % {span}", "mine": f"shiftright(block, {low})"}
    s = state.select("*", *[F.expr(e).alias(n) for n, e in names.items()])
    size = lambda subtree: f"least({span}, blocks - {subtree} * {span})"
    last = F.least(F.col("lo") + ((1 << fan_bits) - 1), F.shiftright(F.col("blocks") - 1, low))
    s = s.withColumn("to", F.explode(F.sequence("lo", last)))
    places = F.expr(f"CASE WHEN place < {size('to')} THEN sequence(place, {size('to')} - 1, {size('mine')}) END")
    s = s.withColumn("target", F.explode(places))
    sent = s.select("tree", (F.col("to") * span + F.col("target")).alias("block"), "blocks", "leaves",
                    F.struct("mine", "root").alias("sent"), F.when(F.col("to") == F.col("mine"), F.col("upper")).alias("upper"))
    got = sent.groupBy("tree", "block", "blocks", "leaves").agg(
        F.array_sort(F.collect_list("sent")).alias("sent"), F.first("upper", ignorenulls=True).alias("upper"))
    got = got.select("tree", "block", "blocks", "leaves", F.transform("sent", lambda x: x["root"]).alias("nodes"), "upper")

    def run(batches):
        for b in batches:
            roots, upper = [], []
            for block, blocks, nodes, known in zip(*(b.column(n).to_pylist() for n in ("block", "blocks", "nodes", "upper")), strict=True):
                left = levels_of(-(-blocks // span))  # levels above the subtrees of this round
                root, more = climb(nodes, (block >> low) & ((1 << fan_bits) - 1), min(fan_bits, left))
                roots.append(root)
                upper.append(known + more)
            yield pa.RecordBatch.from_arrays(
                [b.column("tree"), b.column("block"), b.column("blocks"), b.column("leaves"), pa.array(roots, pa.string()),
                 pa.array(upper, pa.list_(pa.string()))], ["tree", "block", "blocks", "leaves", "root", "upper"])
    return got.mapInArrow(run, "tree string, block bigint, blocks bigint, leaves bigint, root string, upper array<string>")


def butterfly(placed: DataFrame, bits: int = BLOCK_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """Per block its tree's ``root`` and its ``upper`` siblings, after all rounds."""
    state = saved(subtrees(placed, bits), "merkle-subtrees")
    most = state.agg(F.max("blocks")).first()[0] or 1
    for turn in range(-(-levels_of(most) // fan_bits)):
        state = exchange(state, turn, fan_bits)
    return saved(state, "merkle-roots")


def per_leaf(placed: DataFrame, trees: DataFrame, keep: list[str], make: Callable, ddl: str) -> DataFrame:
    """``make(leaf, block, proof)`` for every leaf (with ``at``, ``digest`` and
    ``keep``): the siblings inside its block, then the block's upper ones."""
    names = [f.split()[0] for f in ddl.split(", ")]

    def run(g: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        g, b = g.sort_values("at"), next(block.itertuples(index=False))
        upper = list(b.upper)
        own = all_siblings(g["digest"].tolist(), levels_of(int(b.leaves)) - len(upper))
        return pd.DataFrame([make(x, b, mine + upper) for x, mine in zip(g.itertuples(index=False), own, strict=True)], columns=names)
    narrow = placed.select("tree", "block", "at", "digest", *keep)
    return narrow.groupBy("tree", "block").cogroup(trees.groupBy("tree", "block")).applyInPandas(run, ddl)


def manifest(rows: DataFrame, key: str = "lang", bits: int = BLOCK_BITS, fan_bits: int = FAN_BITS,
             keep_proofs: bool = False) -> DataFrame:
    """Leaves, roots and proofs of ``rows``.

    ``rows`` has ``doc_id``, ``leaf``, ``key`` and ``claimed``, the leaf to be
    verified against the manifest. Returns ``doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified`` per row, and with ``keep_proofs``
    ``at`` (place in the tree) and ``proof`` (a sibling or null per level, up
    to the tree's root, then up to the root).
    """
    leaves = rows.select("doc_id", "claimed", F.col("leaf").alias("digest"),
                         F.coalesce(F.concat(F.lit("="), F.col(key)), F.lit("-")).alias("tree"))
    placed = place(leaves, ["doc_id", "digest", "claimed"], bits)
    trees = butterfly(placed, bits, fan_bits)
    # the trees' roots are the leaves of the last tree
    roots = place(trees.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")),
                  ["name"], bits)
    top = per_leaf(roots, butterfly(roots, bits, fan_bits), ["name"], lambda x, b, proof: (x.name, x.at, b.root, proof),
                   "tree string, top_at bigint, top_root string, top_proof array<string>")

    def verify(x, b, proof):
        over = list(b.top_proof)
        folded = fold(fold(x.claimed, x.at, proof), int(b.top_at), over)
        return (x.doc_id, x.digest, b.root, b.top_root, digest(*filter(None, proof + over)), folded, folded == b.top_root,
                *([x.at, proof + over] if keep_proofs else []))
    ddl = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    # ids travel as text, which pandas leaves alone beside nulls
    ids = placed.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = per_leaf(ids, trees.join(top, "tree"), ["doc_id", "claimed"], verify,
                   ddl + (", at bigint, proof array<string>" if keep_proofs else ""))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def with_leaves(docs: DataFrame, every: int = 7) -> DataFrame:
    """``doc_id, lang, leaf, claimed``: the claim of rows whose id's checksum
    ``every`` divides is that of ``n_chars`` plus one."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in FIELDS[1:]])
    changed = F.crc32(F.col("doc_id").cast("string")) % every == 0
    claim = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    own = leaf([F.col(c) for c in FIELDS])
    return d.select("doc_id", "lang", own.alias("leaf"), F.when(changed, leaf(claim)).otherwise(own).alias("claimed"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(saved(with_leaves(table(spark, sf_dir, "documents")), "merkle-rows"))


SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
d AS (
  SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') ||
      coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body,
    doc_id IS NOT NULL AND {crc32_sql('doc_id::VARCHAR')} % 7 = 0 AS changed
  FROM documents, crc_table),
l AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || body) AS leaf,
    CASE WHEN changed THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') || body) END AS claim
  FROM d),
p AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, leaf, coalesce(claim, leaf) AS claim,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY lang) AS leaves FROM l),
nodes AS (
  SELECT tree, 0 AS level, place, leaf AS h, leaves AS n FROM p
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2, n),
subroots AS MATERIALIZED (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place, subroot AS h, n FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2
  FROM tops WHERE n > 1 GROUP BY level, place // 2, n),
fold AS (
  SELECT tree, place AS leaf_place, place, 0 AS level, claim AS h, leaves AS n, '' AS siblings FROM p
  UNION ALL
  SELECT f.tree, leaf_place, f.place // 2, f.level + 1,
    CASE WHEN s.h IS NULL THEN sha256(f.h) WHEN f.place % 2 = 1 THEN sha256(s.h || f.h) ELSE sha256(f.h || s.h) END,
    (f.n + 1) // 2, siblings || coalesce(s.h, '')
  FROM fold f LEFT JOIN nodes s ON s.tree = f.tree AND s.level = f.level AND s.place = xor(f.place, 1) WHERE f.n > 1),
top_fold AS (
  SELECT f.tree, leaf_place, r.place, 0 AS level, f.h, r.n, siblings FROM fold f JOIN subroots r ON r.tree = f.tree WHERE f.n = 1
  UNION ALL
  SELECT f.tree, leaf_place, f.place // 2, f.level + 1,
    CASE WHEN s.h IS NULL THEN sha256(f.h) WHEN f.place % 2 = 1 THEN sha256(s.h || f.h) ELSE sha256(f.h || s.h) END,
    (f.n + 1) // 2, siblings || coalesce(s.h, '')
  FROM top_fold f LEFT JOIN tops s ON s.level = f.level AND s.place = xor(f.place, 1) WHERE f.n > 1)
SELECT p.doc_id, p.leaf, r.subroot, t.h AS root, sha256(f.siblings) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM p JOIN subroots r ON r.tree = p.tree JOIN top_fold f ON f.tree = p.tree AND f.leaf_place = p.place AND f.n = 1
JOIN tops t ON t.n = 1
"""
