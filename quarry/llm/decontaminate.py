"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a fixed mask over consecutive words: it hashes the words at its
``1`` places and ignores those at its ``0`` places, so it still hits where
ignored words were substituted. All seeds of benchmark items are joined with
all seeds of all documents; every hit names a diagonal (place in the document
minus place in the item). Around the hits the words are compared along that
diagonal: an overlap holds if some window of ``window`` words of the item (the
whole item, if it is shorter) agrees with the document in at least
``min_share`` of its words, whichever words were substituted.

Both masks miss no overlap of items of 12 words and more. Shorter items get
masks of their own (``short_masks``): their words are dealt into groups, and
each mask ignores as many groups as substitutions are allowed, so whichever
words those are, some mask ignores them all. Words are
runs of anything but six ASCII white-space characters, with A-Z lower-cased.

Scale: document seeds stream through the join and are never shuffled while
the benchmark's seeds are below ``broadcast_seeds`` (counted first; 8 bytes of
hash and two numbers each); above it they are joined by shuffle, which splits
hot seeds. Hits are reduced to distinct diagonals in the map tasks; only
documents with hits are read again for the comparison.

Defined cases: null and empty texts contaminate nothing and are clean; rows
with the same doc_id and text are one document, rows with the same doc_id and
other text are told apart; null ids are kept; other columns are ignored;
empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, ascii_lower, saved, table

MASKS = ("11010011", "11100101")
WINDOW, MIN_SHARE, BROADCAST_SEEDS = 13, 0.8, 500_000
#: Items below this many words have masks of their own.
SHORT = 12


def short_masks(n: int, min_share: float = MIN_SHARE) -> list[str]:
    """Masks that together hit an item of ``n`` words wherever the words that
    may differ are: place i is in group i mod (allowed + 2)."""
    allowed = max(k for k in range(n) if n - k >= n * min_share or k == 0)
    groups = min(n, allowed + 2) if allowed else 1
    out = ["".join("0" if i % groups in ignored else "1" for i in range(n)).strip("0")
           for ignored in combinations(range(groups), allowed)]
    return sorted(set(out))


def word_list(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"[{SPACE_CLASS}]+"), lambda w: w != "")


def places(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def mask_seeds(hashes: Column, mask: str) -> Column:
    """Seed of every place of ``hashes`` (one 64-bit hash per word)."""
    n = F.size(hashes) - len(mask)
    # the seed's first item tells the masks apart
    seed = lambda i: F.xxhash64(F.lit(int(mask, 2)), *[hashes[i + p] for p in places(mask)])
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), seed))


def exploded(rows: DataFrame, keys: list[str], masks: dict[str, list[int] | None], at: str) -> DataFrame:
    """``keys``, ``at`` (place), ``seed`` of all masks, one pass over the rows.
    A mask with a list of lengths is for rows of so many words alone."""
    def seeds(mask, lengths):
        all_ = mask_seeds(F.col("hashes"), mask)
        return F.coalesce(all_ if lengths is None else F.when(F.size("hashes").isin(lengths), all_), F.array().cast("array<bigint>"))
    per_mask = F.array(*[seeds(m, n) for m, n in masks.items()])
    e = rows.select(*keys, F.explode(per_mask).alias("seeds"))
    return e.select(*keys, F.posexplode("seeds").alias(at, "seed"))


def hashed(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    w = rows.select(*keys, word_list(F.col(text)).alias("words"))
    return w.select(*keys, F.transform("words", lambda x: F.xxhash64(x)).alias("hashes"))


def overlaps(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW,
             min_share: float = MIN_SHARE, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """``doc_id, text_hash, item_id, doc_start, matches, window_matches,
    window_words, item_words`` of every verified diagonal. ``doc_start`` is
    the word of the document that meets the item's first (it may be negative);
    ``docs`` has doc_id and text, ``items`` item_id and text."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("item_text")).distinct()
    item_words = items.select("item_id", "item_text", word_list(F.col("item_text")).alias("item"))
    short = [r[0] for r in item_words.select(F.size("item").alias("n")).where(f"n between 1 and {SHORT - 1}")
             .distinct().orderBy("n").collect()]  # at most SHORT - 1 numbers
    of_items = {m: None for m in masks}
    for n in short:
        for m in short_masks(n, min_share):
            if of_items.setdefault(m, []) is not None:
                of_items[m].append(n)
    item_seeds = saved(exploded(hashed(items, ["item_id", "item_text"], "item_text"), ["item_id", "item_text"], of_items,
                                "item_at").select(F.xxhash64("item_text").alias("item_hash"), "item_id", "item_at",
                                                  "seed").distinct(), "item-seeds")
    small = item_seeds.count() <= broadcast_seeds
    seeds = exploded(hashed(docs, ["doc_id", "text_hash"], "text"), ["doc_id", "text_hash"], dict.fromkeys(of_items), "doc_at")
    hits = seeds.join(F.broadcast(item_seeds) if small else item_seeds, "seed")
    diagonals = (hits.select("doc_id", "text_hash", "item_id", "item_hash",
                             (F.col("doc_at") - F.col("item_at")).alias("doc_start")).distinct())
    d, i = saved(diagonals, "diagonals"), item_words.withColumn("item_hash", F.xxhash64("item_text"))
    hit_docs = d.select("doc_id", "text_hash").distinct()
    same = lambda a, b: [a["doc_id"].eqNullSafe(b["doc_id"]), a["text_hash"] == b["text_hash"]]
    again = docs.join(hit_docs, same(docs, hit_docs), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    # words are made before the join, once per document and not once per use below
    again = again.select(F.col("doc_id").alias("k1"), F.col("text_hash").alias("k2"), word_list(F.col("text")).alias("words"))
    both = (d.join(again,
                   d["doc_id"].eqNullSafe(F.col("k1")) & (d["text_hash"] == F.col("k2"))).drop("k1", "k2"))
    i = i.select(F.col("item_id").alias("k3"), F.col("item_hash").alias("k4"), "item")
    both = both.join(i, both["item_id"].eqNullSafe(F.col("k3")) & (both["item_hash"] == F.col("k4"))).drop("k3", "k4")
    start = F.col("doc_start").cast("int")
    before = F.greatest(-start, F.lit(0))  # words of the item that lie before the document
    region = F.concat(F.array_repeat(F.lit(None).cast("string"), before),
                      F.slice("words", F.greatest(start, F.lit(0)) + 1, F.greatest(F.size("item") - before, F.lit(0))))
    agree = F.zip_with("item", region, lambda w, x: F.coalesce((w == x).cast("int"), F.lit(0)))
    checked = saved(both.withColumn("agree", agree).drop("words", "item"), "agreement")
    n = F.size("agree")
    size = F.least(n, F.lit(window))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    best = F.array_max(F.transform(F.sequence(F.lit(1), n - size + 1),
                                   lambda s: total(F.slice(F.col("agree"), s, size))))
    out = checked.select("doc_id", "text_hash", "item_id", F.col("doc_start").cast("long").alias("doc_start"),
                         total(F.col("agree")).cast("long").alias("matches"),
                         best.cast("long").alias("window_matches"), size.cast("long").alias("window_words"),
                         n.cast("long").alias("item_words"))
    return out.where(F.col("window_matches") >= F.col("window_words") * F.lit(min_share))


def best_overlap(found: DataFrame) -> DataFrame:
    """The diagonal with the most matches (the first of equals) of every
    document and item."""
    pick = F.max_by(F.struct("doc_start", "matches", "window_matches", "window_words", "item_words"),
                    F.struct("matches", "window_matches", -F.col("doc_start")))
    g = found.groupBy("doc_id", "item_id").agg(pick.alias("r"))
    return g.select("doc_id", "item_id", "r.*")


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated documents."""
    bad = overlaps(docs, items, **options).select(F.col("doc_id").alias("k1"), F.col("text_hash").alias("k2")).distinct()
    mine = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["k1"]) & (mine == bad["k2"]), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_overlap(overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def _sql(masks=MASKS, window=WINDOW) -> str:
    split = ("list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             "'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')")
    every = [(m, None) for m in masks] + [(m, n) for n in range(1, SHORT) for m in short_masks(n)]
    seeds = lambda t, key, own="": " UNION ALL ".join(
        f"SELECT {key}, {k} AS mask, i, [{', '.join(f'w[i + {p + 1}]' for p in places(m))}] AS seed FROM {t}, "
        f"unnest(generate_series(0, len(w) - {len(m)})) AS u(i) WHERE len(w) >= {len(m)}"
        + ("" if n is None else f" AND len(w) = {n}" if own else f" AND EXISTS (SELECT 1 FROM bw WHERE len(bw.w) = {n})")
        for k, (m, n) in enumerate(every))
    return f"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
dw AS (SELECT doc_id, text, {split} AS w FROM d),
b AS (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark),
bw AS (SELECT item_id, text AS item_text, {split} AS w FROM b),
ds AS ({seeds('dw', 'doc_id, text')}),
bs AS ({seeds('bw', 'item_id, item_text', 'own')}),
h AS (SELECT DISTINCT doc_id, text, item_id, item_text, ds.i - bs.i AS doc_start
      FROM ds JOIN bs ON ds.mask = bs.mask AND ds.seed = bs.seed),
a AS (SELECT h.doc_id, h.item_id, h.doc_start, bw.w AS item,
        list_transform(generate_series(1, len(bw.w)), lambda k: CASE WHEN k + doc_start BETWEEN 1 AND len(dw.w)
          AND dw.w[k + doc_start] = bw.w[k] THEN 1 ELSE 0 END) AS agree
      FROM h JOIN dw ON h.doc_id IS NOT DISTINCT FROM dw.doc_id AND h.text = dw.text
             JOIN bw ON h.item_id IS NOT DISTINCT FROM bw.item_id AND h.item_text = bw.item_text),
v AS (SELECT doc_id, item_id, doc_start, list_sum(agree)::BIGINT AS matches,
        least(len(agree), {window})::BIGINT AS window_words, len(agree)::BIGINT AS item_words,
        list_max(list_transform(generate_series(1, len(agree) - least(len(agree), {window}) + 1),
          lambda s: list_sum(list_slice(agree, s, s + least(len(agree), {window}) - 1))))::BIGINT AS window_matches
      FROM a WHERE len(agree) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matches DESC, window_matches DESC, doc_start) AS k
      FROM v WHERE window_matches >= window_words * {MIN_SHARE})
SELECT doc_id, item_id, doc_start, matches, window_matches, window_words, item_words FROM r WHERE k = 1
"""


SQL = _sql()
