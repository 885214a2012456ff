"""Quality classifier with hierarchical empirical Bayes.

Three layers of evidence are combined per document:

1. A document classifier. From labelled rows it takes (a) words and word
   prefixes that occur almost only in toxic documents, by grouped counts, and
   (b) a logistic regression on whether such words occur and on a few figures
   of the text's form (repetition, capitals, symbols at word ends, length).
   It is fitted on at most ``max_labelled`` labelled rows, chosen by hash.
2. Host posteriors: the mean badness of a host's documents (``source``),
   shrunk towards the corpus mean.
3. Path posteriors: the same for (host, path), here ``lang``, shrunk towards
   the host's posterior.

The shrinkage strengths are estimated from the spread of the site means
(method of moments), so sparse sites stay near the prior of the level above.
A document's log odds are the classifier's, plus the path posterior's log odds
against the corpus mean, held within ``site_most``: a site tips documents that
are in doubt, it cannot overrule clear ones.

Scale: the words of a text are counted where it is read; site figures are
sums with map-side combine, so a host with a third of all rows costs one row
per task; site tables are joined to narrow scores, without texts.

Defined cases: a null or empty text is a bad document (it holds nothing);
null hosts and paths are sites of their own; null ids are kept, and no label
belongs to them; repeated rows give repeated results; repeated labels count
once, as bad if any says so; labels without both columns null count for the
one that is given; without any label nothing but empty texts is rejected;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

MAX_LABELLED, MIN_DOCS, MIN_SHARE, SITE_MOST = 40_000, 8, 0.8, 1.0
PREFIXES, STRETCH, MIN_CONTEXTS = (4, 5, 6, 7), 200, 5
_WORD = re.compile(r"\w+")


def terms(text: str) -> dict[str, int]:
    """Distinct lower-cased words and, as ``abcd*``, their prefixes, each with
    a bitmap of the words that precede it (by hash)."""
    found: dict[str, int] = {}
    before = ""
    for w in _WORD.findall(text.lower()):
        bit = 1 << zlib.crc32(before.encode()) % 63
        for t in (w, *(f"{w[:n]}*" for n in PREFIXES if len(w) > n)):
            found[t] = found.get(t, 0) | bit
        before = w
    return found


def form(text: str) -> list[float]:
    """Figures of a text's form, each about 0 to 1. Repetition is taken within
    stretches of ``STRETCH`` words, as long texts repeat their words anyway."""
    words = text.split()
    n = len(words)
    if not n:
        return [1.0] * 6
    distinct = sum(len(set(words[i:i + STRETCH])) for i in range(0, n, STRETCH))
    letters = sum(map(len, words))
    symbols = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:?)\"'")
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    follow = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)
    return [1 - distinct / n, symbols / n, upper / n, follow / n, min(1.0, 10 / n), min(1.0, letters / n / 40)]


class Lexicon:
    """Terms with their weights; ``hits`` looks only at words whose first
    letters some term has."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.heads = {t.rstrip("*")[:PREFIXES[0]] for t in weights}

    def hits(self, text: str) -> float:
        """Sum of the best weight of every distinct word that has one."""
        total, get = 0.0, self.weights.get
        if not self.weights:
            return total
        for w in set(_WORD.findall(text.lower())):
            if w[:PREFIXES[0]] in self.heads:
                total += max(get(w, 0.0), *(get(f"{w[:n]}*", 0.0) for n in PREFIXES if len(w) > n), 0.0)
        return total


def features(text: str, lexicon: Lexicon) -> list[float]:
    f, hits = form(text), lexicon.hits(text)
    # squares let the regression put a bound on either side of a figure
    return [float(hits > 0), min(hits, 4.0), *f, *(x * x for x in f)]


class Classifier:
    def __init__(self, lexicon: Lexicon, weights: list[float], base: float):
        self.lexicon, self.weights, self.base = lexicon, weights, base

    def log_odds(self, text: str | None) -> float:
        """Natural log of the odds that the text is bad."""
        if not text or text.isspace():
            return 20.0
        if not self.weights:
            return self.base
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features(text, self.lexicon), strict=True))
        return max(-20.0, min(20.0, z))


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights (first: constant) by Newton's method with a small ridge."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``text, bad, toxic`` of at most ``most`` labelled documents, chosen by
    a hash of their id. An id counts once: of several texts that with the
    least hash, so copies of a labelled row weigh nothing."""
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 0).cast("int"), F.lit(0))).alias("low"),
        F.max(F.coalesce(F.col("toxic").cast("int"), F.lit(0))).alias("toxic"))
    total = one.count()
    if total > most:  # ids, not texts, are chosen: a bounded set of long numbers
        one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most ``most`` rows of three numbers: small enough to send to every task
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(one), "doc_id")
    rows = rows.groupBy("doc_id", "low", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "doc_id").select("text", "toxic", F.greatest("low", "toxic").alias("bad"))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Classifier:
    """A classifier of at most ``most`` labelled rows; what reaches the driver
    is the lexicon and one row of figures per labelled row."""
    rows = saved(labelled(docs, labels, most), "labelled")

    def count(it):
        n: Counter = Counter()
        bad: Counter = Counter()
        bits: dict[str, int] = {}

        def flush():
            out = pa.RecordBatch.from_pydict({
                "term": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64()),
                "bad": pa.array([bad[k] for k in n], pa.int64()), "contexts": pa.array([bits[k] for k in n], pa.int64())})
            n.clear(), bad.clear(), bits.clear()
            return out

        for b in it:
            for t, y in zip(b.column(0), b.column(1), strict=True):
                found = terms(t.as_py() or "")
                n.update(found.keys())
                for term, seen in found.items():
                    bits[term] = bits.get(term, 0) | seen
                if y.as_py():
                    bad.update(found.keys())
                if len(n) > 120_000:  # partial sums; what a task holds stays bounded
                    yield flush()
        if n:
            yield flush()
    per_term = (rows.select("text", "toxic").mapInArrow(count, "term string, n bigint, bad bigint, contexts bigint")
                .groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"),
                                     F.bit_count(F.bit_or("contexts")).alias("contexts")))
    # a term counts if its share in bad documents is high for sure (a lower bound of the share), and if it
    # follows various words: one that is only there in copies of one text does not
    z = 2.6
    p, n = F.col("bad") / F.col("n"), F.col("n")
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    strong = per_term.where((n >= MIN_DOCS) & (p >= MIN_SHARE) & (low >= 0.5)
                            & (F.col("contexts") >= MIN_CONTEXTS)).select("term", low.alias("w"))
    lexicon = Lexicon({r["term"]: float(r["w"]) for r in strong.collect()})

    def figures(it):
        for b in it:
            texts = [t.as_py() or "" for t in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([features(t, lexicon) for t in texts], pa.list_(pa.float64())), b.column(1)], ["x", "bad"])
    got = rows.select("text", "bad").mapInArrow(figures, "x array<double>, bad int").orderBy("x", "bad").collect()
    y = np.array([r["bad"] for r in got], "f8")
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.1
        return Classifier(lexicon, [], math.log(share / (1 - share)) if len(y) else -2.0)
    return Classifier(lexicon, regression(np.array([r["x"] for r in got]), y).tolist(), 0.0)


def evidence(docs: DataFrame, model: Classifier) -> DataFrame:
    """``doc_id, text_hash, host, path, evidence`` (log odds of being bad)."""
    def run(it):
        for b in it:
            z = pa.array([model.log_odds(t.as_py()) for t in b.column(0)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], z], [*b.schema.names[1:], "evidence"])
    d = docs.select("text", F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"),
                    F.col("source").cast("string").alias("host"), F.col("lang").cast("string").alias("path"))
    return d.mapInArrow(run, "doc_id bigint, text_hash bigint, host string, path string, evidence double")


def strength_of(sites: DataFrame, mean: str) -> float:
    """How many rows the level above is worth, by the method of moments: the
    spread of site means (``s / n``) about ``mean`` beyond what the sites'
    sizes explain is the true spread. One row of sums reaches the driver."""
    dev = F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col(mean)) ** 2)
    r = sites.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sites"), dev.alias("dev"),
                  F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("v"),
                  F.sum(F.col("n").cast("double") ** 2).alias("sq")).first()
    if not r["n"]:
        return 1000.0
    within = r["v"] / r["n"]
    spread = (r["dev"] - (r["sites"] - 1) * within) / max(1.0, r["n"] - r["sq"] / r["n"])
    return max(2.0, min(1000.0, within / max(spread, 1e-9) - 1))


def shrunk(parent: str, strength: float) -> Column:
    """Posterior mean of a site: its own sum and ``strength`` rows of its parent's mean."""
    return (F.col("s") + strength * F.col(parent)) / (F.col("n") + strength)


def site_posteriors(scores: DataFrame) -> DataFrame:
    """``host, path, site_mean, host_mean, corpus_mean`` of every site, by
    grouped sums only."""
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = saved(scores.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s")), "sites")
    corpus = paths.agg((F.sum("s") + 0.5) / (F.sum("n") + 1)).first()[0]
    hosts = (paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
             .withColumn("corpus_mean", F.lit(corpus).cast("double")))
    hosts = hosts.select(F.col("host").alias("h"), "corpus_mean",
                         shrunk("corpus_mean", strength_of(hosts, "corpus_mean")).alias("host_mean"))
    both = paths.join(hosts, paths["host"].eqNullSafe(hosts["h"])).drop("h")
    site = shrunk("host_mean", strength_of(both, "host_mean"))
    return both.select("host", "path", "corpus_mean", "host_mean", site.alias("site_mean"))


def posterior(scores: DataFrame, site_most: float = SITE_MOST) -> DataFrame:
    """``scores`` with ``p_bad`` and ``keep``. ``scores`` should be stored: it
    is read for the site sums and again for the result."""
    sites = site_posteriors(scores)
    sites = sites.withColumnsRenamed({"host": "h", "path": "q"})
    both = scores.join(sites, scores["host"].eqNullSafe(sites["h"]) & scores["path"].eqNullSafe(sites["q"])).drop("h", "q")
    odds = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    site = F.greatest(F.lit(-site_most), F.least(F.lit(site_most), odds("site_mean") - odds("corpus_mean")))
    p = 1 / (1 + F.exp(-(F.col("evidence") + site)))
    return both.withColumn("p_bad", p).withColumn("keep", F.col("p_bad") < 0.5)


def classify(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    return posterior(saved(evidence(docs, train(docs, labels, most)), "evidence"))


def kept(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    bad = classify(docs, labels, most).where("NOT keep").select(
        F.col("doc_id").alias("k1"), F.col("text_hash").alias("k2"), F.col("host").alias("k3"),
        F.col("path").alias("k4")).distinct()
    same = (docs["doc_id"].eqNullSafe(bad["k1"]) & (F.xxhash64(docs["text"]) == bad["k2"])
            & docs["source"].eqNullSafe(bad["k3"]) & docs["lang"].eqNullSafe(bad["k4"]))
    return docs.join(bad, same, "left_anti")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "host", "path", F.round("evidence", 6).alias("evidence"),
                        F.round("site_mean", 6).alias("site_mean"), F.round("p_bad", 6).alias("p_bad"), "keep")


#: A fitted classifier cannot be told in SQL; the query is tested by its
#: accuracy on held-out labels and against a brute-force empirical Bayes.
SQL = None
