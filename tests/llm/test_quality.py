import math

import pytest
from pyspark.sql import functions as F

from quarry.llm import quality as q
from quarry.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    r = q.classify(docs, labels.where("doc_id % 3 != 0"))
    bad = (F.col("quality") == 0).cast("int")
    got = r.join(labels.where("doc_id % 3 = 0 AND toxic = 0"), "doc_id").select("keep", bad.alias("bad")).collect()
    assert sum(x["keep"] != bool(x["bad"]) for x in got) >= 0.95 * len(got)


def test_posteriors_equal_a_plain_computation(spark):
    rows = [(k, k, f"h{k % 4}" if k % 9 else None, "a" if k % 5 else None, ((k * 37) % 100) / 25 - 2.0) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text_hash long, host string, path string, evidence double")
    got = {r["doc_id"]: (r["site_mean"], r["p_bad"]) for r in q.posterior(df).collect()}
    p = lambda z: 1 / (1 + math.exp(-z))
    corpus = (sum(p(r[4]) for r in rows) + 0.5) / (len(rows) + 1)

    def strength(groups):
        n = sum(c for c, _, _ in groups)
        dev = sum(c * (s / c - m) ** 2 for c, s, m in groups)
        v = sum(c * m * (1 - m) for c, _, m in groups) / n
        spread = (dev - (len(groups) - 1) * v) / max(1.0, n - sum(c * c for c, _, _ in groups) / n)
        return max(2.0, min(1000.0, v / max(spread, 1e-9) - 1))

    def sums(key):
        out = {}
        for r in rows:
            c, s = out.get(key(r), (0, 0.0))
            out[key(r)] = (c + 1, s + p(r[4]))
        return out
    hosts, paths = sums(lambda r: r[2]), sums(lambda r: (r[2], r[3]))
    k = strength([(c, s, corpus) for c, s in hosts.values()])
    host = {h: (s + k * corpus) / (c + k) for h, (c, s) in hosts.items()}
    k = strength([(c, s, host[h]) for (h, _), (c, s) in paths.items()])
    for r in rows:
        c, s = paths[r[2], r[3]]
        mean = (s + k * host[r[2]]) / (c + k)
        odds = lambda x: math.log(x / (1 - x))
        z = r[4] + max(-q.SITE_MOST, min(q.SITE_MOST, odds(mean) - odds(corpus)))
        assert got[r[0]] == pytest.approx((mean, p(z)))


def test_edges(spark, make_docs, edge_rows, labels_of):
    docs = make_docs([*edge_rows, *[(100 + i, "good words in a row here " + str(i)) for i in range(30)]], extra=True)
    labels = labels_of([(100, 1, 0), (101, 1, 0), (102, 1, 1), (9, 0, 0), (9, 1, 0), (9, 0, 0), (None, 0, 1), (103, None, 0), (777, 0, 0)])
    kept = q.kept(docs, labels)
    assert kept.columns == docs.columns
    empties = [t for _, t in edge_rows if not t or not t.strip()]
    got = [r["text"] for r in kept.collect()]
    assert not set(got) & set(empties) and len(got) <= docs.count() - len(empties)
    assert q.classify(docs, labels).count() == docs.count()


def test_without_labels_or_documents(spark, make_docs, labels_of, edge_rows):
    none = labels_of([])
    assert q.classify(make_docs([]), none).count() == 0
    kept = q.kept(make_docs(edge_rows), none).collect()
    assert len(kept) == sum(bool(t and t.strip()) for _, t in edge_rows)
    assert q.classify(make_docs([]), labels_of([(1, 0, 0)])).count() == 0


def test_bounded_sample(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    a = sorted(r["text"] for r in q.labelled(docs, labels, 50).collect())
    assert len(a) == 50 and a == sorted(r["text"] for r in q.labelled(docs, labels, 50).collect())


def test_repetition_does_not_grow_with_length():
    text = " ".join(f"w{(i * i) % 1009}" for i in range(500))
    assert abs(q.form(text)[0] - q.form(" ".join([text] * 30))[0]) < 0.05


def test_repeated_labelled_rows_count_once(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i % 3} of {i % 6}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3)] * 4, "doc_id long, quality int, toxic int")
    got = q.labelled(docs, labels, 2)
    assert got.count() == 2 and q.labelled(docs, labels).count() == 3
    assert sorted(r["text"] for r in got.collect()) == sorted(r["text"] for r in q.labelled(docs.repartition(7), labels, 2).collect())
