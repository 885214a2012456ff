import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session", autouse=True)
def _workers(spark):
    entry._python_workers_see_package(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text) pairs, with null or given other columns."""
    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}",
                                     None if t is None else len(t)) for k, (i, t) in enumerate(rows)], DOC)
        if extra:  # names that operators use inside
            for c in ("id", "n", "cid", "comp", "piece", "score", "rank", "text_hash", "host", "path", "h", "k1",
                      "n_shingles", "component_id", "evidence", "keep"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df
    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and white-space texts, repeated rows, ties, a long text."""
    long = " ".join(f"w{i % 977}{'x' * (i % 7)}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (4, "one two"), (5, "one two"), (None, "null id text here ok yes"),
            (None, None), (6, long), (7, long + " tail"), (8, "a@b.co 10.0.0.1 +1 (555) 123-4567"), (9, "x" * 5000),
            (10, "éè \U0001d4b3 日本語 café\u0085b c")]
