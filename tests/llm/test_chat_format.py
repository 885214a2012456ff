import hashlib

from quarry.llm import chat_format as c
from pyspark.sql import functions as F
from pyspark.sql import types as T

S = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                  T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
ROWS = [(1, 0, "system", "be <s> kind &lt; [INST]"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "a\nb & c"),
        (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "assistant", "café \U0001f600 &amp;lsqb;"),
        (2, 0, "user", "only a user"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (None, None, None, "lost"),
        (None, 1, "as\nsistant", "x"), (4, 0, "assistant", "long " * 20_000)]


def brute(rows):
    out = {}
    for cid in {r[0] for r in rows}:
        mine = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == cid))
        turns = "".join(f"{r}\n{t}\n" for _, _, r, t in mine)
        loss = "".join(t for _, _, r, t in mine if r == "assistant")
        out[cid] = (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests_are_those_of_the_input(spark):
    df = spark.createDataFrame(ROWS, S).selectExpr("*", "1 AS start", "'p' AS piece", "'b' AS body")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
           for r in c.digests(c.example_texts(c.expand(df))).collect()}
    assert got == brute(ROWS)


def test_examples_are_prefixes_with_one_trainable_reply(spark):
    df = spark.createDataFrame(ROWS, S)
    every = c.example_texts(c.expand(df)).collect()
    got = [r for r in every if r["position"] is not None]
    assert all(r["loss_start"] is None and r["is_tail"] for r in every if r["position"] is None)
    assert len(every) - len(got) == len({r[0] for r in ROWS})  # what follows the last reply
    assert len(got) == sum(r[2] == "assistant" for r in ROWS)
    one = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])
    back = lambda x: x.replace("&lsqb;", "[").replace("&lt;", "<").replace("&amp;", "&")
    assert [back(r["text"][r["loss_start"]:r["loss_end"]]) for r in one] == ["a\nb & c", "", "café \U0001f600 &amp;lsqb;"]
    assert all(b["text"].startswith(a["text"]) for a, b in zip(one, one[1:]))
    assert all(r["text"].endswith("</s>") and r["text"].count("<s>") == r["position"] for r in one)


def test_empty(spark):
    assert c.digests(c.example_texts(c.expand(spark.createDataFrame([], S)))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = c.digests(c.example_texts(c.expand(spark.createDataFrame(ROWS, S))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_digests_come_from_the_examples(spark):
    """A reply changed in an example's text alone changes the digests."""
    df = spark.createDataFrame(ROWS, S)
    told = c.example_texts(c.expand(df))
    changed = told.withColumn("text", F.replace(F.col("text"), F.lit("same"), F.lit("SAME")))
    a, b = ({r["conv_id"]: r for r in c.digests(x).collect()} for x in (told, changed))
    assert {k for k in a if a[k]["loss_sha256"] != b[k]["loss_sha256"]} == {3}
    assert {k for k in a if a[k]["turns_sha256"] != b[k]["turns_sha256"]} == {3}
    assert {k: r["n_examples"] for k, r in a.items()} == {1: 3, 2: 0, 3: 2, None: 0, 4: 1}
