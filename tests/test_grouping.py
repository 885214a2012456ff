"""Two-level numbering: order, nulls, hot keys."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.grouping import number_within


def test_numbers_as_a_window_does(spark):
    df = spark.range(0, 5000, 1, 7).select(
        F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 3 == 0, "b").otherwise("hot").alias("k"),
        F.when(F.col("id") % 13 == 0, F.lit(None)).otherwise(F.xxhash64("id") % 97).alias("a"),
        F.concat(F.lit("t"), F.col("id") % 700).alias("b"), "id")
    w = Window.partitionBy("k").orderBy("a", "b", "id")
    want = df.withColumn("rn", F.row_number().over(w).cast("long"))
    got = number_within(df, ["k"], ["a", "b", "id"])
    assert got.columns == want.columns and got.schema["rn"].dataType == want.schema["rn"].dataType
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_hot_key_spreads_over_partitions(spark):
    df = spark.range(0, 20_000, 1, 8).select(F.lit("one").alias("k"), "id")
    places = []

    def store(d):
        places.extend(d.groupBy(F.shiftright("__at", 33)).count().collect())
        return d.persist()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it merges partitions as small as these
    try:
        got = number_within(df, ["k"], ["id"], store=store)
        assert got.count() == 20_000 and got.where("rn != id + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(places) > 4 and max(r["count"] for r in places) < 20_000 / 2


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, a long")
    assert number_within(df, ["k"], ["a"]).collect() == []
