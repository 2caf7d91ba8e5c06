import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lurescope.operators import dedup as DD
from lurescope.operators.ranking import global_row_number


def test_global_row_number_equals_window(spark):
    random.seed(7)
    rows = [(i, random.randint(0, 2), random.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g int, v int")
    ours = global_row_number(df, [F.col("v").desc(), F.col("id")], ["g"], "rn")
    ref = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").desc(), "id")))
    j = ours.join(ref, ["id", "g", "v"])
    assert j.count() == 3000 and j.filter("rn != rn2").count() == 0


def test_dedup_first_keeps_positive_and_counts_copies(spark):
    rows = [(1, "same text", 0, "b"), (2, "same text", 1, "z"), (3, "other", 0, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int, source string")
    got = {r.doc_id: r.copies for r in DD.dedup_first(
        df, DD.content_key("text"), [1 - F.col("label"), F.col("source"), F.col("doc_id")],
        ["doc_id", "label"]).collect()}
    assert got == {2: 2, 3: 1}


def test_dedup_is_idempotent(spark):
    rows = [(i, f"t{i % 7}", i % 2, "s") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int, source string")
    order = [1 - F.col("label"), F.col("source"), F.col("doc_id")]
    once = DD.dedup_first(df, DD.content_key("text"), order, ["doc_id", "text", "label", "source"])
    twice = DD.dedup_first(once.drop("dedup_key", "copies"), DD.content_key("text"), order,
                           ["doc_id", "text", "label", "source"])
    assert sorted(r.doc_id for r in once.collect()) == sorted(r.doc_id for r in twice.collect())


def test_cap_per_class_balances(spark):
    rows = [(i, 1 if i < 10 else 0) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, label int").withColumn(
        "k", F.sha2(F.col("doc_id").cast("string"), 256))
    out = DD.cap_per_class(df, "label", [F.col("k"), F.col("doc_id")], 6)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {1: 6, 0: 6}


def test_split_keeps_class_shares(spark):
    df = spark.range(20000).withColumn("label", (F.col("id") % 5 == 0).cast("int"))
    s = df.withColumn("split", DD.split_column(F.col("id").cast("string")))
    shares = {(r.label, r.split): r["count"] for r in s.groupBy("label", "split").count().collect()}
    for lab in (0, 1):
        n = sum(v for (l_, _), v in shares.items() if l_ == lab)
        assert abs(shares[(lab, "test")] / n - 0.15) < 0.02


def test_rank_of_a_million_rows_loses_and_misplaces_none(spark):
    df = spark.range(0, 1_000_000, numPartitions=48).select(
        F.col("id"), (F.xxhash64("id") % 1000).alias("v"), F.concat(F.lit("payload-"), "id").alias("p"),
        (F.col("id") % 3).alias("g"))
    ours = global_row_number(df, [F.col("v"), F.col("id")], ["g"], "rn")
    ref = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    n, wrong = ours.join(ref.select("id", "rn2"), "id").agg(
        F.count(F.lit(1)), F.count_if(F.col("rn") != F.col("rn2"))).first()
    assert (n, wrong) == (1_000_000, 0)
