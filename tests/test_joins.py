from pyspark.sql import functions as F

from lurescope.operators.joins import hot_keys, lookup_join, salted_join


def test_salted_join_equals_plain_join_with_hot_key(spark):
    # one key holds a third of the fact rows
    fact = spark.range(3000).select(F.col("id").alias("row"),
                                    F.when(F.col("id") % 3 == 0, F.lit("hot.example.com"))
                                    .otherwise(F.concat(F.lit("d"), (F.col("id") % 50).cast("string"))).alias("k"))
    dim = spark.createDataFrame([("hot.example.com", 1)] + [(f"d{i}", i) for i in range(0, 50, 2)], "k string, v int")
    a = salted_join(fact, dim, "k", ["row"], "left", buckets=8)
    b = fact.join(dim, "k", "left")
    assert sorted(map(tuple, a.select("row", "k", "v").collect())) == sorted(map(tuple, b.select("row", "k", "v").collect()))
    assert lookup_join(fact, dim, "k").count() == 3000
    assert [r.k for r in hot_keys(fact, "k", 0.1).collect()] == ["hot.example.com"]


def test_message_texts_move_through_few_joins(spark):
    """Hosts, times and labels are joined between narrow rows; the texts meet them, and the html, once."""
    from lurescope.sources.fixtures import Fixtures
    wide = []

    def walk(plan):
        names = [plan.output().apply(k).name() for k in range(plan.output().size())]
        if plan.nodeName() == "Join":
            wide.append(bool({"text", "b_html", "html_text", "html"} & set(names)) and names)
        for k in range(plan.children().size()):
            walk(plan.children().apply(k))
    walk(Fixtures(spark, "/root/testdata/sf0.001").messages._jdf.queryExecution().optimizedPlan())
    assert sum("text" in (n or ()) for n in wide) <= 2 and sum(bool(n) for n in wide) <= 3


def test_message_rows_with_repeated_keys(spark, tmp_path):
    """Documents that share an id, and an event that stands twice: every row meets every row."""
    from lurescope.sources.fixtures import Fixtures
    src, sf = "/root/testdata/sf0.001", str(tmp_path / "sf")
    for name in ("pages", "labels"):
        spark.read.parquet(f"{src}/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    for name, key in (("documents", "doc_id"), ("events", "event_id")):
        df = spark.read.parquet(f"{src}/{name}.parquet").filter(f"{key} < 4")
        df.unionByName(df.filter(f"{key} = 1")).write.parquet(f"{sf}/{name}.parquet")
    got = {r.msg_id: r["count"] for r in Fixtures(spark, sf).messages.groupBy("msg_id").count().collect()}
    assert got == {0: 1, 1: 4, 2: 1, 3: 1}


def test_html_is_not_broadcast(spark):
    from lurescope.sources.fixtures import Fixtures
    plan = Fixtures(spark, "/root/testdata/sf0.001").messages._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [b_pid" in plan
