from pyspark.sql import functions as F

from lurescope.llm.quality import classify, keep_documents

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    train, held = (labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == k) for k in (0, 1))
    got = classify(docs, train)
    assert got.count() == docs.count()
    n, right, kept_good, good = got.join(held, got["id"] == held["doc_id"]).agg(
        F.count(F.lit(1)), F.sum((F.col("keep") == (F.col("quality") == 1)).cast("int")),
        F.sum((F.col("keep") & (F.col("quality") == 1)).cast("int")),
        F.sum((F.col("quality") == 1).cast("int"))).first()
    assert right / n > 0.97 and kept_good / good > 0.98


def test_sparse_sites_shrink_to_their_parents(spark):
    docs = spark.createDataFrame(
        [(i, "plain words in a row here", "big", "en") for i in range(200)]
        + [(1000, "plain words in a row here", "tiny", "en")],
        "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(200)] + [(1000, 0)],
                                   "doc_id bigint, quality int")
    got = {r.host: r for r in classify(docs, labels).dropDuplicates(["host"]).collect()}
    assert abs(got["big"].p_path - 0.9) < 0.03
    assert 0.3 < got["tiny"].p_host < 0.9            # one bad label does not make it 0


def test_defined_results(spark):
    rows = [(None, "Some good words. In a row.", None, None, 1), (1, None, "a", "en", 2), (2, "", "a", "en", 3),
            (3, "WORD!! WORD!! WORD!!", "a", None, 4), (3, "Some words. Here.", "a", None, 4),
            (4, "x" * 200_000, "b", "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, rk int")
    labels = spark.createDataFrame([(3, None, 0), (None, 1, 0), (4, 1, 0), (4, 0, 1)],
                                   "doc_id bigint, quality int, toxic int")
    got = classify(docs, labels)
    assert got.count() == len(rows)
    assert {r.id for r in got.filter("not keep").collect()} >= {1, 2}
    kept = keep_documents(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id in (1, 2)").count() == 0
    assert classify(docs.limit(0), labels).count() == 0
    assert keep_documents(docs, labels.limit(0)).filter("doc_id = 3").count() == 2
