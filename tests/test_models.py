import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lurescope.operators import models as M


def test_best_round():
    assert M.best_round([3, 2, 1, 1, 2, 0.5], 10) == 6
    assert M.best_round([3, 2, 1, 1, 2, 0.5], 2) == 3       # ended before the better one
    assert M.best_round([1.0], 5) == 1 and M.best_round([1, 1, 1], 50) == 1
    assert M.best_round([5, 4, 3, 2], 1) == 4


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 3))
    y = (x[:, 0] + 1.5 * rng.standard_normal(1500) > 0).astype(float)
    df = spark.createDataFrame([(int(i), *map(float, r), float(t), bool(i % 4 == 0)) for i, (r, t) in enumerate(zip(x, y))],
                               "k int, a double, b double, c double, label double, is_val boolean")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="v").transform(df).withColumn("w", F.lit(1.0)).cache()


def scores(model, df):
    return {r["k"]: tuple(r["_prob"]) for r in model.transform(df).select("k", "_prob").collect()}


def test_stopped_model_scores_like_its_prefix_of_trees(spark, frame, tmpdir_path):
    rounds, patience = 25, 4
    whole = M._gbt("v", rounds, 4, 7).fit(frame.filter("not is_val"))
    losses = whole.evaluateEachIteration(frame.filter("is_val"))
    n = M.best_round(losses, patience)
    stopped = M.train_with_patience(frame, "v", rounds, patience, 4, 7)
    assert stopped.getNumTrees == n and stopped.treeWeights == whole.treeWeights[:n]
    got = scores(stopped, frame)
    raw = {r["k"]: 0.0 for r in frame.select("k").collect()}
    for tree, weight in zip(whole.trees[:n], whole.treeWeights):
        for r in tree.setFeaturesCol("v").setPredictionCol("one").transform(frame).select("k", "one").collect():
            raw[r["k"]] += weight * r["one"]
    assert all(got[k][1] == pytest.approx(1 / (1 + np.exp(-2 * raw[k])), abs=1e-12) for k in raw)
    stopped.write().overwrite().save(tmpdir_path + "/m")
    again = M.GBTClassificationModel.load(tmpdir_path + "/m")
    assert scores(again, frame) == got and again.getNumTrees == n


def test_prefix_of_every_length(frame):
    whole = M._gbt("v", 4, 3, 1).fit(frame.filter("not is_val"))
    assert [M.first_trees(whole, n).getNumTrees for n in (1, 2, 3, 4, 9)] == [1, 2, 3, 4, 4]
    assert M.first_trees(whole, 2).getFeaturesCol() == "v"


def test_no_validation_rows(frame):
    assert M.train_with_patience(frame.withColumn("is_val", F.lit(False)), "v", 3, 1, 3, 1).getNumTrees == 3
