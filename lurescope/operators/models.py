"""Scoring, training and model operators on MLlib.

Model parity with the original boosted trees is not a goal (leaf-wise
boosting, extra-trees and L1/L2 terms have no MLlib twin); the structure is
kept: a text score, a "full" model over 37 features + the squished text
score, a "structural" model over the 37 features alone, and the blend.
Everything is distributed MLlib; the only Python slot is an optional
Arrow-batched ``pandas_udf`` for a user's own text model.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurescope import dictionaries as D
from lurescope.operators.scoring import blend, squish

STRUCT_FEATURES = list(D.FEATURE_NAMES)
FULL_FEATURES = STRUCT_FEATURES + [D.TEXT_FEATURE]


# ----------------------------------------------------------------- M07 text score

def prompt_text(subject="subject", sender="from_addr", body="plain_text") -> Column:
    """The scorer's input: subject, sender and the whole body."""
    return F.concat(F.lit("Subject: "), F.coalesce(F.col(subject), F.lit("")),
                    F.lit("\nFrom: "), F.coalesce(F.col(sender), F.lit("")),
                    F.lit("\n\n"), F.coalesce(F.col(body), F.lit("")))


def train_text_model(df: DataFrame, text: str = "text", label: str = "label",
                     num_features: int = 1 << 18, max_iter: int = 50) -> PipelineModel:
    """Tokenise -> hashed term frequencies -> IDF -> logistic regression."""
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\W+", toLowercase=True, minTokenLength=2),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_tfidf", minDocFreq=2),
        LogisticRegression(featuresCol="_tfidf", labelCol=label, maxIter=max_iter, regParam=0.01,
                           probabilityCol="_tprob", rawPredictionCol="_traw", predictionCol="_tpred"),
    ])
    return pipe.fit(df.select(text, F.col(label).cast("double").alias(label)))


def text_score(model: PipelineModel, df: DataFrame, text: str = "text", out: str = "p_text") -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("_tprob")[1]).drop("_tok", "_tf", "_tfidf", "_tprob",
                                                                     "_traw", "_tpred")


def pandas_text_scorer(predict):
    """Slot for a user's own text model: ``predict(list[str]) -> list[float]``
    runs on Arrow batches inside the executors (never row at a time).  The
    UDF is a closure, pickled by value with ``predict``."""
    import pandas as pd

    @F.pandas_udf("double")
    def _score(texts: pd.Series) -> pd.Series:
        return pd.Series(predict(texts.fillna("").tolist()), dtype="float64")
    return _score


# ----------------------------------------------------------------- M10 assemble

def assemble(df: DataFrame, names: list, out: str) -> DataFrame:
    """Missing features -> 0, then one vector column of ``names``."""
    have = set(df.columns)
    filled = df.select("*", *[F.lit(0.0).alias(n) for n in names if n not in have])
    filled = filled.fillna(0.0, subset=names)
    return VectorAssembler(inputCols=names, outputCol=out, handleInvalid="keep").transform(filled)


def with_text_feature(df: DataFrame, p_text: str = "p_text") -> DataFrame:
    """The full model's 38th input: the squished text score."""
    return df.withColumn(D.TEXT_FEATURE, squish(p_text))


# ----------------------------------------------------------------- M08 train

def balanced_weights(df: DataFrame, label: str = "label", out: str = "w") -> DataFrame:
    """Class weight n / (2 * n_class) ("balanced").  The per-class counts are a
    two-row table (a proven size bound), broadcast back."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy())
    cw = counts.select(label, (total.cast("double") / (F.lit(2.0) * F.col("_n"))).alias(out))
    return df.join(F.broadcast(cw), label, "left")


#: Most rounds of boosting, and rounds without a smaller validation loss that end it.
ROUNDS, PATIENCE = 300, 50


def _gbt(features: str, rounds: int, depth: int, seed: int) -> GBTClassifier:
    return GBTClassifier(featuresCol=features, labelCol="label", weightCol="w",
                         maxIter=rounds, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8,
                         minInstancesPerNode=20, minInfoGain=0.01, featureSubsetStrategy="all",
                         seed=seed, predictionCol="_pred") \
        .setProbabilityCol("_prob").setRawPredictionCol("_raw")


def best_round(losses: list, patience: int) -> int:
    """Rounds to keep: up to the smallest loss before the first ``patience`` rounds in a row
    without a smaller one."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def first_trees(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The ensemble of the first ``rounds`` trees, with the parameters of the whole one."""
    if rounds >= model.getNumTrees:
        return model
    jvm, gateway = SparkSession.active()._jvm, SparkSession.active().sparkContext._gateway
    old = model._java_obj
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(jvm.double, rounds)
    for k, (tree, weight) in enumerate(zip(model.trees[:rounds], model.treeWeights)):
        trees[k], weights[k] = tree._java_obj, float(weight)
    new = jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        old.uid(), trees, weights, old.numFeatures(), old.numClasses())
    return GBTClassificationModel._from_java(old.copyValues(new, old.extractParamMap()))


def train_with_patience(train: DataFrame, features: str, rounds: int, patience: int, depth: int,
                        seed: int) -> GBTClassificationModel:
    """Boost on the training rows and keep the trees up to the round that judges the
    validation rows best.  MLlib cannot go on from an ensemble, so all rounds are trained
    and the later trees are cut off; without validation rows all stay."""
    model = _gbt(features, rounds, depth, seed).fit(train.filter(~F.col("is_val")))
    held_out = train.filter("is_val")
    if held_out.isEmpty():
        return model
    return first_trees(model, best_round(model.evaluateEachIteration(held_out), patience))


def train_dual(train: DataFrame, max_iter: int = ROUNDS, depth: int = 5, seed: int = 42,
               patience: int = PATIENCE) -> dict:
    """Full (38 inputs) and structural (37 inputs) boosted trees.

    ``train`` has the 37 features, ``p_text``, ``label`` and ``is_val``
    (validation rows drive early stopping)."""
    d = balanced_weights(with_text_feature(train).withColumn("label", F.col("label").cast("double")))
    d = assemble(assemble(d, FULL_FEATURES, "v_full"), STRUCT_FEATURES, "v_struct")
    return {"full": train_with_patience(d, "v_full", max_iter, patience, depth, seed),
            "structural": train_with_patience(d, "v_struct", max_iter, patience, depth, seed)}


# ----------------------------------------------------------------- M05 score

def score_table(df: DataFrame, models: dict, p_text: str = "p_text") -> DataFrame:
    """p_full, p_struct and the blended final probability for every row."""
    d = assemble(assemble(with_text_feature(df), FULL_FEATURES, "v_full"), STRUCT_FEATURES, "v_struct")
    d = models["full"].transform(d).withColumn("p_full", vector_to_array("_prob")[1]) \
        .drop("_prob", "_raw", "_pred")
    if "structural" in models and models["structural"] is not None:
        d = models["structural"].transform(d).withColumn("p_struct", vector_to_array("_prob")[1]) \
            .drop("_prob", "_raw", "_pred")
        final = blend("p_full", "p_struct", p_text)
    else:
        d = d.withColumn("p_struct", F.lit(None).cast("double"))
        final = blend("p_full", "p_struct", p_text, ensemble=False)
    return d.drop("v_full", "v_struct").withColumn("final_prob", final)


# ----------------------------------------------------------------- M11 artifact

def save_models(spark: SparkSession, models: dict, path: str, threshold: float, version: str = "5.0") -> None:
    """Two model directories plus a one-row metadata table."""
    models["full"].write().overwrite().save(f"{path}/full")
    if models.get("structural") is not None:
        models["structural"].write().overwrite().save(f"{path}/structural")
    meta = {"version": version, "architecture": "dual_ensemble" if models.get("structural") else "single",
            "feature_names_full": FULL_FEATURES, "feature_names_struct": STRUCT_FEATURES,
            "text_squish_range": list(D.TEXT_SQUISH_RANGE), "threshold": threshold}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
        .write.mode("overwrite").json(f"{path}/meta")


def load_models(spark: SparkSession, path: str) -> dict:
    """Load either generation: dual ensemble, or an older single model."""
    meta = json.loads(spark.read.json(f"{path}/meta").head()["meta"])
    out = {"meta": meta, "full": GBTClassificationModel.load(f"{path}/full"), "structural": None}
    if meta.get("architecture") == "dual_ensemble":
        out["structural"] = GBTClassificationModel.load(f"{path}/structural")
    return out


# ----------------------------------------------------------------- M12 / W10 / J06 importance

def importance_table(spark: SparkSession, model, names: list) -> DataFrame:
    """Feature importances of a tree ensemble as (feature, importance)."""
    imp = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, [float(x) for x in imp])), "feature string, importance double")


def rank_importance(imp: DataFrame, top: int = 15) -> DataFrame:
    """Share of total (%), rank, top-k flag, never-used flag, and the
    top1/top2 ratio (999 when the second is 0)."""
    total = F.sum("importance").over(Window.partitionBy())
    order = Window.orderBy(F.col("importance").desc(), F.col("feature"))
    r = imp.select("feature", "importance",
                   (F.col("importance") / F.when(total > 0, total).otherwise(F.lit(1.0)) * 100).alias("share_pct"),
                   F.row_number().over(order).alias("rank"),
                   F.lead("importance").over(order).alias("_next"))
    top2 = F.max(F.when(F.col("rank") == 2, F.col("importance"))).over(Window.partitionBy())
    top1 = F.max(F.when(F.col("rank") == 1, F.col("importance"))).over(Window.partitionBy())
    return r.select("feature", "importance", "share_pct", "rank",
                    (F.col("rank") <= top).cast("int").alias("in_top"),
                    ((F.col("share_pct") < 0.1) & (F.col("importance") == 0)).cast("int").alias("never_used"),
                    F.when(top2 > 0, top1 / top2).otherwise(F.lit(999.0)).alias("top1_top2_ratio"))


def divergence(full: DataFrame, struct: DataFrame) -> DataFrame:
    """Align two importance reports on feature name and flag divergence."""
    a = full.select("feature", F.col("share_pct").alias("full_pct"))
    b = struct.select("feature", F.col("share_pct").alias("struct_pct"))
    j = a.join(b, "feature", "full_outer")
    pf, ps = F.coalesce("full_pct", F.lit(0.0)), F.coalesce("struct_pct", F.lit(0.0))
    flag = (F.when((pf > 5) & (ps < 0.5), F.lit("only_full"))
            .when((ps > 5) & (pf < 0.5), F.lit("only_structural"))
            .when(F.abs(pf - ps) > 10, F.lit("big_divergence")).otherwise(F.lit("")))
    return j.select("feature", "full_pct", "struct_pct", flag.alias("flag"),
                    ((pf > 0.5) | (ps > 0.5)).cast("int").alias("shown"),
                    (F.col("full_pct").isNotNull() & F.col("struct_pct").isNotNull()).cast("int").alias("shared"))
