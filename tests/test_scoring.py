from pyspark.sql import functions as F

from lurescope import dictionaries as D
from lurescope.operators import detections as DET
from lurescope.operators import metrics as MET
from lurescope.operators import scoring as SC
from lurescope.operators.verdicts import domain_age_score


def test_squish_weight_blend_properties(spark):
    ps = [0.0, 0.05, 0.2, 0.5, 0.8, 0.95, 1.0]
    df = spark.createDataFrame([(p, 0.9, 0.1) for p in ps], "p double, f double, s double")
    rows = df.select("p", SC.squish("p").alias("sq"), SC.text_weight("p").alias("w"),
                     SC.blend("f", "s", "p").alias("b")).collect()
    for r in rows:
        assert 0.275 - 1e-12 <= r.sq <= 0.725 + 1e-12
        assert 0.1 - 1e-12 <= r.b <= 0.9 + 1e-12
        if r.p <= 0.05:
            assert r.w == 0.0
        if r.p >= 0.95:
            assert abs(r.w - 1.0) < 1e-12


def test_risk_band_boundaries_inclusive(spark):
    vals = {0.85: "critical", 0.8499: "high", 0.65: "high", 0.45: "medium", 0.25: "low", 0.2499: "safe"}
    df = spark.createDataFrame([(k,) for k in vals], "p double")
    got = {r.p: r.b for r in df.select("p", DET.risk_band("p").alias("b")).collect()}
    assert got == vals


def test_domain_age_score_boundaries(spark):
    cases = {None: 0.5, 6: 1.0, 7: 0.9, 29: 0.9, 30: 0.7, 89: 0.7, 90: 0.5, 365: 0.15, 730: 0.05}
    df = spark.createDataFrame([(k,) for k in cases], "a int")
    got = {r.a: r.s for r in df.select("a", domain_age_score(F.col("a")).alias("s")).collect()}
    assert got == cases


def test_threshold_search_prefers_lowest_fnr_then_first(spark):
    rows = [(0.9, 1)] * 8 + [(0.2, 1)] * 2 + [(0.1, 0)] * 95 + [(0.6, 0)] * 5
    df = spark.createDataFrame(rows, "p double, y int")
    best = MET.choose_threshold(MET.threshold_table(df, "p", "y")).head()
    assert best.fpr <= 0.05 and best.threshold == 0.3 and abs(best.fnr - 0.2) < 1e-12


def test_auc_with_ties(spark):
    rows = [(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)]
    df = spark.createDataFrame(rows, "p double, y int")
    assert abs(MET.auc(df, "p", "y").head().auc - 0.875) < 1e-12


def test_confusion_and_rates(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.1, 1), (0.1, 0), (0.1, 0)], "p double, y int")
    r = MET.rates(MET.confusion(df, "p", "y", D.DEFAULT_THRESHOLD)).head()
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 1, 2, 1)
    assert abs(r.accuracy - 0.6) < 1e-12 and abs(r.fpr - 1 / 3) < 1e-12
