"""Brand similarity by deletion variants, the as-of merge, and the metric intervals, each
against a plain version."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurescope.functions.urls import leet_normalize, primary_part
from lurescope.operators import metrics as MET
from lurescope.operators.domains import brand_matches, deletion_keys
from lurescope.operators.verdicts import asof_join


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def changed(rng, word, times):
    for _ in range(times):
        i, ch = rng.randrange(len(word) + 1), rng.choice("abcé0-")
        word = rng.choice([word[:i] + ch + word[i:], word[:i] + word[i + 1:], word[:i] + ch + word[i + 1:]])
    return word


@pytest.mark.parametrize("d", [1, 2])
def test_brand_matches_equal_brute_force(spark, d):
    rng = random.Random(d)
    brands = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["pay", "ab"]
    brands = list(dict.fromkeys(brands))
    labels = {changed(rng, rng.choice(brands), rng.randrange(4)) for _ in range(400)} | {"", "a", "x" * 300, "p4y", "pay-it"}
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    parts = {r.label: (r.p, r.n) for r in df.select(
        "label", primary_part("label").alias("p"), leet_normalize("label").alias("n")).collect()}
    want = {}
    for x in labels:
        primary, norm = parts[x]
        fits = [(i, b, lev(norm, b)) for i, b in enumerate(brands)
                if norm == b or (len(primary) >= 4 and lev(norm, b) <= d)]
        if fits:
            want[x] = (fits[0][1], fits[0][2], min(f[2] for f in fits))
    first = {r.label: (r.brand, r.brand_distance) for r in brand_matches(df, brands, d).collect()}
    best = {r.label: r.brand_distance for r in brand_matches(df, brands, d, first_in_order=False).collect()}
    assert first == {x: w[:2] for x, w in want.items()} and best == {x: w[2] for x, w in want.items()}
    assert brand_matches(df, [], d).count() == 0


def test_ten_thousand_brands_from_a_table(spark):
    word = lambda k: F.translate(F.md5(k.cast("string")), "0123456789", "ghijklmnpq")
    brands = spark.range(10_000).select(F.substring(word(F.col("id")), 1, 10).alias("brand"),
                                        F.col("id").cast("int").alias("pos"))
    three = F.col("id") * 3
    labels = spark.range(3_000).select(F.concat(F.substring(word(three), 1, 4), F.lit("z"),
                                                F.substring(word(three), 6, 5)).alias("label"))
    got = brand_matches(labels, brands, 2)
    assert "broadcast" not in got._jdf.queryExecution().logical().toString().lower()
    joined = brands.join(labels.withColumn("n", leet_normalize("label")), F.expr("levenshtein(n, brand, 2) >= 0"))
    want = joined.groupBy("label").agg(F.min_by("brand", "pos").alias("brand"))
    assert {(r.label, r.brand) for r in got.collect()} == {(r.label, r.brand) for r in want.collect()}
    assert got.count() > 500


def test_deletion_keys_are_distinct(spark):
    row = spark.createDataFrame([("abcd",), ("aaaa",), ("a",), ("",)], "t string").select("t", deletion_keys("t", 2).alias("k"))
    assert {r.t: len(r.k) for r in row.collect()} == {"abcd": 11, "aaaa": 3, "a": 2, "": 1}


FACTS = "domain string, fetched_at timestamp, age_days bigint"


def test_asof_of_a_hot_domain(spark):
    """A third of the messages on one domain with 10,000 facts; every kind of border."""
    rng, t0 = random.Random(1), dt.datetime(2024, 1, 1)
    hours = lambda x: t0 + dt.timedelta(hours=x)
    facts = [("hot.com", t0 + dt.timedelta(minutes=5 * i), i) for i in range(10_000)]
    facts += [(f"d{rng.randrange(40)}.com", hours(rng.randrange(1500)), rng.randrange(1000)) for _ in range(400)]
    facts = list({(d, t): (d, t, a) for d, t, a in facts}.values())
    rows = [(i, "hot.com" if i % 3 == 0 else rng.choice([None, *[f"d{k}.com" for k in range(45)]]),
             rng.choice([None, hours(rng.randrange(1600)), hours(rng.randrange(1600)), hours(rng.random() * 1600)]))
            for i in range(1500)]
    by = {}
    for d, t, a in facts:
        by.setdefault(d, []).append((t, a))
    want = {}
    for i, d, t in rows:
        live = [f for f in by.get(d, []) if t is not None and t - dt.timedelta(days=7) < f[0] <= t]
        want[i] = max(live)[1] if live else None
    left = spark.createDataFrame(rows, "msg_id bigint, domain string, ts timestamp")
    history = spark.createDataFrame(facts + [(None, t0, 5), ("d1.com", None, 6)], FACTS)
    for width in (6, 24, 168):
        got = asof_join(left, history, "domain", "ts", bucket_hours=width)
        assert {r.msg_id: r.age_days for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "<=" not in plan.split("Join")[1].split("\n")[0]  # no range condition in a join
    with pytest.raises(ValueError):
        asof_join(left, history, "domain", "ts", bucket_hours=5)
    assert asof_join(left, history.limit(0), "domain", "ts").filter("age_days is not null").count() == 0


def test_metric_intervals(spark):
    rng = np.random.default_rng(0)
    label = rng.random(4000) < 0.4
    score = np.clip(label * 0.3 + rng.random(4000) * 0.7, 0, 1).round(4)
    df = spark.createDataFrame([(i, float(s), int(y)) for i, (s, y) in enumerate(zip(score, label))],
                               "k bigint, score double, label int")
    got = {r.metric: r for r in MET.bootstrap_metrics(df, "k", "score", "label", 0.5).collect()}
    pred = score >= 0.5
    tp, fp, tn, fn = ((pred & label).sum(), (pred & ~label).sum(), (~pred & ~label).sum(), (~pred & label).sum())
    pos, neg = score[label][:, None], score[~label][None, :]
    want = {"accuracy": (tp + tn) / 4000, "precision": tp / (tp + fp), "recall": tp / (tp + fn),
            "f1": 2 * tp / (2 * tp + fp + fn), "fpr": fp / (fp + tn), "fnr": fn / (fn + tp),
            "auc": (pos > neg).mean() + 0.5 * (pos == neg).mean(),
            "mcc": (tp * tn - fp * fn) / np.sqrt(float(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))}
    assert {m: pytest.approx(r.point, abs=1e-12) for m, r in got.items()} == want
    for m, share, n in (("accuracy", want["accuracy"], 4000), ("recall", want["recall"], label.sum()), ("fpr", want["fpr"], (~label).sum())):
        half = 1.96 * np.sqrt(share * (1 - share) / n)  # the normal interval
        assert got[m].hi - got[m].lo == pytest.approx(2 * half, rel=0.3)
    assert all(r.lo <= r.point <= r.hi for r in got.values())
    assert MET.bootstrap_metrics(df, "k", "score", "label", 0.5)._jdf.queryExecution().optimizedPlan() \
        .toString().count("LogicalRDD") == 1  # one pass over the rows


def test_metric_intervals_of_one_class_and_of_nothing(spark):
    one = spark.createDataFrame([(1, 0.9, 1), (2, 0.1, 1), (3, None, 1), (4, 0.2, None)], "k bigint, score double, label int")
    got = {r.metric: r.point for r in MET.bootstrap_metrics(one, "k", "score", "label", 0.5).collect()}
    assert got["recall"] == 0.5 and got["auc"] == got["fpr"] == got["mcc"] == 0.0
    assert MET.bootstrap_metrics(one.limit(0), "k", "score", "label", 0.5).count() in (0, 8)
