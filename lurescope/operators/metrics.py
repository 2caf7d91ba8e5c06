"""Evaluation metrics as aggregations.

Every metric is one pass of conditional counts; the threshold grid is 50
thresholds in *one* aggregation; AUC comes from a score histogram whose
size is bounded by the score resolution, not by the row count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurescope import dictionaries as D


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def confusion(df: DataFrame, score, label, threshold) -> DataFrame:
    """Tp, fp, tn, fn at a threshold (one pass)."""
    pred = _c(score) >= (threshold if isinstance(threshold, Column) else F.lit(threshold))
    y = _c(label) == 1
    return df.agg(F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
                  F.count_if(~pred & ~y).alias("tn"), F.count_if(~pred & y).alias("fn"))


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def rates(cm: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, FPR, FNR (0 when a denominator is 0)."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    prec = _div(tp, tp + fp)
    rec = _div(tp, tp + fn)
    return cm.select(
        "tp", "fp", "tn", "fn",
        _div(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
        F.when(prec + rec > 0, F.lit(2.0) * prec * rec / (prec + rec)).otherwise(F.lit(0.0)).alias("f1"),
        _div(fp, fp + tn).alias("fpr"),
        _div(fn, fn + tp).alias("fnr"))


def mcc_expr(tp, fp, tn, fn) -> Column:
    tp, fp, tn, fn = (F.col(x).cast("double") for x in (tp, fp, tn, fn))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(F.lit(0.0))


def score_histogram(df: DataFrame, score, label, resolution: float = 1e-6) -> DataFrame:
    """Per quantised score: positives and negatives.  At most 1/resolution + 1 rows."""
    s = F.round(_c(score) / F.lit(resolution)).cast("bigint")
    return df.groupBy(s.alias("s")).agg(F.count_if(_c(label) == 1).alias("pos"),
                                        F.count_if(_c(label) != 1).alias("neg"))


def auc(df: DataFrame, score, label, resolution: float = 1e-6) -> DataFrame:
    """ROC AUC with ties counted half (Mann-Whitney), on scores
    quantised to ``resolution``.  The window runs over the histogram, whose
    size is bounded by the resolution."""
    h = score_histogram(df, score, label, resolution)
    below = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("neg_below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    return h.agg(
        F.when((F.sum("pos") > 0) & (F.sum("neg") > 0),
               F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") * 0.5))
               / (F.sum("pos").cast("double") * F.sum("neg").cast("double"))).alias("auc"))


def threshold_grid() -> list:
    return [round(D.THRESHOLD_GRID_START + k * D.THRESHOLD_GRID_STEP, 2)
            for k in range(D.THRESHOLD_GRID_POINTS)]


def threshold_table(df: DataFrame, score, label) -> DataFrame:
    """The 50-point grid of FPR/FNR, from ONE aggregation of 200 counts."""
    grid = threshold_grid()
    y = _c(label) == 1
    aggs = []
    for k, t in enumerate(grid):
        pred = _c(score) >= F.lit(t)
        aggs += [F.count_if(pred & y).alias(f"tp{k}"), F.count_if(pred & ~y).alias(f"fp{k}"),
                 F.count_if(~pred & ~y).alias(f"tn{k}"), F.count_if(~pred & y).alias(f"fn{k}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("threshold"),
                              F.col(f"tp{k}").alias("tp"), F.col(f"fp{k}").alias("fp"),
                              F.col(f"tn{k}").alias("tn"), F.col(f"fn{k}").alias("fn"))
                     for k, t in enumerate(grid)])
    long = wide.select(F.explode(rows).alias("r")).select("r.*")
    return long.select("k", "threshold", "tp", "fp", "tn", "fn",
                       _div(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
                       _div(F.col("fn"), F.col("fn") + F.col("tp")).alias("fnr"))


def choose_threshold(grid: DataFrame) -> DataFrame:
    """Smallest FNR with FPR <= 5 %, else <= 8 %, else <= 10 %; the first
    grid point wins ties; 0.5 when nothing qualifies (grid has 50 rows)."""
    tgt = F.explode(F.array(*[F.struct(F.lit(i).alias("ti"), F.lit(t).alias("fpr_target"))
                              for i, t in enumerate(D.THRESHOLD_FPR_TARGETS)])).alias("t")
    cand = (grid.select("*", tgt).select("*", "t.ti", "t.fpr_target").drop("t")
            .filter((F.col("fpr") <= F.col("fpr_target")) & (F.col("fnr") < 1.0)))
    best = cand.agg(F.min_by(F.struct("threshold", "fnr", "fpr", "fpr_target"),
                             F.struct("ti", "fnr", "k")).alias("b"))
    return best.select(
        F.coalesce(F.col("b.threshold"), F.lit(D.THRESHOLD_FALLBACK)).alias("threshold"),
        F.coalesce(F.col("b.fnr"), F.lit(1.0)).alias("fnr"),
        F.coalesce(F.col("b.fpr"), F.lit(1.0)).alias("fpr"),
        F.col("b.fpr_target").alias("fpr_target"))


def group_accuracy(df: DataFrame, group: str, score, label, threshold: float,
                   known_failure: str) -> DataFrame:
    """Accuracy per group, overall, and overall without the known-failure group."""
    correct = ((_c(score) >= F.lit(threshold)) == (_c(label) == 1))
    per = df.groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("n"),
                                                    F.count_if(correct).alias("correct"))
    tot = df.agg(F.lit("__total__").alias("grp"), F.count(F.lit(1)).alias("n"),
                 F.count_if(correct).alias("correct"))
    rest = df.filter(F.col(group) != F.lit(known_failure)).agg(
        F.lit("__total_without_known_failure__").alias("grp"),
        F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("correct"))
    out = per.unionByName(tot).unionByName(rest)
    return out.withColumn("accuracy", _div(F.col("correct"), F.col("n")))


def paired_test(df: DataFrame, pred_a: Column, pred_b: Column, label) -> DataFrame:
    """McNemar statistic (continuity-corrected) and MCC of two runs."""
    y = _c(label) == 1
    ca, cb = (pred_a == y), (pred_b == y)
    agg = df.agg(
        F.count_if(ca & ~cb).alias("a_only"), F.count_if(~ca & cb).alias("b_only"),
        *[F.count_if(p & y).alias(f"tp_{n}") for n, p in (("a", pred_a), ("b", pred_b))],
        *[F.count_if(p & ~y).alias(f"fp_{n}") for n, p in (("a", pred_a), ("b", pred_b))],
        *[F.count_if(~p & ~y).alias(f"tn_{n}") for n, p in (("a", pred_a), ("b", pred_b))],
        *[F.count_if(~p & y).alias(f"fn_{n}") for n, p in (("a", pred_a), ("b", pred_b))])
    b, c = F.col("a_only").cast("double"), F.col("b_only").cast("double")
    return agg.select(
        "a_only", "b_only",
        F.when(b + c > 0, F.pow(F.abs(b - c) - 1.0, 2) / (b + c)).otherwise(F.lit(0.0)).alias("mcnemar_chi2"),
        mcc_expr("tp_a", "fp_a", "tn_a", "fn_a").alias("mcc_a"),
        mcc_expr("tp_b", "fp_b", "tn_b", "fn_b").alias("mcc_b"))


# Poisson(1) inverse CDF steps: P(K <= k) for k = 0..7.
POISSON1_CDF = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def poisson1_weight(u: Column) -> Column:
    out = F.when(u < F.lit(POISSON1_CDF[0]), F.lit(0))
    for k in range(1, len(POISSON1_CDF)):
        out = out.when(u < F.lit(POISSON1_CDF[k]), F.lit(k))
    return out.otherwise(F.lit(len(POISSON1_CDF)))


def bootstrap_accuracy(df: DataFrame, key: str, pred: Column, label, replicates: int = 100,
                       level: float = 0.95) -> DataFrame:
    """Poisson bootstrap interval of accuracy.  Each row carries a
    hash-derived Poisson(1) weight per replicate; weighted counts are
    aggregated per replicate (partial aggregation), then the percentiles
    are taken over ``replicates`` rows."""
    correct = (pred == (_c(label) == 1)).cast("int")
    rep = df.select(key, correct.alias("ok"),
                    F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b"))
    h = F.sha2(F.concat(F.col(key).cast("string"), F.lit(":"), F.col("b").cast("string")), 256)
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    w = poisson1_weight(u)
    per = rep.select("b", "ok", w.alias("w")).groupBy("b").agg(
        F.sum(F.col("w") * F.col("ok")).alias("wc"), F.sum("w").alias("wn"))
    acc = per.select((F.col("wc").cast("double") / F.col("wn")).alias("acc"))
    a = (1 - level) / 2
    point = df.agg(F.avg(correct.cast("double")).alias("point"))
    ci = acc.agg(F.percentile("acc", a).alias("lo"), F.percentile("acc", 1 - a).alias("hi"))
    return point.unionByName(ci, allowMissingColumns=True).agg(
        F.lit("accuracy").alias("metric"), F.max("point").alias("point"),
        F.max("lo").alias("lo"), F.max("hi").alias("hi"))


#: Poisson weights that one SHA-256 gives: eight numbers of 32 bits.
WEIGHTS_PER_HASH = 8


def poisson_weights(key: str, replicates: int) -> list[Column]:
    """A Poisson(1) weight per replicate from the hashes of (key, k), eight from each."""
    out = []
    for k in range(-(-replicates // WEIGHTS_PER_HASH)):
        h = F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"/{k}")), 256)
        out += [poisson1_weight(F.conv(F.substring(h, 1 + 8 * j, 8), 16, 10).cast("bigint") / F.lit(4294967296.0))
                for j in range(WEIGHTS_PER_HASH)]
    return out[:replicates]


def bootstrap_metrics(df: DataFrame, key: str, score: str, label: str, threshold: float, replicates: int = 100,
                      level: float = 0.95, resolution: float = 1e-4) -> DataFrame:
    """Point value and Poisson bootstrap interval of every reported metric: accuracy,
    precision, recall, F1, FPR, FNR, AUC, MCC; one row each (``metric, point, lo, hi``).

    One pass over the rows: their weights are summed into one score histogram with a
    column per replicate (0 is the sample itself), of at most 2 / ``resolution`` rows.  All
    metrics of all replicates come from that histogram.  AUC is that of scores rounded to
    ``resolution``, ties counted half; the others compare the exact score.
    """
    y = F.col(label) == 1
    rows = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).select(
        F.round(F.col(score) / F.lit(resolution)).cast("bigint").alias("s"),
        (F.col(score) >= F.lit(threshold)).alias("pred"), y.alias("y"),
        F.lit(1).alias("w0"), *[w.alias(f"w{b}") for b, w in enumerate(poisson_weights(key, replicates), 1)])
    sums = [F.sum(F.when(side, F.col(f"w{b}")).otherwise(0)).alias(f"{name}{b}")
            for b in range(replicates + 1) for name, side in (("p", F.col("y")), ("n", ~F.col("y")))]
    histogram = rows.groupBy("s", "pred").agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.col(f"p{b}").alias("p"), F.col(f"n{b}").alias("n"))
                               for b in range(replicates + 1)]))
    long = histogram.select("s", "pred", each.alias("x")).select("s", "pred", "x.*")
    below = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    scores = long.groupBy("b", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), *[
        F.sum(F.when(F.col("pred") == bool(pred), F.col(c)).otherwise(0)).alias(name)
        for name, c, pred in (("tp", "p", 1), ("fp", "n", 1), ("tn", "n", 0), ("fn", "p", 0))])
    scores = scores.withColumn("under", F.coalesce(F.sum("n").over(below), F.lit(0)))
    cm = scores.groupBy("b").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")],
        F.sum(F.col("p").cast("double") * (F.col("under") + F.col("n") * 0.5)).alias("wins"),
        (F.sum("p").cast("double") * F.sum("n").cast("double")).alias("pairs"))
    per = cm.select("b", "tp", "fp", "tn", "fn", _div(F.col("wins"), F.col("pairs")).alias("auc"),
                    mcc_expr("tp", "fp", "tn", "fn").alias("mcc"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
    shares = {"accuracy": _div(tp + tn, tp + fp + tn + fn), "precision": prec, "recall": rec,
              "f1": F.when(prec + rec > 0, F.lit(2.0) * prec * rec / (prec + rec)).otherwise(F.lit(0.0)),
              "fpr": _div(fp, fp + tn), "fnr": _div(fn, fn + tp), "auc": F.col("auc"), "mcc": F.col("mcc")}
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in shares.items()]))
    table = per.select("b", named.alias("m")).select("b", "m.*")
    a = (1 - level) / 2
    again = F.when(F.col("b") > 0, F.col("value"))
    return table.groupBy("metric").agg(
        F.max(F.when(F.col("b") == 0, F.col("value"))).alias("point"),
        F.percentile(again, a).alias("lo"), F.percentile(again, 1 - a).alias("hi"))
