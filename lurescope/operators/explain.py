"""Explanations over scored rows (X01-X05, S16) -- projections only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope import dictionaries as D
from lurescope.operators.detections import risk_band


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def weight_proxy(p_text, prob) -> Column:
    """Share of the decision attributed to the text score, min(p_text / p, 1)."""
    return F.when(_c(prob) > 0, F.least(_c(p_text) / _c(prob), F.lit(1.0))).otherwise(F.lit(0.5))


def _rule(feature: str, op: str, value) -> Column:
    c = F.coalesce(F.col(feature).cast("double"), F.lit(0.0))
    return c >= F.lit(value) if op == ">=" else c > F.lit(value)


def signals(p_text, weight) -> Column:
    """The live signal rules, in rule order (an array of strings)."""
    items = [F.when(_c(weight) >= 0.5, F.format_string(
        D.LANGUAGE_SIGNAL.replace("%", "%%").replace("{pct}", "%.0f"), _c(p_text) * 100))]
    for feature, op, value, text in D.SIGNAL_RULES:
        if "{n}" in text:
            msg = F.format_string(text.replace("{n}", "%d"), F.col(feature).cast("int"))
        else:
            msg = F.lit(text)
        items.append(F.when(_rule(feature, op, value), msg))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def key_signals(sig: Column, limit: int = D.KEY_SIGNALS_MAX) -> Column:
    """Stable reorder by the first matching priority keyword, first ``limit``."""
    kws = [k.lower() for k in D.SIGNAL_PRIORITY_KEYWORDS]

    def prio(s):
        low = F.lower(s)
        out = F.lit(len(kws))
        for i in reversed(range(len(kws))):
            out = F.when(low.contains(F.lit(kws[i])), F.lit(i)).otherwise(out)
        return out

    tagged = F.transform(sig, lambda s, i: F.struct(prio(s).alias("p"), i.alias("i"), s.alias("s")))
    return F.transform(F.slice(F.array_sort(tagged), 1, limit), lambda x: x["s"])


def explanation(prob, prediction, p_text, weight, sig: Column) -> Column:
    """Rule-based explanation text."""
    p = _c(prob)
    pct = F.format_string("%.1f%%", p * 100)
    band = risk_band(p)
    base = F.lit(None).cast("string")
    for name, tmpl in D.BAND_SENTENCES.items():
        before, after = tmpl.split("{pct}")
        base = F.when(band == name, F.concat(F.lit(before), pct, F.lit(after))).otherwise(base)
    top = F.array_join(F.slice(sig, 1, D.EXPLANATION_SIGNALS_MAX), "; ")
    w = _c(weight)
    no_signals = F.when(w >= 0.6, F.concat(base, F.lit(" The email language closely resembles known phishing messages."))) \
        .otherwise(F.concat(base, F.lit(" Multiple weak signals combined to trigger detection.")))
    with_signals = (
        F.when(w >= 0.7, F.concat(base, F.lit(" Flagged primarily based on language patterns. Key indicators: "),
                                  top, F.lit(".")))
        .when(w <= 0.3, F.concat(base, F.lit(" Flagged based on structural red flags. Key indicators: "), top,
                                 F.lit(". Email language appeared neutral but technical signals suggest phishing.")))
        .otherwise(F.concat(base, F.lit(" Both language analysis ("),
                            F.format_string("%.0f", _c(p_text) * 100),
                            F.lit("% NLP) and structural signals indicate phishing. Key indicators: "),
                            top, F.lit("."))))
    clean = F.concat(F.lit("This email appears legitimate (phishing probability: "), pct,
                     F.lit("). No significant threats detected."))
    safe = F.concat(F.lit("This email appears legitimate (confidence: "), pct,
                    F.lit("). No significant phishing indicators were detected."))
    return (F.when((_c(prediction) == 0) | (p < 0.25), clean)
            .when(band == "safe", safe)
            .when(F.size(sig) == 0, no_signals)
            .otherwise(with_signals))


def detection_results(scored: DataFrame, prob: str = "final_prob", p_text: str = "p_text",
                      threshold: float = D.DEFAULT_THRESHOLD, id_col: str = "msg_id") -> DataFrame:
    """One detection record per scored row (plus the signals used)."""
    p = F.col(prob)
    pred = (p >= F.lit(threshold)).cast("int")
    w = weight_proxy(p_text, prob)
    sig = signals(p_text, w)
    return scored.select(
        F.col(id_col), *[c for c in ("from_addr", "subject") if c in scored.columns],
        pred.cast("boolean").alias("is_phishing"),
        F.when(pred == 1, F.lit("phishing")).otherwise(F.lit("legitimate")).alias("label"),
        F.round(p, 4).alias("confidence"),
        F.round(p * 100, 1).alias("risk_score"),
        F.round(F.col(p_text), 4).alias("nlp_probability"),
        risk_band(p).alias("risk_level"),
        key_signals(sig).alias("key_signals"),
        explanation(p, pred, p_text, w, sig).alias("explanation"))


def alerts(results: DataFrame, alert_address: str | None = None, subject_max: int = 60) -> DataFrame:
    """One alert row per positive that is not a self-alert."""
    r = results.filter(F.col("is_phishing"))
    if alert_address:
        r = r.filter(~F.lower(F.coalesce("from_addr", F.lit(""))).contains(alert_address.lower()))
    return r.select(
        "msg_id", F.col("from_addr").alias("sender"),
        F.substring(F.coalesce("subject", F.lit("")), 1, subject_max).alias("subject"),
        "confidence", "risk_score", "risk_level",
        F.array_join("key_signals", " | ").alias("signals"), "explanation")
