"""Score arithmetic (M01-M04, M06) -- plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurescope import dictionaries as D


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x)))


def squish(p) -> Column:
    """Clip to [0.05, 0.95], then halve the distance to 0.5."""
    return F.lit(0.5) + (clip(p, D.TEXT_CLIP_LOW, D.TEXT_CLIP_HIGH) - F.lit(0.5)) * F.lit(0.5)


def text_weight(p) -> Column:
    """Position of the squished text score in the squish range, clipped to [0, 1]."""
    lo, hi = D.TEXT_SQUISH_RANGE
    return clip((squish(p) - F.lit(lo)) / (F.lit(hi) - F.lit(lo)), 0.0, 1.0)


def blend(p_full, p_struct, p_text, ensemble: bool = True) -> Column:
    """Weight * full + (1 - weight) * structural; the single-model
    generation scores with the full model alone."""
    if not ensemble:
        return _c(p_full)
    w = text_weight(p_text)
    return w * _c(p_full) + (F.lit(1.0) - w) * _c(p_struct)


def label(prob, threshold: float = D.DEFAULT_THRESHOLD) -> Column:
    """PHISHING when prob >= threshold."""
    return F.when(_c(prob) >= F.lit(threshold), F.lit("PHISHING")).otherwise(F.lit("LEGITIMATE"))


def active_signals(feature_names: list) -> Column:
    """A10: map of the features with a non-zero value."""
    kv = []
    for n in feature_names:
        kv += [F.lit(n), F.col(n).cast("double")]
    return F.map_filter(F.create_map(*kv), lambda k, v: v != 0)


def breakdown_columns(p_text="p_text", p_full="p_full", p_struct="p_struct",
                      threshold: float = D.DEFAULT_THRESHOLD) -> list:
    """Raw, squished, weight, both model scores, final, threshold, label."""
    final = blend(p_full, p_struct, p_text)
    return [
        F.round(_c(p_text), 4).alias("nlp_prob_raw"),
        F.round(squish(p_text), 4).alias("nlp_prob_squished"),
        F.round(text_weight(p_text), 3).alias("nlp_weight"),
        F.round(_c(p_full), 4).alias("prob_full"),
        F.round(_c(p_struct), 4).alias("prob_structural"),
        F.round(final, 4).alias("final_prob"),
        F.lit(threshold).alias("threshold"),
        label(final, threshold).alias("label"),
    ]
