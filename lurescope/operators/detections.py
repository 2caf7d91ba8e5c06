"""Detection log.

The log is append-only: every scoring run appends a part, split into buckets by
the hash of ``email_hash``; the current state is the latest version per
``email_hash`` (no MERGE needed), and ``compact`` folds the parts into it.
"Latest" is a ``max_by`` aggregate, which is combined map-side, so a hash written
millions of times does not become one big group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope import dictionaries as D
from lurescope.operators.versioned import HashLog
from lurescope.session import shared_path

LOG_COLUMNS = ["email_hash", "processed_at", "event_id", "confidence", "is_phishing"]


def latest_versions(log: DataFrame, key: str = "email_hash",
                    order=("processed_at", "event_id")) -> DataFrame:
    """The latest row per key (ties broken by the later event id)."""
    rest = [c for c in log.columns if c != key]
    best = log.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


class DetectionLog(HashLog):
    """The detection log: results in hash buckets in the shared folder, see ``versioned``."""

    def __init__(self, spark: SparkSession, path: str | None = None, **how):
        super().__init__(spark, path or shared_path(spark, "detections"), **how)


def history(latest: DataFrame, limit: int = 100, positives_only: bool = False) -> DataFrame:
    """Newest ``limit`` rows (a top-k: each task keeps at most ``limit``)."""
    d = latest.filter(F.col("is_phishing")) if positives_only else latest
    return d.orderBy(F.col("processed_at").desc(), F.col("event_id").desc()).limit(limit)


def stats(latest: DataFrame) -> DataFrame:
    """Total, positives, rest, rate %, mean confidence -- one pass."""
    total = F.count(F.lit(1))
    pos = F.count_if(F.col("is_phishing"))
    return latest.agg(
        total.alias("total_processed"),
        pos.alias("phishing_detected"),
        (total - pos).alias("legitimate"),
        F.when(total > 0, F.round(pos * 100.0 / total, 2)).otherwise(F.lit(0.0)).alias("phishing_rate"),
        F.coalesce(F.round(F.avg("confidence"), 4), F.lit(0.0)).alias("average_confidence"))


def unseen(batch: DataFrame, seen: DataFrame, key: str = "email_hash", row_key: list | None = None) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``seen`` (left anti join:
    it needs no distinct set, and its output keeps no key order, so a hot key's
    partition can be split)."""
    return batch.join(seen.select(key), key, "left_anti")


def risk_band(p) -> "F.Column":
    """Critical >= 0.85, high >= 0.65, medium >= 0.45, low >= 0.25, else safe."""
    p = F.col(p) if isinstance(p, str) else p
    out = None
    for name, lo in D.RISK_BANDS[:-1]:
        out = (F.when(p >= lo, F.lit(name)) if out is None else out.when(p >= lo, F.lit(name)))
    return out.otherwise(F.lit(D.RISK_BANDS[-1][0]))


def band_mix(log: DataFrame, bucket: str = "1 day", ts: str = "processed_at",
             score: str = "confidence") -> DataFrame:
    """Detections per time bucket and risk band."""
    return (log.groupBy(F.window(ts, bucket).alias("w"), risk_band(score).alias("band"))
            .agg(F.count(F.lit(1)).alias("detections"),
                 F.count_if(F.col("is_phishing")).alias("positives"))
            .select(F.col("w.start").alias("bucket_start"), "band", "detections", "positives"))
