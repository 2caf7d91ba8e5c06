"""Deduplication, caps, samples and splits.

No operator here sends a whole group to one task: "first per key" is a
``min_by`` aggregate (partial aggregation map-side, so a group of a million
copies costs a million comparisons spread over all tasks), and ranks
within a class use the distributed ranking of :mod:`ranking`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.operators.ranking import first_n_per_group, global_row_number


def content_key(text, kind: str = "full") -> Column:
    """SHA-256 key of the whole text, its first 500 bytes or 200 chars."""
    t = F.col(text) if isinstance(text, str) else text
    if kind == "full":
        return F.sha2(t, 256)
    if kind == "bytes500":
        return F.sha2(F.substring(F.encode(t, "UTF-8"), 1, 500), 256)
    if kind == "chars200":
        return F.sha2(F.substring(t, 1, 200), 256)
    raise ValueError(kind)


def dedup_first(df: DataFrame, key: Column | str, order: list, keep: list) -> DataFrame:
    """One row per key -- the first by ``order`` (ascending columns).

    Returns ``key`` (as column ``dedup_key``), the kept columns, and
    ``copies`` (rows sharing the key).
    """
    k = F.col(key) if isinstance(key, str) else key
    d = df.withColumn("dedup_key", k)
    best = d.groupBy("dedup_key").agg(
        F.min_by(F.struct(*keep), F.struct(*order)).alias("_k"),
        F.count(F.lit(1)).alias("copies"))
    return best.select("dedup_key", *[F.col(f"_k.{c}").alias(c) for c in keep], "copies")


def hash_unit(key: Column) -> Column:
    """A uniform number in [0, 1) from a SHA-256 of the key (same in any engine)."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def split_column(key: Column, test: float = 0.15, val_of_rest: float = 0.176) -> Column:
    """Train / val / test by a hash bucket of the key.

    Each class keeps its shares in expectation with no shuffle at all.
    """
    u = hash_unit(key)
    return (F.when(u < test, F.lit("test"))
            .when(u < test + (1 - test) * val_of_rest, F.lit("val"))
            .otherwise(F.lit("train")))


def cap_per_class(df: DataFrame, label: str, order: list, cap: int, balance: bool = True) -> DataFrame:
    """Positives <= cap; negatives <= cap, or <= positives kept when balancing.

    Ranks come from the distributed ranking (no single-task window); the
    balance bound is one scalar subquery.
    """
    # Written once: both the balance bound and the filter read it.
    from lurescope.session import materialize
    ranked = materialize(global_row_number(df, order, [label], name="_rn"), "class_ranks")
    pos_kept = ranked.filter((F.col(label) == 1) & (F.col("_rn") <= cap)).agg(
        F.count(F.lit(1))).scalar()
    neg_cap = F.least(F.lit(cap), pos_kept) if balance else F.lit(cap)
    keep = ((F.col(label) == 1) & (F.col("_rn") <= cap)) | ((F.col(label) == 0) & (F.col("_rn") <= neg_cap))
    return ranked.filter(keep).drop("_rn")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A deterministic sample of at most ``n`` rows (order by a seeded
    hash of the key; unlike ``sample`` it is the same on every run)."""
    h = F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")), 256)
    return first_n_per_group(df.withColumn("_h", h), [F.col("_h"), F.col(key)], n, [], "_rn") \
        .drop("_h", "_rn")


def feed_union(feeds: DataFrame, domain: str = "domain", feed_order: str = "feed_order",
               feed: str = "feed") -> DataFrame:
    """Distinct union of feeds; each domain is credited to the first
    feed (in feed order) that lists it -> net-new count per feed."""
    first = feeds.groupBy(domain).agg(F.min_by(F.col(feed), F.col(feed_order)).alias(feed))
    return first.groupBy(feed).agg(F.count(F.lit(1)).alias("new_domains"))
