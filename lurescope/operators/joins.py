"""Lookup joins from a large fact side to a dimension at distinct-key grain.

``lookup_join`` is the one place where the fact side (URLs, messages) meets a
domain-grain table.  It is a plain equi-join: the optimizer broadcasts the
dimension by its size in bytes (at planning or, with adaptive execution, from
the measured shuffle), and splits the partition of a hot key otherwise.

``salted_join`` is for joins whose output stays co-partitioned on the key, where
a hot partition cannot be split at run time: only the given hot keys are
salted and only their few dimension rows are replicated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT_BUCKETS = 32
HOT_SHARE = 0.01


def lookup_join(fact: DataFrame, dim: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``fact`` joined to ``dim`` on ``key`` (``dim`` unique per key)."""
    return fact.join(dim, key, how)


def hot_keys(fact: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold at least ``share`` of the rows: at most 1 / share rows."""
    counts = fact.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = fact.agg(F.count(F.lit(1))).scalar()
    return counts.filter(F.col("_n") >= total * F.lit(share)).select(key)


def salted_join(fact: DataFrame, dim: DataFrame, key: str, row_key: list, how: str = "left",
                buckets: int = SALT_BUCKETS, hot: DataFrame | None = None) -> DataFrame:
    """As ``lookup_join``; rows of hot keys are dealt to ``buckets`` groups by a
    hash of their row key, and only the hot keys' dimension rows are copied."""
    hot = F.broadcast((hot_keys(fact, key) if hot is None else hot)
                      .select(F.col(key).alias("_hot")).distinct())
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in row_key]), F.lit(buckets)).cast("int")
    f = fact.join(hot, fact[key] == F.col("_hot"), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), salt).otherwise(0)).drop("_hot")
    d = dim.join(hot, dim[key] == F.col("_hot"), "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(buckets - 1)))
                           .otherwise(F.array(F.lit(0))))).drop("_hot")
    return f.join(d, [key, "_salt"], how).drop("_salt")
