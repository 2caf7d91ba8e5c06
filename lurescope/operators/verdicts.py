"""Reputation joins and the domain verdict.

``domain_verdicts`` is a table job: one row per distinct domain.  Dimension
tables (rank list, threat list, facts) are joined at distinct-domain grain by
plain equi-joins: the optimizer broadcasts by bytes and adaptive execution
splits the partition of a hot root domain.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurescope import dictionaries as D
from lurescope.functions.urls import bool_int, normalize_host, shannon_entropy
from lurescope.operators.domains import brand_matches, decompose_hosts


def _ts(value) -> Column:
    """A timestamp literal from a naive UTC datetime or a string (via text,
    so the driver's local time zone plays no part)."""
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(value)).cast("timestamp")


# --------------------------------------------------------------------------
# V11 domain_age_score
# --------------------------------------------------------------------------

def domain_age_score(age: Column) -> Column:
    return (F.when(age.isNull(), 0.5)
            .when(age < 7, 1.0).when(age < 30, 0.9).when(age < 90, 0.7)
            .when(age < 180, 0.5).when(age < 365, 0.3).when(age < 730, 0.15)
            .otherwise(0.05))


# --------------------------------------------------------------------------
# V03 / J05 as-of lookup of facts with a TTL
# --------------------------------------------------------------------------

def facts_as_of(facts: DataFrame, as_of, ttl_days: int = D.FACTS_TTL_DAYS,
                key: str = "domain", ts: str = "fetched_at") -> DataFrame:
    """Latest fact row per key with ``as_of - ttl < fetched_at <= as_of``.

    ``as_of`` is one instant (a literal; the range filter is pushed to the
    scan).  ``max_by`` is a partial aggregate, so a key with many versions
    is combined map-side.
    """
    as_of_col = as_of if isinstance(as_of, Column) else _ts(as_of)
    lo = as_of_col - F.make_dt_interval(F.lit(ttl_days))
    cols = [c for c in facts.columns if c != key]
    live = facts.filter((F.col(ts) <= as_of_col) & (F.col(ts) > lo))
    latest = live.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(ts)).alias("_f"))
    return latest.select(key, *[F.col(f"_f.{c}").alias(c) for c in cols])


def asof_join(left: DataFrame, facts: DataFrame, left_key: str, left_ts: str,
              ttl_days: int = D.FACTS_TTL_DAYS, right_key: str = "domain",
              right_ts: str = "fetched_at", row_id: str = "msg_id", bucket_hours: int = 6) -> DataFrame:
    """Per left row, the latest fact with ``ts - ttl < fetched_at <= ts``.

    A merge instead of a range join: rows and facts go into one table, are sorted within
    (key, time bucket), and each row takes the last fact before it.  A row without one
    takes what is carried over: the latest of the last facts of the earlier buckets that
    the TTL reaches.  So the work is rows + facts, however long a key's history is, a hot
    key is spread over its buckets, and what is carried are at most TTL / bucket small
    rows per (key, bucket).
    """
    if ttl_days * 24 % bucket_hours:
        raise ValueError("bucket_hours must divide the TTL")
    reach, width = ttl_days * 24 // bucket_hours, bucket_hours * 3_600_000_000
    cols = [c for c in facts.columns if c != right_key]

    def bucket(ts):  # zone-free: both kinds of timestamp compare by their wall clock in UTC
        return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(width))

    rows = left.select(
        F.col(left_key).alias("_k"), F.col(left_ts).alias("_t"), F.col(row_id).alias("_id"), bucket(left_ts).alias("_b"))
    known = facts.filter(F.col(right_key).isNotNull() & F.col(right_ts).isNotNull()).select(
        F.col(right_key).alias("_k"), F.col(right_ts).alias("_t"), F.struct(*cols).alias("_f"), bucket(right_ts).alias("_b"))
    merged = rows.withColumn("_row", F.lit(1)).unionByName(
        known.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("_k", "_b").orderBy("_t", "_row")
    merged = merged.withColumn("_here", F.last("_f", ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("_row = 1")

    last = known.groupBy("_k", "_b").agg(F.max_by("_f", "_t").alias("_f"), F.max("_t").alias("_t"))
    carried = (last.withColumn("_b", F.explode(F.sequence(F.col("_b") + 1, F.col("_b") + F.lit(reach))))
               .groupBy("_k", "_b").agg(F.max_by("_f", "_t").alias("_before")))
    live = F.col(f"_before.{right_ts}") > F.col("_t") - F.make_dt_interval(F.lit(ttl_days))
    best = merged.join(carried, ["_k", "_b"], "left").select(
        "_id", "_k", "_t", F.coalesce("_here", F.when(live, F.col("_before"))).alias("_f"))
    return best.select(F.col("_id").alias(row_id), F.col("_k").alias(left_key), F.col("_t").alias(left_ts),
                       *[F.col(f"_f.{c}").alias(c) for c in cols])


# --------------------------------------------------------------------------
# V07 verdict
# --------------------------------------------------------------------------

def _abused(registrar: Column, abuse_list: list) -> Column:
    low = F.lower(F.coalesce(registrar, F.lit("")))
    out = F.lit(False)
    for r in abuse_list:
        out = out | low.contains(F.lit(r))
    return out


def domain_verdicts(domains: DataFrame, rank: DataFrame, threat: DataFrame,
                    facts: DataFrame | None, as_of, dicts: D.Dictionaries,
                    domain_col: str = "domain") -> DataFrame:
    """One verdict per distinct non-empty domain.

    ``rank`` is ``(domain, rank)``, ``threat`` is ``(domain)``; ``facts`` is a
    fact history ``(domain, fetched_at, age_days, registrar, has_mx,
    reputation_hit)`` keyed by registrable domain; ``as_of`` is the instant of
    the verdict (facts fetched later do not count).
    """
    W = D.VERDICT_WEIGHTS
    dom = (domains.select(normalize_host(domain_col).alias("domain"))
           .filter(F.col("domain") != "").distinct())
    parts = decompose_hosts(dom.select(F.col("domain").alias("host")), dicts.public_suffixes)
    v = parts.withColumnRenamed("host", "domain")

    rank_b = rank.select("domain", "rank")
    rank_d = rank_b.select(F.col("domain"), F.col("rank").alias("_rank_d"))
    rank_r = rank_b.select(F.col("domain").alias("root_domain"), F.col("rank").alias("_rank_r"))
    thr = threat.select("domain").distinct()
    thr_d = thr.select("domain", F.lit(True).alias("_thr_d"))
    thr_r = thr.select(F.col("domain").alias("root_domain"), F.lit(True).alias("_thr_r"))
    v = (v.join(rank_d, "domain", "left").join(rank_r, "root_domain", "left")
         .join(thr_d, "domain", "left").join(thr_r, "root_domain", "left"))

    if facts is not None:
        f = facts_as_of(facts, as_of)
        f = f.select(F.col("domain").alias("root_domain"),
                              F.col("age_days").alias("_age"), F.col("registrar").alias("_reg"),
                              F.col("has_mx").alias("_mx"), F.col("reputation_hit").alias("_rep"),
                              F.lit(True).alias("_has_facts"))
        v = v.join(f, "root_domain", "left")
    else:
        v = v.select("*", F.lit(None).cast("bigint").alias("_age"),
                     F.lit(None).cast("string").alias("_reg"),
                     F.lit(None).cast("boolean").alias("_mx"),
                     F.lit(None).cast("boolean").alias("_rep"),
                     F.lit(None).cast("boolean").alias("_has_facts"))

    # Brand similarity is skipped for ranked roots (they are the real brand).
    brands = brand_matches(v.filter(F.col("_rank_r").isNull()).select("label"),
                           dicts.verdict_brands, D.BRAND_SIMILARITY_MAX_DISTANCE)
    v = v.join(brands.withColumnRenamed("brand", "brand_similarity"), "label", "left")
    v = v.withColumn("brand_similarity",
                     F.when(F.col("_rank_r").isNull(), F.col("brand_similarity")))
    v = v.withColumn("brand_distance",
                     F.when(F.col("_rank_r").isNull(), F.col("brand_distance")))

    rank_c = F.coalesce("_rank_d", "_rank_r")
    legit = rank_c.isNotNull()
    threat_c = ~legit & (F.coalesce("_thr_d", F.lit(False)) | F.coalesce("_thr_r", F.lit(False)))
    net = ~legit & ~threat_c & F.coalesce(F.col("_has_facts"), F.lit(False))
    sb = net & F.coalesce(F.col("_rep"), F.lit(False))
    new = net & F.col("_age").isNotNull() & (F.col("_age") < D.NEW_DOMAIN_AGE_DAYS)
    abused = net & _abused(F.col("_reg"), dicts.abuse_registrars)

    ent = F.round(shannon_entropy("label"), 4)
    v = v.withColumn("entropy_score", ent)
    triggers = [
        ("punycode", F.col("domain").contains("xn--")),
        ("high_entropy", F.col("entropy_score") >= D.HIGH_ENTROPY_THRESHOLD),
        ("deep_subdomain", F.col("subdomain_depth") > D.DEEP_SUBDOMAIN_LEVELS),
        ("high_risk_tld", F.col("suffix").isin(list(dicts.high_risk_tlds))
         if dicts.high_risk_tlds else F.lit(False)),
        ("brand_homoglyph", F.col("brand_similarity").isNotNull()),
        ("no_mx", F.col("_mx") == F.lit(False)),
        ("tranco", legit),
        ("tranco_top1k", legit & (rank_c <= D.TOP_RANK_CUTOFF)),
        ("threat_feed", threat_c),
        ("safe_browsing", sb),
        ("newly_registered", new),
        ("registrar_abuse", abused),
    ]
    total = F.lit(0.0)
    kv = []
    for name, cond in triggers:
        cond = F.coalesce(cond, F.lit(False))
        total = total + F.when(cond, F.lit(W[name])).otherwise(F.lit(0.0))
        kv += [F.lit(name), F.when(cond, F.lit(W[name]))]
    kv += [F.lit("_base"), F.lit(D.CONFIDENCE_BASE)]
    breakdown = F.map_filter(F.create_map(*kv), lambda k, x: x.isNotNull())
    conf = F.round(F.greatest(F.lit(D.CONFIDENCE_MIN),
                              F.least(F.lit(D.CONFIDENCE_MAX), F.lit(D.CONFIDENCE_BASE) + total)), 4)
    tier = (F.when(legit, 1).when(threat_c, 2).when(sb, 3).when(net, 4).otherwise(0))
    return v.select(
        "domain", "root_domain", "label", F.col("suffix").alias("tld"),
        legit.alias("is_legitimate"),
        threat_c.alias("is_known_threat"),
        sb.alias("is_safe_browsing_threat"),
        F.when(net, F.col("_age")).cast("bigint").alias("domain_age_days"),
        new.alias("is_newly_registered"),
        F.when(net, F.coalesce(F.col("_reg"), F.lit(""))).otherwise(F.lit("")).alias("registrar"),
        rank_c.cast("bigint").alias("tranco_rank"),
        tier.cast("int").alias("lookup_tier"),
        F.when(threat_c, F.lit("phishing")).when(sb, F.lit("google_safe_browsing"))
         .otherwise(F.lit("")).alias("threat_type"),
        conf.alias("confidence"),
        "entropy_score",
        "subdomain_depth",
        F.col("domain").contains("xn--").alias("is_punycode"),
        "brand_similarity", "brand_distance",
        F.when(F.col("suffix").isin(list(dicts.high_risk_tlds)), F.lit(W["high_risk_tld"]))
         .otherwise(F.lit(0.0)).alias("tld_risk_score"),
        F.col("_mx").alias("has_mx_record"),
        abused.alias("registrar_is_abused"),
        breakdown.alias("score_breakdown"))


def with_root_legit(verdicts: DataFrame) -> DataFrame:
    """Adds ``root_is_legitimate`` (the verdict of the domain's root)."""
    r = verdicts.select(F.col("domain").alias("root_domain"),
                        F.col("is_legitimate").alias("root_is_legitimate"))
    return verdicts.join(r, "root_domain", "left")


def reputation_stats(rank: DataFrame, threat: DataFrame, facts: DataFrame,
                     now) -> DataFrame:
    """Size and age (hours) of each dimension table, one row per input.

    Long form (a union of three one-row aggregates), so no join is needed.
    """
    now_c = _ts(now)

    def age(c):
        return F.round((F.unix_micros(now_c) - F.unix_micros(F.max(c))) / 3.6e9, 2)

    r = rank.agg(F.lit("rank").alias("input"), F.count(F.lit(1)).alias("rows"),
                 F.countDistinct("domain").alias("domains"),
                 F.lit(None).cast("double").alias("age_hours"))
    t = threat.agg(F.lit("threat").alias("input"), F.count(F.lit(1)).alias("rows"),
                   F.countDistinct("domain").alias("domains"),
                   F.lit(None).cast("double").alias("age_hours"))
    f = facts.agg(F.lit("facts").alias("input"), F.count(F.lit(1)).alias("rows"),
                  F.countDistinct("domain").alias("domains"),
                  age("fetched_at").cast("double").alias("age_hours"))
    return r.unionByName(t).unionByName(f)


def verdict_flags(v: DataFrame) -> DataFrame:
    """The three predicates of a verdict."""
    return v.select("domain",
                    bool_int(F.col("is_legitimate")).alias("is_legitimate"),
                    bool_int(F.col("is_known_threat") | F.col("is_safe_browsing_threat"))
                    .alias("is_threat"),
                    F.col("confidence").alias("phishing_confidence"))
