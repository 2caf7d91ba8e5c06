"""Training-set jobs.

Sources and sinks are DataFrames or parquet tables; nothing is collected to
the driver.  Deterministic randomness is hash-derived (SHA-256 of a key and a
seed), so results do not depend on partitioning or on task retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope import dictionaries as D
from lurescope.functions.urls import URL_IN_TEXT_RE, URL_TRAIL_RE
from lurescope.operators.dedup import content_key, dedup_first
from lurescope.operators.versioned import SnapshotTable, utc_micros
from lurescope.operators.ranking import first_n_per_group, global_row_number


# ----------------------------------------------------------------- hash uniforms

def hash_uniform(key: Column, seed: int, field: str) -> Column:
    """A uniform number in [0, 1) from SHA-256 of (key, seed, field)."""
    h = F.sha2(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(field)), 256)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_integers(key: Column, seed: int, field: str, lo: int, hi: int) -> Column:
    """Integer in [lo, hi) (numpy ``integers`` convention)."""
    return (F.lit(lo) + F.floor(hash_uniform(key, seed, field) * F.lit(hi - lo))).cast("double")


def hash_range(key: Column, seed: int, field: str, lo: float, hi: float) -> Column:
    return F.lit(lo) + hash_uniform(key, seed, field) * F.lit(hi - lo)


# ----------------------------------------------------------------- S05 labelled text

def read_labelled_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """S05 reader: CSV with header and at least ``text`` and ``label``.  Without
    ``multi_line`` a file is split among tasks and a text ends with its line; with it
    quoted texts may hold line feeds, and each file is one task."""
    df = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    missing = {"text", "label"} - set(df.columns)
    if missing:
        raise ValueError(f"labelled CSV lacks columns: {sorted(missing)}")
    return clean_labelled(df)


def clean_labelled(df: DataFrame) -> DataFrame:
    """Drop rows without text or label, keep stripped length > 10, label as int."""
    d = df.filter(F.col("text").isNotNull() & F.col("label").isNotNull())
    # all white space counts, and a label that is no number is no label
    d = d.filter(F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")) > 10)
    return (d.withColumn("label", F.expr("try_cast(label AS INT)"))
            .filter(F.col("label").isNotNull()))


def labelled_report(df: DataFrame, source: str = "source") -> DataFrame:
    """S05 report: rows and positive share per source and overall, with a
    warning flag when the positive share is outside 20-80 %."""
    per = df.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 1).alias("positives"))
    tot = df.agg(F.lit("__all__").alias("source"), F.count(F.lit(1)).alias("rows"),
                 F.count_if(F.col("label") == 1).alias("positives"))
    out = per.unionByName(tot)
    share = F.col("positives").cast("double") / F.col("rows").cast("double")
    return out.select("source", "rows", "positives", share.alias("positive_share"),
                      ((share > 0.8) | (share < 0.2)).cast("int").alias("imbalance_warning"))


# ----------------------------------------------------------------- S06 rank list

def rank_list(rows: DataFrame, rank_text: str, domain_text: str, order: list) -> DataFrame:
    """(domain, rank) from raw rows; rows without an integer rank or a
    domain are dropped; the LAST row (by ``order``) wins for a domain."""
    r = rows.select(F.expr(f"try_cast({rank_text} AS INT)").alias("rank"),
                    F.lower(F.trim(F.col(domain_text))).alias("domain"), *order)
    r = r.filter(F.col("rank").isNotNull() & F.col("domain").isNotNull() & (F.col("domain") != ""))
    return r.groupBy("domain").agg(F.max_by("rank", F.struct(*order)).alias("rank"))


def load_rank_list(spark: SparkSession, path: str) -> DataFrame:
    """S06 reader: headerless ``rank,domain`` CSV files; file order decides
    which row is last."""
    raw = (spark.read.option("header", False).option("mode", "PERMISSIVE").csv(path)
           .select("_c0", "_c1", F.col("_metadata.file_path").alias("_file"),
                   F.col("_metadata.file_block_start").alias("_block"),
                   F.monotonically_increasing_id().alias("_row")))
    return rank_list(raw, "_c0", "_c1", ["_file", "_block", "_row"])


# ----------------------------------------------------------------- S07 threat feeds

def read_feed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Feed A: one URL per line, '#' comments."""
    t = spark.read.text(path).select(F.trim("value").alias("url"))
    return t.filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def read_feed_csv_url2(spark: SparkSession, path: str) -> DataFrame:
    """Feed B: CSV without header, '#' comments, URL at index 2 (else 0)."""
    t = spark.read.option("comment", "#").option("header", False).csv(path)
    u = F.col("_c2") if "_c2" in t.columns else F.lit(None)
    return t.select(F.trim(F.coalesce(u, F.col("_c0"))).alias("url")).filter(F.col("url") != "")


def read_feed_csv_url1(spark: SparkSession, path: str) -> DataFrame:
    """Feed C: CSV with a header row, URL in the second column."""
    t = spark.read.option("header", True).csv(path)
    return t.select(F.trim(F.col(t.columns[1])).alias("url")).filter(F.col("url") != "")


def threat_feed_union(feeds: DataFrame, suffixes, feed: str = "feed",
                      feed_order: str = "feed_order") -> DataFrame:
    """(url, feed, feed_order) -> distinct registrable domains with the
    sorted list of feeds naming them."""
    from lurescope.functions.urls import normalize_host
    from lurescope.operators.domains import decompose_hosts
    f = feeds.select(normalize_host("url").alias("host"), feed, feed_order)
    dec = decompose_hosts(f.select("host"), suffixes).select("host", "root_domain")
    d = f.join(dec, "host").select(F.col("root_domain").alias("domain"), feed, feed_order)
    return d.groupBy("domain").agg(
        F.array_join(F.array_sort(F.collect_set(feed)), ",").alias("sources"),
        F.min_by(F.col(feed), F.col(feed_order)).alias("first_feed"))


def feed_refresh(spark: SparkSession, path: str, build, max_age_hours: float = D.THREAT_MAX_AGE_HOURS,
                 now=None, force: bool = False) -> DataFrame:
    """Publish a new version of the stored feed table when there is none, when the
    newest is older than ``max_age_hours``, or on demand (``force``).

    A version is a folder of its own (``versioned.SnapshotTable``): whoever reads an
    older one finishes on its files, and ``build`` may read it too.  The age is in the
    manifest, so no table is read to decide.
    """
    feed = SnapshotTable(spark, path)
    loaded = feed.loaded_at()
    stale = force or loaded is None or utc_micros(now) - loaded > max_age_hours * 3_600_000_000
    if stale:
        clock = F.timestamp_micros(F.lit(utc_micros(now)))
        feed.publish(build().drop("loaded_at").withColumn("loaded_at", clock), now)
    return feed.read()


# ----------------------------------------------------------------- S09 / S10 / S11

def conform_schema(df: DataFrame, columns: list, fill=0.0) -> DataFrame:
    """Exactly ``columns`` in that order; missing ones become ``fill``."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in columns])


def one_per_key(df: DataFrame, key: str, order: list | None = None) -> DataFrame:
    """The first row per key in ``order`` (by default of the row's own values); combined
    in the map tasks, so a key that repeats without end is no hot group."""
    row = F.struct(*df.columns)
    # the smallest row is its own order: it is held, sorted and shuffled once
    first = F.min_by(row, F.struct(*order)) if order else F.min(row)
    return df.groupBy(F.col(key).alias("_one")).agg(first.alias("_row")).select("_row.*")


class FeatureStore:
    """Features materialised once per ``email_hash`` in a parquet table;
    adding a batch writes only keys the store has not seen (left anti), one row each
    (the smallest, column by column)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "email_hash"):
        self.spark, self.path, self.key = spark, path, key

    def read(self) -> DataFrame | None:
        from lurescope.session import path_exists
        return self.spark.read.parquet(self.path) if path_exists(self.spark, self.path) else None

    def add(self, batch: DataFrame) -> None:
        cur = self.read()
        new = batch if cur is None else batch.join(cur.select(self.key), self.key, "left_anti")
        one_per_key(new, self.key).select(*batch.columns).write.mode("append").parquet(self.path)


def append_labelled(new: DataFrame, existing: DataFrame, key: str = "email_hash") -> tuple:
    """Unseen rows of ``new``, one per key, conformed to the stored header.

    Returns ``(rows_to_append, report)``; the report is one row with counts
    before, added and after.
    """
    need = {"label", key}
    if not need.issubset(existing.columns):
        raise ValueError("stored dataset lacks label / key columns")
    fresh = new.join(existing.select(key), key, "left_anti")
    fresh = conform_schema(one_per_key(fresh, key), existing.columns)
    before = existing.agg(F.count(F.lit(1)).alias("before"))
    added = fresh.agg(F.count(F.lit(1)).alias("added"))
    report = before.unionByName(added, allowMissingColumns=True).agg(
        F.max("before").alias("before"), F.max("added").alias("added")) \
        .withColumn("after", F.col("before") + F.col("added"))
    return fresh, report


# ----------------------------------------------------------------- S12 corpus assembly

def assemble_corpus(sources: DataFrame, cap: int = 50_000) -> DataFrame:
    """Union of labelled text sources (text, label, source, source_order,
    row_id) -> dedup by text hash (first source wins) -> at most ``cap`` per
    class (hash order, distributed ranking)."""
    kept = dedup_first(sources, content_key("text"),
                       [F.col("source_order"), F.col("row_id")], ["text", "label", "source", "row_id"])
    return first_n_per_group(kept, [F.col("dedup_key"), F.col("source"), F.col("row_id")], cap,
                             ["label"], "_rn").drop("_rn")


# ----------------------------------------------------------------- S13 / M09

def synthesize_structural(seeds: DataFrame, id_col: str = "i", seed: int = 99) -> DataFrame:
    """One synthetic positive per row of ``seeds`` (row index ``i``):
    six variants by ``i % 6`` with fixed flags and hash-seeded uniforms."""
    i = F.col(id_col)
    base = {n: F.lit(0.0) for n in D.FEATURE_NAMES}
    base["any_url_domain_not_in_tranco"] = F.lit(1.0)
    base["auth_completely_absent"] = F.lit(1.0)
    v = i % 6
    acc = hash_integers(i, seed, "acc", 1, 4)

    def pick(name, cases, default):
        out = None
        for variant, expr in cases:
            out = F.when(v == variant, expr) if out is None else out.when(v == variant, expr)
        return (out.otherwise(default) if out is not None else default).alias(name)

    cols = {n: base[n] for n in D.FEATURE_NAMES}
    cols["unknown_domain_action_content"] = F.when(v == 4, F.lit(3.0)).otherwise(acc)
    cols["suspicious_path_keyword_count"] = pick("x", [
        (0, hash_integers(i, seed, "spk0", 2, 5)), (1, hash_integers(i, seed, "spk1", 1, 3)),
        (2, hash_integers(i, seed, "spk2", 2, 6)), (5, hash_integers(i, seed, "spk5", 1, 3))], F.lit(0.0))
    cols["url_count"] = F.when(v == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    cols["has_http_only"] = F.when(v == 0, hash_integers(i, seed, "http0", 0, 2)) \
        .when(v == 5, F.lit(1.0)).otherwise(F.lit(0.0))
    cols["sender_is_newly_registered"] = F.when(v == 1, F.lit(1.0)).otherwise(F.lit(0.0))
    cols["any_url_newly_registered"] = F.when(v == 1, F.lit(1.0)).otherwise(F.lit(0.0))
    cols["path_brand_mismatch"] = F.when(v == 2, F.lit(1.0)).otherwise(F.lit(0.0))
    cols["url_entropy_score"] = F.when(v == 2, hash_range(i, seed, "ent2", 2.5, 4.0)) \
        .when(v == 3, hash_range(i, seed, "ent3", 3.0, 4.5)) \
        .when(v == 5, hash_range(i, seed, "ent5", 2.0, 3.5)).otherwise(F.lit(0.0))
    cols["max_url_length"] = F.when(v == 3, hash_integers(i, seed, "len3", 80, 200)).otherwise(F.lit(0.0))
    cols["min_url_tranco_rank"] = F.when(v == 3, F.lit(float(D.MIN_URL_RANK_DEFAULT))).otherwise(F.lit(0.0))
    cols["suspicious_attachment_name"] = F.when(v == 4, F.lit(1.0)).otherwise(F.lit(0.0))
    cols["sender_domain_age_score"] = F.when(v == 5, hash_range(i, seed, "age5", 0.7, 1.0)).otherwise(F.lit(0.0))
    return seeds.select(i, *[cols[n].alias(n) for n in D.FEATURE_NAMES],
                        hash_range(i, seed, "nlp", 0.02, 0.20).alias(D.TEXT_FEATURE),
                        F.lit(1).alias("label"))


def adversarial_augment(df: DataFrame, key: str, text_col: str, ratio: float = 0.5,
                        seed: int = 42) -> DataFrame:
    """The first ``ratio`` of positives in seeded-hash order, re-emitted
    with both urgency features 0 and a text score U(0.05, 0.25)."""
    pos = df.filter(F.col("label") == 1)
    n = pos.agg(F.floor(F.count(F.lit(1)) * F.lit(ratio))).scalar()
    h = F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))), 256)
    picked = first_n_per_group(pos.withColumn("_h", h), [F.col("_h"), F.col(key)], n, [], "_rn")
    return (picked.drop("_h", "_rn")
            .withColumn("urgency_phrase_count", F.lit(0.0))
            .withColumn("subject_has_urgency", F.lit(0.0))
            .withColumn(text_col, hash_range(F.col(key), seed, "aug", 0.05, 0.25)))


# ----------------------------------------------------------------- A07 / A08 / A09 / A10

def class_balance(df: DataFrame, label: str = "label", source: str = "source") -> DataFrame:
    """Rows per (label, source) with label totals (rollup) and shares;
    verdict 'balanced' when the positive share is within 40-60 %."""
    r = df.rollup(label, source).agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1))).scalar()
    pos_share = df.agg(F.avg((F.col(label) == 1).cast("double"))).scalar()
    verdict = F.when((pos_share >= 0.4) & (pos_share <= 0.6), F.lit("balanced")).otherwise(F.lit("imbalanced"))
    return r.select(label, source, "rows", (F.col("rows").cast("double") / total).alias("share"),
                    verdict.alias("balance"))


def feature_activation(df: DataFrame, features: list = D.FEATURE_NAMES, ok_pct: float = 0.5) -> DataFrame:
    """% of rows with a value > 0 per feature (one aggregation, then
    unpivot to one row per feature)."""
    wide = df.agg(*[(F.avg((F.col(c) > 0).cast("double")) * 100).alias(c) for c in features])
    long = wide.unpivot([], features, "feature", "active_pct")
    return long.withColumn("ok", (F.col("active_pct") > ok_pct).cast("int"))


def extraction_counters(docs: DataFrame, key: Column, source: str = "source",
                        text: str = "text") -> DataFrame:
    """Per source -- seen, duplicates (a later copy of a seen hash),
    failed (no usable text) and extracted rows."""
    failed = F.col(text).isNull() | ~F.col(text).rlike(r"(?U)\S")
    d = docs.withColumn("_k", key).withColumn("_failed", failed)
    first = d.filter(~F.col("_failed")).groupBy("_k").agg(F.min("doc_id").alias("_first"))
    from lurescope.operators.joins import lookup_join
    j = lookup_join(d, first, "_k")
    dup = ~F.col("_failed") & (F.col("doc_id") != F.col("_first"))
    return j.groupBy(source).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(dup).alias("duplicates"),
        F.count_if(F.col("_failed")).alias("failed"),
        F.count_if(~F.col("_failed") & ~dup).alias("extracted"))


# ----------------------------------------------------------------- F39 text-only messages

def text_only_messages(df: DataFrame, text: str = "text", id_col: str = "msg_id") -> tuple:
    """messages (and their URLs) from raw text: subject and sender from
    ``Subject:`` / ``From:`` lines, URLs from the text (unordered set), all
    authentication results ``none``, no HTML.  Returns (messages, urls)."""
    t = F.col(text)
    subject = F.trim(F.regexp_extract(t, r"(?im)^Subject:[ \t]*(.+)$", 1))
    from_field = F.trim(F.regexp_extract(t, r"(?im)^From:[ \t]*(.+)$", 1))
    addr = F.regexp_extract(from_field, r"<([^>]*)>", 1)
    addr = F.when(addr != "", addr).otherwise(from_field)
    name = F.trim(F.regexp_extract(from_field, r"^([^<]*)<", 1))
    msgs = df.select(
        F.col(id_col).alias("msg_id"), name.alias("from_name"), addr.alias("from_addr"),
        F.lit("").alias("reply_to"), subject.alias("subject"),
        t.alias("plain_text"), F.lit("").alias("html_text"),
        F.lit("none").alias("spf_result"), F.lit("none").alias("dkim_result"),
        F.lit("none").alias("dmarc_result"),
        F.sha2(t, 256).alias("email_hash"))
    found = F.regexp_extract_all(t, F.lit(URL_IN_TEXT_RE), 0)
    cleaned = F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, URL_TRAIL_RE, "")))
    urls = df.select(F.col(id_col).alias("msg_id"), F.explode(cleaned).alias("url")) \
        .withColumn("pos", F.lit(0))
    return msgs, urls


def union_feature_sets(text_only: DataFrame, extracted: DataFrame) -> DataFrame:
    """Union of text-only and pre-extracted feature rows by name."""
    return extracted.unionByName(text_only, allowMissingColumns=True)


def number_rows(df: DataFrame, order: list, name: str = "i") -> DataFrame:
    """0-based distributed row index in ``order``."""
    return global_row_number(df, order, name=name).withColumn(name, F.col(name) - 1)
