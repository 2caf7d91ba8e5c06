"""URL and domain operators at distinct-host grain.

Everything here runs on *distinct* hosts or labels: the number of distinct
domains grows far slower than the number of URLs, and distinct-first keeps a
hot domain (one host behind a third of all links) from becoming a hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.functions.urls import (URL_IN_TEXT_RE, URL_TRAIL_RE, address_host,
                                      leet_normalize, normalize_host, primary_part)


def as_list_df(spark: SparkSession, values, column: str, with_pos: bool = False) -> DataFrame:
    """A dictionary argument (list or DataFrame) as a one-column DataFrame."""
    if isinstance(values, DataFrame):
        return values
    if with_pos:
        return spark.createDataFrame([(v, i) for i, v in enumerate(values)],
                                     f"{column} string, pos int")
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


# --------------------------------------------------------------------------
# U01 extract_urls
# --------------------------------------------------------------------------

def extract_urls(messages: DataFrame, text_cols=("plain_text", "html_text"),
                 id_col: str = "msg_id") -> DataFrame:
    """(msg_id, pos, url) -- ordered, de-duplicated URLs of the text."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols])
    found = F.regexp_extract_all(text, F.lit(URL_IN_TEXT_RE), 0)
    cleaned = F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, URL_TRAIL_RE, "")))
    return (messages.select(id_col, F.posexplode(cleaned).alias("pos", "url"))
            .select(id_col, F.col("pos").cast("int").alias("pos"), "url"))


# --------------------------------------------------------------------------
# U03 / U04 / U06 registrable domain, label, suffix, subdomain depth
# --------------------------------------------------------------------------

def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """A public suffix list as published: one rule per line up to the first white space,
    ``//`` comments.  Returns the column ``suffix``."""
    rule = F.lower(F.regexp_extract("value", r"^\s*(\S*)", 1))
    rules = spark.read.text(path).select(rule.alias("suffix"))
    return rules.filter((F.col("suffix") != "") & ~F.col("suffix").startswith("//")).distinct()


def suffix_rules(spark: SparkSession, suffixes) -> DataFrame:
    """``(kind, key)`` of the rules: ``plain`` (``co.uk``), ``wild`` (``*.ck``, any one label
    before ``ck``) and ``except`` (``!www.ck``, not a suffix although a wild rule says so)."""
    if suffixes is None or (not isinstance(suffixes, DataFrame) and not suffixes):
        raise ValueError("a list or table of public suffixes is required")
    rule = F.col("suffix")
    kind = F.when(rule.startswith("*."), "wild").when(rule.startswith("!"), "except").otherwise("plain")
    return as_list_df(spark, suffixes, "suffix").filter(rule.isNotNull()).select(
        kind.alias("_kind"), F.regexp_replace(rule, r"^([*][.]|!)", "").alias("_cand")).distinct()


def decompose_hosts(hosts: DataFrame, suffixes, host_col: str = "host") -> DataFrame:
    """Split each distinct host into sub-domain / label / public suffix.

    Returns ``host, suffix, label, root_domain, subdomain_depth``.  An exception rule
    that fits prevails (the suffix is the rule less its first label), else the longest
    fitting rule; the host itself counts when it is a suffix (then the label is
    empty and the root falls back to the last two labels).  Without any fitting rule the
    root is the last two labels.  Every tail of a host is one candidate, and one
    equi-join with the rules' keys finds all kinds: a tail from label i on is a suffix by a
    plain rule, from label i - 1 on by a wild rule, from i + 1 on by an exception.
    """
    rules = suffix_rules(hosts.sparkSession, suffixes)
    h = (hosts.select(F.col(host_col).alias("host")).filter(F.col("host") != "").distinct()
         .withColumn("_labels", F.split("host", "[.]")))
    n = F.size("_labels")
    cands = F.transform(F.sequence(F.lit(1), n),
                        lambda i: F.struct(i.alias("i"),
                                           F.array_join(F.slice("_labels", i, n - i + 1), ".")
                                           .alias("c")))
    exploded = h.select("host", n.alias("_n"), F.explode(cands).alias("x")) \
        .select("host", "_n", F.col("x.i").alias("_i"), F.col("x.c").alias("_cand"))
    kind, i = F.col("_kind"), F.col("_i")
    matched = exploded.join(rules, "_cand").groupBy("host").agg(
        F.min(F.when((kind == "except") & (i < F.col("_n")), i + 1)).alias("_not"),
        F.min(F.when(kind == "plain", i).when((kind == "wild") & (i > 1), i - 1)).alias("_is"))
    matched = matched.select("host", F.coalesce("_not", "_is").alias("_i"))
    d = h.join(matched, "host", "left")
    labels, i, n = F.col("_labels"), F.col("_i"), F.size("_labels")
    last_two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    suffix = F.when(i.isNotNull(), F.array_join(F.slice(labels, i, n - i + 1), ".")).otherwise("")
    label = (F.when(i == 1, F.lit(""))
             .when(i.isNotNull(), F.element_at(labels, i - 1))
             .otherwise(F.element_at(labels, n)))
    root = (F.when(i == 1, last_two)
            .when(i.isNotNull(), F.concat(F.element_at(labels, i - 1), F.lit("."), suffix))
            .otherwise(last_two))
    depth = (F.when(i == 1, F.lit(0))
             .when(i.isNotNull(), i - 2)
             .otherwise(n - 1))
    return d.select("host", suffix.alias("suffix"), label.alias("label"),
                    root.alias("root_domain"), depth.cast("int").alias("subdomain_depth"))


# --------------------------------------------------------------------------
# U09 brand similarity (theta join as an equi-join on a length band)
# --------------------------------------------------------------------------

def deletion_keys(text: str, most: int):
    """Hashes of the strings that ``most`` deletions or fewer make of a text, each once."""
    level = F.array(F.col(text))
    every = level
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, lambda s: F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: i <= F.length(s)),
            lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))))))
        every = F.concat(every, level)
    return F.transform(F.array_distinct(every), lambda s: F.xxhash64(s))


def brand_matches(labels: DataFrame, brands, max_distance: int, label_col: str = "label",
                  first_in_order: bool = True) -> DataFrame:
    """(label, brand, brand_distance) for labels similar to a brand.

    A label matches a brand when its leet-normalised primary part equals the
    brand, or the primary part has at least 4 characters, the lengths differ
    by at most ``max_distance`` and the edit distance is at most
    ``max_distance``.  With ``first_in_order`` only the first matching brand in
    list order is kept (``min_by`` on its position); otherwise one row per
    label with any match.

    Candidate pairs come from a deletion neighbourhood: two strings within edit distance
    d have a string in common that d deletions or fewer make of each.  Brands and labels
    are expanded to these variants and joined by their hash, so only pairs that share
    one are compared, whatever the number of brands.
    """
    spark = labels.sparkSession
    d = max_distance
    b = as_list_df(spark, brands, "brand", with_pos=True)
    longest = b.agg(F.max(F.length("brand"))).first()[0] or 0
    lab = (labels.select(F.col(label_col).alias("label")).filter(F.col("label").isNotNull())
           .distinct()
           .withColumn("_primary", primary_part("label"))
           .withColumn("_norm", leet_normalize("label"))
           .filter(F.length("_norm") <= longest + d))  # longer ones are too far from any brand
    lab = lab.withColumn("_key", F.explode(deletion_keys("_norm", d)))
    index = b.withColumn("_key", F.explode(deletion_keys("brand", d)))
    pairs = lab.join(index, "_key")
    lev = F.levenshtein(F.col("_norm"), F.col("brand"), d)
    ok = (F.col("_norm") == F.col("brand")) | ((F.length("_primary") >= 4) & (lev >= 0))
    hits = pairs.filter(ok).select("label", "brand", "pos",
                                   F.levenshtein(F.col("_norm"), F.col("brand")).alias("dist"))
    if not first_in_order:
        return hits.groupBy("label").agg(F.min("dist").alias("brand_distance"))
    best = hits.groupBy("label").agg(
        F.min_by(F.struct("brand", "dist"), F.col("pos")).alias("_b"))
    return best.select("label", F.col("_b.brand").alias("brand"),
                       F.col("_b.dist").cast("int").alias("brand_distance"))


# --------------------------------------------------------------------------
# U11 collect_domains
# --------------------------------------------------------------------------

def message_hosts(messages: DataFrame, message_urls: DataFrame) -> DataFrame:
    """Hosts a message refers to: sender, every URL host, reply-to.

    Returns ``msg_id, role, host`` (role in sender / url / reply_to).
    """
    sender = messages.select("msg_id", F.lit("sender").alias("role"),
                             address_host("from_addr").alias("host"))
    reply = messages.select("msg_id", F.lit("reply_to").alias("role"),
                            address_host("reply_to").alias("host"))
    urls = message_urls.select("msg_id", F.lit("url").alias("role"),
                               normalize_host("url").alias("host"))
    return sender.unionByName(urls).unionByName(reply).filter(F.col("host") != "")


def collect_domains(messages: DataFrame, message_urls: DataFrame, suffixes) -> DataFrame:
    """Distinct domains to judge -- hosts plus the roots of sender and URL hosts."""
    mh = message_hosts(messages, message_urls)
    hosts = mh.select("host").distinct()
    roots_of = mh.filter(F.col("role") != "reply_to").select("host").distinct()
    roots = decompose_hosts(roots_of, suffixes).select(F.col("root_domain").alias("host"))
    return hosts.unionByName(roots).filter(F.col("host") != "").distinct() \
        .select(F.col("host").alias("domain"))
