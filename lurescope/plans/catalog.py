"""Catalog of the SURVEY §2 operators as runnable queries.

Each entry: ``name -> (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql | None)``.
Computed columns carry the same alias on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lurescope import dictionaries as D
from lurescope.functions.urls import (URL_IN_TEXT_RE, bool_int, leet_normalize, normalize_host, primary_part,
                                      shannon_entropy)
from lurescope.operators import domains as DOM
from lurescope.operators import verdicts as VER
from lurescope.plans import oracle as O
from lurescope.plans.jobs import AS_OF, Jobs

CATALOG: dict = {}
_JOBS: dict = {}


def jobs(spark, sf_dir: str, crafted: bool = False) -> Jobs:
    """Jobs per (session, folder, variant); materialized tables are reused."""
    key = (id(spark), sf_dir, crafted)
    if key not in _JOBS:
        _JOBS[key] = Jobs(spark, sf_dir, with_crafted=crafted)
    return _JOBS[key]


def reset():
    _JOBS.clear()


def register(name: str, sql: str | None = None):
    def deco(fn):
        CATALOG[name] = (fn, sql)
        return fn
    return deco


def i(c):
    return bool_int(F.col(c)) if isinstance(c, str) else bool_int(c)


# ---------------------------------------------------------------- U: URLs / domains

# The derived texts hold no URL: the message's own ones are put into them, in
# running text and in mark-up, with the punctuation that follows URLs there.
U01_SQL = O.with_views(["messages", "message_urls"], f"""
SELECT msg_id, CAST(row_number() OVER (PARTITION BY msg_id ORDER BY first_i) - 1 AS INTEGER) AS pos, url
FROM (SELECT msg_id, url, min(i) AS first_i FROM (
        SELECT msg_id, regexp_replace(unnest(l), '[.,;)]+$', '') AS url, unnest(generate_series(1, len(l))) AS i
        FROM (SELECT msg_id, regexp_extract_all(concat_ws(' ',
                       coalesce(plain_text, '') || ' (see ' || coalesce(said, '') || ').',
                       coalesce(html_text, '') || coalesce(marked, '')), {O.q(URL_IN_TEXT_RE)}) AS l
              FROM messages m LEFT JOIN (
                SELECT msg_id AS id, string_agg(url, ', ' ORDER BY pos) AS said,
                       string_agg('<a href="' || url || '">x</a>', '' ORDER BY pos DESC) AS marked
                FROM message_urls GROUP BY msg_id) u ON u.id = m.msg_id) t0) t1
      GROUP BY msg_id, url) t2""")


@register("u01_extract_urls", U01_SQL)
def u01(spark, sf_dir):
    j = jobs(spark, sf_dir)
    listed = j.message_urls.groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("pos", "url"))).alias("l"))
    listed = listed.select("msg_id", F.transform("l", lambda x: x["url"]).alias("l"))
    m = j.messages.join(listed, "msg_id", "left")
    marked = F.transform(F.reverse("l"), lambda u: F.concat(F.lit('<a href="'), u, F.lit('">x</a>')))
    return DOM.extract_urls(m.select(
        "msg_id", F.concat(F.coalesce("plain_text", F.lit("")), F.lit(" (see "),
                           F.coalesce(F.array_join("l", ", "), F.lit("")), F.lit(").")).alias("plain_text"),
        F.concat(F.coalesce("html_text", F.lit("")),
                 F.coalesce(F.array_join(marked, ""), F.lit(""))).alias("html_text")))


@register("u02_normalize_host", O.base_query(
    f"SELECT mu.msg_id, mu.pos, {O.nh('mu.url')} AS host FROM (SELECT msg_id, pos, url FROM message_urls "
    f"UNION ALL SELECT msg_id, pos, url FROM crafted_urls) mu", crafted=True))
def u02(spark, sf_dir):
    j = jobs(spark, sf_dir, crafted=True)
    return j.message_urls.select("msg_id", "pos", normalize_host("url").alias("host"))


def _hosts(j):
    return DOM.message_hosts(j.messages, j.message_urls).select("host").distinct()


def _dec(j):
    return DOM.decompose_hosts(_hosts(j), j.dicts.public_suffixes)


@register("u03_registrable_domain", O.with_views(O.MESSAGE_VIEWS + ["crafted_urls"],
    "SELECT host, suffix, root_domain FROM (" + O.decompose_sql("every", "rules") + ") d",
    O.base_ctes(True) + [("rules", O.dict_sql("rules", "suffix", D.TEST_SUFFIX_RULES)),
                         ("every", "SELECT host FROM mh UNION ALL SELECT unnest(["
                          + ", ".join(O.q(x) for x in D.TEST_SUFFIX_HOSTS) + "])")]))
def u03(spark, sf_dir):
    """U03 with rules of every kind, over the hosts of the views and crafted ones."""
    more = DOM.as_list_df(spark, D.TEST_SUFFIX_HOSTS, "host")
    hosts = _hosts(jobs(spark, sf_dir, crafted=True)).unionByName(more)
    return DOM.decompose_hosts(hosts, D.TEST_SUFFIX_RULES).select("host", "suffix", "root_domain")


@register("u04_domain_label_tld", O.base_query(
    "SELECT host, label, suffix AS tld FROM (" + O.decompose_sql("mh") + ") d", crafted=True))
def u04(spark, sf_dir):
    return _dec(jobs(spark, sf_dir, crafted=True)).select("host", "label", F.col("suffix").alias("tld"))


@register("u05_label_entropy", O.base_query(
    "SELECT label, round(e, 6) AS entropy FROM (" + O.entropy_sql("dec") + ") x", crafted=True))
def u05(spark, sf_dir):
    j = jobs(spark, sf_dir, crafted=True)
    labels = DOM.decompose_hosts(j.domains().select(F.col("domain").alias("host")),
                                 j.dicts.public_suffixes).select("label").filter(F.col("label") != "").distinct()
    return labels.select("label", F.round(shannon_entropy("label"), 6).alias("entropy"))


@register("u06_subdomain_depth", O.base_query(
    "SELECT host, subdomain_depth FROM (" + O.decompose_sql("mh") + ") d", crafted=True))
def u06(spark, sf_dir):
    return _dec(jobs(spark, sf_dir, crafted=True)).select("host", "subdomain_depth")


@register("u07_is_punycode", O.base_query(
    "SELECT DISTINCT host, CAST(strpos(host, 'xn--') > 0 AS INTEGER) AS is_punycode FROM mh", crafted=True))
def u07(spark, sf_dir):
    return _hosts(jobs(spark, sf_dir, crafted=True)).select(
        "host", i(F.col("host").contains("xn--")).alias("is_punycode"))


@register("u08_leet_normalize", O.base_query(
    "SELECT DISTINCT label, regexp_extract(label, '^([^_-]*)', 1) AS primary_part, "
    "translate(regexp_extract(label, '^([^_-]*)', 1), '01345678@!', 'oleasgtbai') AS normalized FROM dec",
    crafted=True))
def u08(spark, sf_dir):
    j = jobs(spark, sf_dir, crafted=True)
    d = DOM.decompose_hosts(j.domains().select(F.col("domain").alias("host")), j.dicts.public_suffixes)
    return d.select("label").distinct().select("label", primary_part("label").alias("primary_part"),
                                                leet_normalize("label").alias("normalized"))


@register("u09_brand_similarity", O.base_query(
    "SELECT * FROM (" + O.brand_sql("dec", "vbrands", D.BRAND_SIMILARITY_MAX_DISTANCE) + ") b", crafted=True))
def u09(spark, sf_dir):
    j = jobs(spark, sf_dir, crafted=True)
    d = DOM.decompose_hosts(j.domains().select(F.col("domain").alias("host")), j.dicts.public_suffixes)
    return DOM.brand_matches(d.select("label"), j.dicts.verdict_brands, D.BRAND_SIMILARITY_MAX_DISTANCE)


@register("u10_tld_risk", O.base_query(
    "SELECT host, CASE WHEN suffix IN (" + ", ".join(O.q(t) for t in D.TEST_HIGH_RISK_TLDS)
    + f") THEN {D.VERDICT_WEIGHTS['high_risk_tld']} ELSE 0.0 END::DOUBLE AS tld_risk_score FROM ("
    + O.decompose_sql("mh") + ") d", crafted=True))
def u10(spark, sf_dir):
    j = jobs(spark, sf_dir, crafted=True)
    return _dec(j).select("host", F.when(F.col("suffix").isin(list(j.dicts.high_risk_tlds)),
                                         F.lit(D.VERDICT_WEIGHTS["high_risk_tld"]))
                          .otherwise(F.lit(0.0)).alias("tld_risk_score"))


@register("u11_collect_domains", O.base_query("SELECT host AS domain FROM doms"))
def u11(spark, sf_dir):
    return jobs(spark, sf_dir).domains()


# ---------------------------------------------------------------- V: verdicts

def _v(spark, sf_dir, crafted=False):
    return jobs(spark, sf_dir, crafted).verdicts()


V07_COLS = ["domain", "root_domain", "label", "tld", "is_legitimate", "is_known_threat",
            "is_safe_browsing_threat", "domain_age_days", "is_newly_registered", "registrar",
            "tranco_rank", "lookup_tier", "threat_type", "confidence", "entropy_score",
            "subdomain_depth", "is_punycode", "brand_similarity", "brand_distance",
            "tld_risk_score", "has_mx_record", "registrar_is_abused"]
_BOOLS = {"is_legitimate", "is_known_threat", "is_safe_browsing_threat", "is_newly_registered",
          "is_punycode", "has_mx_record", "registrar_is_abused"}


def _vsel(cols):
    """Spark projection of verdict columns; booleans as 0/1 (null kept)."""
    out = []
    for c in cols:
        if c in _BOOLS:
            out.append(F.col(c).cast("int").alias(c))
        else:
            out.append(F.col(c))
    return out


def _vsql(cols):
    return ", ".join(f"CAST({c} AS INTEGER) AS {c}" if c in _BOOLS else c for c in cols)


def _verdict_query(name, cols, crafted=False):
    sql = O.verdict_query(f"SELECT {_vsql(cols)} FROM verdicts", crafted)

    def fn(spark, sf_dir):
        return _v(spark, sf_dir, crafted).select(*_vsel(cols))
    register(name, sql)(fn)


_verdict_query("v01_rank_lookup", ["domain", "tranco_rank", "is_legitimate", "lookup_tier"])
_verdict_query("v02_threat_lookup", ["domain", "is_known_threat", "threat_type", "lookup_tier"])
_verdict_query("v03_facts_lookup", ["domain", "domain_age_days", "registrar", "is_newly_registered",
                                    "registrar_is_abused", "is_safe_browsing_threat", "lookup_tier"])
_verdict_query("v04_mx_flag", ["domain", "has_mx_record"])
_verdict_query("v06_heuristic_signals", ["domain", "entropy_score", "subdomain_depth", "is_punycode",
                                         "tld_risk_score", "brand_similarity", "brand_distance"], True)
_verdict_query("v08_lookup_bulk", ["domain", "confidence"])

register("v07_verdict", O.verdict_query(
    f"SELECT {_vsql(V07_COLS)}, breakdown_keys FROM verdicts", True))(
    lambda spark, sf_dir: _v(spark, sf_dir, True).select(
        *_vsel(V07_COLS),
        F.array_join(F.array_sort(F.map_keys("score_breakdown")), ",").alias("breakdown_keys")))

register("v09_predicates", O.verdict_query(
    "SELECT domain, CAST(is_legitimate AS INTEGER) AS is_legitimate, "
    "CAST(is_known_threat OR is_safe_browsing_threat AS INTEGER) AS is_threat, "
    "confidence AS phishing_confidence FROM verdicts"))(
    lambda spark, sf_dir: VER.verdict_flags(_v(spark, sf_dir)))


@register("v05_cert_age_flag", O.verdict_query(
    "SELECT v.domain, CAST(coalesce(f.cert_age_days >= 0 AND f.cert_age_days < 30, false) AS INTEGER) "
    "AS cert_age_flag FROM verdicts v LEFT JOIN domain_facts f ON f.domain = v.root_domain"))
def v05(spark, sf_dir):
    j = jobs(spark, sf_dir)
    f = j.cert_facts().select(F.col("domain").alias("root_domain"), "cert_age_days")
    v = j.verdicts().select("domain", "root_domain").join(f, "root_domain", "left")
    return v.select("domain", i(F.coalesce((F.col("cert_age_days") >= 0) & (F.col("cert_age_days") < 30),
                                           F.lit(False))).alias("cert_age_flag"))


@register("v10_reputation_stats", O.with_views(["domain_rank", "threat_domain", "domain_facts_history"], """
SELECT 'rank' AS input, count(*) AS rows, count(DISTINCT domain) AS domains, CAST(NULL AS DOUBLE) AS age_hours FROM domain_rank
UNION ALL SELECT 'threat', count(*), count(DISTINCT domain), CAST(NULL AS DOUBLE) FROM threat_domain
UNION ALL SELECT 'facts', count(*), count(DISTINCT domain),
       round((epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(max(fetched_at))) / 3.6e9, 2)
FROM domain_facts_history"""))
def v10(spark, sf_dir):
    j = jobs(spark, sf_dir)
    return VER.reputation_stats(j.rank(), j.threat(), j.facts_history(), AS_OF)


@register("v11_domain_age_score", O.with_views(["domain_facts_history"], """
SELECT domain, fetched_at, CASE WHEN age_days IS NULL THEN 0.5 WHEN age_days < 7 THEN 1.0
  WHEN age_days < 30 THEN 0.9 WHEN age_days < 90 THEN 0.7 WHEN age_days < 180 THEN 0.5
  WHEN age_days < 365 THEN 0.3 WHEN age_days < 730 THEN 0.15 ELSE 0.05 END::DOUBLE AS age_score
FROM domain_facts_history"""))
def v11(spark, sf_dir):
    f = jobs(spark, sf_dir).facts_history()
    return f.select("domain", "fetched_at", VER.domain_age_score(F.col("age_days")).alias("age_score"))


@register("j05_asof_facts", O.base_query(f"""
SELECT m.msg_id, d.root_domain AS domain, m.received_ts, max(f.fetched_at) AS fetched_at
FROM messages m
JOIN ({O.decompose_sql('mh')}) d ON d.host = {O.ah('m.from_addr')}
LEFT JOIN domain_facts_history f ON f.domain = d.root_domain AND f.fetched_at <= m.received_ts
     AND f.fetched_at > m.received_ts - INTERVAL 7 DAY
GROUP BY m.msg_id, d.root_domain, m.received_ts"""))
def j05(spark, sf_dir):
    from lurescope.functions.urls import address_host
    j = jobs(spark, sf_dir)
    dec = DOM.decompose_hosts(_hosts(j), j.dicts.public_suffixes).select(
        F.col("host").alias("shost"), F.col("root_domain").alias("domain"))
    m = j.messages.select("msg_id", "received_ts", address_host("from_addr").alias("shost")) \
        .join(dec, "shost", "inner")
    a = VER.asof_join(m, j.facts_history(), "domain", "received_ts")
    return a.select("msg_id", "domain", "received_ts", "fetched_at")


# ---------------------------------------------------------------- F: features

def _feature_query(name, col, crafted=False):
    sql = O.feature_query(f"SELECT msg_id, {col} FROM features", crafted)

    def fn(spark, sf_dir):
        return jobs(spark, sf_dir, crafted).features().select("msg_id", col)
    register(name, sql)(fn)


def _url_query(name, col):
    """URL-rule features over message_urls plus the crafted URL rows."""
    sql = O.feature_query(f"SELECT msg_id, CAST({col} AS DOUBLE) AS {col} FROM uf", crafted=True)

    def fn(spark, sf_dir):
        from lurescope.operators.features import domain_tests, url_features
        j = jobs(spark, sf_dir, crafted=True)
        vt = domain_tests(VER.with_root_legit(j.verdicts()), j.dicts)
        return url_features(j.message_urls, vt, j.dicts).select(
            "msg_id", F.col(col).cast("double").alias(col))
    register(name, sql)(fn)


_FEATURE_IDS = dict(zip(range(1, 38), D.FEATURE_NAMES))
_CRAFTED_URL_RULES = {11: "has_ip_based_url", 15: "url_has_at_symbol", 19: "redirect_depth"}
for _n, _c in _FEATURE_IDS.items():
    if _n in _CRAFTED_URL_RULES:
        _url_query(f"f{_n:02d}_{_c}", _c)
    elif _n != 35:
        _feature_query(f"f{_n:02d}_{_c}", _c)


@register("f35_has_form_in_html", O.with_views(["messages", "crafted_html"], """
SELECT msg_id, CAST(CAST(strpos(lower(coalesce(html_text, '')), '<form') > 0 OR
       regexp_matches(lower(coalesce(html_text, '')), '<input[^>]+type=["'']?(password|text)') AS INTEGER) AS DOUBLE)
       AS has_form_in_html
FROM (SELECT msg_id, html_text FROM messages UNION ALL SELECT msg_id, html_text FROM crafted_html) t"""))
def f35(spark, sf_dir):
    j = jobs(spark, sf_dir)
    h = j.messages.select("msg_id", "html_text").unionByName(j.fx.crafted_html)
    html = F.lower(F.coalesce("html_text", F.lit("")))
    flag = html.contains("<form") | html.rlike(r"<input[^>]+type=[\"']?(password|text)")
    return h.select("msg_id", i(flag).cast("double").alias("has_form_in_html"))


@register("f00_trusted_sender", O.feature_query(
    "SELECT msg_id, CAST(is_trusted AS INTEGER) AS is_trusted FROM mj"))
def f00(spark, sf_dir):
    from lurescope.functions.urls import address_host
    j = jobs(spark, sf_dir)
    v = j.verdicts().select(F.col("domain").alias("shost"), F.col("root_domain").alias("sroot"))
    t = j.trusted()
    m = j.messages.select("msg_id", address_host("from_addr").alias("shost")).join(v, "shost", "left")
    m = m.join(t.select(F.col("domain").alias("shost"), F.lit(True).alias("_a")), "shost", "left")
    m = m.join(t.select(F.col("domain").alias("sroot"), F.lit(True).alias("_b")), "sroot", "left")
    return m.select("msg_id", i(F.coalesce("_a", "_b", F.lit(False))).alias("is_trusted"))


@register("f38_features_all", O.feature_query(
    "SELECT msg_id, " + ", ".join(D.FEATURE_NAMES) + " FROM features"))
def f38(spark, sf_dir):
    return jobs(spark, sf_dir).features()


# ---------------------------------------------------------------- flagship

@register("threat_links_by_sender", O.feature_query("""
SELECT ms.sroot AS sender_domain, CAST(v.confidence AS DOUBLE) AS sender_confidence,
       count(DISTINCT ms.msg_id) AS messages, CAST(sum(t.n_threat) AS BIGINT) AS threat_links
FROM (SELECT m.msg_id, sv.root_domain AS sroot, sv.domain AS shost FROM ms m JOIN verdicts sv ON sv.domain = m.shost) ms
JOIN verdicts v ON v.domain = ms.shost
JOIN (SELECT u.msg_id, count(*) AS n_threat FROM u JOIN verdicts uv ON uv.domain = u.uhost
      WHERE uv.is_known_threat OR uv.is_safe_browsing_threat GROUP BY u.msg_id) t ON t.msg_id = ms.msg_id
GROUP BY ms.sroot, v.confidence"""))
def threat_links_by_sender(spark, sf_dir):
    """Messages linking to a threat domain, by sender domain and the sender
    verdict's confidence."""
    from lurescope.functions.urls import address_host
    j = jobs(spark, sf_dir)
    v = j.verdicts()
    from lurescope.operators.joins import lookup_join
    urls = j.message_urls.select("msg_id", "pos", normalize_host("url").alias("domain"))
    threat_urls = (lookup_join(urls, v.filter(F.col("is_known_threat") | F.col("is_safe_browsing_threat"))
                               .select("domain"), "domain", "left_semi")
                   .groupBy("msg_id").agg(F.count(F.lit(1)).alias("n_threat")))
    s = lookup_join(j.messages.select("msg_id", address_host("from_addr").alias("domain")),
                    v.select("domain", "root_domain", "confidence"), "domain", "inner")
    return (s.join(threat_urls, "msg_id", "inner")
            .groupBy(F.col("root_domain").alias("sender_domain"), F.col("confidence").alias("sender_confidence"))
            .agg(F.count_distinct("msg_id").alias("messages"),
                 F.sum("n_threat").cast("bigint").alias("threat_links")))


# ---------------------------------------------------------------- phrases from a table

@register("f29_phrase_index", O.with_views(["messages"], """
SELECT m.msg_id, count(p.phrase) AS n_phrases
FROM (SELECT msg_id, lower(coalesce(plain_text, '')) AS body FROM messages) m
LEFT JOIN (SELECT DISTINCT phrase FROM (
             SELECT lower(substr(text, CAST(1 + doc_id * 7 % 50 AS BIGINT), CAST(2 + doc_id % 13 AS BIGINT))) AS phrase
             FROM documents) d WHERE phrase <> '') p ON contains(m.body, p.phrase)
GROUP BY m.msg_id"""))
def f29_phrases(spark, sf_dir):
    """Phrase counts of all messages for a phrase table as long as the corpus."""
    from lurescope.operators.phrases import phrase_counts
    j = jobs(spark, sf_dir)
    start, length = 1 + F.col("doc_id") * 7 % 50, 2 + F.col("doc_id") % 13
    phrases = j.fx.t.documents.select(F.lower(F.substring(F.col("text"), start, length)).alias("phrase"))
    body = F.lower(F.coalesce("plain_text", F.lit("")))
    return phrase_counts(j.message_texts().select("msg_id", body.alias("text")), phrases, ["msg_id"])


# ---------------------------------------------------------------- detection log

from lurescope.operators import dedup as DD  # noqa: E402
from lurescope.operators import detections as DET  # noqa: E402

LATEST_SQL = """
latest AS (SELECT email_hash, processed_at, event_id, confidence, is_phishing FROM (
  SELECT *, row_number() OVER (PARTITION BY email_hash ORDER BY processed_at DESC, event_id DESC) AS rn
  FROM detections) t WHERE rn = 1)"""


def _det(spark, sf_dir):
    return jobs(spark, sf_dir).fx.detections


def _latest(spark, sf_dir):
    return DET.latest_versions(_det(spark, sf_dir))


def _with_latest(body):
    return O.with_views(["detections"], body, [("latest", LATEST_SQL.split("AS (", 1)[1].rsplit(")", 1)[0])])


register("w02_latest_version", _with_latest("SELECT * FROM latest"))(_latest)

register("w04_history", _with_latest(
    "SELECT * FROM latest ORDER BY processed_at DESC, event_id DESC LIMIT 100"))(
    lambda spark, sf_dir: DET.history(_latest(spark, sf_dir), 100))

register("w04_history_positives", _with_latest(
    "SELECT * FROM latest WHERE is_phishing ORDER BY processed_at DESC, event_id DESC LIMIT 100"))(
    lambda spark, sf_dir: DET.history(_latest(spark, sf_dir), 100, positives_only=True))

register("w06_recent_positives", _with_latest(
    "SELECT * FROM latest WHERE is_phishing ORDER BY processed_at DESC, event_id DESC LIMIT 10"))(
    lambda spark, sf_dir: DET.history(_latest(spark, sf_dir), 10, positives_only=True))


def _detection_log(spark, sf_dir):
    """The detections as a bucketed log of two parts."""
    import uuid
    from lurescope.session import shared_path
    log = DET.DetectionLog(spark, shared_path(spark, f"detections-{uuid.uuid4().hex[:12]}"))
    d = _det(spark, sf_dir)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    log.append(d.filter(F.col("processed_at") < cut))
    log.append(d.filter(F.col("processed_at") >= cut))
    return log


@register("w05_point_lookup", _with_latest("""
SELECT * FROM latest WHERE email_hash = (
  SELECT arg_min(email_hash, processed_at) FROM detections)"""))
def w05(spark, sf_dir):
    first = _det(spark, sf_dir).agg(F.min_by("email_hash", F.col("processed_at"))).first()[0]
    return _detection_log(spark, sf_dir).lookup(first)


@register("w02_compacted_log", _with_latest("SELECT * FROM latest"))
def w02_compacted(spark, sf_dir):
    """W02 of a log that is compacted between its appends and after them."""
    log = _detection_log(spark, sf_dir)
    log.compact()
    d = _det(spark, sf_dir)
    log.append(d.filter(F.col("event_id") % 2 == 0))  # rows that come again change nothing
    log.append(d.filter(F.col("event_id") % 3 == 0))
    log.compact()
    return log.versions()


register("a01_detection_stats", _with_latest("""
SELECT count(*) AS total_processed, count(*) FILTER (WHERE is_phishing) AS phishing_detected,
       count(*) - count(*) FILTER (WHERE is_phishing) AS legitimate,
       CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE is_phishing) * 100.0 / count(*), 2) ELSE 0.0 END::DOUBLE AS phishing_rate,
       coalesce(round(avg(confidence), 4), 0.0)::DOUBLE AS average_confidence
FROM latest"""))(lambda spark, sf_dir: DET.stats(_latest(spark, sf_dir)))


@register("s14_write_detections", _with_latest("SELECT * FROM latest"))
def s14(spark, sf_dir):
    return _detection_log(spark, sf_dir).latest()


register("j03_unseen_detections", O.with_views(["detections"], """
SELECT b.email_hash, b.event_id FROM detections b
WHERE b.processed_at >= TIMESTAMP '2024-01-05 00:00:00'
  AND NOT EXISTS (SELECT 1 FROM detections s WHERE s.processed_at < TIMESTAMP '2024-01-05 00:00:00'
                  AND s.email_hash = b.email_hash)"""))(
    lambda spark, sf_dir: (lambda d, cut: DET.unseen(
        d.filter(F.col("processed_at") >= cut).select("email_hash", "event_id"),
        d.filter(F.col("processed_at") < cut)))(
        _det(spark, sf_dir), F.lit("2024-01-05 00:00:00").cast("timestamp")))


def _band_sql(p):
    return (f"CASE WHEN {p} >= 0.85 THEN 'critical' WHEN {p} >= 0.65 THEN 'high' "
            f"WHEN {p} >= 0.45 THEN 'medium' WHEN {p} >= 0.25 THEN 'low' ELSE 'safe' END")


register("x06_band_mix", O.with_views(["detections"], f"""
SELECT date_trunc('day', processed_at) AS bucket_start, {_band_sql('confidence')} AS band,
       count(*) AS detections, count(*) FILTER (WHERE is_phishing) AS positives
FROM detections GROUP BY 1, 2"""))(lambda spark, sf_dir: DET.band_mix(_det(spark, sf_dir)))


# ---------------------------------------------------------------- dedup / caps / samples / splits

DOCS_SQL = ("SELECT d.doc_id, d.text, d.source, CAST(coalesce(l.toxic, 0) AS INTEGER) AS label "
            "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")


def _docs(spark, sf_dir):
    t = jobs(spark, sf_dir).fx.t
    lab = t.labels.select("doc_id", "toxic")
    return (t.documents.select("doc_id", "text", "source").join(lab, "doc_id", "left")
            .select("doc_id", "text", "source", F.coalesce("toxic", F.lit(0)).cast("int").alias("label")))


W01_SQL = f"""
SELECT dedup_key, doc_id, label, copies FROM (
  SELECT sha256(text) AS dedup_key, doc_id, label,
         row_number() OVER (PARTITION BY sha256(text) ORDER BY 1 - label, source, doc_id) AS rn,
         count(*) OVER (PARTITION BY sha256(text)) AS copies
  FROM ({DOCS_SQL}) d) t WHERE rn = 1"""


def _w01(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return DD.dedup_first(d, DD.content_key("text"), [1 - F.col("label"), F.col("source"), F.col("doc_id")],
                          ["doc_id", "label"])


register("w01_dedup_content", W01_SQL)(_w01)

register("w03_dedup_keys", """
SELECT doc_id, sha256(text) AS key_full, sha256(encode(text)[1:500]) AS key_bytes500,
       sha256(substr(text, 1, 200)) AS key_chars200 FROM documents""")(
    lambda spark, sf_dir: jobs(spark, sf_dir).fx.t.documents.select(
        "doc_id", DD.content_key("text").alias("key_full"),
        DD.content_key("text", "bytes500").alias("key_bytes500"),
        DD.content_key("text", "chars200").alias("key_chars200")))

W07_CAP = 40


@register("w07_cap_per_class", f"""
WITH u AS ({W01_SQL}),
r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY dedup_key, doc_id) AS rn FROM u),
p AS (SELECT count(*) AS n FROM r WHERE label = 1 AND rn <= {W07_CAP})
SELECT doc_id, label FROM r
WHERE (label = 1 AND rn <= {W07_CAP}) OR (label = 0 AND rn <= least({W07_CAP}, (SELECT n FROM p)))""")
def w07(spark, sf_dir):
    u = _w01(spark, sf_dir)
    return DD.cap_per_class(u, "label", [F.col("dedup_key"), F.col("doc_id")], W07_CAP) \
        .select("doc_id", "label")


register("w08_seeded_sample", """
SELECT doc_id FROM documents ORDER BY sha256(CAST(doc_id AS VARCHAR) || ':42'), doc_id LIMIT 100""")(
    lambda spark, sf_dir: DD.seeded_sample(jobs(spark, sf_dir).fx.t.documents.select("doc_id"),
                                           "doc_id", 100, 42))

register("w09_stratified_split", f"""
SELECT doc_id, label,
       CASE WHEN u < 0.15 THEN 'test' WHEN u < 0.15 + (1 - 0.15) * 0.176 THEN 'val' ELSE 'train' END AS split
FROM (SELECT doc_id, label, ('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 AS u
      FROM ({DOCS_SQL}) d) t""")(
    lambda spark, sf_dir: _docs(spark, sf_dir).select(
        "doc_id", "label", DD.split_column(F.col("doc_id").cast("string")).alias("split")))


@register("j03_unseen_hashes", """
SELECT b.doc_id, sha256(b.text) AS content_key FROM documents b
WHERE b.doc_id >= (SELECT count(*) FROM documents) / 2
  AND NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id < (SELECT count(*) FROM documents) / 2
                  AND sha256(s.text) = sha256(b.text))""")
def j03(spark, sf_dir):
    """Content hashes of a new batch (second half of the documents)
    that the first half has not seen."""
    d = jobs(spark, sf_dir).fx.t.documents.select("doc_id", DD.content_key("text").alias("content_key"))
    half = jobs(spark, sf_dir).fx.t.documents.agg(F.count(F.lit(1)) / 2).scalar()
    return DET.unseen(d.filter(F.col("doc_id") >= half), d.filter(F.col("doc_id") < half), "content_key")


# ---------------------------------------------------------------- scoring, metrics, explanations

from lurescope.operators import explain as EX  # noqa: E402
from lurescope.operators import metrics as MET  # noqa: E402
from lurescope.operators import scoring as SC  # noqa: E402

THRESH = D.DEFAULT_THRESHOLD


def _scored(spark, sf_dir):
    return jobs(spark, sf_dir).scored()


def _labelled(spark, sf_dir):
    return _scored(spark, sf_dir).filter(F.col("label").isNotNull())


register("m01_squish", O.scored_query(f"SELECT msg_id, p_text, {O.squish_sql('p_text')} AS squished FROM scored"))(
    lambda spark, sf_dir: _scored(spark, sf_dir).select("msg_id", "p_text", SC.squish("p_text").alias("squished")))

register("m02_text_weight", O.scored_query(f"SELECT msg_id, {O.weight_sql('p_text')} AS nlp_weight FROM scored"))(
    lambda spark, sf_dir: _scored(spark, sf_dir).select("msg_id", SC.text_weight("p_text").alias("nlp_weight")))

register("m03_blend", O.scored_query("SELECT msg_id, final_prob, p_full AS final_single FROM scored"))(
    lambda spark, sf_dir: _scored(spark, sf_dir).select(
        "msg_id", "final_prob", SC.blend("p_full", "p_struct", "p_text", ensemble=False).alias("final_single")))

register("m04_label", O.scored_query(
    f"SELECT msg_id, CASE WHEN final_prob >= {THRESH} THEN 'PHISHING' ELSE 'LEGITIMATE' END AS label FROM scored"))(
    lambda spark, sf_dir: _scored(spark, sf_dir).select("msg_id", SC.label("final_prob", THRESH).alias("label")))

_ACTIVE_SQL = ("array_to_string(list_sort(list_filter([" + ", ".join(
    f"CASE WHEN {n} <> 0 THEN '{n}' END" for n in D.FEATURE_NAMES) + "], lambda x: x IS NOT NULL)), ',')")

register("m06_score_breakdown", O.scored_query(f"""
SELECT msg_id, round(p_text, 4) AS nlp_prob_raw, round({O.squish_sql('p_text')}, 4) AS nlp_prob_squished,
       round({O.weight_sql('p_text')}, 3) AS nlp_weight, round(p_full, 4) AS prob_full,
       round(p_struct, 4) AS prob_structural, round(final_prob, 4) AS final_prob,
       {O.dbl(THRESH)} AS threshold,
       CASE WHEN final_prob >= {THRESH} THEN 'PHISHING' ELSE 'LEGITIMATE' END AS label,
       {_ACTIVE_SQL} AS active_signals
FROM scored"""))(
    lambda spark, sf_dir: _scored(spark, sf_dir).select(
        "msg_id", *SC.breakdown_columns(),
        F.array_join(F.array_sort(F.map_keys(SC.active_signals(D.FEATURE_NAMES))), ",").alias("active_signals")))

_LAB = "(SELECT * FROM scored WHERE label IS NOT NULL)"
_CM_SQL = f"""
SELECT count(*) FILTER (WHERE final_prob >= {THRESH} AND label = 1) AS tp,
       count(*) FILTER (WHERE final_prob >= {THRESH} AND label <> 1) AS fp,
       count(*) FILTER (WHERE final_prob < {THRESH} AND label <> 1) AS tn,
       count(*) FILTER (WHERE final_prob < {THRESH} AND label = 1) AS fn
FROM {_LAB} t"""


def _d(a, b):
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE {O.dbl(0.0)} END"


_RATES_SQL = f"""
SELECT tp, fp, tn, fn, {_d('tp + tn', 'tp + fp + tn + fn')} AS accuracy,
       {_d('tp', 'tp + fp')} AS precision, {_d('tp', 'tp + fn')} AS recall,
       CASE WHEN {_d('tp', 'tp + fp')} + {_d('tp', 'tp + fn')} > 0
            THEN {O.dbl(2.0)} * {_d('tp', 'tp + fp')} * {_d('tp', 'tp + fn')} / ({_d('tp', 'tp + fp')} + {_d('tp', 'tp + fn')})
            ELSE {O.dbl(0.0)} END AS f1,
       {_d('fp', 'fp + tn')} AS fpr, {_d('fn', 'fn + tp')} AS fnr
FROM cm"""

register("a02_confusion_matrix", O.scored_query(_CM_SQL))(
    lambda spark, sf_dir: MET.confusion(_labelled(spark, sf_dir), "final_prob", "label", THRESH))

register("a03_classification_rates", O.scored_query(_RATES_SQL, [("cm", _CM_SQL)]))(
    lambda spark, sf_dir: MET.rates(MET.confusion(_labelled(spark, sf_dir), "final_prob", "label", THRESH)))


def _auc_sql(src):
    return f"""
SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
       sum(CAST(pos AS DOUBLE) * (neg_below + neg * 0.5)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS auc
FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
      FROM (SELECT CAST(round(final_prob / 1e-6) AS BIGINT) AS s,
                   count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
            FROM {src} t GROUP BY 1) h) h2"""


register("a04_auc", O.scored_query(_auc_sql(_LAB)))(
    lambda spark, sf_dir: MET.auc(_labelled(spark, sf_dir), "final_prob", "label"))


def _grid_sql(src):
    rows = ", ".join(f"({k}, {t})" for k, t in enumerate(MET.threshold_grid()))
    return f"""
SELECT k, threshold, tp, fp, tn, fn, {_d('fp', 'fp + tn')} AS fpr, {_d('fn', 'fn + tp')} AS fnr FROM (
  SELECT g.k, CAST(g.threshold AS DOUBLE) AS threshold,
         count(*) FILTER (WHERE s.final_prob >= g.threshold AND s.label = 1) AS tp,
         count(*) FILTER (WHERE s.final_prob >= g.threshold AND s.label <> 1) AS fp,
         count(*) FILTER (WHERE s.final_prob < g.threshold AND s.label <> 1) AS tn,
         count(*) FILTER (WHERE s.final_prob < g.threshold AND s.label = 1) AS fn
  FROM (SELECT * FROM (VALUES {rows}) AS v(k, threshold)) g, {src} s GROUP BY g.k, g.threshold) c"""


def _choose_sql(grid):
    tg = ", ".join(f"({i}, {t})" for i, t in enumerate(D.THRESHOLD_FPR_TARGETS))
    return f"""
SELECT coalesce(max(threshold), {O.dbl(D.THRESHOLD_FALLBACK)}) AS threshold, coalesce(max(fnr), {O.dbl(1.0)}) AS fnr,
       coalesce(max(fpr), {O.dbl(1.0)}) AS fpr, CAST(max(fpr_target) AS DOUBLE) AS fpr_target FROM (
  SELECT g.threshold, g.fnr, g.fpr, t.fpr_target,
         row_number() OVER (ORDER BY t.ti, g.fnr, g.k) AS rn
  FROM ({grid}) g JOIN (SELECT * FROM (VALUES {tg}) AS v(ti, fpr_target)) t
    ON g.fpr <= t.fpr_target AND g.fnr < 1.0) x WHERE rn = 1"""


register("a05_threshold_search", O.scored_query(_choose_sql(_grid_sql(_LAB))))(
    lambda spark, sf_dir: MET.choose_threshold(MET.threshold_table(_labelled(spark, sf_dir), "final_prob", "label")))

_KNOWN_FAILURE = "src0"
register("a06_group_accuracy", O.scored_query(f"""
SELECT grp, n, correct, {_d('correct', 'n')} AS accuracy FROM (
  SELECT from_name AS grp, count(*) AS n, count(*) FILTER (WHERE (final_prob >= {THRESH}) = (label = 1)) AS correct
  FROM {_LAB} t GROUP BY from_name
  UNION ALL SELECT '__total__', count(*), count(*) FILTER (WHERE (final_prob >= {THRESH}) = (label = 1)) FROM {_LAB} t
  UNION ALL SELECT '__total_without_known_failure__', count(*),
         count(*) FILTER (WHERE (final_prob >= {THRESH}) = (label = 1)) FROM {_LAB} t WHERE from_name <> '{_KNOWN_FAILURE}') u"""))(
    lambda spark, sf_dir: MET.group_accuracy(_labelled(spark, sf_dir), "from_name", "final_prob", "label",
                                             THRESH, _KNOWN_FAILURE))


def _mcc_sql(tp, fp, tn, fn):
    t = [f"CAST({x} AS DOUBLE)" for x in (tp, fp, tn, fn)]
    den = f"sqrt(({t[0]} + {t[1]}) * ({t[0]} + {t[3]}) * ({t[2]} + {t[1]}) * ({t[2]} + {t[3]}))"
    return f"CASE WHEN {den} > 0 THEN ({t[0]} * {t[2]} - {t[1]} * {t[3]}) / {den} ELSE {O.dbl(0.0)} END"


register("a11_paired_test", O.scored_query(f"""
SELECT a_only, b_only,
       CASE WHEN a_only + b_only > 0 THEN pow(abs(CAST(a_only AS DOUBLE) - CAST(b_only AS DOUBLE)) - 1.0, 2)
            / (CAST(a_only AS DOUBLE) + CAST(b_only AS DOUBLE)) ELSE {O.dbl(0.0)} END AS mcnemar_chi2,
       {_mcc_sql('tp_a', 'fp_a', 'tn_a', 'fn_a')} AS mcc_a, {_mcc_sql('tp_b', 'fp_b', 'tn_b', 'fn_b')} AS mcc_b
FROM (SELECT count(*) FILTER (WHERE (pa = y) AND NOT (pb = y)) AS a_only,
             count(*) FILTER (WHERE NOT (pa = y) AND (pb = y)) AS b_only,
             count(*) FILTER (WHERE pa AND y) AS tp_a, count(*) FILTER (WHERE pb AND y) AS tp_b,
             count(*) FILTER (WHERE pa AND NOT y) AS fp_a, count(*) FILTER (WHERE pb AND NOT y) AS fp_b,
             count(*) FILTER (WHERE NOT pa AND NOT y) AS tn_a, count(*) FILTER (WHERE NOT pb AND NOT y) AS tn_b,
             count(*) FILTER (WHERE NOT pa AND y) AS fn_a, count(*) FILTER (WHERE NOT pb AND y) AS fn_b
      FROM (SELECT final_prob >= {THRESH} AS pa, p_text >= 0.5 AS pb, label = 1 AS y FROM {_LAB} t) s) c"""))(
    lambda spark, sf_dir: MET.paired_test(_labelled(spark, sf_dir), F.col("final_prob") >= THRESH,
                                          F.col("p_text") >= 0.5, "label"))

_P_STEPS = " ".join(f"WHEN u < {c!r} THEN {k}" for k, c in enumerate(MET.POISSON1_CDF))
register("a12_metric_interval", O.scored_query(f"""
SELECT 'accuracy' AS metric, (SELECT avg(CAST(ok AS DOUBLE)) FROM r0) AS point,
       quantile_cont(acc, 0.025) AS lo, quantile_cont(acc, 0.975) AS hi
FROM (SELECT b, CAST(sum(w * ok) AS DOUBLE) / sum(w) AS acc FROM (
        SELECT b, ok, CASE {_P_STEPS} ELSE {len(MET.POISSON1_CDF)} END AS w FROM (
          SELECT r0.msg_id, r0.ok, b.b,
                 ('0x' || substr(sha256(CAST(r0.msg_id AS VARCHAR) || ':' || CAST(b.b AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 AS u
          FROM r0, (SELECT unnest(generate_series(1, 100)) AS b) b) x) y GROUP BY b) z""",
    [("r0", f"SELECT msg_id, CAST((final_prob >= {THRESH}) = (label = 1) AS INTEGER) AS ok FROM {_LAB} t")]))(
    lambda spark, sf_dir: MET.bootstrap_accuracy(_labelled(spark, sf_dir), "msg_id",
                                                 F.col("final_prob") >= THRESH, "label", 100))


_METRICS_SQL = """SELECT b, (tp + tn) / (tp + fp + tn + fn) AS accuracy, pr AS precision, rc AS recall,
  CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1,
  CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr, CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END AS fnr,
  auc, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0
       THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM counted) c"""
_METRIC_NAMES = ["accuracy", "precision", "recall", "f1", "fpr", "fnr", "auc", "mcc"]
register("a12_metric_intervals", O.scored_query(
    " UNION ALL ".join(f"SELECT '{m}' AS metric, max({m}) FILTER (b = 0) AS point, "
                       f"quantile_cont({m}, 0.025) FILTER (b > 0) AS lo, quantile_cont({m}, 0.975) FILTER (b > 0) AS hi "
                       "FROM measured" for m in _METRIC_NAMES),
    [("drawn", f"""
SELECT b, CAST(round(final_prob / 1e-4) AS BIGINT) AS s, final_prob >= {THRESH} AS pred, label = 1 AS y,
       CASE WHEN b = 0 THEN 1 ELSE (CASE {_P_STEPS} ELSE {len(MET.POISSON1_CDF)} END) END AS w
FROM (SELECT final_prob, label, g.b,
             ('0x' || substr(sha256(CAST(msg_id AS VARCHAR) || '/' || CAST((g.b - 1) // 8 AS VARCHAR)),
                             CAST(1 + 8 * ((g.b - 1) % 8) AS BIGINT), 8))::BIGINT / 4294967296.0 AS u
      FROM {_LAB} t, (SELECT unnest(generate_series(0, 100)) AS b) g WHERE g.b > 0
      UNION ALL SELECT final_prob, label, 0, 0.5 FROM {_LAB} t) x"""),
     ("ranked", """
SELECT b, s, sum(w) FILTER (y) AS p, sum(w) FILTER (NOT y) AS n FROM drawn GROUP BY b, s"""),
     ("won", """
SELECT b, sum(coalesce(p, 0) * (coalesce(under, 0) + 0.5 * coalesce(n, 0)))::DOUBLE / (sum(p) * sum(n)) AS auc
FROM (SELECT *, sum(n) OVER (PARTITION BY b ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS under
      FROM ranked) r GROUP BY b"""),
     ("counted", """
SELECT d.b, any_value(auc) AS auc, coalesce(sum(w) FILTER (pred AND y), 0)::DOUBLE AS tp,
       coalesce(sum(w) FILTER (pred AND NOT y), 0)::DOUBLE AS fp, coalesce(sum(w) FILTER (NOT pred AND NOT y), 0)::DOUBLE AS tn,
       coalesce(sum(w) FILTER (NOT pred AND y), 0)::DOUBLE AS fn FROM drawn d JOIN won ON won.b = d.b GROUP BY d.b"""),
     ("measured", _METRICS_SQL)]))(
    lambda spark, sf_dir: MET.bootstrap_metrics(_labelled(spark, sf_dir), "msg_id", "final_prob", "label", THRESH))


# X01-X05, S16 --------------------------------------------------------------

def _signals_sql():
    items = [f"CASE WHEN w >= 0.5 THEN printf('{D.LANGUAGE_SIGNAL.replace('{pct}', '%.0f').replace('%', '%%').replace('%%.0f', '%.0f')}', p_text * 100) END"]
    for feature, op, value, text in D.SIGNAL_RULES:
        cond = f"coalesce(CAST({feature} AS DOUBLE), 0.0) {op} {value}"
        if "{n}" in text:
            msg = f"printf({O.q(text.replace('{n}', '%d'))}, CAST({feature} AS INTEGER))"
        else:
            msg = O.q(text)
        items.append(f"CASE WHEN {cond} THEN {msg} END")
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


_PRIO_SQL = "CASE " + " ".join(f"WHEN strpos(lower(s), {O.q(k.lower())}) > 0 THEN {i}"
                                for i, k in enumerate(D.SIGNAL_PRIORITY_KEYWORDS)) + \
    f" ELSE {len(D.SIGNAL_PRIORITY_KEYWORDS)} END"

_SIG_CTES = [
    ("sw", f"SELECT *, final_prob >= {THRESH} AS pred, CASE WHEN final_prob > 0 THEN least(p_text / final_prob, {O.dbl(1.0)}) ELSE {O.dbl(0.5)} END AS w FROM scored"),
    ("sg", f"SELECT *, {_signals_sql()} AS sig FROM sw"),
    ("ks", f"""
SELECT msg_id, string_agg(s, ' | ' ORDER BY p, i) AS key_signals FROM (
  SELECT msg_id, s, i, p, row_number() OVER (PARTITION BY msg_id ORDER BY p, i) AS rn FROM (
    SELECT msg_id, s, i, {_PRIO_SQL} AS p FROM (
      SELECT msg_id, unnest(sig) AS s, unnest(generate_series(1, len(sig))) AS i FROM sg) t0) t1) t2
WHERE rn <= {D.KEY_SIGNALS_MAX} GROUP BY msg_id"""),
]


def _expl_sql():
    pct = "printf('%.1f%%', final_prob * 100)"
    band = _band_sql("final_prob")
    base = "CASE " + " ".join(
        f"WHEN {band} = '{n}' THEN {O.q(t.split('{pct}')[0])} || {pct} || {O.q(t.split('{pct}')[1])}"
        for n, t in D.BAND_SENTENCES.items()) + " END"
    top = f"array_to_string(sig[1:{D.EXPLANATION_SIGNALS_MAX}], '; ')"
    return f"""CASE WHEN NOT pred OR final_prob < 0.25
     THEN 'This email appears legitimate (phishing probability: ' || {pct} || '). No significant threats detected.'
   WHEN {band} = 'safe' THEN 'This email appears legitimate (confidence: ' || {pct} || '). No significant phishing indicators were detected.'
   WHEN len(sig) = 0 THEN CASE WHEN w >= 0.6 THEN {base} || ' The email language closely resembles known phishing messages.'
                               ELSE {base} || ' Multiple weak signals combined to trigger detection.' END
   WHEN w >= 0.7 THEN {base} || ' Flagged primarily based on language patterns. Key indicators: ' || {top} || '.'
   WHEN w <= 0.3 THEN {base} || ' Flagged based on structural red flags. Key indicators: ' || {top} || '. Email language appeared neutral but technical signals suggest phishing.'
   ELSE {base} || ' Both language analysis (' || printf('%.0f', p_text * 100) || '% NLP) and structural signals indicate phishing. Key indicators: ' || {top} || '.' END"""


def _results(spark, sf_dir):
    return EX.detection_results(_scored(spark, sf_dir))


register("x01_risk_band", O.scored_query(f"SELECT msg_id, {_band_sql('final_prob')} AS risk_level FROM scored"))(
    lambda spark, sf_dir: _scored(spark, sf_dir).select("msg_id", DET.risk_band("final_prob").alias("risk_level")))

register("x02_signals", O.scored_query("SELECT msg_id, array_to_string(sig, ' | ') AS signals FROM sg", _SIG_CTES))(
    lambda spark, sf_dir: _scored(spark, sf_dir).select(
        "msg_id", F.array_join(EX.signals("p_text", EX.weight_proxy("p_text", "final_prob")), " | ").alias("signals")))

register("x03_key_signals", O.scored_query(
    "SELECT sg.msg_id, coalesce(ks.key_signals, '') AS key_signals FROM sg LEFT JOIN ks ON ks.msg_id = sg.msg_id",
    _SIG_CTES))(
    lambda spark, sf_dir: _results(spark, sf_dir).select(
        "msg_id", F.array_join("key_signals", " | ").alias("key_signals")))

register("x04_explanation", O.scored_query(f"SELECT msg_id, {_expl_sql()} AS explanation FROM sg", _SIG_CTES))(
    lambda spark, sf_dir: _results(spark, sf_dir).select("msg_id", "explanation"))

_X05_SQL = f"""
SELECT sg.msg_id, sg.from_addr, sg.subject, pred AS is_phishing,
       CASE WHEN pred THEN 'phishing' ELSE 'legitimate' END AS label,
       round(final_prob, 4) AS confidence, round(final_prob * 100, 1) AS risk_score,
       round(p_text, 4) AS nlp_probability, {_band_sql('final_prob')} AS risk_level,
       coalesce(ks.key_signals, '') AS key_signals, {_expl_sql()} AS explanation
FROM sg LEFT JOIN ks ON ks.msg_id = sg.msg_id"""

register("x05_detection_result", O.scored_query(
    "SELECT msg_id, CAST(is_phishing AS INTEGER) AS is_phishing, label, confidence, risk_score, nlp_probability, "
    "risk_level, key_signals, explanation FROM x5", _SIG_CTES + [("x5", _X05_SQL)]))(
    lambda spark, sf_dir: _results(spark, sf_dir).select(
        "msg_id", F.col("is_phishing").cast("int").alias("is_phishing"), "label", "confidence", "risk_score",
        "nlp_probability", "risk_level", F.array_join("key_signals", " | ").alias("key_signals"), "explanation"))

ALERT_ADDRESS = "u1@"
register("s16_alert_sink", O.scored_query(
    f"SELECT msg_id, from_addr AS sender, substr(coalesce(subject, ''), 1, 60) AS subject, confidence, risk_score, "
    f"risk_level, key_signals AS signals, explanation FROM x5 WHERE is_phishing "
    f"AND strpos(lower(coalesce(from_addr, '')), {O.q(ALERT_ADDRESS)}) = 0", _SIG_CTES + [("x5", _X05_SQL)]))(
    lambda spark, sf_dir: EX.alerts(_results(spark, sf_dir), ALERT_ADDRESS))


# ---------------------------------------------------------------- training-set jobs

from lurescope.operators import datasets as DS  # noqa: E402


def _labelled_docs(spark, sf_dir):
    t = jobs(spark, sf_dir).fx.t
    return (t.documents.join(t.labels, "doc_id")
            .select("doc_id", "text", F.col("toxic").alias("label"), "source"))


register("s05_labelled_report", """
WITH c AS (SELECT d.text, CAST(l.toxic AS INTEGER) AS label, d.source FROM documents d JOIN labels l ON l.doc_id = d.doc_id
           WHERE d.text IS NOT NULL AND l.toxic IS NOT NULL AND length(trim(d.text)) > 10),
r AS (SELECT source, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positives FROM c GROUP BY source
      UNION ALL SELECT '__all__', count(*), count(*) FILTER (WHERE label = 1) FROM c)
SELECT source, rows, positives, CAST(positives AS DOUBLE) / CAST(rows AS DOUBLE) AS positive_share,
       CAST(CAST(positives AS DOUBLE) / CAST(rows AS DOUBLE) > 0.8 OR CAST(positives AS DOUBLE) / CAST(rows AS DOUBLE) < 0.2 AS INTEGER) AS imbalance_warning
FROM r""")(lambda spark, sf_dir: DS.labelled_report(DS.clean_labelled(_labelled_docs(spark, sf_dir))))

_RANK_ROWS_SQL = """
SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'n/a' ELSE ' ' || CAST(page_id % 40 AS VARCHAR) END AS rank_text,
       upper(host) || ' ' AS domain_text FROM hosts"""


def _rank_rows(spark, sf_dir):
    h = jobs(spark, sf_dir).fx.hosts
    return h.select("page_id",
                    F.when(F.col("page_id") % 13 == 0, F.lit("n/a"))
                    .otherwise(F.concat(F.lit(" "), (F.col("page_id") % 40).cast("string"))).alias("rank_text"),
                    F.concat(F.upper("host"), F.lit(" ")).alias("domain_text"))


register("s06_rank_list", O.with_views(["hosts"], """
SELECT lower(trim(domain_text)) AS domain, arg_max(TRY_CAST(trim(rank_text) AS INTEGER), page_id) AS rank
FROM rr WHERE TRY_CAST(trim(rank_text) AS INTEGER) IS NOT NULL AND lower(trim(domain_text)) <> ''
GROUP BY 1""", [("rr", _RANK_ROWS_SQL)]))(
    lambda spark, sf_dir: DS.rank_list(_rank_rows(spark, sf_dir), "rank_text", "domain_text", ["page_id"]))

_FEEDS_SQL = """
SELECT url, 'a' AS feed, 0 AS feed_order FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT url, 'b', 1 FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT url, 'c', 2 FROM pages WHERE page_id % 5 = 0"""


def _feeds(spark, sf_dir):
    p = jobs(spark, sf_dir).fx.t.pages.select("page_id", "url")
    parts = [p.filter(F.col("page_id") % m == 0).select("url", F.lit(n).alias("feed"), F.lit(o).alias("feed_order"))
             for n, o, m in (("a", 0, 2), ("b", 1, 3), ("c", 2, 5))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FEED_CTES = [("psl", O.dict_sql("psl", "suffix", D.TEST_PUBLIC_SUFFIXES)), ("feeds", _FEEDS_SQL),
              ("fh", f"SELECT {O.nh('url')} AS host, feed, feed_order FROM feeds"),
              ("fdec", O.decompose_sql("fh")),
              ("fd", "SELECT d.root_domain AS domain, f.feed, f.feed_order FROM fh f JOIN fdec d ON d.host = f.host")]
_S07_SQL = O.with_views([], """
SELECT domain, array_to_string(list_sort(list_distinct(list(feed))), ',') AS sources, arg_min(feed, feed_order) AS first_feed
FROM fd GROUP BY domain""", _FEED_CTES)

register("s07_threat_feeds", _S07_SQL)(
    lambda spark, sf_dir: DS.threat_feed_union(_feeds(spark, sf_dir), D.TEST_PUBLIC_SUFFIXES))

register("w12_feed_union", O.with_views([], """
SELECT feed, count(*) AS new_domains FROM (SELECT domain, arg_min(feed, feed_order) AS feed FROM fd GROUP BY domain) t
GROUP BY feed""", _FEED_CTES))(
    lambda spark, sf_dir: DD.feed_union(
        DS.threat_feed_union(_feeds(spark, sf_dir), D.TEST_PUBLIC_SUFFIXES)
        .select("domain", F.col("first_feed").alias("feed"), F.lit(0).alias("feed_order"))))


@register("s08_feed_refresh", O.with_views([], "SELECT domain, sources FROM (" + _S07_SQL.split("\nSELECT", 1)[0]
                                           + "\nSELECT" + _S07_SQL.split("\nSELECT", 1)[1] + ") s", []))
def s08(spark, sf_dir):
    import uuid
    from lurescope.session import shared_path
    path = shared_path(spark, f"threat_feed-{uuid.uuid4().hex[:12]}")
    t = DS.feed_refresh(spark, path, lambda: DS.threat_feed_union(_feeds(spark, sf_dir), D.TEST_PUBLIC_SUFFIXES))
    return t.select("domain", "sources")


@register("s08_feed_versions", O.with_views([], """
SELECT 0 AS version, domain, sources FROM (
  SELECT domain, array_to_string(list_sort(list_distinct(list(feed))), ',') AS sources
  FROM fd WHERE feed <> 'c' GROUP BY domain) a
UNION ALL
SELECT 1 AS version, domain, array_to_string(list_sort(list_distinct(list(feed))), ',') AS sources FROM fd GROUP BY domain
UNION ALL
SELECT 2 AS version, domain, 'kept' AS sources FROM fd GROUP BY domain""", _FEED_CTES))
def s08_versions(spark, sf_dir):
    """Two forced refreshes in a row, the second one built from the version before it;
    the readers opened before each are read last."""
    import uuid
    from lurescope.operators.versioned import SnapshotTable
    from lurescope.session import shared_path
    path = shared_path(spark, f"threat_feed-{uuid.uuid4().hex[:12]}")
    feeds = _feeds(spark, sf_dir)
    feed = SnapshotTable(spark, path)
    opened = [DS.feed_refresh(spark, path, lambda: DS.threat_feed_union(x, D.TEST_PUBLIC_SUFFIXES), force=True)
              for x in (feeds.filter("feed <> 'c'"), feeds)]
    opened.append(DS.feed_refresh(spark, path, lambda: feed.read().withColumn("sources", F.lit("kept")), force=True))
    parts = [df.select(F.lit(v).alias("version"), "domain", "sources") for v, df in enumerate(opened)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FEATS = ", ".join(D.FEATURE_NAMES)


def _store(spark, sf_dir):
    import uuid
    from lurescope.session import shared_path
    j = jobs(spark, sf_dir)
    f = j.feature_table().join(j.messages.select("msg_id", "received_ts"), "msg_id") \
        .withColumn("email_hash", F.sha2(F.col("msg_id").cast("string"), 256))
    store = DS.FeatureStore(spark, shared_path(spark, f"feature_store-{uuid.uuid4().hex[:12]}"))
    store.add(f.filter(F.col("received_ts") < F.lit("2024-01-16").cast("timestamp")))
    return store, f


@register("s09_feature_store", O.feature_query(
    f"SELECT msg_id, sha256(CAST(msg_id AS VARCHAR)) AS email_hash, {_FEATS} FROM features"))
def s09(spark, sf_dir):
    store, f = _store(spark, sf_dir)
    store.add(f.unionByName(f))  # a key that stands twice in a batch is stored once
    return store.read().select("msg_id", "email_hash", *D.FEATURE_NAMES)


_URL_GROUP = D.FEATURE_NAMES[5:19]
register("s10_conform_schema", O.feature_query(
    "SELECT msg_id, " + ", ".join(f"{O.dbl(0.0)} AS {n}" if n in _URL_GROUP else n for n in D.FEATURE_NAMES)
    + " FROM features"))(
    lambda spark, sf_dir: DS.conform_schema(
        jobs(spark, sf_dir).feature_table().drop(*_URL_GROUP), ["msg_id"] + D.FEATURE_NAMES))


@register("s11_append_labelled", O.with_views(["messages"], """
SELECT count(*) FILTER (WHERE received_ts < TIMESTAMP '2024-01-16 00:00:00') AS before,
       count(*) FILTER (WHERE received_ts >= TIMESTAMP '2024-01-16 00:00:00') AS added,
       count(*) AS after FROM messages"""))
def s11(spark, sf_dir):
    store, f = _store(spark, sf_dir)
    existing = store.read()
    _rows, report = DS.append_labelled(f.unionByName(f), existing)  # a key that stands twice is added once
    return report


_CORPUS_SQL = """
SELECT d.text, CAST(l.toxic AS INTEGER) AS label, 'documents' AS source, 0 AS source_order, d.doc_id AS row_id
FROM documents d JOIN labels l ON l.doc_id = d.doc_id
UNION ALL SELECT text, 0, 'conversations', 1, conv_id * 1000 + turn FROM conversations
UNION ALL SELECT text, 0, 'benchmark', 2, item_id FROM benchmark"""


def _corpus_sources(spark, sf_dir):
    t = jobs(spark, sf_dir).fx.t
    a = t.documents.join(t.labels, "doc_id").select(
        "text", F.col("toxic").cast("int").alias("label"), F.lit("documents").alias("source"),
        F.lit(0).alias("source_order"), F.col("doc_id").alias("row_id"))
    b = t.conversations.select("text", F.lit(0).alias("label"), F.lit("conversations").alias("source"),
                               F.lit(1).alias("source_order"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"))
    c = t.benchmark.select("text", F.lit(0).alias("label"), F.lit("benchmark").alias("source"),
                           F.lit(2).alias("source_order"), F.col("item_id").alias("row_id"))
    return a.unionByName(b).unionByName(c)


register("s12_assemble_corpus", f"""
WITH src AS ({_CORPUS_SQL}),
k AS (SELECT * FROM (SELECT sha256(text) AS dedup_key, label, source, row_id,
        row_number() OVER (PARTITION BY sha256(text) ORDER BY source_order, row_id) AS rn FROM src) t WHERE rn = 1)
SELECT dedup_key, label, source, row_id FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY dedup_key, source, row_id) AS rn2 FROM k) t2
WHERE rn2 <= 50000""")(
    lambda spark, sf_dir: DS.assemble_corpus(_corpus_sources(spark, sf_dir)).select(
        "dedup_key", "label", "source", "row_id"))


def _u_sql(key, seed, field):
    return (f"(('0x' || substr(sha256(concat_ws(':', CAST({key} AS VARCHAR), '{seed}', '{field}')), 1, 8))::BIGINT"
            f" / 4294967296.0)")


def _int_sql(key, seed, field, lo, hi):
    return f"CAST({lo} + floor({_u_sql(key, seed, field)} * {hi - lo}) AS DOUBLE)"


def _rng_sql(key, seed, field, lo, hi):
    return f"({O.dbl(repr(lo))} + {_u_sql(key, seed, field)} * {O.dbl(repr(hi - lo))})"


def _s13_sql():
    s, i = 99, "i"
    cols = {n: O.dbl(0.0) for n in D.FEATURE_NAMES}
    v = f"({i} % 6)"
    cols["any_url_domain_not_in_tranco"] = O.dbl(1.0)
    cols["auth_completely_absent"] = O.dbl(1.0)
    cols["unknown_domain_action_content"] = f"CASE WHEN {v} = 4 THEN {O.dbl(3.0)} ELSE {_int_sql(i, s, 'acc', 1, 4)} END"
    cols["suspicious_path_keyword_count"] = (
        f"CASE WHEN {v} = 0 THEN {_int_sql(i, s, 'spk0', 2, 5)} WHEN {v} = 1 THEN {_int_sql(i, s, 'spk1', 1, 3)} "
        f"WHEN {v} = 2 THEN {_int_sql(i, s, 'spk2', 2, 6)} WHEN {v} = 5 THEN {_int_sql(i, s, 'spk5', 1, 3)} ELSE {O.dbl(0.0)} END")
    cols["url_count"] = f"CASE WHEN {v} = 0 THEN {O.dbl(1.0)} ELSE {O.dbl(0.0)} END"
    cols["has_http_only"] = (f"CASE WHEN {v} = 0 THEN {_int_sql(i, s, 'http0', 0, 2)} WHEN {v} = 5 THEN {O.dbl(1.0)} "
                             f"ELSE {O.dbl(0.0)} END")
    for n in ("sender_is_newly_registered", "any_url_newly_registered"):
        cols[n] = f"CASE WHEN {v} = 1 THEN {O.dbl(1.0)} ELSE {O.dbl(0.0)} END"
    cols["path_brand_mismatch"] = f"CASE WHEN {v} = 2 THEN {O.dbl(1.0)} ELSE {O.dbl(0.0)} END"
    cols["url_entropy_score"] = (f"CASE WHEN {v} = 2 THEN {_rng_sql(i, s, 'ent2', 2.5, 4.0)} "
                                 f"WHEN {v} = 3 THEN {_rng_sql(i, s, 'ent3', 3.0, 4.5)} "
                                 f"WHEN {v} = 5 THEN {_rng_sql(i, s, 'ent5', 2.0, 3.5)} ELSE {O.dbl(0.0)} END")
    cols["max_url_length"] = f"CASE WHEN {v} = 3 THEN {_int_sql(i, s, 'len3', 80, 200)} ELSE {O.dbl(0.0)} END"
    cols["min_url_tranco_rank"] = f"CASE WHEN {v} = 3 THEN {O.dbl(float(D.MIN_URL_RANK_DEFAULT))} ELSE {O.dbl(0.0)} END"
    cols["suspicious_attachment_name"] = f"CASE WHEN {v} = 4 THEN {O.dbl(1.0)} ELSE {O.dbl(0.0)} END"
    cols["sender_domain_age_score"] = f"CASE WHEN {v} = 5 THEN {_rng_sql(i, s, 'age5', 0.7, 1.0)} ELSE {O.dbl(0.0)} END"
    body = ", ".join(f"{cols[n]} AS {n}" for n in D.FEATURE_NAMES)
    return O.feature_query(
        f"SELECT {i}, {body}, {_rng_sql(i, s, 'nlp', 0.02, 0.20)} AS {D.TEXT_FEATURE}, 1 AS label "
        f"FROM (SELECT row_number() OVER (ORDER BY msg_id) - 1 AS i FROM features WHERE label = 1) t")


@register("s13_synthesize_structural", _s13_sql())
def s13(spark, sf_dir):
    pos = jobs(spark, sf_dir).feature_table().filter(F.col("label") == 1).select("msg_id")
    seeds = DS.number_rows(pos, [F.col("msg_id")], "i").select("i")
    return DS.synthesize_structural(seeds, "i", 99)


register("m09_adversarial_augment", O.scored_query(f"""
SELECT msg_id, {O.dbl(0.0)} AS urgency_phrase_count, {O.dbl(0.0)} AS subject_has_urgency,
       {_rng_sql('msg_id', 42, 'aug', 0.05, 0.25)} AS p_text
FROM (SELECT msg_id, row_number() OVER (ORDER BY sha256(CAST(msg_id AS VARCHAR) || ':42'), msg_id) AS rn
      FROM scored WHERE label = 1) t
WHERE rn <= (SELECT floor(count(*) * 0.5) FROM scored WHERE label = 1)"""))(
    lambda spark, sf_dir: DS.adversarial_augment(_scored(spark, sf_dir), "msg_id", "p_text")
    .select("msg_id", "urgency_phrase_count", "subject_has_urgency", "p_text"))


def _dataset(spark, sf_dir):
    j = jobs(spark, sf_dir)
    return j.feature_table().filter(F.col("label").isNotNull()).join(
        j.messages.select("msg_id", F.col("from_name").alias("source")), "msg_id")


_A07_SQL = O.feature_query("""
SELECT label, source, count(*) AS rows,
       CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM ds) AS share,
       CASE WHEN (SELECT avg(CAST(label = 1 AS DOUBLE)) FROM ds) BETWEEN 0.4 AND 0.6 THEN 'balanced' ELSE 'imbalanced' END AS balance
FROM ds GROUP BY ROLLUP (label, source)""")
_A07_SQL = _A07_SQL.replace("\nSELECT label, source, count(*) AS rows",
                            ",\nds AS (SELECT f.label, m.from_name AS source FROM features f JOIN messages m "
                            "ON m.msg_id = f.msg_id WHERE f.label IS NOT NULL)\nSELECT label, source, count(*) AS rows", 1)

register("a07_class_balance", _A07_SQL)(lambda spark, sf_dir: DS.class_balance(_dataset(spark, sf_dir)))


@register("s15_write_dataset", _A07_SQL)
def s15(spark, sf_dir):
    import uuid
    from lurescope.session import shared_path
    path = shared_path(spark, f"dataset-{uuid.uuid4().hex[:12]}")
    _dataset(spark, sf_dir).write.mode("overwrite").parquet(path)
    return DS.class_balance(spark.read.parquet(path))


register("a08_feature_activation", O.feature_query(" UNION ALL ".join(
    f"SELECT '{n}' AS feature, avg(CAST({n} > 0 AS DOUBLE)) * 100 AS active_pct, "
    f"CAST(avg(CAST({n} > 0 AS DOUBLE)) * 100 > 0.5 AS INTEGER) AS ok FROM features" for n in D.FEATURE_NAMES)))(
    lambda spark, sf_dir: DS.feature_activation(jobs(spark, sf_dir).feature_table()))

register("a09_extraction_counters", """
WITH d AS (SELECT doc_id, source, text, text IS NULL OR length(trim(text)) = 0 AS failed, sha256(text) AS k FROM documents),
f AS (SELECT k, min(doc_id) AS first FROM d WHERE NOT failed GROUP BY k)
SELECT source, count(*) AS seen, count(*) FILTER (WHERE NOT failed AND doc_id <> first) AS duplicates,
       count(*) FILTER (WHERE failed) AS failed,
       count(*) FILTER (WHERE NOT failed AND NOT (doc_id <> first)) AS extracted
FROM d LEFT JOIN f ON f.k = d.k GROUP BY source""")(
    lambda spark, sf_dir: DS.extraction_counters(
        jobs(spark, sf_dir).fx.t.documents.select("doc_id", "source", "text"), DD.content_key("text")))

register("a10_active_signals", O.feature_query(
    f"SELECT msg_id, {_ACTIVE_SQL} AS active_signals, "
    f"({' + '.join(f'CAST({n} <> 0 AS INTEGER)' for n in D.FEATURE_NAMES)}) AS n_active FROM features"))(
    lambda spark, sf_dir: jobs(spark, sf_dir).feature_table().select(
        "msg_id", F.array_join(F.array_sort(F.map_keys(SC.active_signals(D.FEATURE_NAMES))), ",").alias("active_signals"),
        F.size(F.map_keys(SC.active_signals(D.FEATURE_NAMES))).alias("n_active")))

_RAW_TEXT_SQL = ("SELECT msg_id, 'Subject: ' || subject || chr(10) || 'From: ' || from_name || ' <' || from_addr || '>' "
                 "|| chr(10) || chr(10) || plain_text AS text FROM messages")


def _raw_text(spark, sf_dir):
    m = jobs(spark, sf_dir).messages
    return m.select("msg_id", F.concat(F.lit("Subject: "), "subject", F.lit("\nFrom: "), "from_name", F.lit(" <"),
                                       "from_addr", F.lit(">\n\n"), "plain_text").alias("text"))


register("f39_text_only_messages", O.with_views(["messages"], """
SELECT msg_id, trim(regexp_extract(text, '(?im)^From:[ \t]*(.+)$', 1)) AS from_field,
       trim(regexp_extract(text, '(?im)^Subject:[ \t]*(.+)$', 1)) AS subject,
       sha256(text) AS email_hash, 'none' AS spf_result, '' AS html_text
FROM rt""", [("rt", _RAW_TEXT_SQL)]))(
    lambda spark, sf_dir: (lambda m: m.select(
        "msg_id", F.concat_ws(" ", F.concat(F.col("from_name"), F.lit(" <"), F.col("from_addr"), F.lit(">")))
        .alias("from_field"), "subject", "email_hash", "spf_result", "html_text"))(
        DS.text_only_messages(_raw_text(spark, sf_dir))[0]))

register("w11_union_feature_sets", O.feature_query("""
SELECT msg_id, 'extracted' AS origin, auth_completely_absent, url_count FROM features
UNION ALL SELECT msg_id, 'text_only', CAST(1.0 AS DOUBLE), NULL FROM messages"""))(
    lambda spark, sf_dir: DS.union_feature_sets(
        DS.text_only_messages(_raw_text(spark, sf_dir))[0].select(
            "msg_id", F.lit("text_only").alias("origin"),
            F.when((F.col("spf_result") == "none") & (F.col("dkim_result") == "none") & (F.col("dmarc_result") == "none"),
                   F.lit(1.0)).otherwise(F.lit(0.0)).alias("auth_completely_absent")),
        jobs(spark, sf_dir).feature_table().select("msg_id", F.lit("extracted").alias("origin"),
                                                   "auth_completely_absent", "url_count")))


# ---------------------------------------------------------------- models (MLlib)

from lurescope.operators import models as ML  # noqa: E402


register("m07_text_score")(lambda spark, sf_dir: jobs(spark, sf_dir).text_scores())


@register("m08_train_dual")
def m08(spark, sf_dir):
    j = jobs(spark, sf_dir)
    test = j.model_frame().filter(F.col("split") == "test")
    return ML.score_table(test, j.models()).select("msg_id", "label", "p_text", "p_full", "p_struct", "final_prob")


@register("m05_score_table")
def m05(spark, sf_dir):
    j = jobs(spark, sf_dir)
    f = j.feature_table().join(j.text_scores(), "msg_id")
    return ML.score_table(f, j.models()).select(
        "msg_id", "p_text", "p_full", "p_struct", "final_prob",
        SC.label("final_prob", THRESH).alias("label_pred"))


@register("m10_assemble_features")
def m10(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    j = jobs(spark, sf_dir)
    f = ML.with_text_feature(j.feature_table().drop("url_count").join(j.text_scores(), "msg_id"))
    v = ML.assemble(ML.assemble(f, ML.FULL_FEATURES, "v_full"), ML.STRUCT_FEATURES, "v_struct")
    return v.select("msg_id", F.size(vector_to_array("v_full")).alias("n_full"),
                    F.size(vector_to_array("v_struct")).alias("n_struct"),
                    vector_to_array("v_full")[len(ML.FULL_FEATURES) - 1].alias("squished_text"))


@register("m11_save_load")
def m11(spark, sf_dir):
    import uuid
    from lurescope.session import shared_path
    j = jobs(spark, sf_dir)
    path = shared_path(spark, f"models-{uuid.uuid4().hex[:12]}")
    ML.save_models(spark, j.models(), path, THRESH)
    loaded = ML.load_models(spark, path)
    test = j.model_frame().filter(F.col("split") == "test")
    a = ML.score_table(test, j.models()).select("msg_id", F.col("final_prob").alias("p_saved"))
    b = ML.score_table(test, loaded).select("msg_id", F.col("final_prob").alias("p_loaded"),
                                            F.lit(loaded["meta"]["threshold"]).alias("threshold"))
    return a.join(b, "msg_id")


@register("m12_importance_report")
def m12(spark, sf_dir):
    j = jobs(spark, sf_dir)
    m = j.models()
    full = ML.rank_importance(ML.importance_table(spark, m["full"], ML.FULL_FEATURES))
    struct = ML.rank_importance(ML.importance_table(spark, m["structural"], ML.STRUCT_FEATURES))
    return ML.divergence(full, struct)


def _activation_counts(df, names):
    """Rows with a non-zero value per feature (one aggregation, then unpivot).
    Integer counts keep every sum exact, so both engines agree bit for bit."""
    wide = df.agg(*[F.count_if(F.col(n) > 0).cast("double").alias(n) for n in names])
    return wide.unpivot([], names, "feature", "importance")


def _imp_fixture(spark, sf_dir):
    """Importance fixture from the data: activation counts of each feature
    (labelled rows for 'full' incl. the text score, all rows for 'structural')."""
    s = _scored(spark, sf_dir)
    lab = s.filter(F.col("label").isNotNull()).withColumn(
        D.TEXT_FEATURE, (F.col("p_text") >= 0.5).cast("double"))
    return _activation_counts(lab, ML.FULL_FEATURES), _activation_counts(s, ML.STRUCT_FEATURES)


def _imp_fixture_sql():
    lab = "(SELECT *, CAST(p_text >= 0.5 AS DOUBLE) AS nlp_phishing_prob FROM scored WHERE label IS NOT NULL)"
    full = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, CAST(count(*) FILTER (WHERE {n} > 0) AS DOUBLE) AS importance FROM {lab} t"
        for n in ML.FULL_FEATURES)
    struct = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, CAST(count(*) FILTER (WHERE {n} > 0) AS DOUBLE) AS importance FROM scored"
        for n in ML.STRUCT_FEATURES)
    return [("imp_full", full), ("imp_struct", struct)]


def _rank_sql(src):
    return f"""
SELECT feature, importance,
       importance / CASE WHEN sum(importance) OVER () > 0 THEN sum(importance) OVER () ELSE 1.0 END * 100 AS share_pct,
       row_number() OVER (ORDER BY importance DESC, feature) AS rank,
       CAST(row_number() OVER (ORDER BY importance DESC, feature) <= 15 AS INTEGER) AS in_top,
       CAST(importance / CASE WHEN sum(importance) OVER () > 0 THEN sum(importance) OVER () ELSE 1.0 END * 100 < 0.1
            AND importance = 0 AS INTEGER) AS never_used,
       CASE WHEN t2 > 0 THEN t1 / t2 ELSE 999.0 END AS top1_top2_ratio
FROM (SELECT *, max(importance) OVER () AS t1,
             (SELECT importance FROM {src} ORDER BY importance DESC, feature LIMIT 1 OFFSET 1) AS t2 FROM {src}) x"""


register("w10_feature_ranking", O.scored_query("SELECT * FROM rf", _imp_fixture_sql() + [("rf", _rank_sql("imp_full"))]))(
    lambda spark, sf_dir: ML.rank_importance(_imp_fixture(spark, sf_dir)[0]))

register("j06_report_alignment", O.scored_query("""
SELECT coalesce(a.feature, b.feature) AS feature, a.share_pct AS full_pct, b.share_pct AS struct_pct,
       CASE WHEN coalesce(a.share_pct, 0) > 5 AND coalesce(b.share_pct, 0) < 0.5 THEN 'only_full'
            WHEN coalesce(b.share_pct, 0) > 5 AND coalesce(a.share_pct, 0) < 0.5 THEN 'only_structural'
            WHEN abs(coalesce(a.share_pct, 0) - coalesce(b.share_pct, 0)) > 10 THEN 'big_divergence' ELSE '' END AS flag,
       CAST(coalesce(a.share_pct, 0) > 0.5 OR coalesce(b.share_pct, 0) > 0.5 AS INTEGER) AS shown,
       CAST(a.share_pct IS NOT NULL AND b.share_pct IS NOT NULL AS INTEGER) AS shared
FROM rf a FULL OUTER JOIN rs b ON a.feature = b.feature""",
    _imp_fixture_sql() + [("rf", _rank_sql("imp_full")), ("rs", _rank_sql("imp_struct"))]))(
    lambda spark, sf_dir: (lambda fs: ML.divergence(ML.rank_importance(fs[0]), ML.rank_importance(fs[1])))(
        _imp_fixture(spark, sf_dir)))


def _split_sql(src):
    return (f"(SELECT *, CASE WHEN u < 0.15 THEN 'test' WHEN u < 0.15 + (1 - 0.15) * 0.176 THEN 'val' ELSE 'train' END "
            f"AS split FROM (SELECT *, ('0x' || substr(sha256(CAST(msg_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 AS u "
            f"FROM {src} t0) t1)")


_M13_CTES = [
    ("sp", f"SELECT * FROM {_split_sql('scored')} s WHERE label IS NOT NULL"),
    ("val", "SELECT * FROM sp WHERE split = 'val'"),
    ("tst", "SELECT * FROM sp WHERE split = 'test'"),
    ("ch", _choose_sql(_grid_sql("val"))),
    ("cm", _CM_SQL.replace(f"{THRESH}", "(SELECT threshold FROM ch)").replace(_LAB, "tst")),
]
_M13_SQL = O.scored_query(
    f"SELECT (SELECT threshold FROM ch) AS threshold, r.*, ({_auc_sql('tst')}) AS auc FROM ({_RATES_SQL}) r",
    _M13_CTES)


@register("m13_evaluation_report", _M13_SQL)
def m13(spark, sf_dir):
    from lurescope.operators.dedup import split_column
    s = _labelled(spark, sf_dir).withColumn("split", split_column(F.col("msg_id").cast("string")))
    val, test = s.filter(F.col("split") == "val"), s.filter(F.col("split") == "test")
    thr = MET.choose_threshold(MET.threshold_table(val, "final_prob", "label")).select("threshold").scalar()
    r = MET.rates(MET.confusion(test, "final_prob", "label", thr))
    return r.select(thr.alias("threshold"), "*", MET.auc(test, "final_prob", "label").scalar().alias("auc"))


# ---------------------------------------------------------------- raw mail ingest

from lurescope.sources import mail as MAIL  # noqa: E402


def _corpus(spark, sf_dir):
    """Raw corpus derived from the tables: rendered messages written as
    mbox / single-message files in the shared folder (written once)."""
    import uuid
    from lurescope.session import shared_path
    j = jobs(spark, sf_dir)
    if "_corpus" not in j._tables:
        path = shared_path(spark, f"corpus-{uuid.uuid4().hex[:12]}")
        raw = MAIL.render_raw(j.messages, j.message_urls, j.message_attachments)
        MAIL.write_corpus(raw, path)
        j._tables["_corpus"] = path
    return j._tables["_corpus"]


def _ingested(spark, sf_dir):
    j = jobs(spark, sf_dir)
    if "_ingested" not in j._tables:
        root = _corpus(spark, sf_dir)
        parsed = MAIL.parse_messages(MAIL.read_messages(spark, root))
        j._tables["_ingested"] = materialize_tbl(parsed, "parsed_messages")
    return MAIL.ingest(j._tables["_ingested"])


def materialize_tbl(df, name):
    from lurescope.session import materialize
    return materialize(df, name)


def _msg_id(col="message_id"):
    """The fixture's number; null for any other Message-ID."""
    return F.expr(f"try_cast(regexp_extract({col}, '<(-?[0-9]+)@', 1) AS BIGINT)")


def _derived(df):
    return df.filter(F.col("msg_id").isNotNull())


# One file per phishing message; how many mbox files hold the other classes is
# the writer's choice, so only their presence is compared.
register("s01_corpus_scan", O.with_views(["messages"], """
SELECT CASE label WHEN 1 THEN 'phishing' WHEN 0 THEN 'legit' ELSE 'unlabelled' END AS source,
       CAST(label AS INTEGER) AS label, CASE WHEN label = 1 THEN count(*) END AS single_files
FROM messages GROUP BY messages.label"""))(
    lambda spark, sf_dir: MAIL.corpus_scan(spark, _corpus(spark, sf_dir)).groupBy("source", "label").agg(
        F.count(F.lit(1)).alias("n")).select(
        "source", "label", F.when(F.col("label") == 1, F.col("n")).alias("single_files")))

register("s02_mbox_split", O.with_views(["messages"], """
SELECT CASE label WHEN 1 THEN 'phishing' WHEN 0 THEN 'legit' ELSE 'unlabelled' END AS source, count(*) AS messages
FROM messages GROUP BY 1"""))(
    lambda spark, sf_dir: MAIL.read_messages(spark, _corpus(spark, sf_dir))
    .groupBy("source").agg(F.count(F.lit(1)).alias("messages")))

register("s03_ingest_messages", O.with_views(["messages", "message_attachments"], """
SELECT m.msg_id, m.from_name, m.from_addr, m.reply_to, trim(m.subject) AS subject,
       CAST(length(m.html_text) > 0 AS INTEGER) AS has_html, coalesce(a.n, 0) AS n_attachments
FROM messages m LEFT JOIN (SELECT msg_id, count(*) AS n FROM message_attachments GROUP BY msg_id) a
  ON a.msg_id = m.msg_id"""))(
    lambda spark, sf_dir: (lambda parts: parts[0].join(
        parts[2].groupBy("msg_key").agg(F.count(F.lit(1)).alias("n_attachments")), "msg_key", "left").select(
        _msg_id().alias("msg_id"), "from_name", "from_addr", "reply_to", "subject",
        F.col("has_html").cast("int").alias("has_html"),
        F.coalesce("n_attachments", F.lit(0)).alias("n_attachments")).transform(_derived))(_ingested(spark, sf_dir)))

register("s04_auth_results", O.with_views(["messages"], "SELECT msg_id, spf_result, dkim_result, dmarc_result FROM messages"))(
    lambda spark, sf_dir: _ingested(spark, sf_dir)[0].select(
        _msg_id().alias("msg_id"), "spf_result", "dkim_result", "dmarc_result").transform(_derived))

register("s03_ingest_urls", O.with_views(["message_urls"], """
SELECT msg_id, CAST(row_number() OVER (PARTITION BY msg_id ORDER BY first_pos) - 1 AS INTEGER) AS pos, url
FROM (SELECT msg_id, url, min(pos) AS first_pos FROM message_urls GROUP BY msg_id, url) t"""))(
    lambda spark, sf_dir: (lambda parts: parts[1].join(parts[0].select("msg_key", "message_id"), "msg_key").select(
        _msg_id().alias("msg_id"), F.col("pos").cast("int").alias("pos"), "url").transform(_derived))(_ingested(spark, sf_dir)))

def _damaged(spark, sf_dir):
    """Mail as real corpora hold it, of five kinds, one of each per message: an unknown
    charset, bytes of a one-byte charset, no content at all, a body cut off, and a
    Message-ID that is no number.  (messages, urls, attachments, rejects)"""
    j = jobs(spark, sf_dir)
    if "_damaged" not in j._tables:
        k = F.col("msg_id").cast("string")

        def kind(name, *raw, charset="UTF-8"):
            text = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in raw])
            return j.messages.select(F.lit(name).alias("source"), F.lit(None).cast("int").alias("label"),
                                     F.concat(F.lit(name + "/"), k).alias("msg_key"),
                                     F.encode(text, charset).alias("raw"), F.lit(False).alias("mbox"))
        mail = [kind("charset", 'From: a@x.example.com\nContent-Type: text/plain; charset="idna"\n\n\u00fcber..', k, "\n"),
                kind("latin1", "From: b@x.example.com\nSubject: l1 ", k, "\nContent-Type: text/plain; "
                     "charset=iso-8859-1\n\ncaf\u00e9 ", k, "\n", charset="ISO-8859-1"),
                kind("empty", ""),
                kind("truncated", "From: c@x.example.com\nSubject: cut ", k, "\nContent-Type: multipart/mixed; "
                     'boundary="B"\n\n--B\nContent-Type: text/plain\n\nstart of ', k),
                kind("message-id", "From: d@x.example.com\nMessage-ID: <abc.", k, "@mail>\nSubject: real id\n\nhello\n")]
        every = mail[0]
        for more in mail[1:]:
            every = every.unionByName(more)
        j._tables["_damaged"] = materialize_tbl(MAIL.parse_messages(every), "damaged_messages")
    return MAIL.ingest(j._tables["_damaged"])


register("t05_rejects", O.with_views(["messages"], """
SELECT 'charset/' || msg_id AS msg_key, 'UnicodeError' AS error, (SELECT 4 * count(*) FROM messages) AS parsed
FROM messages"""))(
    lambda spark, sf_dir: (lambda parts: parts[3].select(
        "msg_key", F.split_part("error", F.lit(":"), F.lit(1)).alias("error"),
        parts[0].agg(F.count(F.lit(1))).scalar().alias("parsed")))(_damaged(spark, sf_dir)))

# Bytes survive: subjects and bodies of the damaged mail, in any charset.
register("s03_ingest_damaged", O.with_views(["messages"], """
SELECT kind || '/' || msg_id AS msg_key, replace(subject, '#', msg_id) AS subject, replace(body, '#', msg_id) AS body
FROM (SELECT CAST(msg_id AS VARCHAR) AS msg_id FROM messages) m,
     (VALUES ('latin1', 'l1 #', 'caf\u00e9 #'), ('empty', '', ''), ('truncated', 'cut #', 'start of #'),
             ('message-id', 'real id', 'hello')) AS v(kind, subject, body)"""))(
    lambda spark, sf_dir: _damaged(spark, sf_dir)[0].select(
        "msg_key", "subject", F.trim(F.regexp_replace("plain_text", r"\s+$", "")).alias("body")))


# ---------------------------------------------------------------- streaming

from lurescope.streaming import monitor as MON  # noqa: E402

STREAM_WATERMARK = "31 days"   # the replayed month fits in one watermark: nothing is late


def _monitor_run(spark, sf_dir, raw_mode=False, scorer=None):
    """Run the monitor once over the message stream (availableNow) and keep
    the Monitor (its outputs are tables in the shared folder)."""
    import uuid
    from lurescope.session import shared_path
    j = jobs(spark, sf_dir)
    key = "_monitor_raw" if raw_mode else "_monitor_models" if scorer else "_monitor"
    if key in j._tables:
        return j._tables[key]
    base = shared_path(spark, f"monitor-{uuid.uuid4().hex[:12]}")
    dims = lambda: (spark.read.parquet(j._tables_path("domain_rank")),
                    spark.read.parquet(j._tables_path("threat_domain")),
                    spark.read.parquet(j._tables_path("domain_facts_history")),
                    spark.read.parquet(j._tables_path("domain_facts")))
    j.rank(); j.threat(); j.facts_history(); j.cert_facts()
    trusted = lambda rank: rank.filter(F.col("rank") <= D.TEST_TRUSTED_TOP_N).select("domain")
    src = f"{base}/source"
    # the replayed month is judged at the fixture's instant
    how = {"scorer": scorer or MON.fixed_scores, "dicts": D.TEST_DICTIONARIES, "as_of": lambda batch_id: AS_OF}
    if raw_mode:
        MON.write_raw_source(MAIL.render_raw(j.messages_once(), j.message_urls, j.message_attachments,
                                             keep=("received_ts",)), src)
        mon = MON.Monitor(spark, f"{base}/out", dims, trusted, alert_address=ALERT_ADDRESS, **how)
        schema = MON.RAW_SCHEMA
    else:
        rows = _ltz(j.messages.drop("label", "lang")).withColumn(
            "email_hash", F.sha2(F.col("msg_id").cast("string"), 256))
        rows.repartitionByRange(12, "received_ts", "msg_id").write.mode("overwrite").parquet(src)
        mon = MON.Monitor(spark, f"{base}/out", dims, trusted, alert_address=ALERT_ADDRESS, **how,
                          urls=j.message_urls, attachments=j.message_attachments)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(src).schema)
    q = mon.start(src, f"{base}/checkpoint", max_files=4, schema=schema)
    q.awaitTermination()
    j._tables[key] = mon
    return mon


_NOT_OWN = f"strpos(lower(coalesce(from_addr, '')), {O.q(ALERT_ADDRESS)}) = 0"
_T01_SQL = O.scored_query(
    "SELECT msg_id, CAST(is_phishing AS INTEGER) AS is_phishing, confidence, risk_score, risk_level FROM x5 "
    f"WHERE {_NOT_OWN}", _SIG_CTES + [("x5", _X05_SQL)])

register("t01_monitor", _T01_SQL)(
    lambda spark, sf_dir: _monitor_run(spark, sf_dir).latest_log().select(
        "msg_id", F.col("is_phishing").cast("int").alias("is_phishing"), "confidence", "risk_score", "risk_level"))

register("t01_monitor_raw", _T01_SQL)(
    lambda spark, sf_dir: _monitor_run(spark, sf_dir, raw_mode=True).latest_log().select(
        "msg_id", F.col("is_phishing").cast("int").alias("is_phishing"), "confidence", "risk_score", "risk_level"))

register("t03_self_alert_filter", O.scored_query(
    f"SELECT msg_id, from_addr AS sender, substr(coalesce(subject, ''), 1, 60) AS subject, confidence, risk_score "
    f"FROM x5 WHERE is_phishing AND strpos(lower(coalesce(from_addr, '')), {O.q(ALERT_ADDRESS)}) = 0",
    _SIG_CTES + [("x5", _X05_SQL)]))(
    lambda spark, sf_dir: _monitor_run(spark, sf_dir).alerts().select(
        "msg_id", "sender", "subject", "confidence", "risk_score"))

# 12 source files, 4 per batch: three batches that hold every message
register("t04_bounded_intake", O.with_views(["messages"], "SELECT CAST(3 AS BIGINT) AS batches, count(*) AS arrived FROM messages"))(
    lambda spark, sf_dir: _monitor_run(spark, sf_dir).metrics().agg(
        F.countDistinct("batch_id").alias("batches"), F.sum("arrived").alias("arrived")))

# the trained models as scorer (rows only: the models are fitted here)
register("t01_monitor_models")(lambda spark, sf_dir: _monitor_run(
    spark, sf_dir, scorer=MON.model_scorer(jobs(spark, sf_dir).models(), jobs(spark, sf_dir).text_model()))
    .latest_log().select("msg_id", F.col("is_phishing").cast("int").alias("is_phishing"), "confidence"))

register("t06_cycle_counters", O.scored_query(f"""
SELECT count(*) AS arrived, count(*) FILTER (WHERE {_NOT_OWN}) AS scored,
       count(*) FILTER (WHERE {_NOT_OWN} AND final_prob >= {THRESH}) AS positive,
       count(*) FILTER (WHERE NOT {_NOT_OWN}) AS skipped, CAST(0 AS BIGINT) AS duplicates FROM scored"""))(
    lambda spark, sf_dir: _monitor_run(spark, sf_dir).metrics().agg(
        F.sum("arrived").alias("arrived"), F.sum("scored").alias("scored"),
        F.sum("positive").alias("positive"), F.sum("skipped").alias("skipped"),
        F.sum("duplicates").alias("duplicates")))

register("t08_reputation_refresh", O.with_views(["threat_domain"], """
SELECT CAST(b AS INTEGER) AS batch_id, (SELECT count(*) FROM threat_domain) AS threat_rows
FROM (SELECT unnest(generate_series(0, 2)) AS b) g"""))(lambda spark, sf_dir: _monitor_run(spark, sf_dir).metrics().select(
    "batch_id", "threat_rows"))


def _ltz(df):
    """Event-time columns as TIMESTAMP (the tables store TIMESTAMP_NTZ; the
    session time zone is UTC, so wall-clock values are unchanged)."""
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz"
                       else F.col(f.name) for f in df.schema])


def _stream_source(spark, sf_dir, name, df, files=12, order=("ts",)):
    import uuid
    from lurescope.session import shared_path
    df = _ltz(df)
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.repartitionByRange(files, *order).write.mode("overwrite").parquet(path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return path, schema


@register("t02_stream_dedup", O.with_views(["detections"], "SELECT DISTINCT email_hash FROM detections"))
def t02(spark, sf_dir):
    import uuid
    from lurescope.session import shared_path
    det = jobs(spark, sf_dir).fx.detections
    src, schema = _stream_source(spark, sf_dir, "detections-src", det, order=("processed_at", "event_id"))
    base = shared_path(spark, f"dedup-{uuid.uuid4().hex[:12]}")
    out = MON.stream_dedup(spark, src, schema, "email_hash", f"{base}/out", f"{base}/ckpt")
    return out.select("email_hash")


@register("t02_stream_dedup_log", O.with_views(["detections"], "SELECT DISTINCT email_hash FROM detections"))
def t02_log(spark, sf_dir):
    """T02 where the state remembers nothing for long, and a second run has no state of the
    first: what is older than the watermark is looked up in the log."""
    import uuid
    from lurescope.session import shared_path
    det = jobs(spark, sf_dir).fx.detections
    src, schema = _stream_source(spark, sf_dir, "detections-src", det, order=("processed_at", "event_id"))
    base = shared_path(spark, f"dedup-{uuid.uuid4().hex[:12]}")
    for run in ("a", "b"):
        out = MON.stream_dedup(spark, src, schema, "email_hash", f"{base}/out", f"{base}/{run}", horizon="0 seconds")
    return out.select("email_hash")


def _rates(spark, sf_dir, slide):
    import uuid
    from lurescope.session import shared_path
    ev = jobs(spark, sf_dir).fx.t.events.select("event_id", "ts", "value")
    src, schema = _stream_source(spark, sf_dir, "events-src", ev, order=("ts", "event_id"))
    base = shared_path(spark, f"rates-{uuid.uuid4().hex[:12]}")
    return MON.event_rates(spark, src, schema, f"{base}/out", f"{base}/ckpt", "1 hour", slide,
                           STREAM_WATERMARK, "ts", F.col("value") >= 175)


register("t07_event_rates", """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       count(*) AS events, count(*) FILTER (WHERE value >= 175) AS positives
FROM events GROUP BY 1, 2""")(lambda spark, sf_dir: _rates(spark, sf_dir, None))

register("t07_event_rates_sliding", """
SELECT ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, count(*) AS events,
       count(*) FILTER (WHERE value >= 175) AS positives
FROM (SELECT value, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS ws
      FROM events, (SELECT unnest(generate_series(0, 3)) AS k) g) t
GROUP BY 1, 2""")(lambda spark, sf_dir: _rates(spark, sf_dir, "15 minutes"))


# ---------------------------------------------------------------- join patterns under their own names

_verdict_query("j01_lookup_with_fallback", ["domain", "root_domain", "tranco_rank", "is_legitimate"])

register("j02_membership_semi", O.with_views(["message_attachments"], f"""
SELECT DISTINCT msg_id FROM message_attachments
WHERE (CASE WHEN strpos(filename, '.') > 0 THEN '.' || lower(regexp_extract(filename, '([^.]*)$', 1)) ELSE '' END)
      IN ({", ".join(O.q(x) for x in D.DEFAULT_DANGEROUS_EXTENSIONS)})"""))(
    lambda spark, sf_dir: _j02(spark, sf_dir))


def _j02(spark, sf_dir):
    """Messages with a listed attachment extension -- a left semi join
    with the extension list."""
    a = jobs(spark, sf_dir).message_attachments
    ext = F.when(F.col("filename").contains("."),
                 F.concat(F.lit("."), F.lower(F.substring_index("filename", ".", -1)))).otherwise(F.lit(""))
    lst = spark.createDataFrame([(x,) for x in D.DEFAULT_DANGEROUS_EXTENSIONS], "ext string")
    return a.select("msg_id", ext.alias("ext")).join(lst, "ext", "left_semi") \
        .select("msg_id").distinct()


register("j04_theta_brand_join", CATALOG["u09_brand_similarity"][1])(CATALOG["u09_brand_similarity"][0])
