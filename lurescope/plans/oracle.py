"""DuckDB oracle SQL for the domain, verdict and feature jobs.

Written independently of the Spark plans (LIKE-style suffix matching instead
of candidate explosion, a theta join for brands, ``unnest`` for entropy), so
that agreement of the two is a real check.  All text is plain SQL over the
driver's tables plus the derived views of ``sources.fixtures``.
"""

from __future__ import annotations

from lurescope import dictionaries as D
from lurescope.functions import urls as U
from lurescope.plans.sqlkit import with_views
from lurescope.sources.fixtures import dict_sql

DICTS = D.TEST_DICTIONARIES
AS_OF_SQL = "TIMESTAMP '2024-01-20 00:00:00'"


def q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def nh(x: str) -> str:
    """normalize_host."""
    s = f"lower(trim({x}))"
    return (f"(CASE WHEN {x} IS NULL OR {s} = '' THEN '' "
            f"WHEN strpos({s}, '@') > 0 AND strpos({s}, '/') = 0 "
            f"THEN trim(regexp_extract({s}, '([^@]*)$', 1)) "
            f"ELSE trim(regexp_extract(CASE WHEN starts_with({s}, 'http://') OR starts_with({s}, 'https://') "
            f"THEN {s} ELSE 'http://' || {s} END, {q(U.HOST_OF_URL_RE)}, 1)) END)")


def ah(x: str) -> str:
    """Domain part of an address."""
    return (f"(CASE WHEN strpos(trim({x}), '@') > 0 "
            f"THEN lower(trim(regexp_extract(trim({x}), '([^@]*)$', 1))) ELSE '' END)")


def any_contains(text: str, words) -> str:
    words = list(dict.fromkeys(words))
    if not words:
        return "false"
    return "(" + " OR ".join(f"strpos({text}, {q(w)}) > 0" for w in words) + ")"


def count_contains(text: str, words) -> str:
    words = list(dict.fromkeys(words))
    if not words:
        return "0"
    return "(" + " + ".join(f"CAST(strpos({text}, {q(w)}) > 0 AS INTEGER)" for w in words) + ")"


def brand_not_in(text: str, label: str, brands, min_len: int = 0) -> str:
    parts = [f"(strpos({text}, {q(b)}) > 0 AND strpos({label}, {q(b)}) = 0)"
             for b in dict.fromkeys(brands) if len(b) >= min_len]
    return "(" + " OR ".join(parts) + ")" if parts else "false"


def decompose_sql(src: str, psl: str = "psl") -> str:
    """host -> suffix, label, root_domain, subdomain_depth."""
    pre = "left(h.host, length(h.host) - length(m.sfx) - 1)"
    return f"""
SELECT h.host,
       coalesce(m.sfx, '') AS suffix,
       CASE WHEN m.sfx = h.host THEN ''
            WHEN m.sfx IS NOT NULL THEN regexp_extract({pre}, '([^.]*)$', 1)
            ELSE regexp_extract(h.host, '([^.]*)$', 1) END AS label,
       CASE WHEN m.sfx IS NOT NULL AND m.sfx <> h.host
            THEN regexp_extract({pre}, '([^.]*)$', 1) || '.' || m.sfx
            WHEN strpos(h.host, '.') > 0 THEN regexp_extract(h.host, '([^.]*[.][^.]*)$', 1)
            ELSE h.host END AS root_domain,
       CAST(CASE WHEN m.sfx = h.host THEN 0
            WHEN m.sfx IS NOT NULL THEN length({pre}) - length(replace({pre}, '.', ''))
            ELSE length(h.host) - length(replace(h.host, '.', '')) END AS INTEGER) AS subdomain_depth
FROM (SELECT DISTINCT host FROM {src} WHERE host <> '') h
LEFT JOIN (SELECT host, arg_max(sfx, CASE WHEN prevails THEN 1000 ELSE 0 END + length(sfx)) AS sfx FROM (
             SELECT h2.host, r.kind = '!' AS prevails,
                    CASE r.kind WHEN '!' THEN regexp_replace(r.tail, '^[^.]*[.]', '')
                         WHEN '*' THEN regexp_extract(left(h2.host, length(h2.host) - length(r.tail) - 1), '([^.]*)$', 1)
                                       || '.' || r.tail
                         ELSE r.tail END AS sfx
             FROM (SELECT DISTINCT host FROM {src} WHERE host <> '') h2
             JOIN (SELECT left(suffix, 1) AS kind, regexp_replace(suffix, '^([*][.]|!)', '') AS tail FROM {psl}) r
               ON ends_with(h2.host, '.' || r.tail) OR (h2.host = r.tail AND r.kind <> '*')) c
           GROUP BY host) m ON m.host = h.host"""


def entropy_sql(src: str) -> str:
    """label -> e (unrounded Shannon entropy) for non-empty labels of ``src``."""
    return f"""
SELECT label, -sum(p * log2(p)) AS e FROM (
  SELECT label, count(*) * 1.0 / length(label) AS p
  FROM (SELECT label, unnest(string_split(label, '')) AS ch
        FROM (SELECT DISTINCT label FROM {src} WHERE label IS NOT NULL AND label <> '') t0) t1
  GROUP BY label, ch) t2
GROUP BY label"""


def brand_sql(src: str, brands: str, max_d: int, first: bool = True) -> str:
    """label -> first matching brand (list order) and its distance."""
    inner = f"""
SELECT l.label, b.brand, b.pos, levenshtein(l.norm, b.brand) AS dist
FROM (SELECT DISTINCT label, regexp_extract(label, '^([^_-]*)', 1) AS prim,
             translate(regexp_extract(label, '^([^_-]*)', 1), '01345678@!', 'oleasgtbai') AS norm
      FROM {src} WHERE label IS NOT NULL) l
JOIN {brands} b ON l.norm = b.brand
     OR (length(l.prim) >= 4 AND abs(length(l.norm) - length(b.brand)) <= {max_d}
         AND levenshtein(l.norm, b.brand) <= {max_d})"""
    if first:
        return (f"SELECT label, arg_min(brand, pos) AS brand, "
                f"CAST(arg_min(dist, pos) AS INTEGER) AS brand_distance FROM ({inner}) x GROUP BY label")
    return f"SELECT label, min(dist) AS brand_distance FROM ({inner}) x GROUP BY label"


def murls_sql(crafted: bool) -> str:
    if crafted:
        return "SELECT msg_id, pos, url FROM message_urls UNION ALL SELECT msg_id, pos, url FROM crafted_urls"
    return "SELECT msg_id, pos, url FROM message_urls"


def base_ctes(crafted: bool = False) -> list:
    """Message hosts, domain set, decomposition -- the verdict inputs."""
    d = DICTS
    return [
        ("psl", dict_sql("psl", "suffix", d.public_suffixes)),
        ("vbrands", dict_sql("vbrands", "brand", d.verdict_brands, with_pos=True)),
        ("fbrands", dict_sql("fbrands", "brand", d.feature_brands, with_pos=True)),
        ("murls", murls_sql(crafted)),
        ("mh", f"""
SELECT * FROM (
  SELECT msg_id, 'sender' AS role, {ah('from_addr')} AS host FROM messages
  UNION ALL SELECT msg_id, 'url' AS role, {nh('url')} AS host FROM murls
  UNION ALL SELECT msg_id, 'reply_to' AS role, {ah('reply_to')} AS host FROM messages) t
WHERE host <> ''"""),
        ("mh_nr", "SELECT host FROM mh WHERE role <> 'reply_to'"),
        ("dec1", decompose_sql("mh_nr")),
        ("doms", "SELECT DISTINCT host FROM (SELECT host FROM mh UNION ALL SELECT root_domain AS host FROM dec1) t WHERE host <> ''"),
        ("dec", decompose_sql("doms")),
    ]


def verdict_ctes(crafted: bool = False) -> list:
    d = DICTS
    W = D.VERDICT_WEIGHTS
    ctes = base_ctes(crafted)
    ctes += [
        ("fx", f"""
SELECT domain, age_days AS age, registrar AS reg, has_mx AS mx, reputation_hit AS rep FROM (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY fetched_at DESC) AS rn
  FROM domain_facts_history
  WHERE fetched_at <= {AS_OF_SQL} AND fetched_at > {AS_OF_SQL} - INTERVAL 7 DAY) t WHERE rn = 1"""),
        ("v0", """
SELECT d.host AS domain, d.root_domain, d.label, d.suffix, d.subdomain_depth,
       rd.rank AS rank_d, rr.rank AS rank_r,
       td.domain IS NOT NULL AS thr_d, tr.domain IS NOT NULL AS thr_r,
       f.age, f.reg, f.mx, f.rep, f.domain IS NOT NULL AS has_facts
FROM dec d
LEFT JOIN domain_rank rd ON rd.domain = d.host
LEFT JOIN domain_rank rr ON rr.domain = d.root_domain
LEFT JOIN (SELECT DISTINCT domain FROM threat_domain) td ON td.domain = d.host
LEFT JOIN (SELECT DISTINCT domain FROM threat_domain) tr ON tr.domain = d.root_domain
LEFT JOIN fx f ON f.domain = d.root_domain"""),
        ("unranked_labels", "SELECT label FROM v0 WHERE rank_r IS NULL"),
        ("vbr", brand_sql("unranked_labels", "vbrands", D.BRAND_SIMILARITY_MAX_DISTANCE)),
        ("vent", entropy_sql("v0")),
        ("v1", f"""
SELECT v0.*,
       coalesce(rank_d, rank_r) AS rk,
       (rank_d IS NOT NULL OR rank_r IS NOT NULL) AS legit,
       CASE WHEN rank_r IS NULL THEN b.brand END AS brand_similarity,
       CASE WHEN rank_r IS NULL THEN b.brand_distance END AS brand_distance,
       CAST(CASE WHEN v0.label = '' THEN 0.0 ELSE round(coalesce(e.e, 0.0), 4) END AS DOUBLE) AS entropy_score
FROM v0 LEFT JOIN vbr b ON b.label = v0.label LEFT JOIN vent e ON e.label = v0.label"""),
        ("v2", f"""
SELECT *,
       NOT legit AND (thr_d OR thr_r) AS threat,
       NOT legit AND NOT (thr_d OR thr_r) AND has_facts AS net
FROM v1"""),
        ("v3", f"""
SELECT *,
       net AND coalesce(rep, false) AS sb,
       net AND age IS NOT NULL AND age < {D.NEW_DOMAIN_AGE_DAYS} AS new_reg,
       net AND {any_contains("lower(coalesce(reg, ''))", d.abuse_registrars)} AS abused,
       strpos(domain, 'xn--') > 0 AS puny,
       suffix IN ({", ".join(q(t) for t in d.high_risk_tlds)}) AS risky_tld
FROM v2"""),
    ]
    trig = [
        ("punycode", "puny"),
        ("high_entropy", f"entropy_score >= {D.HIGH_ENTROPY_THRESHOLD}"),
        ("deep_subdomain", f"subdomain_depth > {D.DEEP_SUBDOMAIN_LEVELS}"),
        ("high_risk_tld", "risky_tld"),
        ("brand_homoglyph", "brand_similarity IS NOT NULL"),
        ("no_mx", "mx = false"),
        ("tranco", "legit"),
        ("tranco_top1k", f"legit AND rk <= {D.TOP_RANK_CUTOFF}"),
        ("threat_feed", "threat"),
        ("safe_browsing", "sb"),
        ("newly_registered", "new_reg"),
        ("registrar_abuse", "abused"),
    ]
    total = " + ".join(f"(CASE WHEN coalesce({c}, false) THEN CAST({W[k]} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
                       for k, c in trig)
    keys = ", ".join(f"CASE WHEN coalesce({c}, false) THEN {q(k)} END" for k, c in trig)
    ctes.append(("verdicts", f"""
SELECT domain, root_domain, label, suffix AS tld,
       legit AS is_legitimate, threat AS is_known_threat, sb AS is_safe_browsing_threat,
       CAST(CASE WHEN net THEN age END AS BIGINT) AS domain_age_days,
       new_reg AS is_newly_registered,
       CASE WHEN net THEN coalesce(reg, '') ELSE '' END AS registrar,
       CAST(rk AS BIGINT) AS tranco_rank,
       CAST(CASE WHEN legit THEN 1 WHEN threat THEN 2 WHEN sb THEN 3 WHEN net THEN 4 ELSE 0 END AS INTEGER) AS lookup_tier,
       CASE WHEN threat THEN 'phishing' WHEN sb THEN 'google_safe_browsing' ELSE '' END AS threat_type,
       round(greatest(CAST({D.CONFIDENCE_MIN} AS DOUBLE), least(CAST({D.CONFIDENCE_MAX} AS DOUBLE),
             CAST({D.CONFIDENCE_BASE} AS DOUBLE) + (CAST(0 AS DOUBLE) + {total}))), 4) AS confidence,
       entropy_score, subdomain_depth, puny AS is_punycode, brand_similarity, brand_distance,
       CAST(CASE WHEN risky_tld THEN {W['high_risk_tld']} ELSE 0.0 END AS DOUBLE) AS tld_risk_score,
       mx AS has_mx_record, abused AS registrar_is_abused,
       array_to_string(list_sort(list_filter([{keys}, '_base'], lambda x: x IS NOT NULL)), ',') AS breakdown_keys
FROM v3"""))
    return ctes


def feature_ctes(crafted: bool = False) -> list:
    d = DICTS
    brands = d.feature_brands
    ctes = verdict_ctes(crafted)
    long_sub = " OR ".join(f"(strpos(label, {q(b)}) > 0 AND label <> {q(b)})"
                           for b in dict.fromkeys(brands) if len(b) >= D.MIN_BRAND_LEN_FOR_SUBSTRING) or "false"
    sub = "array_to_string(string_split(domain, '.')[1:subdomain_depth], '.')"
    ctes += [
        ("vr", """
SELECT v.*, r.is_legitimate AS root_is_legitimate
FROM verdicts v LEFT JOIN verdicts r ON r.domain = v.root_domain"""),
        ("fhomo", brand_sql("vr", "fbrands", 2, first=False)),
        ("vt", f"""
SELECT vr.*,
       NOT coalesce(root_is_legitimate, false) AND (
         (list_has_any(string_split_regex(label, '[-_]'), {lst(brands)})
          AND len(string_split_regex(label, '[-_]')) > 1) OR {long_sub}) AS compound_hit,
       NOT coalesce(root_is_legitimate, false)
         AND coalesce(h.brand_distance <= {D.FEATURE_HOMOGRAPH_MAX_DISTANCE}, false) AS homograph_hit,
       NOT coalesce(root_is_legitimate, false) AND
         {brand_not_in(f"CASE WHEN subdomain_depth > 0 THEN {sub} ELSE '' END", "label", brands)} AS sub_brand_hit
FROM vr LEFT JOIN (SELECT label AS hlabel, brand_distance FROM fhomo) h ON h.hlabel = vr.label"""),
        ("uent", entropy_sql("vt")),
        ("u", f"""
SELECT mu.msg_id, mu.url, {nh('mu.url')} AS uhost,
       lower(regexp_extract(mu.url, {q(U.PATH_RE)}, 1)) AS path,
       regexp_extract(mu.url, {q(U.QUERY_RE)}, 1) AS query
FROM murls mu"""),
        ("uj", f"""
SELECT u.msg_id,
       coalesce(v.is_known_threat OR v.is_safe_browsing_threat, false) AS u_threat,
       coalesce(v.is_legitimate, false) AS u_legit,
       v.tranco_rank AS u_rank,
       coalesce(v.is_newly_registered, false) AS u_new,
       regexp_matches(u.url, {q(U.IPV4_PREFIX_RE)}) OR regexp_matches(u.uhost, {q(U.IPV4_FULL_RE)}) AS u_ip,
       coalesce(v.root_domain IN ({", ".join(q(s) for s in d.shorteners)}), false) AS u_short,
       starts_with(u.url, 'http://') AS u_http,
       length(u.url) AS u_len,
       strpos(regexp_extract(u.url, {q(U.NETLOC_RE)}, 1), '@') > 0 AS u_at,
       CASE WHEN coalesce(v.label, '') <> '' THEN e.e END AS u_ent,
       {count_contains('u.path', d.path_keywords)} AS u_kw,
       NOT coalesce(v.is_legitimate, false) AND {brand_not_in('u.path', "lower(coalesce(v.label, ''))", brands, D.MIN_BRAND_LEN_FOR_SUBSTRING)} AS u_pbm,
       CAST(coalesce(v.root_domain IN ({", ".join(q(s) for s in d.shorteners)}), false) AS INTEGER)
       + CAST(list_has_any(list_transform(list_filter(string_split(u.query, '&'),
                 lambda p: strpos(p, '=') > 0 AND length(split_part(p, '=', 1)) > 0
                      AND length(substr(p, strpos(p, '=') + 1)) > 0),
               lambda p: lower(split_part(p, '=', 1))), {lst(d.redirect_params)}) AS INTEGER)
       + CAST(strpos(lower(u.url), 'http%3a') > 0 AS INTEGER) AS u_redir,
       coalesce(v.sub_brand_hit, false) AS u_sub,
       coalesce(v.compound_hit, false) AS u_comp,
       coalesce(v.homograph_hit, false) AS u_homo
FROM u LEFT JOIN vt v ON v.domain = u.uhost LEFT JOIN uent e ON e.label = v.label"""),
        ("uf", """
SELECT msg_id,
       max(CAST(u_threat AS INTEGER)) AS any_url_domain_is_threat,
       max(CAST(u_legit AS INTEGER)) AS any_legit,
       min(u_rank) AS min_rank,
       max(CAST(u_new AS INTEGER)) AS any_url_newly_registered,
       count(*) AS url_count,
       max(CAST(u_ip AS INTEGER)) AS has_ip_based_url,
       max(CAST(u_short AS INTEGER)) AS has_url_shortener,
       max(CAST(u_http AS INTEGER)) AS has_http_only,
       max(u_len) AS max_url_length,
       max(CAST(u_at AS INTEGER)) AS url_has_at_symbol,
       max(u_ent) AS max_ent,
       sum(u_kw) AS suspicious_path_keyword_count,
       max(CAST(u_pbm AS INTEGER)) AS path_brand_mismatch,
       max(u_redir) AS redirect_depth,
       max(CAST(u_sub AS INTEGER)) AS brand_in_subdomain,
       max(CAST(u_comp AS INTEGER)) AS url_compound,
       max(CAST(u_homo AS INTEGER)) AS url_homograph
FROM uj GROUP BY msg_id"""),
        ("af", f"""
SELECT msg_id,
       max(CAST(CASE WHEN strpos(filename, '.') > 0
                     THEN '.' || lower(regexp_extract(filename, '([^.]*)$', 1)) ELSE '' END
                IN ({", ".join(q(x) for x in d.dangerous_extensions)}) AS INTEGER)) AS has_dangerous_attachment,
       max(CAST({any_contains('lower(filename)', d.lure_words)} AS INTEGER)) AS suspicious_attachment_name
FROM message_attachments GROUP BY msg_id"""),
        ("anc", f"""
SELECT msg_id, href, trim(lower(regexp_replace(txt, '<[^>]+>', '', 'g'))) AS anchor_text FROM (
  SELECT msg_id,
         unnest(regexp_extract_all(html_text, {q(_anchor_re())}, 1)) AS href,
         unnest(regexp_extract_all(html_text, {q(_anchor_re())}, 2)) AS txt
  FROM messages WHERE length(coalesce(html_text, '')) > 0) t"""),
        ("anc2", f"SELECT msg_id, href, {nh('href')} AS host FROM anc WHERE {any_contains('anchor_text', brands)}"),
        ("anc_dec", decompose_sql("anc2")),
        ("lookup", """
SELECT DISTINCT msg_id, domain, is_legitimate FROM (
  SELECT mh.msg_id, v.domain, v.is_legitimate FROM mh JOIN verdicts v ON v.domain = mh.host
  UNION ALL
  SELECT mh.msg_id, r.domain, r.is_legitimate FROM mh JOIN verdicts v ON v.domain = mh.host
       JOIN verdicts r ON r.domain = v.root_domain WHERE mh.role <> 'reply_to') t"""),
        ("lm", """
SELECT a.msg_id,
       max(CAST(NOT (CASE WHEN lh.is_legitimate IS NOT NULL THEN lh.is_legitimate
                          ELSE coalesce(lr.is_legitimate, false) END) AS INTEGER)) AS link_text_domain_mismatch
FROM anc2 a
LEFT JOIN anc_dec ad ON ad.host = a.host
LEFT JOIN lookup lh ON lh.msg_id = a.msg_id AND lh.domain = a.host
LEFT JOIN lookup lr ON lr.msg_id = a.msg_id AND lr.domain = ad.root_domain
GROUP BY a.msg_id"""),
        ("trusted", f"SELECT domain FROM domain_rank WHERE rank <= {D.TEST_TRUSTED_TOP_N}"),
        ("ms", f"""
SELECT m.*, {ah('m.from_addr')} AS shost, {ah('m.reply_to')} AS rhost FROM messages m"""),
        ("mj", """
SELECT ms.*, sv.root_domain AS sroot, sv.is_legitimate AS s_legit,
       sv.is_known_threat OR sv.is_safe_browsing_threat AS s_threat,
       sv.domain_age_days AS s_age, sv.is_newly_registered AS s_new,
       sv.compound_hit AS s_comp, sv.homograph_hit AS s_homo,
       rv.root_domain AS rroot, cf.cert_age_days AS s_cert,
       (th.domain IS NOT NULL OR tr.domain IS NOT NULL) AS is_trusted,
       uf.*, af.has_dangerous_attachment, af.suspicious_attachment_name, lm.link_text_domain_mismatch
FROM ms
LEFT JOIN vt sv ON sv.domain = ms.shost
LEFT JOIN vt rv ON rv.domain = ms.rhost
LEFT JOIN domain_facts cf ON cf.domain = sv.root_domain
LEFT JOIN trusted th ON th.domain = ms.shost
LEFT JOIN trusted tr ON tr.domain = sv.root_domain
LEFT JOIN uf ON uf.msg_id = ms.msg_id
LEFT JOIN af ON af.msg_id = ms.msg_id
LEFT JOIN lm ON lm.msg_id = ms.msg_id"""),
    ]
    # RE2 and Java agree on these patterns; each tag and block becomes a blank
    html_text = "coalesce(html_text, '')"
    for pattern in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "<[^>]+>",
                    "[ \\t\\r\\n]+"):
        html_text = f"regexp_replace({html_text}, {q(pattern)}, ' ', 'g')"
    combined = (f"lower(coalesce(plain_text, '') || ' ' || trim({html_text}) || ' ' "
                "|| coalesce(subject, ''))")
    subject = "lower(coalesce(subject, ''))"
    display = "lower(coalesce(from_name, ''))"
    s_legit = "coalesce(s_legit, false)"
    n_brand = " + ".join(f"CAST(strpos({display}, {q(b)}) > 0 OR strpos({subject}, {q(b)}) > 0 AS INTEGER)"
                         for b in dict.fromkeys(brands)) or "0"
    n_action = count_contains(combined, d.action_keywords)
    pats = "|".join(f"(?:{p})" for p in d.subject_patterns)
    feats = {
        "sender_in_tranco": f"CAST({s_legit} AS INTEGER)",
        "sender_is_threat": "CAST(coalesce(s_threat, false) AS INTEGER)",
        "sender_domain_age_score": ("CASE WHEN s_age IS NULL THEN 0.5 WHEN s_age < 7 THEN 1.0 WHEN s_age < 30 THEN 0.9 "
                                    "WHEN s_age < 90 THEN 0.7 WHEN s_age < 180 THEN 0.5 WHEN s_age < 365 THEN 0.3 "
                                    "WHEN s_age < 730 THEN 0.15 ELSE 0.05 END"),
        "sender_is_newly_registered": "CAST(coalesce(s_new, false) AS INTEGER)",
        "ssl_cert_age_days": "CAST(coalesce(s_cert >= 0 AND s_cert < 30, false) AS INTEGER)",
        "any_url_domain_is_threat": "coalesce(any_url_domain_is_threat, 0)",
        "any_url_domain_not_in_tranco": "CAST(coalesce(url_count, 0) > 0 AND coalesce(any_legit, 0) = 0 AS INTEGER)",
        "min_url_tranco_rank": f"coalesce(min_rank, {D.MIN_URL_RANK_DEFAULT})",
        "any_url_newly_registered": "coalesce(any_url_newly_registered, 0)",
        "url_count": "coalesce(url_count, 0)",
        "has_ip_based_url": "coalesce(has_ip_based_url, 0)",
        "has_url_shortener": "coalesce(has_url_shortener, 0)",
        "has_http_only": "coalesce(has_http_only, 0)",
        "max_url_length": "coalesce(max_url_length, 0)",
        "url_has_at_symbol": "coalesce(url_has_at_symbol, 0)",
        "url_entropy_score": "coalesce(round(max_ent, 3), 0.0)",
        "suspicious_path_keyword_count": "coalesce(suspicious_path_keyword_count, 0)",
        "path_brand_mismatch": "coalesce(path_brand_mismatch, 0)",
        "redirect_depth": "coalesce(redirect_depth, 0)",
        "brand_in_subdomain": "coalesce(brand_in_subdomain, 0)",
        "compound_brand_domain": "greatest(coalesce(url_compound, 0), CAST(coalesce(s_comp, false) AS INTEGER))",
        "homograph_attack": "greatest(coalesce(url_homograph, 0), CAST(coalesce(s_homo, false) AS INTEGER))",
        "sender_display_mismatch": (f"CAST(length({display}) > 0 AND strpos(from_addr, '@') > 0 AND NOT {s_legit} "
                                    f"AND {any_contains(display, brands)} AS INTEGER)"),
        "reply_to_differs": ("CAST(length(trim(coalesce(reply_to, ''))) > 0 AND coalesce(sroot, '') <> '' "
                             "AND coalesce(rroot, '') <> '' AND sroot <> rroot AS INTEGER)"),
        "spf_fail": "CAST(spf_result IN ('fail', 'softfail') AS INTEGER)",
        "dkim_fail": "CAST(dkim_result = 'fail' AS INTEGER)",
        "dmarc_fail": "CAST(dmarc_result = 'fail' AS INTEGER)",
        "auth_completely_absent": "CAST(spf_result = 'none' AND dkim_result = 'none' AND dmarc_result = 'none' AS INTEGER)",
        "urgency_phrase_count": count_contains(combined, d.urgency_phrases),
        "subject_has_urgency": f"CAST(regexp_matches({subject}, {q(pats)}) AS INTEGER)",
        "impersonation_score": f"CASE WHEN {s_legit} THEN 0 ELSE {n_brand} END",
        "unknown_domain_action_content": (f"CASE WHEN {s_legit} THEN 0 WHEN {n_action} = 0 THEN 0 "
                                          f"WHEN {n_action} <= 2 THEN 1 WHEN {n_action} <= 4 THEN 2 ELSE 3 END"),
        "has_dangerous_attachment": "coalesce(has_dangerous_attachment, 0)",
        "suspicious_attachment_name": "coalesce(suspicious_attachment_name, 0)",
        "has_form_in_html": ("CAST(strpos(lower(coalesce(html_text, '')), '<form') > 0 OR "
                             "regexp_matches(lower(coalesce(html_text, '')), '<input[^>]+type=[\"'']?(password|text)') AS INTEGER)"),
        "link_text_domain_mismatch": "coalesce(link_text_domain_mismatch, 0)",
        "html_to_text_ratio": ("least(round_even(length(coalesce(html_text, '')) / "
                               "(length(coalesce(plain_text, '')) + 1), 2), 100.0)"),
    }
    cols = ",\n       ".join(
        f"CASE WHEN is_trusted THEN 0.0 ELSE CAST({feats[n]} AS DOUBLE) END AS {n}" for n in D.FEATURE_NAMES)
    ctes.append(("features", f"SELECT msg_id, label, {cols}\nFROM mj"))
    return ctes


def _anchor_re() -> str:
    from lurescope.operators.features import ANCHOR_RE
    return ANCHOR_RE


MESSAGE_VIEWS = ["messages", "message_urls", "message_attachments", "domain_rank",
                 "threat_domain", "domain_facts", "domain_facts_history"]


def verdict_query(body: str, crafted: bool = False) -> str:
    views = MESSAGE_VIEWS + (["crafted_urls"] if crafted else [])
    return with_views(views, body, verdict_ctes(crafted))


def feature_query(body: str, crafted: bool = False, crafted_html: bool = False) -> str:
    views = MESSAGE_VIEWS + (["crafted_urls"] if crafted else []) + (["crafted_html"] if crafted_html else [])
    return with_views(views, body, feature_ctes(crafted))


def base_query(body: str, crafted: bool = False) -> str:
    views = MESSAGE_VIEWS + (["crafted_urls"] if crafted else [])
    return with_views(views, body, base_ctes(crafted))


def dbl(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def squish_sql(p: str) -> str:
    return (f"({dbl(0.5)} + (greatest({dbl(D.TEXT_CLIP_LOW)}, least({dbl(D.TEXT_CLIP_HIGH)}, {p})) - {dbl(0.5)})"
            f" * {dbl(0.5)})")


def weight_sql(p: str) -> str:
    lo, hi = D.TEXT_SQUISH_RANGE
    return (f"greatest({dbl(0.0)}, least({dbl(1.0)}, ({squish_sql(p)} - {dbl(lo)}) / ({dbl(hi)} - {dbl(lo)})))")


def scored_ctes() -> list:
    w = weight_sql("p_text")
    return [("scored0", f"""
SELECT f.*, m.from_addr, m.from_name, m.subject,
       CAST((f.msg_id * 37) % 101 AS DOUBLE) / {dbl(100.0)} AS p_text,
       CAST((f.msg_id * 53 + 7) % 101 AS DOUBLE) / {dbl(100.0)} AS p_full,
       CAST((f.msg_id * 17 + 3) % 101 AS DOUBLE) / {dbl(100.0)} AS p_struct
FROM features f JOIN messages m ON m.msg_id = f.msg_id"""),
            ("scored", f"SELECT *, {w} * p_full + ({dbl(1.0)} - {w}) * p_struct AS final_prob FROM scored0")]


def scored_query(body: str, extra: list | None = None) -> str:
    views = MESSAGE_VIEWS
    return with_views(views, body, feature_ctes(False) + scored_ctes() + (extra or []))
