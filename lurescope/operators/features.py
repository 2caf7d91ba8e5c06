"""Message features (F00-F39): the 37-column feature table.

Plan shape:

* URL rows (``message_urls``) get their per-URL columns, are joined once to
  the verdict table on the URL host (verdicts carry their root's legitimacy
  and all domain-only brand tests), and are aggregated back with one
  ``groupBy(msg_id)`` (partial aggregation map-side);
* the sender host is joined once to the verdict table;
* attachments and anchors are aggregated per message the same way;
* the tests on texts are made in the scan, which hands on numbers alone;
* everything meets in left joins on ``msg_id``, between narrow rows.

Domain-only tests (homograph, compound brand, brand-in-subdomain) are
computed at distinct-domain grain, not per URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope import dictionaries as D
from lurescope.functions.urls import (address_host, any_contained, any_regex, bool_int,
                                      has_ip_host, normalize_host,
                                      query_param_names, shannon_entropy, url_netloc, url_path)
from lurescope.operators.domains import brand_matches
from lurescope.operators.phrases import with_phrase_count
from lurescope.operators.joins import lookup_join
from lurescope.operators.verdicts import domain_age_score


def _brands_in(text: Column, brands: list, min_len: int = 0) -> Column:
    return any_contained(text, [b for b in brands if len(b) >= min_len])


def _brand_not_in_label(text: Column, label: Column, brands: list, min_len: int = 0) -> Column:
    """Some brand (length >= min_len) is in ``text`` but not in ``label``."""
    out = F.lit(False)
    for b in dict.fromkeys(brands):
        if len(b) >= min_len:
            out = out | (text.contains(F.lit(b)) & ~label.contains(F.lit(b)))
    return out


def domain_tests(verdicts: DataFrame, dicts: D.Dictionaries) -> DataFrame:
    """Per-domain brand tests used by F20-F22 (distinct-domain grain).

    Input: the verdict table with ``root_is_legitimate``.  Output adds
    ``compound_hit``, ``homograph_hit`` and ``sub_brand_hit``.
    """
    brands = list(dicts.feature_brands)
    label = F.lower(F.col("label"))
    parts = F.split(label, "[-_]")
    part_is_brand = F.exists(parts, lambda p: p.isin(brands)) if brands else F.lit(False)
    long_sub = F.lit(False)
    for b in dict.fromkeys(brands):
        if len(b) >= D.MIN_BRAND_LEN_FOR_SUBSTRING:
            long_sub = long_sub | (label.contains(F.lit(b)) & (label != F.lit(b)))
    unranked_root = ~F.coalesce(F.col("root_is_legitimate"), F.lit(False))
    compound = unranked_root & ((part_is_brand & (F.size(parts) > 1)) | long_sub)

    # Length band 2, edit distance 1 (equality is distance 0).
    homo = brand_matches(verdicts.select("label"), brands, 2, first_in_order=False)
    homo = homo.filter(F.col("brand_distance") <= D.FEATURE_HOMOGRAPH_MAX_DISTANCE) \
        .select("label", F.lit(True).alias("_homo"))

    sub_labels = F.slice(F.split("domain", "[.]"), 1, F.greatest(F.col("subdomain_depth"), F.lit(0)))
    subdomain = F.when(F.col("subdomain_depth") > 0, F.array_join(sub_labels, ".")).otherwise("")
    sub_hit = unranked_root & _brand_not_in_label(F.lower(subdomain), label, brands)

    return (verdicts.join(homo, "label", "left")
            .withColumn("compound_hit", compound)
            .withColumn("homograph_hit", unranked_root & F.coalesce("_homo", F.lit(False)))
            .withColumn("sub_brand_hit", sub_hit)
            .drop("_homo"))


def url_features(message_urls: DataFrame, vt: DataFrame, dicts: D.Dictionaries) -> DataFrame:
    """F06-F22 URL part: one row per message that has URLs."""
    u = message_urls.select("msg_id", "pos", "url", normalize_host("url").alias("uhost"))
    path = F.lower(url_path("url"))
    params = query_param_names("url")
    redirect_param = F.exists(params, lambda p: p.isin(list(dicts.redirect_params))) \
        if dicts.redirect_params else F.lit(False)
    v = vt.select(
        F.col("domain").alias("uhost"), "root_domain", "label", "is_legitimate",
        "is_known_threat", "is_safe_browsing_threat", "tranco_rank", "is_newly_registered",
        "root_is_legitimate", "compound_hit", "homograph_hit", "sub_brand_hit")
    j = lookup_join(u, v, "uhost")
    legit = F.coalesce(F.col("is_legitimate"), F.lit(False))
    shortener = F.coalesce(F.col("root_domain").isin(list(dicts.shorteners)), F.lit(False)) \
        if dicts.shorteners else F.lit(False)
    label = F.lower(F.coalesce(F.col("label"), F.lit("")))
    j = with_phrase_count(j, ["msg_id", "pos"], path, dicts.path_keywords, "u_kw")
    per = j.select(
        "msg_id",
        (F.coalesce(F.col("is_known_threat"), F.lit(False))
         | F.coalesce(F.col("is_safe_browsing_threat"), F.lit(False))).alias("u_threat"),
        legit.alias("u_legit"),
        F.col("tranco_rank").alias("u_rank"),
        F.coalesce(F.col("is_newly_registered"), F.lit(False)).alias("u_new"),
        has_ip_host("url").alias("u_ip"),
        shortener.alias("u_short"),
        F.col("url").startswith("http://").alias("u_http"),
        F.length("url").alias("u_len"),
        url_netloc("url").contains("@").alias("u_at"),
        F.when(F.length(F.coalesce("label", F.lit(""))) > 0, shannon_entropy("label"))
         .alias("u_ent"),
        "u_kw",
        (~legit & _brand_not_in_label(path, label, dicts.feature_brands,
                                      D.MIN_BRAND_LEN_FOR_SUBSTRING)).alias("u_pbm"),
        (bool_int(shortener) + bool_int(redirect_param)
         + bool_int(F.lower("url").contains("http%3a"))).alias("u_redir"),
        F.coalesce(F.col("sub_brand_hit"), F.lit(False)).alias("u_sub"),
        F.coalesce(F.col("compound_hit"), F.lit(False)).alias("u_comp"),
        F.coalesce(F.col("homograph_hit"), F.lit(False)).alias("u_homo"))
    return per.groupBy("msg_id").agg(
        F.max(bool_int(F.col("u_threat"))).alias("any_url_domain_is_threat"),
        F.max(bool_int(F.col("u_legit"))).alias("_any_legit"),
        F.min("u_rank").alias("_min_rank"),
        F.max(bool_int(F.col("u_new"))).alias("any_url_newly_registered"),
        F.count(F.lit(1)).alias("url_count"),
        F.max(bool_int(F.col("u_ip"))).alias("has_ip_based_url"),
        F.max(bool_int(F.col("u_short"))).alias("has_url_shortener"),
        F.max(bool_int(F.col("u_http"))).alias("has_http_only"),
        F.max("u_len").alias("max_url_length"),
        F.max(bool_int(F.col("u_at"))).alias("url_has_at_symbol"),
        F.max("u_ent").alias("_max_ent"),
        F.sum("u_kw").alias("suspicious_path_keyword_count"),
        F.max(bool_int(F.col("u_pbm"))).alias("path_brand_mismatch"),
        F.max("u_redir").alias("redirect_depth"),
        F.max(bool_int(F.col("u_sub"))).alias("brand_in_subdomain"),
        F.max(bool_int(F.col("u_comp"))).alias("_url_compound"),
        F.max(bool_int(F.col("u_homo"))).alias("_url_homograph"))


def attachment_features(attachments: DataFrame, dicts: D.Dictionaries) -> DataFrame:
    """F33, F34 per message."""
    name = F.coalesce(F.col("filename"), F.lit(""))
    ext = F.when(name.contains("."), F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))) \
        .otherwise(F.lit(""))
    danger = ext.isin(list(dicts.dangerous_extensions))
    lure = any_contained(F.lower(name), dicts.lure_words)
    return attachments.groupBy("msg_id").agg(
        F.max(bool_int(danger)).alias("has_dangerous_attachment"),
        F.max(bool_int(lure)).alias("suspicious_attachment_name"))


ANCHOR_RE = r"(?is)<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"


def html_to_text(html) -> Column:
    """Text of an HTML part: scripts and styles out, tags to blanks."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"[ \t\r\n]+", " "))


def content_text(messages: DataFrame) -> Column:
    """What the content features read: the parser's ``combined`` text where
    there is one, else the plain part and the HTML part's text."""
    if "combined" in messages.columns:
        return F.coalesce("combined", F.lit(""))
    return F.concat(F.coalesce("plain_text", F.lit("")), F.lit(" "),
                    html_to_text(F.coalesce("html_text", F.lit(""))))


def anchors(messages: DataFrame) -> DataFrame:
    """(msg_id, href, anchor_text) of every ``<a href>`` in the HTML part.

    One regex pass over the HTML; href and text are then cut out of each
    (short) match.
    """
    html = F.coalesce(F.col("html_text"), F.lit(""))
    m = messages.filter(F.length(html) > 0)
    found = F.regexp_extract_all(html, F.lit(ANCHOR_RE), 0)
    return (m.select("msg_id", F.explode(found).alias("a"))
            .select("msg_id", F.regexp_extract("a", ANCHOR_RE, 1).alias("href"),
                    F.trim(F.lower(F.regexp_replace(F.regexp_extract("a", ANCHOR_RE, 2), "<[^>]+>", "")))
                    .alias("anchor_text")))


def link_mismatch(messages: DataFrame, message_urls: DataFrame, vt: DataFrame,
                  dicts: D.Dictionaries, stage: bool = True) -> DataFrame:
    """an anchor's text names a brand while its link does not resolve to
    a legitimate domain among the message's looked-up domains (the link host's
    verdict if the host is among them, else its root's)."""
    from lurescope.operators.domains import decompose_hosts
    a = anchors(messages)
    a = a.filter(_brands_in(F.col("anchor_text"), dicts.feature_brands))
    a = a.withColumn("hhost", normalize_host("href"))
    dec = decompose_hosts(a.select(F.col("hhost").alias("host")), dicts.public_suffixes) \
        .select(F.col("host").alias("hhost"), F.col("root_domain").alias("hroot"))
    a = a.join(dec, "hhost", "left")
    if stage:
        # The HTML is scanned once; the (small) anchor table feeds four joins.
        from lurescope.session import materialize
        a = materialize(a, "brand_anchors")
    # Only messages with such anchors need their lookup set.
    with_anchor = a.select("msg_id").distinct()
    s = msg_lookup_set(messages.join(with_anchor, "msg_id", "left_semi"),
                       message_urls.join(with_anchor, "msg_id", "left_semi"), vt)
    a = a.join(s.select("msg_id", F.col("domain").alias("hhost"),
                        F.col("is_legitimate").alias("_lh")), ["msg_id", "hhost"], "left")
    a = a.join(s.select("msg_id", F.col("domain").alias("hroot"),
                        F.col("is_legitimate").alias("_lr")), ["msg_id", "hroot"], "left")
    legit = F.when(F.col("_lh").isNotNull(), F.col("_lh")) \
        .otherwise(F.coalesce(F.col("_lr"), F.lit(False)))
    return a.groupBy("msg_id").agg(F.max(bool_int(~legit)).alias("link_text_domain_mismatch"))


def text_features(messages: DataFrame, dicts: D.Dictionaries) -> DataFrame:
    """What a message tells by itself (F01-F05, F23-F32, F35, F37): its key, the hosts of its
    addresses and one narrow column per test, made where the texts are read."""
    combined = F.lower(F.concat(content_text(messages), F.lit(" "), F.coalesce("subject", F.lit(""))))
    subject = F.lower(F.coalesce("subject", F.lit("")))
    display = F.lower(F.coalesce("from_name", F.lit("")))
    n_brand = F.lit(0)
    for b in dict.fromkeys(dicts.feature_brands):
        n_brand = n_brand + F.when(display.contains(F.lit(b)) | subject.contains(F.lit(b)), 1).otherwise(0)
    html = F.lower(F.coalesce("html_text", F.lit("")))
    ratio = F.least(F.bround(F.length(F.coalesce("html_text", F.lit("")))
                             / (F.length(F.coalesce("plain_text", F.lit(""))) + 1), 2), F.lit(100.0))
    none = [F.col(c) == "none" for c in ("spf_result", "dkim_result", "dmarc_result")]
    m = messages.select(
        "msg_id", address_host("from_addr").alias("shost"), address_host("reply_to").alias("rhost"),
        ((F.length(display) > 0) & F.col("from_addr").contains("@")
         & _brands_in(display, dicts.feature_brands)).alias("_display_brand"),
        (F.length(F.trim(F.coalesce("reply_to", F.lit("")))) > 0).alias("_reply_to"),
        bool_int(F.col("spf_result").isin("fail", "softfail")).alias("_spf_fail"),
        bool_int(F.col("dkim_result") == "fail").alias("_dkim_fail"),
        bool_int(F.col("dmarc_result") == "fail").alias("_dmarc_fail"),
        bool_int(none[0] & none[1] & none[2]).alias("_auth_completely_absent"),
        bool_int(any_regex(subject, dicts.subject_patterns)).alias("_subject_has_urgency"),
        n_brand.alias("_n_brand"),
        bool_int(html.contains("<form") | html.rlike(r"<input[^>]+type=[\"']?(password|text)"))
        .alias("_has_form_in_html"),
        ratio.alias("_html_to_text_ratio"),
        combined.alias("_said"))
    tables = []
    for name, phrases in (("_n_action", dicts.action_keywords), ("_n_urgency", dicts.urgency_phrases)):
        if isinstance(phrases, DataFrame):
            tables.append(with_phrase_count(messages.select("msg_id", combined.alias("_said")), ["msg_id"],
                                            F.col("_said"), phrases, name).select("msg_id", name))
        else:
            m = with_phrase_count(m, ["msg_id"], F.col("_said"), phrases, name)
    m = m.drop("_said")
    for counted in tables:
        m = m.join(counted, "msg_id", "left")
    return m


def features_all(messages: DataFrame, message_urls: DataFrame, attachments: DataFrame,
                 verdicts: DataFrame, trusted: DataFrame | list,
                 cert_facts: DataFrame | None, dicts: D.Dictionaries,
                 zero_trusted: bool = True, keep: tuple = (), stage: bool = True) -> DataFrame:
    """msg_id + the 37 features in fixed order (F00 applied).

    ``verdicts`` must come from :func:`domain_verdicts` over the message
    domains; ``msg_id`` is the key of ``messages``.  ``trusted`` is a list or a ``(domain)`` DataFrame.
    """
    from lurescope.operators.domains import as_list_df
    from lurescope.operators.verdicts import with_root_legit

    spark = messages.sparkSession
    vt = domain_tests(with_root_legit(verdicts), dicts)
    if stage:
        # Distinct-domain grain, used by six joins below: written once.
        from lurescope.session import materialize
        vt = materialize(vt, "domain_tests")

    uf = url_features(message_urls, vt, dicts)
    af = attachment_features(attachments, dicts)

    # The texts are read where they lie: what they tell is a few numbers a message, which
    # go through the lookups with the message's key and two hosts.  No text is shuffled.
    m = text_features(messages, dicts)
    sv = vt.select(F.col("domain").alias("shost"), F.col("root_domain").alias("sroot"),
                   F.col("is_legitimate").alias("s_legit"),
                   (F.col("is_known_threat") | F.col("is_safe_browsing_threat")).alias("s_threat"),
                   F.col("domain_age_days").alias("s_age"),
                   F.col("is_newly_registered").alias("s_new"),
                   F.col("compound_hit").alias("s_comp"), F.col("homograph_hit").alias("s_homo"))
    rv = vt.select(F.col("domain").alias("rhost"), F.col("root_domain").alias("rroot"))
    m = lookup_join(m, sv, "shost")
    m = lookup_join(m, rv, "rhost")
    if cert_facts is not None:
        cf = cert_facts.select(F.col("domain").alias("sroot"), F.col("cert_age_days").alias("s_cert"))
        m = m.join(cf, "sroot", "left")
    else:
        m = m.withColumn("s_cert", F.lit(None).cast("bigint"))
    tr = as_list_df(spark, trusted, "domain").select(F.col("domain").alias("_t")).distinct()
    tr_list = tr.select(F.col("_t").alias("shost"), F.lit(True).alias("_t_host"))
    tr_root = tr.select(F.col("_t").alias("sroot"), F.lit(True).alias("_t_root"))
    m = m.join(tr_list, "shost", "left").join(tr_root, "sroot", "left")

    m = m.join(uf, "msg_id", "left").join(af, "msg_id", "left")

    # F36 needs the message's own looked-up domains.
    lm = link_mismatch(messages, message_urls, vt, dicts, stage)
    m = m.join(lm, "msg_id", "left")
    if keep:
        m = messages.select("msg_id", *keep).join(m, "msg_id", "left")

    s_legit = F.coalesce(F.col("s_legit"), F.lit(False))
    n_action = F.col("_n_action")
    ucount = F.coalesce(F.col("url_count"), F.lit(0))

    f = {
        "sender_in_tranco": bool_int(s_legit),
        "sender_is_threat": bool_int(F.coalesce("s_threat", F.lit(False))),
        "sender_domain_age_score": domain_age_score(F.col("s_age")),
        "sender_is_newly_registered": bool_int(F.coalesce("s_new", F.lit(False))),
        "ssl_cert_age_days": bool_int(F.coalesce((F.col("s_cert") >= 0) & (F.col("s_cert") < 30),
                                                 F.lit(False))),
        "any_url_domain_is_threat": F.coalesce("any_url_domain_is_threat", F.lit(0)),
        "any_url_domain_not_in_tranco": bool_int((ucount > 0) & (F.coalesce("_any_legit", F.lit(0)) == 0)),
        "min_url_tranco_rank": F.coalesce("_min_rank", F.lit(D.MIN_URL_RANK_DEFAULT)),
        "any_url_newly_registered": F.coalesce("any_url_newly_registered", F.lit(0)),
        "url_count": ucount,
        "has_ip_based_url": F.coalesce("has_ip_based_url", F.lit(0)),
        "has_url_shortener": F.coalesce("has_url_shortener", F.lit(0)),
        "has_http_only": F.coalesce("has_http_only", F.lit(0)),
        "max_url_length": F.coalesce("max_url_length", F.lit(0)),
        "url_has_at_symbol": F.coalesce("url_has_at_symbol", F.lit(0)),
        "url_entropy_score": F.coalesce(F.round("_max_ent", 3), F.lit(0.0)),
        "suspicious_path_keyword_count": F.coalesce("suspicious_path_keyword_count", F.lit(0)),
        "path_brand_mismatch": F.coalesce("path_brand_mismatch", F.lit(0)),
        "redirect_depth": F.coalesce("redirect_depth", F.lit(0)),
        "brand_in_subdomain": F.coalesce("brand_in_subdomain", F.lit(0)),
        "compound_brand_domain": F.greatest(F.coalesce("_url_compound", F.lit(0)),
                                            bool_int(F.coalesce("s_comp", F.lit(False)))),
        "homograph_attack": F.greatest(F.coalesce("_url_homograph", F.lit(0)),
                                       bool_int(F.coalesce("s_homo", F.lit(False)))),
        "sender_display_mismatch": bool_int(F.col("_display_brand") & ~s_legit),
        "reply_to_differs": bool_int(F.col("_reply_to")
                                     & (F.coalesce("sroot", F.lit("")) != "")
                                     & (F.coalesce("rroot", F.lit("")) != "")
                                     & (F.col("sroot") != F.col("rroot"))),
        **{n: F.col(f"_{n}") for n in ("spf_fail", "dkim_fail", "dmarc_fail", "auth_completely_absent")},
        "urgency_phrase_count": F.col("_n_urgency"),
        "subject_has_urgency": F.col("_subject_has_urgency"),
        "impersonation_score": F.when(s_legit, F.lit(0)).otherwise(F.col("_n_brand")),
        "unknown_domain_action_content": F.when(s_legit, 0).when(n_action == 0, 0)
        .when(n_action <= 2, 1).when(n_action <= 4, 2).otherwise(3),
        "has_dangerous_attachment": F.coalesce("has_dangerous_attachment", F.lit(0)),
        "suspicious_attachment_name": F.coalesce("suspicious_attachment_name", F.lit(0)),
        "has_form_in_html": F.col("_has_form_in_html"),
        "link_text_domain_mismatch": F.coalesce("link_text_domain_mismatch", F.lit(0)),
        "html_to_text_ratio": F.col("_html_to_text_ratio"),
    }
    trusted_c = F.coalesce(F.col("_t_host"), F.col("_t_root"), F.lit(False)) if zero_trusted \
        else F.lit(False)
    out = []
    for name in D.FEATURE_NAMES:
        c = f[name].cast("double")
        out.append(F.when(trusted_c, F.lit(0.0)).otherwise(c).alias(name))
    return m.select("msg_id", *keep, *out)


def msg_lookup_set(messages: DataFrame, message_urls: DataFrame, vt: DataFrame) -> DataFrame:
    """(msg_id, domain, is_legitimate): the verdicts a message can look up --
    its sender host and root, URL hosts and roots, reply-to host."""
    from lurescope.operators.domains import message_hosts
    mh = message_hosts(messages, message_urls)
    v = vt.select("domain", "root_domain", "is_legitimate")
    hv = lookup_join(mh, v.withColumnRenamed("domain", "host"), "host", "inner")
    hosts = hv.select("msg_id", F.col("host").alias("domain"), "is_legitimate")
    roots = hv.filter(F.col("role") != "reply_to").select(
        "msg_id", F.col("root_domain").alias("domain"))
    roots = roots.join(v.select("domain", "is_legitimate"), "domain", "inner") \
        .select("msg_id", "domain", "is_legitimate")
    return hosts.unionByName(roots).distinct()
