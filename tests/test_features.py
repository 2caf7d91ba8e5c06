import dataclasses

import pytest

from lurescope import dictionaries as D
from lurescope.operators.domains import collect_domains
from lurescope.operators.features import features_all
from lurescope.operators.verdicts import domain_verdicts

DICTS = dataclasses.replace(D.PRODUCTION_DICTIONARIES,
                            public_suffixes=["com", "net", "org", "co.uk", "example.com"])
MSG_SCHEMA = ("msg_id long, from_name string, from_addr string, reply_to string, subject string, "
              "plain_text string, html_text string, spf_result string, dkim_result string, dmarc_result string")


@pytest.fixture(scope="module")
def feats(spark):
    msgs = [
        (1, "Ops Team", "ops@mailer.example.com", "", "weekly numbers",
         "numbers at https://reports.example.com/q3 and http://192.168.10.20/export", "", "pass", "pass", "pass"),
        (2, "PayPal Service", "notice@paypal-secure.example.com", "back@collector.example.net",
         "Your account will be suspended", "verify your identity within 24 hours", "", "fail", "fail", "fail"),
        (3, "", "x@micr0soft.example.com", "", "hello", "see https://bit.ly/abc?next=http%3A%2F%2Fz.example.com",
         "", "none", "none", "none"),
        (4, "Billing", "billing@vendor.example.com", "", "statement", "attached", "", "pass", "none", "none"),
        (5, "Friendly", "news@trusted.example.com", "", "urgent invoice", "https://trusted.example.com/a",
         "<form><input type=password></form>", "fail", "fail", "fail"),
        (6, "", "someone@quiet.example.org", "", "lunch?", "no links here at all", "", "pass", "pass", "pass"),
    ]
    m = spark.createDataFrame(msgs, MSG_SCHEMA)
    urls = spark.createDataFrame([(1, 0, "https://reports.example.com/q3"), (1, 1, "http://192.168.10.20/export"),
                                  (3, 0, "https://bit.ly/abc?next=http%3A%2F%2Fz.example.com"),
                                  (5, 0, "https://trusted.example.com/a")], "msg_id long, pos int, url string")
    atts = spark.createDataFrame([(4, "Invoice_2024.zip")], "msg_id long, filename string")
    rank = spark.createDataFrame([("trusted.example.com", 5), ("reports.example.com", 40)], "domain string, rank int")
    threat = spark.createDataFrame([("collector.example.net",)], "domain string")
    v = domain_verdicts(collect_domains(m, urls, DICTS.public_suffixes), rank, threat, None, "2024-01-20", DICTS)
    f = features_all(m, urls, atts, v, ["trusted.example.com"], None, DICTS)
    return {r.msg_id: r.asDict() for r in f.collect()}


def test_two_urls_one_ip(feats):
    f = feats[1]
    assert f["url_count"] == 2 and f["has_ip_based_url"] == 1 and f["has_http_only"] == 1
    assert f["min_url_tranco_rank"] == 40 and f["any_url_domain_not_in_tranco"] == 0


def test_compound_brand_and_reply_to(feats):
    f = feats[2]
    assert f["compound_brand_domain"] == 1 and f["reply_to_differs"] == 1
    assert f["spf_fail"] == 1 and f["dkim_fail"] == 1 and f["dmarc_fail"] == 1
    assert f["urgency_phrase_count"] >= 2 and f["subject_has_urgency"] == 1
    assert f["sender_display_mismatch"] == 1 and f["impersonation_score"] >= 1


def test_leet_domain_and_shortener(feats):
    f = feats[3]
    assert f["homograph_attack"] == 1 and f["has_url_shortener"] == 1
    assert f["redirect_depth"] == 3 and f["auth_completely_absent"] == 1


def test_lure_attachment(feats):
    f = feats[4]
    assert f["has_dangerous_attachment"] == 1 and f["suspicious_attachment_name"] == 1


def test_trusted_sender_zeroes_everything(feats):
    assert all(v == 0 for k, v in feats[5].items() if k != "msg_id")


def test_zero_link_message(feats):
    f = feats[6]
    assert f["url_count"] == 0 and f["any_url_domain_not_in_tranco"] == 0
    assert f["min_url_tranco_rank"] == D.MIN_URL_RANK_DEFAULT


def test_verdict_confidence_bounds(spark, feats):
    from lurescope.plans.catalog import jobs
    v = jobs(spark, "/root/testdata/sf0.001").verdicts()
    row = v.agg({"confidence": "min"}).head()[0], v.agg({"confidence": "max"}).head()[0]
    assert 0.02 <= row[0] <= row[1] <= 0.99


def test_no_text_is_joined(spark, tmp_path):
    """The tests on texts are made in the scan: no join meets a text or an HTML part."""
    spark.createDataFrame([(1, "", "a@x.example.com", "", "s", "plain", "<p>", "none", "none", "none")], MSG_SCHEMA) \
        .write.parquet(f"{tmp_path}/m")
    m = spark.read.parquet(f"{tmp_path}/m")
    urls = spark.createDataFrame([(1, 0, "https://x.example.com/a")], "msg_id long, pos int, url string")
    atts = spark.createDataFrame([(1, "a.zip")], "msg_id long, filename string")
    v = spark.createDataFrame([("x.example.com", 5)], "domain string, rank int")
    v = domain_verdicts(collect_domains(m, urls, DICTS.public_suffixes), v, v.select("domain"), None,
                        "2024-01-20", DICTS)
    f = features_all(m, urls, atts, v, [], None, DICTS, keep=("subject",))
    joined, todo = set(), [f._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        below = [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Join":
            joined |= {c.output().apply(k).name() for c in below for k in range(c.output().size())}
        todo += below
    assert {"msg_id", "_n_action"} <= joined
    assert not joined & {"plain_text", "html_text", "_said"}
