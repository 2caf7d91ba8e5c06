import dataclasses

from lurescope import dictionaries as D
from lurescope.operators.domains import collect_domains
from lurescope.operators.features import features_all
from lurescope.operators.verdicts import domain_verdicts

DICTS = dataclasses.replace(D.PRODUCTION_DICTIONARIES, public_suffixes=["com", "net", "org", "example.com"])
MSG = ("msg_id long, from_name string, from_addr string, reply_to string, subject string, "
       "plain_text string, html_text string, spf_result string, dkim_result string, dmarc_result string")


def _f07(spark, urls):
    m = spark.createDataFrame([(1, "", "a@quiet.example.org", "", "s", "t", "", "pass", "pass", "pass")], MSG)
    u = spark.createDataFrame([(1, i, x) for i, x in enumerate(urls)], "msg_id long, pos int, url string")
    a = spark.createDataFrame([], "msg_id long, filename string")
    rank = spark.createDataFrame([("known.example.com", 3)], "domain string, rank int")
    threat = spark.createDataFrame([], "domain string")
    v = domain_verdicts(collect_domains(m, u, DICTS.public_suffixes), rank, threat, None, "2024-01-20", DICTS)
    f = features_all(m, u, a, v, [], None, DICTS, stage=False).head()
    return f.any_url_domain_not_in_tranco


def test_adding_a_ranked_url_never_raises_f07(spark):
    before = _f07(spark, ["https://odd.example.net/x"])
    after = _f07(spark, ["https://odd.example.net/x", "https://known.example.com/y"])
    assert before == 1 and after == 0


def test_verdict_independent_of_input_order_and_duplicates(spark):
    rank = spark.createDataFrame([("known.example.com", 3)], "domain string, rank int")
    threat = spark.createDataFrame([("bad-x.example.com",)], "domain string")
    doms = ["known.example.com", "bad-x.example.com", "p4ypal.example.com", "a.b.c.d.known.example.com"]
    one = spark.createDataFrame([(d,) for d in doms], "domain string")
    two = spark.createDataFrame([(d,) for d in reversed(doms + doms)], "domain string")
    cols = ["domain", "confidence", "lookup_tier", "brand_similarity"]
    a = sorted(tuple(r) for r in domain_verdicts(one, rank, threat, None, "2024-01-20", DICTS).select(*cols).collect())
    b = sorted(tuple(r) for r in domain_verdicts(two, rank, threat, None, "2024-01-20", DICTS).select(*cols).collect())
    assert a == b and len(a) == 4
