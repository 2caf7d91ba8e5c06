import math

from pyspark.sql import functions as F

from lurescope.functions import urls as U
from lurescope.operators import domains as DOM

SUFFIXES = ["com", "net", "org", "co.uk", "uk", "example.com"]


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).head()["r"]


def test_normalize_host_variants(spark):
    cases = {
        "HTTPS://Mail.Example.COM:8443/path?q=1": "mail.example.com",
        "  user@Sub.Example.org ": "sub.example.org",
        "example.net/login": "example.net",
        "https://good.example.org@evil.example.com/x": "evil.example.com",
        "https://a_b.example.com/x|y": "a_b.example.com",
        "": "",
    }
    for raw, host in cases.items():
        assert one(spark, U.normalize_host(F.col("v")), raw) == host, raw


def test_ip_url_rule_keeps_prefix_quirk(spark):
    assert one(spark, U.has_ip_host(F.col("v")), "http://10.20.30.40/a") is True
    assert one(spark, U.has_ip_host(F.col("v")), "http://10.20.30.40.example.net/a") is True
    assert one(spark, U.has_ip_host(F.col("v")), "http://999.1.1.1/a") is False
    assert one(spark, U.has_ip_host(F.col("v")), "http://01.2.3.4/a") is False
    assert one(spark, U.has_ip_host(F.col("v")), "https://example.com/1.2.3.4") is False


def test_query_param_names_need_a_value(spark):
    got = one(spark, U.query_param_names(F.col("v")), "https://x.com/r?Next=http%3A&empty=&bare&a=b=c#f")
    assert got == ["next", "a"]


def test_entropy_matches_definition(spark):
    for s in ["paypal", "aaaa", "x7kq9zpl", "a"]:
        freq = {c: s.count(c) for c in set(s)}
        want = -sum((n / len(s)) * math.log2(n / len(s)) for n in freq.values())
        assert abs(one(spark, U.shannon_entropy(F.col("v")), s) - want) < 1e-12
    assert one(spark, U.shannon_entropy(F.col("v")), "") == 0.0


def test_leet_normalize(spark):
    assert one(spark, U.leet_normalize(F.col("v")), "micr0s0ft-login") == "microsoft"
    assert one(spark, U.leet_normalize(F.col("v")), "p4yp4l_secure") == "paypal"


def test_extract_urls_order_trim_distinct(spark):
    text = ("see https://a.example.com/x, then (http://b.example.org/y). again https://a.example.com/x "
            'and <a href="https://c.example.net/z?q=1">c</a>')
    df = spark.createDataFrame([(1, text, "")], "msg_id long, plain_text string, html_text string")
    got = [(r.pos, r.url) for r in DOM.extract_urls(df).orderBy("pos").collect()]
    assert got == [(0, "https://a.example.com/x"), (1, "http://b.example.org/y"),
                   (2, "https://c.example.net/z?q=1")]


def test_decompose_two_label_suffix_and_fallbacks(spark):
    hosts = spark.createDataFrame([(h,) for h in [
        "mail.shop.co.uk", "a.b.c.example.com", "example.com", "x.unknowntld", "localhost"]], "host string")
    got = {r.host: (r.suffix, r.label, r.root_domain, r.subdomain_depth)
           for r in DOM.decompose_hosts(hosts, SUFFIXES).collect()}
    assert got["mail.shop.co.uk"] == ("co.uk", "shop", "shop.co.uk", 1)
    assert got["a.b.c.example.com"] == ("example.com", "c", "c.example.com", 2)
    assert got["example.com"] == ("example.com", "", "example.com", 0)
    assert got["x.unknowntld"] == ("", "unknowntld", "x.unknowntld", 1)
    assert got["localhost"] == ("", "localhost", "localhost", 0)


def test_brand_match_first_in_list_order_and_length_floor(spark):
    brands = ["paypal", "paypol", "ups", "chase"]
    labels = spark.createDataFrame([(x,) for x in ["paypol", "paypal", "upz", "ups", "chasse", "chxxe"]],
                                   "label string")
    got = {r.label: (r.brand, r.brand_distance) for r in DOM.brand_matches(labels, brands, 2).collect()}
    assert got["paypol"] == ("paypal", 1)      # first brand in order wins over the exact later one
    assert got["paypal"] == ("paypal", 0)
    assert "upz" not in got                    # primary part shorter than 4: exact match only
    assert got["ups"] == ("ups", 0)
    assert got["chasse"] == ("chase", 1)
    assert got["chxxe"] == ("chase", 2)
