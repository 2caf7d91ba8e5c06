import datetime as dt

from lurescope.operators.verdicts import asof_join, facts_as_of

FACTS = "domain string, fetched_at timestamp, age_days bigint"


def test_facts_as_of_ttl_boundary_and_latest(spark):
    t = dt.datetime
    facts = spark.createDataFrame([
        ("a.com", t(2024, 1, 13), 5),    # exactly 7 days old: outside the TTL
        ("b.com", t(2024, 1, 14), 6),    # inside
        ("b.com", t(2024, 1, 19), 7),    # newer: wins
        ("c.com", t(2024, 1, 21), 8),    # in the future of as_of: ignored
    ], FACTS)
    got = {r.domain: r.age_days for r in facts_as_of(facts, t(2024, 1, 20)).collect()}
    assert got == {"b.com": 7}


def test_asof_join_per_row_time(spark):
    t = dt.datetime
    facts = spark.createDataFrame([("x.com", t(2024, 1, 1), 1), ("x.com", t(2024, 1, 10), 2)], FACTS)
    left = spark.createDataFrame([(1, "x.com", t(2024, 1, 5)), (2, "x.com", t(2024, 1, 12)),
                                  (3, "x.com", t(2024, 1, 30)), (4, "y.com", t(2024, 1, 5))],
                                 "msg_id long, domain string, ts timestamp")
    got = {r.msg_id: r.age_days for r in asof_join(left, facts, "domain", "ts").collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: None}
