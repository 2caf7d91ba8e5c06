import os

import pytest

from lurescope import dictionaries as D
from lurescope.operators import datasets as DS


def _write(path, text):
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_rank_list_last_row_wins_and_bad_rows_dropped(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "rank.csv"),
               "1,Example.COM\nx,bad.example.org\n2,other.example.net\n7, example.com \nonlyonecolumn\n")
    got = {r.domain: r.rank for r in DS.load_rank_list(spark, p).collect()}
    assert got == {"example.com": 7, "other.example.net": 2}


def test_three_feed_formats_union(spark, tmpdir_path):
    a = _write(os.path.join(tmpdir_path, "a.txt"), "# comment\nhttps://x.bad.example.com/login\n\n")
    b = _write(os.path.join(tmpdir_path, "b.csv"),
               "# id,dateadded,url\n1,2024-01-01,http://y.worse.example.org/a\nhttp://z.example.net/\n")
    c = _write(os.path.join(tmpdir_path, "c.csv"), "id,url,verified\n9,https://x.bad.example.com/other,yes\n")
    fa = DS.read_feed_lines(spark, a).selectExpr("url", "'a' AS feed", "0 AS feed_order")
    fb = DS.read_feed_csv_url2(spark, b).selectExpr("url", "'b' AS feed", "1 AS feed_order")
    fc = DS.read_feed_csv_url1(spark, c).selectExpr("url", "'c' AS feed", "2 AS feed_order")
    u = DS.threat_feed_union(fa.unionByName(fb).unionByName(fc), ["com", "net", "org"])
    got = {r.domain: (r.sources, r.first_feed) for r in u.collect()}
    # with only com/net/org listed, the registrable domain is example.<tld>
    assert got == {"example.com": ("a,c", "a"), "example.org": ("b", "b"),
                   "example.net": ("b", "b")}


def test_labelled_csv_requires_columns_and_cleans(spark, tmpdir_path):
    good = _write(os.path.join(tmpdir_path, "good.csv"),
                  'text,label,source\n"a long enough text body",1,s1\n"short",0,s1\n,1,s2\n')
    df = DS.read_labelled_csv(spark, good)
    assert [(r.text, r.label) for r in df.collect()] == [("a long enough text body", 1)]
    bad = _write(os.path.join(tmpdir_path, "bad.csv"), "body,label\nx,1\n")
    with pytest.raises(ValueError):
        DS.read_labelled_csv(spark, bad)


def test_conform_schema_fills_and_orders(spark):
    df = spark.createDataFrame([(1, 2.0)], "msg_id long, url_count double")
    out = DS.conform_schema(df, ["msg_id"] + D.FEATURE_NAMES)
    assert out.columns == ["msg_id"] + D.FEATURE_NAMES
    row = out.head()
    assert row.url_count == 2.0 and row.spf_fail == 0.0
