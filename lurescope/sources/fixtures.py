"""Mail-shaped views derived from the driver tables.

The driver tables hold no mail, so messages, their URLs and attachments,
the rank / threat / facts dimensions and a detection log are derived from
``documents``, ``events``, ``pages`` and ``labels``.  Each view exists twice:

* a Spark builder (DataFrame API: explode instead of joining to a VALUES
  table, a scalar subquery instead of a cross join, distributed ranking
  instead of a global ``row_number``), and
* the same view as SQL text, used as a CTE by the DuckDB oracle.

Both must give identical rows; ``tools/oracle_check.py`` checks that.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.operators.ranking import global_row_number
from lurescope.sources.tables import Tables

HOST_RE = r"^https?://([^/?#:]+)"
ROOT_RE = r"([^.]+[.]example[.][a-z]+)$"


class Fixtures:
    """Spark builders of the derived views for one scale-factor folder."""

    def __init__(self, spark, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)

    # -- scalar: number of pages, as a scalar subquery (no cross join) -----
    def _page_count(self):
        return self.t.pages.agg(F.count(F.lit(1))).scalar()

    @cached_property
    def hosts(self) -> DataFrame:
        host = F.lower(F.regexp_extract("url", HOST_RE, 1))
        return (self.t.pages.select("page_id", "url", "html", host.alias("host"))
                .withColumn("root_domain", F.regexp_extract("host", ROOT_RE, 1)))

    def _host_part(self, alias: str, cols: list) -> DataFrame:
        return self.hosts.select(F.col("page_id").alias(f"{alias}_pid"),
                                 *[F.col(c).alias(f"{alias}_{c}") for c in cols])

    @cached_property
    def messages(self) -> DataFrame:
        # Texts and html are wide: the joins that only add hosts, times and labels are
        # made between narrow rows, so that a text moves once and an html twice.
        n = self._page_count()
        d = self.t.documents.select("doc_id", "lang", "source", "text")
        ids = self.t.documents.select("doc_id").distinct().select(
            "doc_id",
            ((F.col("doc_id") * 7) % n).alias("s_pid"),
            ((F.col("doc_id") * 11 + 1) % n).alias("r_pid"),
            (F.col("doc_id") % n).alias("b_pid"))
        e = self.t.events.select(F.col("event_id").alias("doc_id"), "ts", "user_id")
        s = self._host_part("s", ["host"])
        r = self._host_part("r", ["host"])
        lab = self.t.labels.select("doc_id", F.col("toxic").alias("label"))
        heads = (ids.join(e, "doc_id").join(lab, "doc_id", "left")
                 .join(s, "s_pid").join(r, "r_pid")
                 .select("doc_id", "ts", "user_id", "s_host", "r_host", "label"))
        # the size of pages is guessed from files that hold repeats well; html is not broadcast
        bodies = ids.join(self._host_part("b", ["html"]).hint("merge"), "b_pid").select(
            "doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("b_html")).otherwise(F.lit("")).alias("html_text"))
        uid = F.col("user_id").cast("string")
        m = d.join(heads, "doc_id").join(bodies, "doc_id")
        return m.select(
            F.col("doc_id").alias("msg_id"),
            F.col("ts").alias("received_ts"),
            "lang",
            F.col("source").alias("from_name"),
            F.concat(F.lit("u"), uid, F.lit("@"), F.col("s_host")).alias("from_addr"),
            F.when(F.col("doc_id") % 3 == 0,
                   F.concat(F.lit("r"), uid, F.lit("@"), F.col("r_host")))
             .otherwise(F.lit("")).alias("reply_to"),
            F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("subject"),
            F.col("text").alias("plain_text"),
            "html_text",
            F.expr("CASE doc_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' "
                   "WHEN 2 THEN 'softfail' ELSE 'none' END").alias("spf_result"),
            F.expr("CASE doc_id % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' "
                   "ELSE 'none' END").alias("dkim_result"),
            F.expr("CASE doc_id % 7 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' "
                   "ELSE 'none' END").alias("dmarc_result"),
            "label")

    @cached_property
    def message_urls(self) -> DataFrame:
        n = self._page_count()
        k = (F.col("doc_id") % 4).cast("int")
        d = (self.t.documents.select("doc_id")
             .select("doc_id", F.explode(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), 1, k))
                     .alias("pos"))
             .withColumn("page_id", (F.col("doc_id") * 13 + F.col("pos") * 5) % n))
        h = self.hosts.select("page_id", "url", "host", "root_domain")
        return (d.join(h, "page_id")
                .select(F.col("doc_id").alias("msg_id"), F.col("pos").cast("int").alias("pos"),
                        "url", "host", "root_domain"))

    @cached_property
    def message_attachments(self) -> DataFrame:
        i = F.col("doc_id").cast("string")
        name = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Invoice_"), i, F.lit(".zip")))
                .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("notes_"), i, F.lit(".txt")))
                .otherwise(F.concat(F.lit("setup"), i, F.lit(".exe"))))
        return (self.t.documents.filter(F.col("doc_id") % 5 == 0)
                .select(F.col("doc_id").alias("msg_id"), name.alias("filename")))

    @cached_property
    def domain_rank(self) -> DataFrame:
        counts = (self.hosts.groupBy("root_domain").agg(F.count(F.lit(1)).alias("n"))
                  .filter((F.col("n") >= 4) & ~F.col("root_domain").like("%-%")))
        ranked = global_row_number(counts, [F.col("n").desc(), F.col("root_domain").asc()],
                                   name="rank")
        return ranked.select(F.col("root_domain").alias("domain"), "rank")

    @cached_property
    def threat_domain(self) -> DataFrame:
        return (self.hosts.filter(F.col("root_domain").like("%-%"))
                .select(F.col("root_domain").alias("domain")).distinct())

    @cached_property
    def domain_facts(self) -> DataFrame:
        roots = self.hosts.select(F.col("root_domain").alias("domain")).distinct()
        k = F.col("k")
        ranked = global_row_number(roots, [F.col("domain").asc()], name="k")
        return ranked.select(
            "domain",
            ((k * 37) % 900).alias("age_days"),
            ((k * 53) % 400).alias("cert_age_days"),
            F.when(k % 4 == 0, F.lit("NameCheap, Inc.")).otherwise(F.lit("Other Registrar"))
             .alias("registrar"),
            (k % 6 != 0).alias("has_mx"),
            (k % 11 == 0).alias("reputation_hit"))

    @cached_property
    def domain_facts_history(self) -> DataFrame:
        f = self.domain_facts
        v = F.explode(F.array(F.lit(0), F.lit(9), F.lit(18))).alias("d")
        x = f.select("*", v).filter((F.col("age_days") + F.col("d")) % 4 != 1)
        return x.select(
            "domain",
            (F.lit("2024-01-01 00:00:00").cast("timestamp")
             + F.make_dt_interval(F.col("d"))).alias("fetched_at"),
            F.when((F.col("d") == 9) & (F.col("age_days") % 5 == 0), F.lit(None).cast("bigint"))
             .otherwise(F.col("age_days") + F.col("d")).alias("age_days"),
            "registrar", "has_mx", "reputation_hit")

    @cached_property
    def crafted_urls(self) -> DataFrame:
        return self.spark.createDataFrame(CRAFTED_URLS, "msg_id bigint, pos int, url string, "
                                                        "host string, root_domain string")

    @cached_property
    def crafted_html(self) -> DataFrame:
        return self.spark.createDataFrame(CRAFTED_HTML, "msg_id bigint, html_text string")

    @cached_property
    def detections(self) -> DataFrame:
        return self.t.events.select(
            F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type"))
             .alias("email_hash"),
            F.col("ts").alias("processed_at"), "event_id",
            (F.col("value") / 500.0).alias("confidence"),
            (F.col("value") >= 175).alias("is_phishing"))


# Hand-made rows that exercise the URL rules the derived views never hit.
# They are only ever unioned with a derived view.
CRAFTED_URLS = [
    (-1, 0, "http://10.20.30.40/a/verify", "10.20.30.40", "30.40"),
    (-1, 1, "http://10.20.30.40.example.net/a", "10.20.30.40.example.net", "40.example.net"),
    (-1, 2, "http://999.1.1.1/a", "999.1.1.1", "1.1"),
    (-2, 0, "https://tionsh.example.org@zz.example.com/x", "zz.example.com", "zz.example.com"),
    (-2, 1, "https://a_b.zz.example.com/x|y?q=a@b", "a_b.zz.example.com", "zz.example.com"),
    (-3, 0, "https://ads-track.example.org/r?Next=http%3A%2F%2Fzz.example.com",
     "ads-track.example.org", "ads-track.example.org"),
    (-3, 1, "https://zz.example.com/r?context=1", "zz.example.com", "zz.example.com"),
    (-4, 0, "https://xn--tinsh-abc.example.org/x", "xn--tinsh-abc.example.org",
     "xn--tinsh-abc.example.org"),
]
CRAFTED_HTML = [
    (-1, '<form action="/p"><input type="hidden"></form>'),
    (-2, "<input name=\"k\" type='password'>"),
    (-3, '<input type="hidden">'),
    (-4, '<a class="k" href="http://zz.example.com/x"><b>Tionsh</b> portal</a>'),
    (-5, "<a href='https://tionsh.example.net/'>Tionsh</a>"),
    (-6, '<a href="http://zz.example.com/y">Ti<b>on</b>sh login</a>'),
]


# --------------------------------------------------------------------------
# The same views as SQL text (DuckDB oracle CTEs)
# --------------------------------------------------------------------------

VIEW_SQL = {
    "hosts": """
SELECT page_id, url, html,
       lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host,
       regexp_extract(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '([^.]+[.]example[.][a-z]+)$', 1) AS root_domain
FROM pages""",
    "messages": """
SELECT d.doc_id AS msg_id, e.ts AS received_ts, d.lang, d.source AS from_name,
       concat('u', CAST(e.user_id AS VARCHAR), '@', s.host) AS from_addr,
       CASE WHEN d.doc_id % 3 = 0 THEN concat('r', CAST(e.user_id AS VARCHAR), '@', r.host) ELSE '' END AS reply_to,
       split_part(d.text, chr(10), 1) AS subject,
       d.text AS plain_text,
       CASE WHEN d.doc_id % 2 = 0 THEN b.html ELSE '' END AS html_text,
       CASE d.doc_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'softfail' ELSE 'none' END AS spf_result,
       CASE d.doc_id % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' ELSE 'none' END AS dkim_result,
       CASE d.doc_id % 7 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' ELSE 'none' END AS dmarc_result,
       l.toxic AS label
FROM documents d
CROSS JOIN (SELECT count(*) AS n FROM pages) c
JOIN events e ON e.event_id = d.doc_id
JOIN hosts s ON s.page_id = (d.doc_id * 7) % c.n
JOIN hosts r ON r.page_id = (d.doc_id * 11 + 1) % c.n
JOIN hosts b ON b.page_id = d.doc_id % c.n
LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "message_urls": """
SELECT d.doc_id AS msg_id, j.pos, h.url, h.host, h.root_domain
FROM documents d
CROSS JOIN (SELECT count(*) AS n FROM pages) c
JOIN (VALUES (0), (1), (2)) AS j(pos) ON j.pos < d.doc_id % 4
JOIN hosts h ON h.page_id = (d.doc_id * 13 + j.pos * 5) % c.n""",
    "message_attachments": """
SELECT doc_id AS msg_id,
       CASE doc_id % 3 WHEN 0 THEN concat('Invoice_', CAST(doc_id AS VARCHAR), '.zip')
                       WHEN 1 THEN concat('notes_', CAST(doc_id AS VARCHAR), '.txt')
                       ELSE concat('setup', CAST(doc_id AS VARCHAR), '.exe') END AS filename
FROM documents WHERE doc_id % 5 = 0""",
    "domain_rank": """
SELECT root_domain AS domain, row_number() OVER (ORDER BY n DESC, root_domain) AS rank
FROM (SELECT root_domain, count(*) AS n FROM hosts GROUP BY root_domain) t
WHERE n >= 4 AND root_domain NOT LIKE '%-%'""",
    "threat_domain": """
SELECT DISTINCT root_domain AS domain FROM hosts WHERE root_domain LIKE '%-%'""",
    "domain_facts": """
SELECT domain, (k * 37) % 900 AS age_days, (k * 53) % 400 AS cert_age_days,
       CASE k % 4 WHEN 0 THEN 'NameCheap, Inc.' ELSE 'Other Registrar' END AS registrar,
       k % 6 <> 0 AS has_mx, k % 11 = 0 AS reputation_hit
FROM (SELECT root_domain AS domain, row_number() OVER (ORDER BY root_domain) AS k
      FROM (SELECT DISTINCT root_domain FROM hosts) t0) t""",
    "domain_facts_history": """
SELECT f.domain, TIMESTAMP '2024-01-01 00:00:00' + v.d * INTERVAL 1 DAY AS fetched_at,
       CASE WHEN v.d = 9 AND f.age_days % 5 = 0 THEN NULL ELSE f.age_days + v.d END AS age_days,
       f.registrar, f.has_mx, f.reputation_hit
FROM domain_facts f
JOIN (VALUES (0), (9), (18)) AS v(d) ON (f.age_days + v.d) % 4 <> 1""",
    "crafted_urls": """
SELECT * FROM (VALUES
  (-1, 0, 'http://10.20.30.40/a/verify', '10.20.30.40', '30.40'),
  (-1, 1, 'http://10.20.30.40.example.net/a', '10.20.30.40.example.net', '40.example.net'),
  (-1, 2, 'http://999.1.1.1/a', '999.1.1.1', '1.1'),
  (-2, 0, 'https://tionsh.example.org@zz.example.com/x', 'zz.example.com', 'zz.example.com'),
  (-2, 1, 'https://a_b.zz.example.com/x|y?q=a@b', 'a_b.zz.example.com', 'zz.example.com'),
  (-3, 0, 'https://ads-track.example.org/r?Next=http%3A%2F%2Fzz.example.com', 'ads-track.example.org', 'ads-track.example.org'),
  (-3, 1, 'https://zz.example.com/r?context=1', 'zz.example.com', 'zz.example.com'),
  (-4, 0, 'https://xn--tinsh-abc.example.org/x', 'xn--tinsh-abc.example.org', 'xn--tinsh-abc.example.org')
) AS v(msg_id, pos, url, host, root_domain)""",
    "crafted_html": """
SELECT * FROM (VALUES
  (-1, '<form action="/p"><input type="hidden"></form>'),
  (-2, '<input name="k" type=''password''>'),
  (-3, '<input type="hidden">'),
  (-4, '<a class="k" href="http://zz.example.com/x"><b>Tionsh</b> portal</a>'),
  (-5, '<a href=''https://tionsh.example.net/''>Tionsh</a>'),
  (-6, '<a href="http://zz.example.com/y">Ti<b>on</b>sh login</a>')
) AS v(msg_id, html_text)""",
    "detections": """
SELECT concat(CAST(user_id AS VARCHAR), ':', event_type) AS email_hash, ts AS processed_at, event_id,
       value / 500.0 AS confidence, value >= 175 AS is_phishing
FROM events""",
}

# Views each view depends on (so a CTE list can be closed over).
VIEW_DEPS = {
    "messages": ["hosts"],
    "message_urls": ["hosts"],
    "domain_rank": ["hosts"],
    "threat_domain": ["hosts"],
    "domain_facts": ["hosts"],
    "domain_facts_history": ["domain_facts"],
}


def dict_sql(name: str, column: str, values: list, with_pos: bool = False) -> str:
    """A dictionary as a VALUES relation (oracle side)."""
    def q(v):
        return "'" + str(v).replace("'", "''") + "'"
    if with_pos:
        rows = ", ".join(f"({q(v)}, {i})" for i, v in enumerate(values))
        return f"SELECT * FROM (VALUES {rows}) AS v({column}, pos)"
    rows = ", ".join(f"({q(v)})" for v in values)
    return f"SELECT * FROM (VALUES {rows}) AS v({column})"
