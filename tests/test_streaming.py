import tempfile

import pytest
from pyspark.sql import functions as F

from lurescope.streaming import monitor as MON


def test_event_rates_stream_equals_batch(spark, tmpdir_path):
    ev = (spark.read.parquet("/root/testdata/sf0.001/events.parquet")
          .select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value"))
    src = tmpdir_path + "/src"
    ev.repartitionByRange(6, "ts").write.parquet(src)
    got = MON.event_rates(spark, src, "event_id bigint, ts timestamp, value double", tmpdir_path + "/out",
                          tmpdir_path + "/ckpt", "1 hour", None, "31 days", "ts", F.col("value") >= 175,
                          max_files=2)
    want = ev.groupBy(F.window("ts", "1 hour").start.alias("window_start")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("value") >= 175).alias("positives"))
    a = sorted((r.window_start, r.events, r.positives) for r in got.collect())
    b = sorted((r.window_start, r.events, r.positives) for r in want.collect())
    assert a == b


def test_dedup_keeps_late_rows_and_drops_copies(spark, tmpdir_path):
    """A row eight days late is kept; copies in the same and in later files go."""
    t = [(1, "a", "2024-01-20 00:00:00"), (2, "b", "2024-01-21 00:00:00"), (3, "a", "2024-01-21 01:00:00"),
         (4, "c", "2024-01-13 00:00:00"), (5, "b", "2024-01-22 00:00:00"), (6, "a", "2024-01-22 00:00:00")]
    schema = "n int, k string, ts timestamp"
    df = spark.createDataFrame(t, "n int, k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in ((1, 2), (3, 4), (5, 6)):
        df.filter(F.col("n").isin(*part)).coalesce(1).write.mode("append").parquet(tmpdir_path + "/src")
    got = MON.stream_dedup(spark, tmpdir_path + "/src", schema, "k", tmpdir_path + "/out",
                           tmpdir_path + "/ckpt", max_files=1)
    rows = [(r.k, r.n) for r in got.collect()]
    assert sorted(k for k, _ in rows) == ["a", "b", "c"]
    assert ("c", 4) in rows


def test_verdicts_follow_refreshed_facts(spark):
    """Facts fetched after an earlier batch change the next batch's verdict."""
    from lurescope import dictionaries as D
    from lurescope.operators.verdicts import domain_verdicts
    dom = spark.createDataFrame([("new.example.com",)], "domain string")
    none = spark.createDataFrame([], "domain string, rank bigint")
    facts = spark.createDataFrame([("new.example.com", "2024-02-01 00:00:00", 3, "x", True, False)],
                                  "domain string, fetched_at string, age_days bigint, registrar string, "
                                  "has_mx boolean, reputation_hit boolean") \
        .withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    flags = [domain_verdicts(dom, none, none.select("domain"), facts, at, D.TEST_DICTIONARIES)
             .first().is_newly_registered for at in ("2024-01-31 00:00:00", "2024-02-02 00:00:00")]
    assert flags == [False, True]


def _files(spark, path, first, last, copies=3):
    """One file per number: keys first..last, each in ``copies`` rows, and the file's own rows."""
    for f in range(first, last):
        (spark.range(copies * 10).select(
            F.concat(F.lit("k"), (F.col("id") % 10 + f * 5).cast("string")).alias("k"),
            F.lit(f).alias("file"), F.timestamp_seconds(F.lit(1_700_000_000) - F.col("id") * 86_400).alias("ts"))
         .coalesce(1).write.mode("append").parquet(path))


@pytest.mark.parametrize("horizon", ["0 seconds", "1 second", "1 hour"])
def test_state_and_log_agree_with_the_batch_twin(spark, tmpdir_path, horizon):
    """Copies within the horizon (the state's), beyond it (the log's: with 0 seconds every
    older copy), after a restart and, with a lost checkpoint, after a new start."""
    schema = "k string, file int, ts timestamp"
    src, out = tmpdir_path + "/src", tmpdir_path + "/out"

    def check(checkpoint):
        got = MON.stream_dedup(spark, src, schema, "k", out, tmpdir_path + checkpoint, max_files=1, horizon=horizon)
        want = spark.read.schema(schema).parquet(src).dropDuplicates(["k"])
        assert sorted(r.k for r in got.collect()) == sorted(r.k for r in want.collect())

    _files(spark, src, 0, 3)
    check("/a")
    _files(spark, src, 2, 5)   # copies of the files before, on both sides of the watermark
    check("/a")                # restart with its state
    check("/a")                # nothing new
    _files(spark, src, 4, 6)
    check("/b")                # no state: everything arrives again
    check("/b")


def test_state_covers_what_the_log_is_not_asked_for(spark, tmpdir_path, monkeypatch):
    """Within the horizon no part of the own run is read; beyond it all are."""
    from lurescope.operators.versioned import HashLog
    asked = []
    scan = HashLog._scan
    monkeypatch.setattr(HashLog, "_scan", lambda self, content, parts: asked.append(list(parts)) or scan(self, content, parts))
    for horizon, some in (("1 hour", False), ("0 seconds", True)):
        base = f"{tmpdir_path}/{some}"
        _files(spark, base + "/src", 0, 3)
        MON.stream_dedup(spark, base + "/src", "k string, file int, ts timestamp", "k", base + "/out", base + "/c",
                         max_files=1, horizon=horizon)
        lookups, asked[:] = asked[:-1], []  # the last scan is the result's
        assert any(lookups) == some
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_a_replayed_batch_rewrites_its_part(spark, tmpdir_path):
    """The sink ran but the batch was not committed: the restart runs it again."""
    import glob
    import os
    schema = "k string, file int, ts timestamp"
    args = (tmpdir_path + "/src", schema, "k", tmpdir_path + "/out", tmpdir_path + "/c")
    _files(spark, args[0], 0, 3)
    first = sorted(r.k for r in MON.stream_dedup(spark, *args, max_files=1).collect())
    for name in glob.glob(args[4] + "/commits/*2*") + glob.glob(args[4] + "/commits/.*2*"):
        os.remove(name)
    again = MON.stream_dedup(spark, *args, max_files=1).collect()
    assert sorted(r.k for r in again) == first == sorted({r.k for r in again})


def test_monitor_counts_and_drops_copies(spark):
    """The monitor over a source in which every message arrives twice."""
    from lurescope.plans import catalog as C
    sf = "/root/testdata/sf0.001"
    j = C.jobs(spark, sf)
    once = C._monitor_run(spark, sf)
    base = tempfile.mkdtemp(prefix="lurescope-test-", dir="/tmp")
    src = once.out.rsplit("/", 1)[0] + "/source"
    rows = spark.read.parquet(src)
    rows.unionByName(rows).coalesce(1).write.parquet(base + "/src")
    rows.coalesce(1).write.mode("append").parquet(base + "/src")
    mon = MON.Monitor(spark, base + "/out", once.dims, once.trusted, alert_address=once.alert_address,
                      scorer=once.scorer, dicts=once.dicts, as_of=once.as_of, urls=j.message_urls,
                      attachments=j.message_attachments, horizon="0 seconds")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    mon.start(base + "/src", base + "/c", max_files=1, schema=schema).awaitTermination()
    a, b = (sorted(tuple(r) for r in m.latest_log().select("msg_id", "is_phishing", "confidence").collect())
            for m in (once, mon))
    assert a == b
    counted = mon.metrics().agg(F.sum("arrived"), F.sum("scored"), F.sum("skipped"), F.sum("duplicates")).first()
    n = rows.count()
    scored = once.latest_log().count()
    # own alerts are not logged: each copy beyond the horizon is skipped again
    assert counted[0] == 3 * n == sum(counted[1:]) and counted[1] == scored and counted[2] >= n - scored


def test_stages_after_the_features_hold_no_text(spark):
    """A text meets the features for the scorer only; neither stage writes it again."""
    from lurescope.plans import catalog as C
    mon = C._monitor_run(spark, "/root/testdata/sf0.001")
    for stage in ("features", "scored"):
        columns = spark.read.parquet(f"{mon.out}/stage/{stage}/batch_id=0").columns
        assert "subject" in columns and not {"plain_text", "html_text"} & set(columns)


def test_texts_of_a_finished_batch_are_not_kept(spark):
    """Raw mail: a text is staged in one table of its batch, which goes with the batch; log and
    counters are those of the message stream."""
    import os
    from lurescope.plans import catalog as C
    sf = "/root/testdata/sf0.001"
    rows, raw = C._monitor_run(spark, sf), C._monitor_run(spark, sf, raw_mode=True)
    for mon in (rows, raw):
        stage = f"{mon.out.removeprefix('file:')}/stage"
        held = {c for d, _, names in os.walk(stage) if any(n.endswith(".parquet") for n in names)
                for c in spark.read.parquet("file:" + d).columns}
        assert "email_hash" in held and not {"raw", "plain_text", "html_text", "combined"} & held
    a, b = (sorted(tuple(r) for r in m.latest_log().select("msg_id", "is_phishing", "confidence").collect()) for m in (rows, raw))
    assert a == b
    a, b = (m.metrics().agg(F.sum("arrived"), F.sum("scored"), F.sum("rejected"), F.count("*")).first() for m in (rows, raw))
    assert a == b


def test_write_releases_its_shuffle_files(spark, tmpdir_path):
    from lurescope import session as S
    seen = []
    spark.conf.set(S.SHUFFLE_CLEANUP, "false")
    try:
        with S.releasing_shuffles(spark):
            seen.append(spark.conf.get(S.SHUFFLE_CLEANUP))
        seen.append(spark.conf.get(S.SHUFFLE_CLEANUP))
    finally:
        spark.conf.unset(S.SHUFFLE_CLEANUP)
    assert seen == ["true", "false"]
    table = S.materialize(spark.range(1000).repartition(5, "id"), "shuffled")
    assert table.count() == 1000


def test_raw_source_is_laid_out_by_arrival_without_shuffling_mail(spark, tmpdir_path, monkeypatch):
    """Files follow each other in time, hold about as many messages each, and all of them; null
    times come first.  Only times and ids are dealt by range."""
    import glob
    import os

    dealt = []
    kind = next(k for k in type(spark.range(1)).__mro__ if "repartitionByRange" in vars(k))
    deal = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, *a: dealt.append(self.columns) or deal(self, *a))
    raw = spark.range(0, 1200, 1, 5).select(
        F.col("id").alias("msg_id"), F.when(F.col("id") % 100 != 7, F.timestamp_seconds(F.col("id") * 7919 % 1200)).alias("received_ts"),
        F.concat(F.lit("Subject: é "), "id", F.lit("\n\n")).alias("raw"))
    MON.write_raw_source(raw, tmpdir_path + "/src")
    files = sorted(glob.glob(tmpdir_path + "/src/part-*"))
    parts = [spark.read.parquet(f).collect() for f in files]
    assert len(files) == 12 and os.listdir(tmpdir_path) == ["src"] and not any("raw" in c for c in dealt)
    assert all(50 < len(p) < 200 for p in parts) and sum(map(len, parts)) == 1200
    assert {(r.msg_id, bytes(r.raw).decode()) for p in parts for r in p} == {(i, f"Subject: é {i}\n\n") for i in range(1200)}
    key = lambda r: (r.received_ts is not None, r.received_ts and r.received_ts.timestamp(), r.msg_id)
    spans = [(min(map(key, p)), max(map(key, p))) for p in parts]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
