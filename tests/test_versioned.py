import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from lurescope.operators import datasets as DS
from lurescope.operators.detections import DetectionLog, latest_versions
from lurescope.operators.versioned import HashLog, SnapshotTable, Taken

SCHEMA = "email_hash string, processed_at timestamp, event_id bigint, confidence double, is_phishing boolean"


def events(spark, first, last, keys=50):
    return spark.range(first, last).select(
        F.concat(F.lit("h"), (F.col("id") % keys).cast("string")).alias("email_hash"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 97).alias("processed_at"),
        F.col("id").alias("event_id"), (F.col("id") / 1000).alias("confidence"), (F.col("id") % 3 == 0).alias("is_phishing"))


def rows(df):
    return sorted(tuple(r) for r in df.select(*[c.split(" ")[0] for c in SCHEMA.split(", ")]).collect())


def filled(spark, path, parts=3):
    log = DetectionLog(spark, path, buckets=8)
    for p in range(parts):
        log.append(events(spark, p * 200, p * 200 + 300))
    return log, events(spark, 0, 300).unionByName(events(spark, 200, 500)).unionByName(events(spark, 400, 700))


# ------------------------------------------------------------------ the bucketed log

def test_latest_and_versions(spark, tmpdir_path):
    log, all_rows = filled(spark, tmpdir_path + "/log")
    assert rows(log.versions()) == rows(all_rows)
    assert rows(log.latest()) == rows(latest_versions(all_rows))
    again = DetectionLog(spark, tmpdir_path + "/log")  # buckets come from the log itself
    assert again.buckets == 8 and rows(again.latest()) == rows(log.latest())


def test_point_lookup_reads_one_bucket(spark, tmpdir_path):
    log, all_rows = filled(spark, tmpdir_path + "/log")
    for compacted in (False, True):
        for key in ("h0", "h17", "missing"):
            got = log.lookup(key)
            assert rows(got) == rows(latest_versions(all_rows).filter(F.col("email_hash") == key))
            plan = got._jdf.queryExecution().executedPlan().toString()
            filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)
            assert re.search(r"bucket#\d+ = \d", filters[1]) and "EqualTo(email_hash" in filters[2], plan
        log.compact()
    bucket = log.scan().filter(F.col("email_hash") == "h17").select("bucket").distinct().collect()
    read = log.scan().filter(F.col("bucket") == bucket[0][0]).select(F.input_file_name()).distinct().count()
    assert len(bucket) == 1 and read == 1 < len(log.scan().inputFiles())


def test_files_have_bloom_filters_on_the_hash(spark, tmpdir_path):
    """A lookup of a hash that a file lacks reads no row group, though its bounds hold it."""
    log = DetectionLog(spark, tmpdir_path + "/log", buckets=2)
    log.append(events(spark, 0, 60_000, keys=60_000).withColumn("email_hash", F.sha2("email_hash", 256)))
    files = [f.replace("file://", "") for f in log.scan().inputFiles()]
    plain = tmpdir_path + "/plain"
    log.versions().coalesce(1).write.parquet(plain)
    size = sum(os.path.getsize(os.path.join(plain, f)) for f in os.listdir(plain))
    assert sum(map(os.path.getsize, files)) > size + len(files) * 1_000_000  # 1 MiB a filter
    hashes = [r[0] for r in log.versions().select("email_hash").orderBy("email_hash").limit(3).collect()]
    assert log.lookup(hashes[1]).count() == 1 and log.lookup(hashes[1][:-1] + "x").count() == 0


def test_compaction_keeps_the_latest_state(spark, tmpdir_path):
    log, all_rows = filled(spark, tmpdir_path + "/log")
    before, old_reader, number = rows(log.latest()), log.latest(), log.manifests.read()[0]
    log.compact()
    assert rows(log.latest()) == before and len(rows(log.versions())) == len(before)
    assert rows(old_reader) == before and rows(log.versions(number)) == rows(all_rows)
    log.append(events(spark, 650, 720))
    assert rows(log.latest()) == rows(latest_versions(all_rows.unionByName(events(spark, 650, 720))))
    log.compact()
    assert log.compact() == log.manifests.read()[0]  # nothing to fold


def test_killed_compaction_leaves_the_old_state(spark, tmpdir_path, monkeypatch):
    log, _ = filled(spark, tmpdir_path + "/log")
    before, versions = rows(log.latest()), rows(log.versions())
    with monkeypatch.context() as m:
        m.setattr(log.manifests, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            log.compact()
    assert rows(log.latest()) == before and rows(log.versions()) == versions
    dead = log.vacuum(min_age=dt.timedelta(0))
    assert len(dead) == 1 and dead[0].startswith("part=snapshot-") and rows(log.latest()) == before


def test_append_during_compaction_is_kept(spark, tmpdir_path, monkeypatch):
    log, all_rows = filled(spark, tmpdir_path + "/log")
    other, write = DetectionLog(spark, tmpdir_path + "/log"), HashLog._write
    late = events(spark, 700, 760)

    def slow(self, df, part):
        write(self, df, part)
        if self is log:
            other.append(late)
    monkeypatch.setattr(HashLog, "_write", slow)
    log.compact()
    assert rows(log.latest()) == rows(latest_versions(all_rows.unionByName(late)))
    assert len(log.manifests.read()[1]["parts"]) == 1


def test_repeated_append_replaces_its_part(spark, tmpdir_path):
    log = DetectionLog(spark, tmpdir_path + "/log")
    for _ in range(2):
        log.append(events(spark, 0, 40), part="batch-0")
    assert rows(log.versions()) == rows(events(spark, 0, 40))


def test_unseen_reads_the_batchs_buckets(spark, tmpdir_path):
    log, all_rows = filled(spark, tmpdir_path + "/log")
    batch = events(spark, 0, 3, keys=1).unionByName(events(spark, 70, 71, keys=80))
    got = log.unseen(batch)
    assert [r.email_hash for r in got.collect()] == ["h70"]
    assert "bucket" in got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert rows(HashLog(spark, tmpdir_path + "/none").unseen(batch)) == rows(batch)


def test_null_keys_and_an_empty_log(spark, tmpdir_path):
    log = DetectionLog(spark, tmpdir_path + "/log")
    assert log.latest() is None and log.lookup("x") is None and log.compact() is None
    log.append(spark.createDataFrame([(None, dt.datetime(2024, 1, 1), 1, 0.5, True)], SCHEMA))
    log.append(spark.createDataFrame([], SCHEMA))
    assert len(rows(log.latest())) == 1
    log.compact()
    assert len(rows(log.latest())) == 1


# ------------------------------------------------------------------ snapshots

def test_a_reader_opened_before_a_refresh_finishes(spark, tmpdir_path):
    feed = SnapshotTable(spark, tmpdir_path + "/feed")
    assert feed.read() is None and feed.loaded_at() is None
    feed.publish(spark.range(5))
    old = feed.read()
    feed.publish(feed.read().unionByName(spark.range(5, 9)))  # the builder reads the old version
    assert feed.read().count() == 9 and old.count() == 5
    feed.publish(spark.range(2))
    assert old.count() == 5 and feed.versions() == [0, 1, 2] and feed.read(1).count() == 9


def test_refresh_by_age_and_on_demand(spark, tmpdir_path):
    path, at = tmpdir_path + "/feed", dt.datetime(2024, 1, 1)
    build = lambda n: lambda: spark.range(n)

    def refresh(n, hours, **how):
        return DS.feed_refresh(spark, path, build(n), 6, now=at + dt.timedelta(hours=hours), **how).count()
    assert [refresh(3, 0), refresh(4, 5), refresh(5, 7), refresh(6, 8), refresh(7, 8, force=True),
            refresh(8, 8, force=True)] == [3, 3, 5, 5, 7, 8]
    grown = DS.feed_refresh(spark, path, lambda: SnapshotTable(spark, path).read().unionByName(
        spark.range(1).withColumn("loaded_at", F.current_timestamp())), force=True)
    assert grown.count() == 9 and grown.select("loaded_at").distinct().count() == 1


def test_failed_refresh_leaves_the_old_version(spark, tmpdir_path):
    feed = SnapshotTable(spark, tmpdir_path + "/feed")
    feed.publish(spark.range(5))
    with pytest.raises(Exception):
        feed.publish(spark.range(5).select(F.raise_error(F.lit("no")).alias("id")))
    assert feed.versions() == [0] and feed.read().count() == 5


def test_two_writers_of_one_version(spark, tmpdir_path):
    feed = SnapshotTable(spark, tmpdir_path + "/feed")
    feed.publish(spark.range(5))
    with pytest.raises(Taken):
        feed.manifests.commit({}, None)
    assert feed.read().count() == 5


def test_vacuum_keeps_what_versions_name(spark, tmpdir_path):
    feed = SnapshotTable(spark, tmpdir_path + "/feed")
    for n in range(4):
        feed.publish(spark.range(n + 1))
    assert feed.vacuum(keep=2) == []  # folders of other versions are young
    assert len(feed.vacuum(keep=2, min_age=dt.timedelta(0))) == 2
    assert feed.versions() == [2, 3] and feed.read(2).count() == 3 and feed.read().count() == 4


# ------------------------------------------------------------------ stores

def test_feature_store_writes_a_key_once(spark, tmpdir_path):
    store = DS.FeatureStore(spark, tmpdir_path + "/store")
    schema = "email_hash string, x int"
    store.add(spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], schema))
    store.add(spark.createDataFrame([("b", 4), ("c", 6), ("c", 5), ("c", 5)], schema))
    assert sorted(tuple(r) for r in store.read().collect()) == [("a", 1), ("b", 3), ("c", 5)]


def test_append_labelled_counts_a_key_once(spark):
    schema = "email_hash string, label int"
    new = spark.createDataFrame([("a", 1), ("n", 1), ("n", 1)], schema)
    fresh, report = DS.append_labelled(new, spark.createDataFrame([("a", 1), ("b", 0)], schema))
    assert [tuple(r) for r in fresh.collect()] == [("n", 1)]
    assert tuple(report.first()) == (2, 1, 3)


def test_a_row_is_held_once_while_its_key_is_made_single(spark):
    """The smallest row of a key is its own order: no second copy is sorted and shuffled."""
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "y"), ("a", 1, "x"), (None, 5, "z")], "k string, n int, t string")
    one = DS.one_per_key(df, "k")
    assert sorted(map(tuple, one.collect()), key=str) == [("a", 1, "x"), (None, 5, "z")]
    assert "min_by" not in one._jdf.queryExecution().optimizedPlan().toString()
    assert DS.one_per_key(df, "k", ["t"]).filter("k = 'a'").head().t is None
